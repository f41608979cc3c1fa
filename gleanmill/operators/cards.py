"""The acceptance gate of review cards: one reason a card, references checked by joins, and a coverage quota a material.

A card falls at the first rule it breaks: no usable answer, no reference, a reference to evidence that its material does
not have, a knowledge unit that is not there or shares no evidence with the card, an answer that is noise or not held by
what it cites, a question or a hint that cannot stand alone, a question that an earlier card of the material asks. The
cards that are left are published if they cover enough of the material's knowledge units.

References are exploded and joined on (material, id), and folded back to one row a card; nothing is gathered by
material, so a material with a third of all cards is no larger a task than others. What is gathered is a card's own
citations. Null and empty texts and lists count as missing; blank and repeated references count once at most. Repeated
evidence and unit rows of one id count once (the least snippet, all evidence of a unit). Rows of equal material and
number are one card to the references and cards of their own to the rules; of equal questions the least number, then the
least answer, stays. Long texts are read whole, but for the cuts that the rules state. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import curation as C

# Patterns that results depend on.
TIMECODE = r"\d{1,2}:\d{2}(?::\d{2})?(?:[,.]\d{1,3})?"
TIME_RANGE = rf"^\s*[\[(]?{TIMECODE}(?:\s*(?:-->|[-至~～—–])\s*{TIMECODE})?[\])]?\s*[-，。；：:\s]*"
ARTEFACT = rf"(?i)父段摘要[：:]|OCR\s*出现时间|视频画面(?:聚合)?|{TIMECODE}\s*(?:-->|[-至~～—–])\s*{TIMECODE}|多一句没有[，,、 ]*少一句不行|高级软件人才培训专家"
DROPPED_LINE = r"(?i)^\s*(?:OCR\s*出现时间|视频画面(?:聚合)?|多一句没有[，,、 ]*少一句不行|高级软件人才培训专家)"
PARENT_MARK = r"^\s*父段摘要[：:]\s*"
CREDIT = r"(?i)^字幕由.{1,40}?(?:提供|制作)$"
WATERMARKS = ("字幕提供", "中文字幕", "文字幕", "字幕由")
CUE = (
    r"^(?:(?:嗯|啊|哦|好|对|那么|然后|其实|首先|第一点|也就是说|大家可以看到|那这样的方式呢|我们先看一下|"
    r"欢迎大家(?:点赞|关注|收藏|转发|投币|一键三连)+|(?:感谢|谢谢)大家(?:的)?(?:收看|观看|支持)|"
    r"(?:请|记得)?(?:点赞|关注|收藏|转发|投币|一键三连)+|(?:我们)?(?:下期|下次)(?:视频)?再见)(?:了|呢|啊|吧|嘛)?)+$"
)
MARKS = r"[\s，。；：:,.!?！？、]+"
NOISE_ENDS = r"^[ \-，。；：:,.!?！？]+|[ \-，。；：:,.!?！？]+$"
PHRASE_AGAIN = r"(.{2,14})(?:\s+\1){2,}"
CONNECTORS = (
    r"此外|另外|同时|而且|并且|但是|然而|因此|所以|从而|这意味着|这说明|"
    r"(?:它|其|该(?:机制|系统|方法|算法|功能|组件|方案))"
    r"(?:使用|采用|通过|依赖|负责|保证|支持|实现|解决|导致|需要|可以|能够|会|将|必须|应当)|"
    r"并(?:使用|采用|通过|依赖|负责|保证|支持|实现|解决|导致|需要|可以|能够|会|将)"
)
LIST_MARK = r"^(?:[-*+]>|\d+[.)])\s+"
TEACHING_START = r"^(?:就|还|接下来|下面|首先)?(?:必须|需要|要)?(?:先)?(?:搞定|来看|看看|讲解|学习)"
INTERVIEW = r"(?:如果)?面试官(?:要求|问|问到|提到).{0,80}(?:如何回答|怎么回答|你会怎么说)"
VAGUE = (
    r"(?:什么意思|这些是什么|那是什么|到底什么意思|本节(?:的)?(?:核心内容|关键知识点|主要内容)|"
    r"本段(?:的)?(?:核心内容|关键知识点|主要内容)|这段(?:主要)?讲了什么|需要掌握什么)"
)
ASKED_ON = r"[？?].+(?:分别)?(?:如何|怎么|怎样|使用|实现|起什么作用)"
HINT_ENDS = r"^[。！？!? ]+|[。！？!? ]+$"
GENERIC_HINT = r"^(?:先)?回忆(?:一下)?(?:本节|本段|这段|资料|视频)?(?:的)?(?:内容|核心内容|关键知识点|主要内容)$"
#: Characters of an answer, of a question or hint; share of a material's units that published cards cover (relaxed: the second).
ANSWER_MOST, SHORT_MOST = 1200, 180
QUOTA = {False: 0.6, True: 0.4}


def artefact(text: Column) -> Column:
    """Marks of retrieval and of recognised frames that belong in no card."""
    return T.collapsed(text).rlike(ARTEFACT)


def answer_text(raw: Column) -> Column:
    """The answer with its lines and lists; null if it is empty or holds artefacts."""
    lines = F.transform(F.split(F.regexp_replace(raw, "\r\n?", "\n"), "\n"), lambda x: F.regexp_replace(x, r"\s+$", ""))
    text = F.array_join(F.filter(lines, lambda x: ~x.rlike(DROPPED_LINE)), "\n")
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, PARENT_MARK, ""), "\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    cut = lambda t: F.when(F.length(t) > ANSWER_MOST, F.concat(F.regexp_replace(F.substring(t, 1, ANSWER_MOST), r"\s+$", ""), F.lit("..."))).otherwise(t)
    return C._let(text, lambda t: F.when((F.length(t) > 0) & ~artefact(t), cut(t)))


def noise(text: Column) -> Column:
    """Nothing that holds a fact: empty but for a time code, a watermark, a spoken cue, or one phrase over and over."""
    times = lambda tight, m: (F.length(tight) - F.length(F.replace(tight, F.lit(m), F.lit("")))) / len(m)
    watermark = lambda tight: tight.rlike(CREDIT) | (F.aggregate(F.array(*[times(tight, m) for m in WATERMARKS]), F.lit(0.0), lambda a, x: a + x) >= 2)
    fact = lambda bare: (bare == "") | C._let(F.regexp_replace(bare, r"\s+", ""), watermark) | F.regexp_replace(bare, MARKS, "").rlike(CUE) | bare.rlike(PHRASE_AGAIN) | C.repeated_ngram(bare)
    return C._let(F.regexp_replace(F.trim(F.regexp_replace(T.collapsed(F.coalesce(text, F.lit(""))), TIME_RANGE, "")), NOISE_ENDS, ""), fact)


def answer_claims(answer: Column) -> Column:
    """Normalised claims: parts between strong marks and before connecting words, without headings, list marks and connectors."""
    sentences = F.filter(F.split(F.coalesce(answer, F.lit("")), C.CLAIM_ENDS), lambda x: ~F.ltrim(x).startswith("#"))
    parts = F.flatten(F.transform(sentences, lambda x: F.split(x, rf"[，,]\s*(?=(?:{CONNECTORS}))")))
    bare = lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), LIST_MARK, ""), rf"^(?:{CONNECTORS})[，,:：\s]*", "")
    return F.filter(F.transform(parts, lambda x: T.dedupe_key(bare(x))), lambda x: F.length(x) > 0)


def held(answer: Column, source_key: Column, relaxed: bool = False) -> Column:
    """Whether the source (normalised) has the answer, or holds each of its claims."""
    key = T.dedupe_key(answer)
    each = C._let(answer_claims(answer), lambda claims: (F.size(claims) > 0) & F.forall(claims, lambda c: C.grounded(c, source_key, relaxed)))
    return (F.length(key) > 0) & (F.length(source_key) > 0) & ~artefact(answer) & (F.contains(source_key, key) | each)


def question_stands(question: Column) -> Column:
    """A question that can be asked alone: one intent, a topic, no pointing, no task, no talk about the material."""

    def stands(q: Column) -> Column:
        several = (F.regexp_count(q, F.lit("[？?]")) > 1) | q.rlike(ASKED_ON) | q.rlike(C.ANSWER_IN_QUESTION)
        meta = q.rlike(TEACHING_START) | q.rlike(C.POINTING_START) | q.rlike(C.TASK_START) | q.rlike(INTERVIEW) | q.rlike(VAGUE)
        return F.length(T.dedupe_key(q)).between(8, 180) & ~several & ~artefact(q) & ~meta & (q.rlike(C.QUESTION_FORM) | q.rlike(C.RECALL_FORM)) & ~noise(q)

    return C._let(T.collapsed(F.coalesce(question, F.lit(""))), stands)


def hint_stands(hint: Column) -> Column:
    stands = lambda h: F.length(T.dedupe_key(h)).between(6, 180) & ~artefact(h) & ~F.regexp_replace(h, HINT_ENDS, "").rlike(GENERIC_HINT) & ~noise(h)
    return C._let(T.collapsed(F.coalesce(hint, F.lit(""))), stands)


def _ids(ids: Column) -> Column:
    """Distinct references that are not blank."""
    return F.array_distinct(F.filter(F.coalesce(ids, F.array().cast("array<string>")), lambda x: F.trim(x) != ""))


def gate(cards: DataFrame, evidence: DataFrame, units: DataFrame, relaxed: bool = False) -> DataFrame:
    """cards (material, card, question, hint, answer, evidence_ids, unit_ids) with reason (null: accepted) and published.

    evidence: (material, evidence_id, snippet); units: (material, unit_id, evidence_ids). Ids are strings.
    """
    texts = (answer_text(F.col("answer")).alias("_answer"), T.compact(F.col("question"), SHORT_MOST).alias("_question"), T.compact(F.col("hint"), SHORT_MOST).alias("_hint"))
    c = cards.select("material", "card", "answer", *texts, _ids(F.col("evidence_ids")).alias("_cites"), _ids(F.col("unit_ids")).alias("_units"))
    has = evidence.groupBy("material", "evidence_id").agg(F.min(F.coalesce("snippet", F.lit(""))).alias("_snippet"))
    unit = units.filter("trim(unit_id) <> ''").groupBy("material", "unit_id").agg(F.array_distinct(F.flatten(F.collect_list(_ids(F.col("evidence_ids"))))).alias("_of"))
    unit = unit.filter(F.size("_of") > 0)
    cited = c.select("material", "card", F.posexplode("_cites").alias("_at", "evidence_id")).join(has, ["material", "evidence_id"], "left")
    sources = cited.groupBy("material", "card").agg(
        F.count_if(F.col("_snippet").isNull()).alias("_foreign"),
        T.dedupe_key(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_snippet"))), lambda x: x["_snippet"]), " ")).alias("_source"),
    )
    meant = c.select("material", "card", "_cites", F.explode("_units").alias("unit_id")).join(unit, ["material", "unit_id"], "left")
    meant = meant.groupBy("material", "card").agg(F.count_if(F.col("_of").isNull()).alias("_strange"), F.count_if(~F.arrays_overlap("_of", "_cites")).alias("_apart"))
    quota = unit.groupBy("material").agg(F.count("*").alias("_n"))
    j = c.join(sources, ["material", "card"], "left").join(meant, ["material", "card"], "left").join(quota, "material", "left")
    answer, question, planned = F.col("_answer"), F.col("_question"), F.col("_n").isNotNull()
    reason = (
        F.when(answer.isNull(), "no_answer")
        .when(F.size("_cites") == 0, "no_evidence")
        .when(F.col("_foreign") > 0, "unknown_evidence")
        .when(planned & (F.col("_strange") > 0), "unknown_unit")
        .when(planned & (F.col("_apart") > 0), "unit_apart")
        .when(noise(answer) | ~held(answer, F.col("_source"), relaxed), "not_held")
        .when(~question_stands(question), "question")
        .when(~hint_stands(F.col("_hint")), "hint")
    )
    j = j.select("material", "card", "answer", "_units", "_n", T.dedupe_key(question).alias("_key"), reason.alias("reason"))
    again = Window.partitionBy("material", "_key", F.col("reason").isNull()).orderBy("card", "answer")
    j = j.withColumn("reason", F.when(F.col("reason").isNull() & (F.row_number().over(again) > 1), "repeated_question").otherwise(F.col("reason")))
    covered = j.filter("reason is null and _n is not null").select("material", F.explode("_units").alias("unit_id")).distinct().groupBy("material").agg(F.count("*").alias("_covered"))
    least = F.least(F.col("_n"), F.greatest(F.lit(1), F.ceil(F.col("_n") * QUOTA[relaxed])))
    enough = F.col("_n").isNull() | (F.coalesce("_covered", F.lit(0)) >= least)
    return j.join(covered, "material", "left").select("material", "card", "reason", (F.col("reason").isNull() & enough).alias("published"))
