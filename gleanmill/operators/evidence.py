"""Evidence of an answer: projection, quality of snippets, admission of answers, variants of questions, choice for prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapsed, compact, dedupe_key, tokens

#: Fixed values.
SNIPPET = 220
MARKS = r"[#*\-`>|\s.。·…:：,，;；/\\()\[\]{}]+"
CLOCK = r"\b\d{1,2}:\d{2}(?::\d{2})?(?:[,.]\d{1,3})?\b"
NUMBERED = r"(?:^|\s)\d+(?:\.\d+)*\s*[一-鿿A-Za-z]"
BARE = ("目录", "索引", "标题", "时间戳")
LEAST_TOP, LEAST_COVERAGE, LEAST_SNIPPET, LEAST_ANSWERABLE = 0.25, 0.08, 0.35, 0.45
#: Words of an intent, and what the variants of a question add.
INTENTS = (
    (("jd", "岗位", "招聘", "能力", "要求", "缺口"), ("岗位要求 技能栈", "能力缺口 项目匹配", "学习路径 面试准备")),
    (("简历", "resume", "项目", "经历"), ("简历项目 经历证据", "技术亮点 量化成果", "项目难点 解决方案")),
    (("复习", "忘", "忘记", "回顾", "知识点", "概念", "原理", "是什么"), ("核心概念 原理", "关键步骤 公式 示例", "易混点 对比 总结")),
    (("区别", "对比", "比较", "不同", "差异"), ("差异对比", "适用场景 优缺点", "典型例子")),
    (("怎么", "如何", "步骤", "实现", "做法"), ("步骤 方法", "示例 场景", "注意事项 常见问题")),
    (("报错", "错误", "异常", "失败", "bug"), ("原因分析", "排查步骤", "修复方案")),
)
#: What other questions get.
ANY_INTENT = ("核心概念 原理", "方法步骤 示例", "总结 对比 应用场景")
LONGEST_QUERY = 120


def public_source(value: Column) -> Column:
    """The trimmed address if a browser can open it, else null."""
    v = F.trim(value)
    return F.when(v.rlike(r"(?i)^https?://[^/?#]"), v)


def project(chunks: DataFrame) -> DataFrame:
    """chunks: (chunk_id, document_id, text, title, section, source, source_path, score). What may be shown of a chunk."""
    text = lambda c, other: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit(other))
    return chunks.select(
        F.col("chunk_id").alias("evidence_id"), "document_id", text("title", "未命名资料").alias("title"), text("section", "全文").alias("section"),
        compact(F.col("text"), SNIPPET).alias("snippet"), text("source", "unknown").alias("source"), public_source(F.col("source_path")).alias("source_path"), F.bround("score", 6).alias("score"),
    )


def public_metadata(names: Column, values: Column) -> Column:
    """A map without private paths and addresses: of entries named ...path or ...url only public values stay."""
    pairs = F.arrays_zip(names.alias("k"), values.alias("v"))
    private = lambda p: F.lower(F.replace(p["k"], F.lit("_"), F.lit(""))).rlike("(path|url)$")
    return F.map_from_entries(F.transform(F.filter(pairs, lambda p: ~private(p) | public_source(p["v"]).isNotNull()), lambda p: F.struct(p["k"], F.when(private(p), public_source(p["v"])).otherwise(p["v"]))))


def metadata_view(chunk: Column, block: Column, shown: tuple[str, ...]) -> Column:
    """A block's map with the chunk's values of the shown keys on top; a null never hides a value."""
    own = F.map_filter(chunk, lambda k, v: k.isin(*shown) & v.isNotNull())
    rest = F.map_filter(block, lambda k, v: ~F.array_contains(F.map_keys(own), k))
    return F.map_concat(rest, own)


def snippet_quality(snippet: Column) -> Column:
    """0 to 1: length without marks, less for short, clock-ridden and contents-like texts."""
    text = collapsed(F.coalesce(snippet, F.lit("")))
    left = F.regexp_replace(text, MARKS, "")
    clocks = F.aggregate(F.regexp_extract_all(text, F.lit(CLOCK), F.lit(0)), F.lit(0), lambda n, x: n + F.length(x))
    dots = (F.length(text) - F.length(F.replace(text, F.lit("..."), F.lit("")))) / 3
    contents = (text.contains("目录") & (F.length(text) < 80)) | (F.regexp_count(text, F.lit(NUMBERED)) >= 4) | (dots >= 3)
    less = lambda when, by: F.when(when, by).otherwise(1.0)
    quality = F.least(F.length(left) / 80, F.lit(1.0)) * less(F.length(left) < 12, 0.35) * less(clocks / F.greatest(F.length(text), F.lit(1)) > 0.45, 0.35) * less(contents, 0.3)
    return F.when((left == "") | left.isin(*BARE), 0.0).otherwise(F.bround(quality, 6))


def admission(questions: DataFrame, evidence: DataFrame, least_support: int = 1, strict: bool = True) -> DataFrame:
    """Whether a question is answered, or the first reason against it: (query_id, status, reason, confidence, supporting).

    questions: (query_id, question, variants: array, candidates, filtered, removed); evidence, few rows a question:
    (query_id, rank, score, title, section, snippet, summary_only, located). Scores are those of the local rerank.
    """
    e = evidence.withColumn("quality", snippet_quality(F.col("snippet"))).withColumn("words", tokens(F.concat_ws(" ", "title", "section", "snippet")))
    of = e.groupBy("query_id").agg(
        F.min_by("score", "rank").alias("top"), F.min("score").alias("low"), F.max("score").alias("high"), F.count("*").alias("n"), F.min_by("quality", "rank").alias("quality"), F.min_by("located", "rank").alias("located"),
        F.min("summary_only").alias("all_summaries"), F.count_if((F.col("quality") >= LEAST_SNIPPET) & ~F.col("summary_only")).alias("supporting"), F.array_distinct(F.flatten(F.collect_list("words"))).alias("words"),
    )
    q = questions.withColumn("asked", F.array_distinct(tokens(F.concat_ws(" ", "question", F.array_join("variants", " "))))).join(of, "query_id", "left")
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    coverage = F.coalesce(F.size(F.array_intersect("asked", "words")) / F.when(F.size("asked") > 0, F.size("asked")), F.lit(0.0))
    best = F.when(F.col("high") > F.col("low"), (F.col("top") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(1.0)
    penalty = F.lit(0.08) + F.when(F.col("all_summaries"), 0.25).otherwise(0.0) + F.when(F.col("removed") / F.greatest("n", F.lit(1)) >= 0.5, 0.05).otherwise(0.0)
    score = unit(F.bround(unit(best), 6) * 0.4 + coverage * 0.25 + F.least(F.col("supporting") / least_support, F.lit(1.0)) * 0.2 + F.col("quality") * 0.15 - F.bround(penalty, 6))
    raw = F.bround("top", 6)
    near = F.when(F.col("located"), (raw >= LEAST_TOP * 0.84) & (coverage >= 0.12) & (F.col("quality") >= 0.5)).otherwise((raw >= LEAST_TOP * 0.8) & (coverage >= 0.18) & (F.col("quality") >= 0.7))
    has = F.col("n").isNotNull()
    reason = (
        F.when(F.col("candidates") <= 0, "NO_EVIDENCE").when(F.col("filtered") <= 0, "FILTERED_OUT").when(~has, "LOW_CONFIDENCE").when(F.col("all_summaries"), "ONLY_DIAGNOSTIC_CANDIDATES").when(F.col("quality") < LEAST_SNIPPET, "WEAK_SNIPPET")
        .when((F.bround(unit(F.col("top")), 6) < LEAST_TOP) & ~near, "LOW_CONFIDENCE").when(F.lit(strict) & (coverage < LEAST_COVERAGE), "INSUFFICIENT_COVERAGE")
        .when(F.col("supporting") < least_support, "INSUFFICIENT_COVERAGE").when(score < LEAST_ANSWERABLE, "LOW_CONFIDENCE")
    )
    judged = has & (F.col("candidates") > 0) & (F.col("filtered") > 0)
    return q.select("query_id", F.when(reason.isNull(), "ANSWERED").otherwise("REFUSED").alias("status"), reason.alias("reason"), F.when(judged, F.bround(score, 6)).otherwise(0.0).alias("confidence"), F.coalesce(F.when(judged, F.col("supporting")), F.lit(0)).cast("long").alias("supporting"))


def variants(question: Column) -> Column:
    """The cleaned question and three more by its intent, each of LONGEST_QUERY characters at most; none for an empty one."""
    quotes = "[\"'“”‘’]+"
    base = F.regexp_replace(F.trim(F.coalesce(question, F.lit(""))), f"^{quotes}|{quotes}$", "")
    base = collapsed(F.regexp_replace(base, r"^\s*(?:[-*]|\d+[.)、]|[（(]\d+[）)])\s*", ""))
    lower = F.lower(base)
    adds = F.array(*map(F.lit, ANY_INTENT))
    for words, more in reversed(INTENTS):
        adds = F.when(lower.rlike("|".join(words)), F.array(*map(F.lit, more))).otherwise(adds)
    every = F.concat(F.array(base), F.transform(adds, lambda a: F.concat(base, F.lit(" "), a)))
    return F.when(base == "", F.array().cast("array<string>")).otherwise(F.transform(every, lambda x: F.left(x, F.lit(LONGEST_QUERY))))


def first_of_text(rows: DataFrame, section: str, text: str, order: list[str], most: int = 600) -> DataFrame:
    """The first row of each section and normalised text, with the text cut; rows without text go."""
    cut = compact(F.col(text), most)
    w = Window.partitionBy("_s", "_k").orderBy(*order)
    keyed = rows.withColumn(text, cut).filter(F.col(text) != "").withColumn("_s", F.trim(section)).withColumn("_k", F.sha2(dedupe_key(F.col(text)), 256))
    return keyed.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_s", "_k", "_n")


def without_adjacent_repeats(rows: DataFrame, key: str, order: list[str], channel: str, value: str, only: str = "subtitle") -> DataFrame:
    """Rows of the channel that repeat the row before them, if that is of the channel too, go."""
    w = Window.partitionBy(key).orderBy(*order)
    again = (F.col(channel) == only) & (F.lag(channel).over(w) == only) & (F.lag(value).over(w) == F.col(value))
    return rows.withColumn("_again", F.coalesce(again, F.lit(False))).filter("not _again").drop("_again")


def representatives(rows: DataFrame, key: str, kind: str, order: list[str], limit: int, most_primary: int = 12, most_visual: int = 4) -> DataFrame:
    """Of each key evenly spaced rows: primary ones first, then visual ones, then summaries, as far as the limit goes.

    kind: primary, visual or summary. If places are left, they stay empty.
    """
    counts = rows.groupBy(key).agg(F.count_if(F.col(kind) == "primary").alias("_p"), F.count_if(F.col(kind) == "visual").alias("_v"))
    p = F.least(F.col("_p"), F.lit(min(most_primary, limit)))
    v = F.least(F.col("_v"), F.lit(most_visual), limit - p)
    quotas = counts.select(key, p.alias("_qp"), v.alias("_qv"), (limit - p - v).alias("_qs"))
    quota = F.when(F.col(kind) == "primary", F.col("_qp")).when(F.col(kind) == "visual", F.col("_qv")).otherwise(F.col("_qs")).cast("int")
    w = Window.partitionBy(key, kind)
    numbered = rows.join(quotas, key).withColumn("_k", quota).withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    places = F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda j: F.bround(j * (F.col("_n") - 1) / (F.col("_k") - 1), 0).cast("int"))
    chosen = F.when(F.col("_k") <= 0, False).when(F.col("_n") <= F.col("_k"), True).when(F.col("_k") == 1, F.col("_i") == F.floor(F.col("_n") / 2)).otherwise(F.array_contains(places, F.col("_i")))
    return numbered.filter(chosen).drop("_qp", "_qv", "_qs", "_k", "_i", "_n")


def with_followers(rows: DataFrame, key: str, order: list[str], preferred: Column) -> DataFrame:
    """The preferred rows and the one after each."""
    w = Window.partitionBy(key).orderBy(*order)
    kept = rows.withColumn("_p", F.coalesce(preferred, F.lit(False)))
    return kept.withColumn("_f", F.coalesce(F.lag("_p").over(w), F.lit(False))).filter("_p or _f").drop("_p", "_f")

