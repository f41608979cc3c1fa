"""What a learning material is cleaned to and asked about: contents, questions, terms, sections, progress, frames, near-duplicate candidates."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clock, collapsed, compact, dedupe_key
from ..session import work_table
from .curation import question_fault, question_key

#: Lines and marks that screens, subtitles and indexes add to a text.
ADDED_LINE = "(?i)^\\s*(?:OCR\\s*出现时间|视频画面(?:聚合)?|多一句没有[，,、 ]*少一句不行|高级软件人才培训专家)"
TIMECODE = r"\d{1,2}:\d{2}(?::\d{2})?(?:[,.]\d{1,3})?"
LEADING_TIMECODE = rf"^\s*[\[(]?{TIMECODE}(?:\s*(?:-->|[-至~～—–])\s*{TIMECODE})?[\])]?\s*(?:[-，。；：:\s]*)"
SLOGAN = "多一句没有[，,、 ]*少一句不行[，,、 ]*用更短时间[，,、 ]*教会更实用的技术[！!]?"
CREDIT = "字幕由.{1,40}?(?:提供|制作)"
CREDIT_MARKS, CREDIT_REST = ("字幕提供", "中文字幕", "文字幕", "字幕由"), ("中文字幕提供", "文字幕提供", "字幕提供", "中文字幕", "字幕由")
#: Forms of questions, and of what only looks like one.
ASKED = "([^。！？!?；;]{2,180}[？?])"
CUE = "什么是|为什么|为何|如何|怎么|怎样|哪些|哪种|哪个|是否|能否|有何|有什么|区别是什么|作用是什么"
REPORTED = r"(?:介绍|讲解|说明|分析|讨论|解释|判断|检查|确认|验证|查看|取决于)\s*$"
EMPTY_QUESTIONS = (
    "(?:对吧|对不对|是吧|没错吧|有没有问题)$", "是不是(?:就|很|也|又|已经|还)", "^(?:该|那|这|它|他们|它们|这些|这样|这种|那它)?(?:到底)?(?:是|该)?(?:怎么办|怎么做)(?:的)?(?:呢)?$", "下面这个图|找一二三四五六七|它们是不是|是不是很方便",
    "^(?:(?:大家)?(?:明白|懂|清楚|记住|学会|看懂)(?:了)?(?:吗|没有|没)|(?:是不是|对不对|好不好|可以吗|行不行|有没有问题))$",
)
POINTING = "这个|那个|这些|它们|他们|刚才|下面这个图|这个消息|该怎么办|大家|同学们|我们|你来看|回想一下|面试官问的是"
USUAL_CARDS = 8
#: Terms that tell nothing, and the words of a section.
NO_TERMS = ("知识点", "遗漏", "漏掉", "视频", "文档", "资料", "还有", "讲了", "相关", "内容", "寻找", "补充")
SECTIONS = (
    ("personal_info", ("姓名", "电话", "邮箱", "求职意向", "个人信息")), ("summary", ("个人总结", "自我评价", "优势", "简介")), ("education", ("教育", "学校", "学院", "专业", "学位")), ("work_experience", ("工作", "实习", "任职", "公司")),
    ("project_experience", ("项目", "作品", "实践", "系统")), ("skills", ("技能", "技术", "语言", "工具", "栈")), ("awards", ("奖项", "荣誉", "竞赛")), ("certifications", ("证书", "认证")), ("research", ("论文", "科研", "研究")),
)
NEED_EVIDENCE = ("work_experience", "project_experience", "skills", "research")

#: Triggers whose frames no group's quota holds back; shares and lengths of near texts.
FREE_OF_QUOTA = ("ambiguous_visual", "visual_verification")
NEAR_PAIRS, HELD_LETTERS = 0.88, 10
#: Up to so many candidates of a document are compared with each other; classes of windows; so many letters are marked at a time.
FEW, SPAN_CLASSES, MARKED_LETTERS = 1_000, 7, 200_000
NAME, SKETCH = ["start", "end", "place"], ["n", "s0", "s1", "s2", "s3"]
PAIR = ["document_id", *NAME, *[f"later_{c}" for c in NAME]]


def cleaned(text: Column) -> Column:
    """The text without added lines, time codes, slogans and subtitle credits; empty if only letters of credits are left."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), lambda x: ~x.rlike(ADDED_LINE))
    t = F.regexp_replace(collapsed(F.array_join(lines, " ")), r"^父段摘要[：:]\s*", "")
    for pattern in (rf"(?i)OCR\s*出现时间[：:]\s*{TIMECODE}", rf"(?i)视频画面(?:聚合)?\s*{TIMECODE}(?:\s*[-至~～—–]\s*{TIMECODE})?", SLOGAN, "高级软件人才培训专家"):
        t = F.regexp_replace(t, pattern, " ")
    t = F.trim(F.regexp_replace(t, LEADING_TIMECODE, ""))
    marks = reduce(Column.__add__, [F.regexp_count(t, F.lit(m)) for m in CREDIT_MARKS])
    without = F.regexp_replace(F.regexp_replace(t, CREDIT, " "), "|".join(CREDIT_REST), " ")
    t = F.when((marks >= 2) | t.rlike(CREDIT), without).otherwise(t)
    t = F.regexp_replace(collapsed(t), r"^[，。；：:,.!?！？、-]+\s*", "")
    return F.when(F.regexp_replace(t, r"[\s，。；：:,.!?！？、-]+", "").rlike("^[中文字幕提供]+$"), "").otherwise(t)


def asks(text: Column) -> Column:
    """Ends with a question mark, or is short and has a question word that does not only report a question."""
    t = collapsed(text)
    before = F.regexp_extract(t, f"^(.*?)(?:{CUE})", 1)
    return t.rlike("[?？]$") | ((F.length(t) <= 100) & t.rlike(CUE) & ~before.rlike(REPORTED))


def has_aim(text: Column) -> Column:
    """No greeting, confirmation or question without an object."""
    key = dedupe_key(text)
    return (F.length(key) >= 5) & ~reduce(Column.__or__, [key.rlike(p) for p in EMPTY_QUESTIONS])


def source_questions(evidence: DataFrame) -> DataFrame:
    """evidence (evidence_id, position, kind, channel, section, text): (evidence_id, position, k, question), each once for its evidence.

    Sentences with a question mark first, then clauses that ask, then a section that does. Summaries and frame texts are left out.
    """
    own = evidence.filter(~F.coalesce("kind", F.lit("")).isin("summary", "video_segment_summary", "ocr_occurrence") & (F.coalesce("channel", F.lit("")) != "frame_ocr"))
    t = own.withColumn("t", cleaned(F.col("text")))
    sentences = F.regexp_extract_all("t", F.lit(r"(?:^|(?<=[。！？!?；;]))\s*" + ASKED), F.lit(1))
    clauses = F.filter(F.split("t", "[，,。；;！？!?]"), lambda c: asks(compact(c, 180)))
    section = F.filter(F.array(F.coalesce("section", F.lit(""))), asks)
    every = t.select("evidence_id", "position", F.posexplode(F.transform(F.concat(sentences, clauses, section), lambda q: compact(q, 180))).alias("k", "question"))
    good = every.filter((F.col("question") != "") & has_aim(F.col("question")))
    first = F.row_number().over(Window.partitionBy("evidence_id", dedupe_key(F.col("question"))).orderBy("k"))
    return good.withColumn("_n", first).filter("_n = 1").drop("_n")


def structured_questions(questions: DataFrame, key: str) -> DataFrame:
    """questions (key, place, question): the first of each stable question that stands without its context, if a material has more than USUAL_CARDS."""
    alone = questions.withColumn("_q", question_key(F.col("question"))).filter((F.col("_q") != "") & question_fault(F.col("question")).isNull() & ~compact(F.col("question"), 180).rlike(POINTING))
    first = alone.withColumn("_n", F.row_number().over(Window.partitionBy(key, "_q").orderBy("place"))).filter("_n = 1")
    return first.withColumn("_m", F.count("*").over(Window.partitionBy(key))).filter(F.col("_m") > USUAL_CARDS).drop("_q", "_n", "_m")


def weighting_terms(text: Column, most: int = 80) -> Column:
    """Latin terms and CJK runs with their n-grams of 2 to 6, the longest first, then by the term."""
    latin = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9+#.]{2,}"), F.lit(0))
    runs = F.regexp_extract_all(dedupe_key(cleaned(text)), F.lit("[一-鿿]{2,}"), F.lit(0))
    grams = lambda s: F.flatten(F.transform(F.sequence(F.lit(2), F.least(F.lit(6), F.length(s))), lambda w: F.transform(F.sequence(F.lit(1), F.length(s) - w + 1), lambda i: F.substring(s, i, w))))
    every = F.array_distinct(F.concat(latin, runs, F.flatten(F.transform(runs, grams))))
    kept = F.filter(every, lambda t: ~t.isin(*NO_TERMS))
    return F.slice(F.transform(F.array_sort(F.transform(kept, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), lambda x: x["t"]), 1, most)


def section_key(text: Column) -> Column:
    out = F.lit("other")
    for name, words in reversed(SECTIONS):
        out = F.when(F.lower(text).rlike("|".join(words)), name).otherwise(out)
    return out


def evidence_policy(section: Column) -> Column:
    return F.when(section.isin(*NEED_EVIDENCE), "REQUIRED").otherwise("OPTIONAL")


def percent(status: Column, event_percent: Column, phase: Column, completed: Column, phases: int = 6) -> Column:
    """What a material's processing shows: 100 at its end, else the event's figure, else one inferred from the phase (below 100)."""
    inferred = F.bround((phase + F.when(completed, 1.0).otherwise(0.25)) * 100 / phases, 0).cast("int")
    within = lambda c, top: F.greatest(F.lit(0), F.least(F.lit(top), c))
    return F.when(status.isin("READY", "PARTIAL"), 100).when(event_percent.isNotNull(), within(event_percent.cast("int"), 100)).otherwise(within(inferred, 99))


def _decoded(content: pd.Series) -> pd.Series:
    def one(raw: bytes | None) -> str | None:
        for name in ("utf-8-sig", "gb18030", "latin-1"):
            try:
                return None if raw is None else bytes(raw).decode(name)
            except UnicodeDecodeError:
                continue
        return None

    return pd.Series([one(x) for x in content], dtype=object)


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 (with or without its mark), else GB18030, else Latin-1. UTF-8 is decoded natively, the rest in batches."""
    plain = F.try_validate_utf8(content.cast("string"))
    return F.coalesce(F.regexp_replace(plain, "^﻿", ""), F.pandas_udf(_decoded, "string")(F.when(plain.isNull(), content)))


def _dealt(pdf: pd.DataFrame, budget: int, min_interval: int, per_group: int) -> np.ndarray:
    """Which frames of a video are taken; pdf is in order of bucket and place in it, the first initial frame has no bucket."""
    second, initial = pdf["second"].to_numpy(), (pdf["trigger"] == "initial_slide").to_numpy()
    group = pd.factorize(pdf["quota_group"])[0]
    taken, blocked, spent = np.zeros(len(pdf), bool), np.zeros(len(pdf), bool), np.zeros(len(pdf) + 1, int)

    def take(i: int) -> None:
        taken[i] = True
        blocked[~initial & (np.abs(second - second[i]) < min_interval)] = True
        if group[i] >= 0:
            spent[group[i]] += 1
            blocked[(group == group[i]) & (spent[group[i]] >= per_group)] = True

    bucket = pdf["bucket"].to_numpy()
    if len(bucket) and bucket[0] < 0:
        take(0)
    dealt = np.flatnonzero(bucket >= 0)
    head = dealt[np.unique(bucket[dealt], return_index=True)[1]]  # of each bucket the first frame not yet seen
    stop = np.append(head[1:], len(pdf))[: len(head)]
    gave = True
    while gave and (left := budget - int(taken.sum())) > 0 and len(filled := np.flatnonzero(head < stop)):
        gave = False
        if len(filled) > left:
            filled = filled[[len(filled) // 2]] if left == 1 else filled[np.unique(np.rint(np.arange(left) * (len(filled) - 1) / (left - 1)).astype(int))]
        for b in filled:
            fit = head[b] + np.flatnonzero(~blocked[head[b] : stop[b]])
            head[b] = fit[0] + 1 if len(fit) else stop[b]
            if len(fit):
                take(fit[0])
                gave = True
    return taken


def frame_budget(frames: DataFrame, budget: int, min_interval: int = 2, per_group: int = 1) -> DataFrame:
    """frames (video_id, frame, second, group_id, trigger, priority): at most `budget` of each video, and always its first initial frame.

    The others are ranked in time buckets of ceil(span / budget) seconds by their distance to the bucket's middle, then by
    priority, second and frame. In each round every bucket, or an even choice of them if fewer may be taken, gives its
    first frame that no taken one blocks: other than initial frames, those nearer than min_interval seconds; other than
    doubtful ones, those of a group that has given per_group. Buckets and ranks are windows of one shuffle by video; what
    was taken decides what may follow, so the choice itself runs over one video's ranked frames at a time.
    """
    video = Window.partitionBy("video_id")
    width = F.greatest(F.lit(1), F.ceil((F.max("second").over(video) - F.min("second").over(video) + 1) / max(1, budget)))
    initial = F.col("trigger") == "initial_slide"
    opening = initial & (F.row_number().over(video.orderBy(F.desc(initial), "second", "frame")) == 1)
    f = frames.select("video_id", "frame", "second", "trigger", "priority", F.when((F.col("group_id") != "") & ~F.col("trigger").isin(*FREE_OF_QUOTA), F.col("group_id")).alias("quota_group"), width.alias("width"), opening.alias("opening"))
    f = f.withColumn("bucket", F.when(F.col("opening"), -1).otherwise(F.floor(F.col("second") / F.col("width"))))
    off = F.abs(F.col("second") - (F.col("bucket") + 0.5) * F.col("width"))
    f = f.withColumn("place", F.row_number().over(Window.partitionBy("video_id", "bucket").orderBy(off, F.desc("priority"), "second", "frame")))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bucket", "place"], ignore_index=True)
        return pdf.loc[_dealt(pdf, budget, min_interval, per_group), ["video_id", "frame", "second"]]

    return f.select("video_id", "frame", "second", "trigger", "quota_group", "bucket", "place").groupBy("video_id").applyInPandas(choose, "video_id long, frame long, second long")


def visual_ranges(selected: DataFrame, others: DataFrame) -> DataFrame:
    """selected (video_id, frame, second, group_id) with the clock times of the group's other frames (video_id, second, group_id), on its first selected frame only."""
    times = others.filter("group_id is not null").groupBy("video_id", "group_id").agg(F.transform(F.array_sort(F.collect_set("second")), lambda s: clock(s)).alias("times"))
    first = F.row_number().over(Window.partitionBy("video_id", "group_id").orderBy("second", "frame")) == 1
    met = selected.withColumn("_first", first & F.col("group_id").isNotNull()).join(times, ["video_id", "group_id"], "left")
    return met.select("video_id", "frame", "second", "group_id", F.coalesce(F.when(F.col("_first"), F.col("times")), F.array().cast("array<string>")).alias("times"))


def _spread(x: np.ndarray) -> np.ndarray:
    """64-bit numbers spread over all bits, by the last steps of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _letters(key: str) -> np.ndarray:
    return np.frombuffer(key.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _pairs(key: str) -> np.ndarray:
    a = _letters(key)
    return _spread(np.unique(a[:-1] << np.uint64(32) | a[1:]))


def _sketched(keys: pd.Series) -> pd.DataFrame:
    """How many character pairs a text has, and for 256 classes of them whether their number is odd."""
    n, bits = np.empty(len(keys), np.int32), np.empty((len(keys), 256), np.uint8)
    for k, key in enumerate(keys):
        p = _pairs(key)
        n[k], bits[k] = len(p), np.bincount(p >> np.uint64(56), minlength=256) & 1
    s = np.packbits(bits, axis=1).view(np.int64)
    return pd.DataFrame({"n": n, **{f"s{i}": s[:, i] for i in range(4)}})


def _sketch(key: Column) -> Column:
    return F.pandas_udf(_sketched, "n int, s0 long, s1 long, s2 long, s3 long")(key)


def _alike_marks(key: str, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the parts of a text's character pairs, and which of them are of its own class.

    Two sets that have a share of `least` in common differ in at most (1 - least) / least * n elements, n the smaller number.
    Dealt by a hash to one part more than that, they agree in a whole part. Sizes go by classes that grow by 1 / least: the
    parts follow from the class of the smaller set, so each set is dealt for its own class and the one below.
    """
    p = _pairs(key)
    own, h, marks, mine = math.ceil(math.log(len(p)) / -math.log(least) - 1e-9), _spread(p + np.uint64(1)), [], []
    for level in range(own, max(own - 2, -1), -1):
        k = math.floor((1 - least) / least * (1 / least) ** level + 1e-6) + 1
        z = np.zeros(k, np.uint64)
        np.bitwise_xor.at(z, (p % np.uint64(k)).astype(np.int64), h)
        marks.append(_spread(z ^ _spread(np.arange(k, dtype=np.uint64) + np.uint64((level + 1) << 32))))
        mine.append(np.full(k, level == own))
    return np.concatenate(marks).view(np.int64), np.concatenate(mine)


def _span_class(length: int, held: int) -> int:
    return min((length // held).bit_length() - 1, SPAN_CLASSES - 1)


def _held_marks(key: str, held: int, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """The least run of `held` letters in each window, for each class of windows that `classes` has as a bit, and which are of the text's own class.

    Windows have `held` letters, twice as many and so on, and a text's own are the longest that fit. The windows of a text are windows
    of each text that holds it, so all its marks of its own class are marks of the other.
    """
    a, own, marks, mine = _letters(key), _span_class(len(key), held), [], []
    h = np.zeros(len(a) - held + 1, np.uint64)
    for j in range(held):
        h = h * np.uint64(0x9E3779B97F4A7C15) + a[j : j + len(h)]
    h = _spread(h)
    for c in (c for c in range(own + 1) if classes >> c & 1):
        low, size, width = h, 1, (held << c) - held + 1
        while 2 * size <= width:
            low, size = np.minimum(low[:-size], low[size:]), 2 * size
        low = np.unique(np.minimum(low[: len(low) - (width - size)], low[width - size :]))
        marks.append(_spread(low + np.uint64(c)))
        mine.append(np.full(len(low), c == own))
    return np.concatenate(marks).view(np.int64), np.concatenate(mine)


def _marked(texts: DataFrame, columns: list[str], each) -> DataFrame:
    """A row (columns, mark, mine) for each mark that `each` gives a row of texts, passed on after every MARKED_LETTERS letters."""

    def rows(frames):
        for pdf in frames:
            for _, some in pdf.groupby(pdf["key"].str.len().cumsum() // MARKED_LETTERS):
                got = [each(r) for r in some.itertuples(index=False)]
                out = some[columns].iloc[np.repeat(np.arange(len(some)), [len(m) for m, _ in got])]
                yield out.assign(mark=np.concatenate([m for m, _ in got]), mine=np.concatenate([o for _, o in got]))

    kinds = dict(texts.dtypes)
    return texts.mapInPandas(rows, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", mark long, mine boolean")


def _grams(text: Column) -> Column:
    letters = F.split(text, "")
    return F.array_distinct(F.zip_with(F.slice(letters, 1, F.size(letters) - 1), F.slice(letters, 2, F.size(letters) - 1), lambda x, y: F.concat(x, y)))


def _met(texts: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Texts beside the others of equal keys, whose columns are named later_."""
    same = reduce(Column.__and__, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in keys])
    later = [F.col(f"b.{c}").alias(f"later_{c}") for c in others.columns if c not in keys]
    return texts.alias("a").join(others.alias("b"), same).select(*[F.col(f"a.{c}") for c in texts.columns], *later)


def _order(side: str = "") -> Column:
    return F.struct(*[F.col(f"{side}{c}").alias(c) for c in NAME])


def _may_be_alike(least: float) -> Column:
    """Sketches differ in no more classes than sets in elements; sets with a share of `least` in common differ in at most (1 - least) / (1 + least) of the sum of their sizes."""
    apart = reduce(Column.__add__, [F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"later_s{i}"))) for i in range(4)])
    close = F.least("n", "later_n") >= least * F.greatest("n", "later_n") - 1e-9
    return close & (apart <= (1 - least) / (1 + least) * (F.col("n") + F.col("later_n")) + 1e-6)


def _is_held(held: int) -> Column:
    return (F.least("letters", "later_letters") >= held) & (F.contains("key", "later_key") | F.contains("later_key", "key"))


def _judged(both: DataFrame, least: float, held: int) -> DataFrame:
    """Of pairs of texts the names of the near ones."""
    shared = F.size(F.array_intersect(_grams(F.col("key")), _grams(F.col("later_key"))))
    alike = shared / (F.col("n") + F.col("later_n") - shared) >= least
    return both.filter(F.when(_is_held(held), True).when(_may_be_alike(least), alike)).select(*PAIR)


def near_pairs(texts: DataFrame, least: float = NEAR_PAIRS, held: int = HELD_LETTERS) -> DataFrame:
    """texts (document_id, NAME, key, letters, and n and s0 to s3 by _sketch; NAME orders a document's texts, keys have two letters or more): PAIR of the near ones, each once.

    Near is a text held in another, from `held` letters, or a share of `least` of both texts' character pairs in common.
    All texts of a document meet, so this is for few in each. Lengths and sketches leave few pairs whose sets are compared.
    """
    return _judged(_met(texts, texts, ["document_id"]).filter(_order() < _order("later_")), least, held)


def near_pairs_of_many(texts: DataFrame, least: float = NEAR_PAIRS, held: int = HELD_LETTERS) -> DataFrame:
    """The same for documents of many texts: no pair of them all is made.

    Sets may be alike if they share the mark of a part. A text may be held in those that have that mark of it which fewest
    texts of the document have. Two joins on marks give these pairs, and exact sets and texts decide.
    """
    name, mark = ["document_id", *NAME], ["document_id", "mark"]
    parts = work_table(_marked(texts, [*name, *SKETCH], lambda r: _alike_marks(r.key, least)), "parts")
    alike = _met(parts, parts, mark).filter((_order() < _order("later_")) & (F.col("mine") | F.col("later_mine")) & _may_be_alike(least))

    long = texts.filter(F.col("letters") >= held)
    own = reduce(Column.__add__, [(F.col("letters") >= held << c).cast("int") for c in range(1, SPAN_CLASSES)])
    classes = long.groupBy("document_id").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), own)).alias("classes"))
    runs = work_table(_marked(long.join(classes, "document_id"), [*name, "letters"], lambda r: _held_marks(r.key, held, r.classes)), "runs")
    having = runs.groupBy(mark).agg(F.count("*").alias("having"))
    rare = runs.filter("mine").join(having, mark).groupBy(*name, "letters").agg(F.min(F.struct("having", "mark")).alias("x")).select(*name, "letters", "x.mark")
    met = _met(rare, runs, mark).filter((F.col("letters") <= F.col("later_letters")) & (_order() != _order("later_")))
    first, last = F.least(_order(), _order("later_")), F.greatest(_order(), _order("later_"))
    holding = met.select("document_id", *[first[c].alias(c) for c in NAME], *[last[c].alias(f"later_{c}") for c in NAME])

    pairs = alike.select(*PAIR).unionByName(holding).distinct().join(texts, name)
    return _judged(pairs.join(texts.select("document_id", *[F.col(c).alias(f"later_{c}") for c in texts.columns if c != "document_id"]), ["document_id", *[f"later_{c}" for c in NAME]]), least, held)


def _dropped(frames):
    """PAIR of near texts by document and later one: the later ones that are near one not dropped before. It holds one document's dropped names."""
    doc, gone = None, set()
    for pdf in frames:
        out = []
        for d, *both in pdf[PAIR].itertuples(index=False, name=None):
            at, later = tuple(both[: len(NAME)]), tuple(both[len(NAME) :])
            if d != doc:
                doc, gone = d, set()
            if later not in gone and at not in gone:
                gone.add(later)
                out.append((d, *later))
        yield pd.DataFrame(out, columns=["document_id", *NAME])


def _firsts(keyed: DataFrame) -> DataFrame:
    """The first of a document's equal texts; those of the same start and end are told apart by the place of their letters."""
    firsts = keyed.groupBy("document_id", "key", "letters", "x").agg(F.min(F.struct("start", "end")).alias("_s"))
    placed = firsts.select("document_id", "_s.start", "_s.end", "key", "letters", "x.*")
    return placed.withColumn("place", F.row_number().over(Window.partitionBy("document_id", "start", "end").orderBy("key")))


def without_near_candidates(candidates: DataFrame, few: int = FEW) -> DataFrame:
    """candidates (document_id, start, end, text) in order of start, end and letters, without those near a kept one before.

    Of equal texts the first counts; a text of less than two letters is near none. The texts of a document meet each other if
    they are at most `few`, else by joins on marks. Near texts in order decide in one pass which of them are dropped.
    """
    keyed = candidates.select("document_id", "start", "end", dedupe_key(F.coalesce("text", F.lit(""))).alias("key")).withColumn("x", _sketch("key"))
    keyed = work_table(keyed.withColumn("letters", F.length("key")), "candidates")
    some = keyed.filter("letters >= 2")
    crowded = some.groupBy("document_id").agg(F.count("*").alias("n")).filter(F.col("n") > few).select("document_id")
    texts = _firsts(some.join(crowded, "document_id", "left_anti").repartition("document_id"))
    near = near_pairs(texts)
    if not crowded.isEmpty():
        tasks = 4 * candidates.sparkSession.sparkContext.defaultParallelism  # a text gives many marks, so few bytes are much work
        large = work_table(_firsts(some.join(crowded, "document_id", "left_semi")).repartition(tasks), "texts")
        near, texts = near.unionByName(near_pairs_of_many(large)), texts.unionByName(large)
    near = near.repartition("document_id").sortWithinPartitions("document_id", *[f"later_{c}" for c in NAME])
    out = near.mapInPandas(_dropped, "document_id long, start long, end long, place int")
    name = ["document_id", *NAME]
    named = texts.select(*name).join(out, name, "left_anti").select("document_id", "start", "end")
    return named.unionByName(keyed.filter("letters < 2").select("document_id", "start", "end"))
