"""Text functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One CJK character, or a run of Latin letters, digits and joining signs.
TOKEN = r"[一-鿿]|[a-zA-Z0-9_+#.-]+"


def tokens(text: Column) -> Column:
    """Lower-cased tokens in order, repeats kept."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), F.lower)


def strip_nul(text: Column) -> Column:
    return F.translate(text, "\0", "")


def normalized(text: Column) -> Column:
    """No NUL, line feeds only, runs of blanks and of empty lines collapsed, ends stripped."""
    t = F.regexp_replace(strip_nul(text), "\r\n?", "\n")
    t = F.regexp_replace(F.regexp_replace(t, "[ \t]+", " "), "\n{3,}", "\n\n")
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def collapsed(text: Column) -> Column:
    """Runs of Unicode white space become one space; ends stripped."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def dedupe_key(text: Column) -> Column:
    """Letters and digits only, lower-cased."""
    return F.lower(F.regexp_replace(text, r"(?U)[\W_]+", ""))


def compact(text: Column, n: int) -> Column:
    t = collapsed(text)
    return F.when(F.length(t) > n, F.concat(F.rtrim(F.substring(t, 1, n)), F.lit("..."))).otherwise(t)


def extract_summary(text: Column, most: int, least: int = 40) -> Column:
    """The text if short; else up to its last full stop if that is late enough; else cut."""
    t = collapsed(text)
    head = F.substring(t, 1, most)
    stop = F.greatest(F.length(head) - F.locate(".", F.reverse(head)) + 1, F.length(head) - F.locate("。", F.reverse(head)) + 1)
    has = head.contains(".") | head.contains("。")
    at = F.when(head.contains(".") & head.contains("。"), stop).when(head.contains("."), F.length(head) - F.locate(".", F.reverse(head)) + 1).otherwise(F.length(head) - F.locate("。", F.reverse(head)) + 1)
    return F.when(F.length(t) <= most, t).when(has & (at > least), F.expr("substring(h, 1, a)") if False else F.left(head, at)).otherwise(F.concat(F.rtrim(head), F.lit("...")))


def is_heading(line: Column, most: int = 32) -> Column:
    """A marked heading, or a short line that ends with a colon."""
    t = F.trim(line)
    return t.rlike(r"^#{1,6} \S") | ((F.length(t) <= most) & t.rlike("[:：]$"))


def seconds(clock: Column) -> Column:
    """HH:MM:SS or MM:SS, fractions dropped; anything else is 0."""
    p = F.split(F.regexp_replace(clock, r"[.,]\d+$", ""), ":")
    n = lambda k: F.get(p, F.lit(k)).cast("int")
    fits = clock.rlike(r"^\d{1,2}(:\d{1,2}){1,2}([.,]\d+)?$")
    return F.when(fits & (F.size(p) == 3), n(0) * 3600 + n(1) * 60 + n(2)).when(fits, n(0) * 60 + n(1)).otherwise(0)


def clock(sec: Column) -> Column:
    s = F.greatest(sec.cast("int"), F.lit(0))
    return F.format_string("%02d:%02d:%02d", (s / 3600).cast("int"), (s % 3600 / 60).cast("int"), s % 60)


def time_bucket(sec: Column, width: int) -> Column:
    return (F.floor(sec / width) * width).cast("long")


def masked_variables(text: Column) -> Column:
    """UUIDs and numbers of four digits and more are replaced by their kind."""
    t = F.regexp_replace(text, "(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "{uuid}")
    return F.regexp_replace(t, r"\d{4,}", "{num}")


def top_frame(stack: Column, project: str) -> Column:
    """The first frame of the project, else the first frame, else the first line."""
    lines = F.transform(F.split(stack, "\n"), lambda x: F.trim(x))  # F.trim takes a second argument
    return F.coalesce(F.get(F.filter(lines, lambda x: x.contains(project)), F.lit(0)), F.get(F.filter(lines, lambda x: x.startswith("at ")), F.lit(0)), F.get(lines, F.lit(0)))


def char_ngrams(text: Column, n: int) -> Column:
    """Distinct character n-grams of the text without white space; a shorter text is its own n-gram, an empty one has none."""
    t = F.lower(F.regexp_replace(text, r"(?U)\s+", ""))
    bound = F.filter(F.array(t), lambda s: F.length(s) > 0)  # the text is computed once, not for every n-gram
    grams = F.transform(bound, lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - (n - 1), F.lit(1))), lambda i: F.substring(s, i, F.lit(n))))
    return F.array_distinct(F.flatten(grams))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; two empty ones give 0."""
    both = F.size(F.array_intersect(a, b))
    return both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1))


def coverage(query: Column, evidence: Column) -> Column:
    """Share of the query's distinct values that the evidence has."""
    q = F.array_distinct(query)
    return F.size(F.array_intersect(q, evidence)) / F.greatest(F.size(q), F.lit(1))


def token_estimate(text: Column) -> Column:
    return F.floor((F.length(text) + 1) / 2).cast("long")


def zh_ratio(text: Column) -> Column:
    zh, latin = F.regexp_count(text, F.lit("[一-鿿]")), F.regexp_count(text, F.lit("[A-Za-z]"))
    return F.when(zh + latin > 0, zh / (zh + latin)).otherwise(0.0)


def recency(days: Column) -> Column:
    """Decay by 30 days; unknown counts as one half."""
    return F.coalesce(F.exp(-F.greatest(days, F.lit(0)) / 30.0), F.lit(0.5))


#: Fixed values.
SCOPES = {"TASK": 1.0, "SESSION": 0.95, "MATERIAL": 0.8, "PROJECT": 0.7, "USER": 0.55, "SYSTEM": 0.35}


def scope_priority(scope: Column, default: float = 0.4) -> Column:
    known = F.create_map(*[F.lit(x) for kv in SCOPES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, scope), F.lit(default))


def backoff(attempt: Column) -> Column:
    return F.least(F.lit(3600), F.pow(F.lit(2), F.least(attempt, F.lit(8))).cast("int"))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, unequal lengths and zero norms."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def stable_id(*parts: Column, size: int = 10) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, size)
