"""The registered queries of this package: thin wrappers that apply each operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import bpe, decontam, divergence, hosts, jaccard, langid, licences, packing, pii, rules, slots, suffixes, whitening


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = licences.scan(docs, licences.fit(docs))
    return found.select("doc_id", F.array_join("families", ",").alias("families"), "n_paragraphs", F.round("score", 4).alias("score"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.apply_policy(rules.ledger(table(spark, sf_dir, "documents")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicate(table(spark, sf_dir, "documents"))


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes shards and index, and returns where each sequence lies, with the checksum of its bytes as read back from there."""
    out = slots.materialise(table(spark, sf_dir, "documents"))
    return slots.read_index(spark, out).join(slots.checksums(spark, out), "slot").select("doc_id", "piece", "start", "length", "ids_crc32", "slot", "shard", "at", "payload_crc32")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = hosts.judge(pages, hosts.outcomes_by_number(pages, table(spark, sf_dir, "labels")))
    return found.select("page_id", "host", "path", "rule", "verdict")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(~langid.held_out()))
    split = docs.select("doc_id", "text", langid.held_out().alias("held_out"))
    found = langid.predict(split, model, "held_out")
    return found.select("doc_id", "held_out", "lang_pred", "score", "accepted")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.detect(docs, pii.fit(docs))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return whitening.whiten(vectors, whitening.fit(vectors))


def op13_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.decode(bpe.encode(table(spark, sf_dir, "documents")))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_ngram_jaccard, op2_licence_scan, op3_quality_rules, op4_suffix_dedup, op5_token_shards, op6_url_filters, op7_benchmark_decontamination, op8_language_id, op9_pii, op10_best_fit_packing, op11_source_divergence, op12_embedding_whitening, op13_bpe_round_trip)
}

_LETTERS = "[^\\x20\\x09-\\x0D]"



def _strength_sql(name: str, level: str) -> str:
    return f"""{name} as (select case when sum(n) is null then {hosts.MOST_STRENGTH} when sum(n * (bad / n - prior) * (bad / n - prior)) - sum(prior * (1 - prior)) > 0
        then least({hosts.MOST_STRENGTH}, greatest({hosts.LEAST_STRENGTH}, sum(n * prior * (1 - prior)) / sum(n) / ((sum(n * (bad / n - prior) * (bad / n - prior)) - sum(prior * (1 - prior))) / sum(n)) - 1))
        else {hosts.MOST_STRENGTH} end as s from {level} where n > 0)"""


def _rule_sql(value: Callable[[str, str, str], str]) -> str:
    """The longest rule that fits, in the order of falling length."""
    return " ".join(f"when (host = '{h}' or host like '%.{h}') and starts_with(path, '{p}') then '{value(say, h, p)}'" for say, h, p in sorted(hosts.RULES, key=lambda r: (-len(r[1] + r[2]), r)))


def _share_sql(n: str, total: str) -> str:
    return f"(1 + (1000000000::hugeint * ({n} + 2)) // ({total} + 2 * v))"


ORACLE_SQL: dict[str, str] = {
    "op11_source_divergence": rf"""
with d as (select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
t as (select row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term, count(*) as n from t group by 1, 2 having count(distinct row) >= {divergence.LEAST_DOCS}),
sizes as (select lang, coalesce(sum(n), 0) as total, count(n) as v from (select distinct lang from d) left join kept using (lang) group by 1),
seen as (select lang, source, term, count(*) as n from t join kept using (lang, term) group by 1, 2, 3),
groups as (select lang, source, coalesce(sum(n), 0) as total from (select distinct lang, source from d) left join seen using (lang, source) group by 1, 2),
grid as (select lang, source, term, coalesce(seen.n, 0) as n, {_share_sql("coalesce(seen.n, 0)", "groups.total")} as p, {_share_sql("kept.n", "sizes.total")} as q
         from groups join kept using (lang) join sizes using (lang) left join seen using (lang, source, term)),
met as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value from grid a join grid b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
parts as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value from groups a join groups b on a.lang = b.lang and a.source <> b.source left join met on met.lang = a.lang and met.source = a.source and met.item = b.source
    union all select lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) from grid where n > 0 and p > q)
select lang, source, part, item, value::bigint as value, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from parts
qualify part = 'pair' or rank <= {divergence.TOP_TERMS}
""",
    "op3_quality_rules": rf"""
with t as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, regexp_extract_all(text, '{_LETTERS}+') as w,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_LETTERS}')) as lines from t),
g as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g
      from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w)),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from g) where n > 1),
c as (select doc_id, count(distinct i + k) as n from r, (values (0), (1), (2)) k(k) group by 1),
m as (select w.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, len(lines)::bigint as n_lines,
        (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words,
        len(regexp_extract_all(text, '!'))::bigint as n_exclaim, len(regexp_extract_all(text, '\p{{Lu}}'))::bigint as n_upper
      from w left join c using (doc_id)),
f as (select *, ((n_words < 50)::bigint + 2 * (100 * n_repeat_words > 50 * n_words)::bigint + 4 * (n_symbols * 4 > n_words)::bigint
        + 8 * (n_dup_lines * 2 > n_lines)::bigint + 16 * (word_chars < 2 * n_words or word_chars > 15 * n_words)::bigint
        + 32 * (n_exclaim * 5 > n_words)::bigint + 64 * (n_upper * 2 > word_chars)::bigint)::bigint as failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 as base_failed, failed = 0 as kept, failed from f
""",
    "op6_url_filters": rf"""
with seen as (select page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path from pages),
known as (select page_id, max((quality = 0 or toxic = 1)::int) as bad from (select page_id, try_cast(nullif(regexp_extract(path, '/([0-9]{{1,18}})(?:[^0-9]|\z)', 1), '') as bigint) as doc_id from seen) join labels using (doc_id) group by 1),
counted as (select host, count(bad) as n, coalesce(sum(bad), 0)::double as bad from seen left join known using (page_id) group by 1),
bare as (select *, regexp_replace(regexp_replace(host, '^.*@', ''), '(:[0-9]*)?[.]?$', '') as b from counted),
parts as (select *, string_split(b, '.') as l, regexp_matches(b, '^[0-9.]+$|^\[') as numbers from bare),
wide as (select *, case when len(l) >= 3 and length(l[-1]) = 2 and l[-2] in ({", ".join(f"'{x}'" for x in hosts.SECOND)}) then 2 else 1 end as k from parts),
hosts as (select host, n, bad, case when numbers then '#' else array_to_string(l[greatest(len(l) - k + 1, 1):], '.') end as suffix, case when numbers then b else array_to_string(l[greatest(len(l) - k, 1):], '.') end as domain from wide),
base as (select (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1) as base from hosts),
s1 as (select suffix, sum(n) as n, sum(bad) as bad, any_value(base) as prior from hosts, base group by 1),
{_strength_sql("w1", "s1")},
p1 as (select suffix, (bad + prior * s) / (n + s) as prior from s1, w1),
s2 as (select suffix, domain, n, bad, prior from (select suffix, domain, sum(n) as n, sum(bad) as bad from hosts group by 1, 2) join p1 using (suffix)),
{_strength_sql("w2", "s2")},
p2 as (select suffix, domain, (bad + prior * s) / (n + s) as prior from s2, w2),
s3 as (select host, n, bad, prior from hosts join p2 using (suffix, domain)),
{_strength_sql("w3", "s3")},
ab as (select host, bad + prior * s as a, n - bad + (1 - prior) * s as b from s3, w3),
least as (select host, a / (a + b) - {hosts.Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > {hosts.MAX_BAD} as blocked from ab)
select page_id, host, path, case {_rule_sql(lambda say, h, p: h + p)} end as rule,
    coalesce(case {_rule_sql(lambda say, h, p: say)} end, case when blocked then 'block' else 'allow' end) as verdict from seen join least using (host)
""",
}
