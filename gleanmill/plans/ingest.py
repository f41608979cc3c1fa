"""Queries of the block parsers. Tables and subtitles are first written as text from rows, then parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from ..sources import blocks as B
from .registry import query


def _docs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "text")


@query("src1_file_type", """
select page_id, case when page_id % 4 = 0 then 'md' when page_id % 5 = 0 then 'pdf' when page_id % 5 = 1 then 'bin' when page_id % 5 = 2 then 'md' when page_id % 3 = 0 then 'png' when page_id % 3 = 1 then 'pdf' else 'txt' end as file_type from pages""")
def src1(spark, d):
    k = F.col("page_id")
    name = F.concat(F.lit("a.b/f"), k.cast("string"), F.when(k % 5 == 0, ".PDF").when(k % 5 == 1, ".bin").when(k % 5 == 2, ".Markdown").otherwise(""))
    media = F.when(k % 3 == 0, "image/png").when(k % 3 == 1, "application/pdf")
    return table(spark, d, "pages").select("page_id", B.file_type(F.when(k % 4 == 0, "Markdown").when(k % 4 == 1, "exe"), name, media).alias("file_type"))


@query("src4_text_blocks", r"""
with b as (select doc_id, unnest(l) as c, unnest(range(len(l))) as block from (select doc_id, string_split_regex(text, '\n\s*\n') as l from documents)),
s as (select doc_id, block, regexp_replace(c, '^\s+|\s+$', '', 'g') as c from b),
h as (select *, not contains(c, chr(10)) and (regexp_matches(c, '^#{1,6} \S') or (length(c) <= 36 and regexp_matches(c, '[:\x{ff1a}]$'))) as head from s where c <> '')
select doc_id as document_id, block::bigint as block, case when head then 'heading' else 'text' end as block_type,
  last_value(case when head then regexp_replace(c, '^#+ |[:\x{ff1a}]$', '', 'g') end ignore nulls) over (partition by doc_id order by block rows unbounded preceding) as section, md5(c) as content from h""")
def src4(spark, d):
    return B.text_blocks(_docs(spark, d)).select("document_id", F.col("block").cast("long").alias("block"), "block_type", "section", F.md5("content").alias("content"))


@query("src5_markdown_blocks", r"""
with x as (select doc_id, unnest(l) as line, unnest(range(len(l))) as pos from (select doc_id, string_split(text, chr(10)) as l from documents)),
f as (select *, regexp_matches(line, '^\s*```') as fence from x),
g as (select *, count(*) filter (fence) over (partition by doc_id order by pos) as fences from f),
k as (select *, case when fence or fences % 2 = 1 then 'code' when regexp_matches(line, '^\s*$') then 'blank' when regexp_matches(line, '^#{1,6} \S') then 'heading' when regexp_matches(line, '^\s*\|.*\|\s*$') then 'table' else 'text' end as kind from g),
o as (select *, kind = 'heading' or (fence and fences % 2 = 1) or kind is distinct from lag(kind) over (partition by doc_id order by pos) as opens from k),
n as (select *, count(*) filter (opens) over (partition by doc_id order by pos) as block from o),
b as (select doc_id, block, kind, count(*) as n_lines, string_agg(line, chr(10) order by pos) as content from n where kind <> 'blank' group by all)
select doc_id as document_id, block::bigint as block, case when kind = 'text' and regexp_matches(content, '^\s*([-*]|\d+\.) ') then 'list' else kind end as block_type,
  last_value(case when kind = 'heading' then regexp_replace(content, '^#+ ', '') end ignore nulls) over (partition by doc_id order by block rows unbounded preceding) as section, n_lines::bigint as n_lines, md5(content) as content from b""")
def src5(spark, d):
    return B.markdown_blocks(_docs(spark, d)).withColumn("content", F.md5("content"))


@query("src6_markdown_tables", """
select n_regionkey::bigint as document_id, 2::bigint as block, row_number() over (partition by n_regionkey order by n_nationkey)::bigint as row, n_nationkey || chr(9) || n_name as cells from nation
union all select distinct n_regionkey::bigint, 2::bigint, 0::bigint, 'key' || chr(9) || 'name' from nation""")
def src6(spark, d):
    rows = table(spark, d, "nation").groupBy(F.col("n_regionkey").cast("long").alias("document_id")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("r"))
    body = F.array_join(F.transform("r", lambda x: F.concat(F.lit("| "), x["n_nationkey"].cast("string"), F.lit(" | "), x["n_name"], F.lit(" |"))), "\n")
    docs = rows.select("document_id", F.concat(F.lit("# Nations\n| key | name |\n| --- | :-: |\n"), body, F.lit("\nEnd.")).alias("text"))
    return B.table_rows(B.markdown_blocks(docs))


@query("src7_subtitle_cues", r"""
select conv_id as document_id, (row_number() over (partition by conv_id order by turn) - 1)::bigint as cue, (turn * 35)::int as start, (turn * 35 + 30)::int as end,
  regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') as text from conversations""")
def src7(spark, d):
    from ..functions import text as T

    at = F.col("turn") * 35
    cue = F.concat(F.col("turn").cast("string"), F.lit("\n"), T.clock(at), F.lit(",000 --> "), T.clock(at + 30), F.lit(",500\n"), F.regexp_replace("text", r"\s+", " "), F.lit("\n"))
    docs = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("document_id")).agg(F.array_sort(F.collect_list(F.struct("turn", cue.alias("c")))).alias("cues"))
    return B.cues(docs.select("document_id", F.array_join(F.col("cues.c"), "\n").alias("text")))


@query("fm11_estimated_cues", r"""
with s as (select item_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?\x{3002}\x{ff01}\x{ff1f}])\s*', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as l from benchmark),
x as (select item_id, len(l) as n, unnest(l) as text, unnest(range(len(l))) as cue from s)
select item_id as document_id, cue::bigint as cue, round(600.0::double * cue / n, 3) as start, round(600.0::double * (cue + 1) / n, 3) as end, text from x""")
def fm11(spark, d):
    return B.estimated_cues(table(spark, d, "benchmark").select(F.col("item_id").alias("document_id"), "text", F.lit(600.0).alias("duration")))
