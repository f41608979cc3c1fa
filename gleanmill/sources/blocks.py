"""Text formats as blocks: plain text, Markdown, pipe tables and subtitles, parsed with native columns.

Every parser takes (document_id, text) and gives rows per block; windows span one document. Null texts have no
blocks; empty and blank blocks are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Types that a caller can declare.
DECLARED = ("pdf", "docx", "doc", "pptx", "ppt", "md", "markdown", "xlsx", "xls", "txt", "text", "srt", "vtt", "png", "jpg", "jpeg", "webp", "mp4")


def file_type(declared: Column, name: Column, media_type: Column) -> Column:
    """The declared type if it is a known one, else the file's suffix, else what the media type says, else txt."""
    said, suffix = F.lower(F.trim(declared)), F.regexp_extract(F.lower(name), r"[^/.]\.([^./]+)$", 1)
    media = F.regexp_extract(F.lower(media_type), "^(?:image|video)/(.+)$", 1)
    found = F.coalesce(F.when(said.isin(*DECLARED), said), F.when(suffix != "", suffix), F.when(media != "", media), F.when(media_type == "application/pdf", "pdf"), F.lit("txt"))
    return F.when(found == "markdown", "md").otherwise(found)


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _carry(value: Column, order: str) -> Column:
    """The latest value that is not null, within a document."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy("document_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def text_blocks(docs: DataFrame) -> DataFrame:
    """Blocks parted by blank lines; a heading names the section of what follows: (document_id, block, block_type, section, content)."""
    b = docs.select("document_id", F.posexplode(F.split("text", r"\n\s*\n")).alias("block", "content"))
    b = b.withColumn("content", stripped("content")).filter("content <> ''")
    b = b.withColumn("block_type", F.when(~F.col("content").contains("\n") & T.is_heading(F.col("content"), 36), "heading").otherwise("text"))
    title = F.when(F.col("block_type") == "heading", F.regexp_replace("content", "^#+ |[:：]$", ""))
    return b.select("document_id", "block", "block_type", _carry(title, "block").alias("section"), "content")


def markdown_blocks(docs: DataFrame) -> DataFrame:
    """Headings, fenced code, pipe tables, lists and paragraphs: (document_id, block, block_type, section, n_lines, content).

    A line belongs to code while an odd number of fences came before it. A block ends at a blank line, a heading or
    where the kind of line changes; a paragraph that starts with a bullet or a number is a list.
    """
    line = F.col("line")
    by_line = Window.partitionBy("document_id").orderBy("at")
    up_to = by_line.rowsBetween(Window.unboundedPreceding, 0)
    x = docs.select("document_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    x = x.withColumn("fence", line.rlike(r"^\s*```")).withColumn("fences", F.count_if("fence").over(up_to))
    inside = F.col("fence") | (F.col("fences") % 2 == 1)
    kind = F.when(inside, "code").when(line.rlike(r"^\s*$"), "blank").when(line.rlike(r"^#{1,6} \S"), "heading").when(line.rlike(r"^\s*\|.*\|\s*$"), "table").otherwise("text")
    x = x.withColumn("kind", kind)
    opens = (F.col("kind") == "heading") | (F.col("fence") & (F.col("fences") % 2 == 1)) | ~F.col("kind").eqNullSafe(F.lag("kind").over(by_line))
    x = x.withColumn("block", F.count_if(opens).over(up_to)).filter("kind <> 'blank'")
    b = x.groupBy("document_id", "block", "kind").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("lines"))
    b = b.select("document_id", "block", "kind", F.size("lines").cast("long").alias("n_lines"), F.array_join(F.col("lines.line"), "\n").alias("content"))
    is_list = (F.col("kind") == "text") & F.col("content").rlike(r"^\s*([-*]|\d+\.) ")
    title = F.when(F.col("kind") == "heading", F.regexp_replace("content", "^#+ ", ""))
    return b.select("document_id", "block", F.when(is_list, "list").otherwise(F.col("kind")).alias("block_type"), _carry(title, "block").alias("section"), "n_lines", "content")


def table_rows(blocks: DataFrame) -> DataFrame:
    """Of the Markdown blocks that are tables with a separator as second line, each row as tab-separated cells: (document_id, block, row, cells)."""
    lines = F.split("content", "\n")
    ok = F.get(lines, F.lit(1)).rlike(r"^\s*\|[\s:|-]*-[\s:|-]*\|\s*$")
    t = blocks.filter(F.col("block_type") == "table").filter(ok).select("document_id", "block", F.posexplode(lines).alias("at", "line")).filter("at <> 1")
    cells = F.transform(F.split(F.regexp_replace("line", r"^\s*\||\|\s*$", ""), r"\|"), stripped)
    return t.select("document_id", "block", F.when(F.col("at") == 0, 0).otherwise(F.col("at") - 1).cast("long").alias("row"), F.array_join(cells, "\t").alias("cells"))


def cues(docs: DataFrame) -> DataFrame:
    """SubRip and WebVTT cues, and lines like `[mm:ss] text`: (document_id, cue, start, end in seconds or null, text)."""
    clock = r"(\d{1,2}:\d{2}(?::\d{2})?)(?:[.,]\d+)?"
    b = docs.select("document_id", F.posexplode(F.split("text", r"\n\s*\n")).alias("cue", "c"))
    timed = rf"(?s)^\s*(?:[^\n]*\n)?{clock} *--> *{clock}[^\n]*\n(.*)$"
    noted = rf"(?s)^\s*\[{clock}\] *(.*)$"
    found = F.col("c").rlike(timed)
    b = b.filter(found | F.col("c").rlike(noted))
    part = lambda k: F.regexp_extract("c", timed, k)
    return b.select(
        "document_id",
        F.col("cue").cast("long").alias("cue"),
        F.when(found, T.seconds(part(1))).otherwise(T.seconds(F.regexp_extract("c", noted, 1))).alias("start"),
        F.when(found, T.seconds(part(2))).alias("end"),
        stripped(F.when(found, part(3)).otherwise(F.regexp_extract("c", noted, 2))).alias("text"),
    )


def estimated_cues(docs: DataFrame) -> DataFrame:
    """Sentences spread evenly over a duration: docs (document_id, text, duration) to (document_id, cue, start, end, text)."""
    s = F.filter(F.transform(F.split("text", r"(?<=[.!?。！？])\s*"), stripped), lambda x: x != "")
    x = docs.select("document_id", "duration", F.size(s).alias("n"), F.posexplode(s).alias("cue", "text"))
    at = lambda k: F.round(F.col("duration") * k / F.col("n"), 3)
    return x.select("document_id", F.col("cue").cast("long").alias("cue"), at(F.col("cue")).alias("start"), at(F.col("cue") + 1).alias("end"), "text")
