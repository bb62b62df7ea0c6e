"""Pages: parse marked-up documents into rows, look at them, and write them back.

``docs`` have (doc_id, content); ``pages`` have (doc_id, pos, page_num, content), pos from 1 in document order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageflow.functions import text as t

DASH = r"----- Page (\d+) -----"


def parse_pages(docs: DataFrame, strict: bool = True, drop_errors: bool = False, dialect: str = "begin_end", keep_head: bool = False) -> DataFrame:
    """A row a page; content runs to the next marker.

    ``strict`` asks for the marker's closing `` --`` on its line. ``drop_errors`` leaves failed pages out. Text before the
    first marker is left out, or with ``keep_head`` a page of position 0 without a number, which a document without markers is as
    a whole. Other documents without markers, empty and null ones give no rows; numbers beyond int are null.
    """
    marker = DASH if dialect == "dash" else t.BEGIN_STRICT if strict else t.BEGIN
    clean = (lambda p: t.trim(F.regexp_replace(p, f"^{DASH}\n?", ""))) if dialect == "dash" else t.trim_end
    # A page's columns are made inside the array that is exploded, so that filters on them don't run the patterns again.
    page = lambda p: F.struct(F.regexp_extract(p, f"^{marker}", 1).try_cast("int").alias("page_num"), clean(p).alias("content"))
    parts = F.split("content", f"(?={marker})", -1)
    marked = F.filter(parts, lambda p: p.rlike(f"^{marker}"))
    rows = docs.select("doc_id", F.posexplode(F.transform(marked, page)).alias("pos", "p"))
    pages = rows.select("doc_id", (F.col("pos") + 1).alias("pos"), "p.page_num", "p.content")
    if keep_head:
        head = docs.select("doc_id", F.lit(0).alias("pos"), F.lit(None).cast("int").alias("page_num"), F.get(parts, F.lit(0)).alias("content"))
        pages = pages.unionByName(head.where(~F.col("content").rlike(f"^{marker}") & (t.trim(F.col("content")) != "")))
    return pages.where(~t.is_error(F.col("content"))) if drop_errors else pages


def without_markers(docs: DataFrame, strict: bool = True) -> DataFrame:
    """(doc_id): documents in which no page marker stands, null ones too; page operators give no rows for them."""
    found = F.coalesce(F.col("content").rlike(t.BEGIN_STRICT if strict else t.BEGIN), F.lit(False))
    return docs.where(~found).select("doc_id")


def last_wins(pages: DataFrame) -> DataFrame:
    """One row for each page number of a document: the last in order."""
    order = Window.partitionBy("doc_id", "page_num").orderBy(F.desc("pos"))
    return pages.withColumn("_r", F.row_number().over(order)).where(F.col("_r") == 1).drop("_r")


def page_markers(pages: DataFrame) -> DataFrame:
    """Add begin_continues, end_continues and printed, the printed page number of the first End marker."""
    begin, end = F.regexp_extract("content", t.BEGIN_STRICT, 0), F.regexp_extract("content", t.END, 0)
    return pages.withColumns(
        {
            "begin_continues": begin.contains(t.CONTINUES),
            "end_continues": end.contains(t.CONTINUES),
            "printed": F.regexp_extract(end, r"\(Printed Page (\d+)\)", 1).try_cast("int"),
        }
    )


def page_text(num: Column, body: Column, begin_continues: Column, end_continues: Column, printed: Column) -> Column:
    """A page with its markers."""
    mark = lambda c: F.when(c, f" {t.CONTINUES}").otherwise("")
    shown = F.when(printed.isNotNull(), F.concat(F.lit(" (Printed Page "), printed.cast("string"), F.lit(")"))).otherwise("")
    return F.concat(F.lit("### -- Begin Page "), num.cast("string"), mark(begin_continues), F.lit(" --\n"), body, F.lit("\n### -- End"), shown, mark(end_continues), F.lit(" --"))


def error_page(num: Column) -> Column:
    return F.concat(F.lit("### -- Begin Page "), num.cast("string"), F.lit(f" --\n\n{t.ERROR_MARK} for page "), num.cast("string"), F.lit("]"))


def render_pages(pages: DataFrame, dialect: str = "begin_end", order: str = "pos") -> DataFrame:
    """(doc_id, content): a document's pages, in ``order``, parted by blank lines. A document is built in one task."""
    content = F.col("content") if dialect == "begin_end" else F.concat(F.lit("----- Page "), F.col("page_num").cast("string"), F.lit(" -----\n"), F.col("content"))
    gathered = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), content.alias("c")))).alias("p"))
    return gathered.select("doc_id", F.array_join(F.transform("p", lambda x: x["c"]), "\n\n").alias("content"))


def fill_missing(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """(doc_id, page_num, content, missing) for each page of (doc_id, start_page, end_page); absent ones fail."""
    every = ranges.where(F.col("start_page") <= F.col("end_page")).select("doc_id", F.explode(F.sequence("start_page", "end_page")).alias("page_num"))
    joined = every.join(pages.select("doc_id", "page_num", "content"), ["doc_id", "page_num"], "left")
    return joined.select("doc_id", "page_num", F.coalesce("content", error_page(F.col("page_num"))).alias("content"), F.col("content").isNull().alias("missing"))


def flag_blank(pages: DataFrame, threshold: int = 10) -> DataFrame:
    """Add body, is_blank (the body has ``threshold`` characters at most) and is_error."""
    if isinstance(threshold, bool) or not isinstance(threshold, int) or threshold < 0:
        raise ValueError("threshold must be an int of at least 0")
    # The body comes out of a generator, so that a filter on it doesn't run its patterns a second time.
    made = pages.select("*", F.explode(F.array(t.body_of(F.col("content")))).alias("body"))
    return made.withColumn("is_blank", F.length("body") <= threshold).withColumn("is_error", t.is_error(F.col("content")))


def renumber(pages: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Number pages from 1 in their order; ``old_page`` keeps the number, the marker's status stays."""
    order = Window.partitionBy(*by).orderBy("pos")
    # Only the first marker is rewritten: what stands before and behind its number is put back as it is, all in one pass.
    begin = r"(?s)^(?<before>.*?### -- Begin Page )\d+(?<after>(?-s:.*?) --)"
    made = pages.withColumn("old_page", F.col("page_num")).withColumn("page_num", F.row_number().over(order))
    return made.withColumn("content", F.regexp_replace("content", F.lit(begin), F.concat(F.lit("${before}"), F.col("page_num").cast("string"), F.lit("${after}"))))


def remove_blank(docs: DataFrame, threshold: int = 10, keep_errors: bool = False) -> DataFrame:
    """Pages that aren't blank, numbered anew: (doc_id, pos, page_num, content, old_page, body, is_error).

    Documents without markers have no pages: see ``without_markers``.
    """
    flagged = flag_blank(parse_pages(docs), threshold)
    stays = ~F.col("is_blank") | (F.col("is_error") & F.lit(keep_errors))
    return renumber(flagged.where(stays)).drop("is_blank")


def select_pages(pages: DataFrame, start: int = 1, end: int | None = None) -> DataFrame:
    """Pages start to end; None is the last page."""
    low = F.col("page_num") >= max(1, start)
    return pages.where(low if end is None else low & (F.col("page_num") <= end))


def has_text(pages: DataFrame, column: str = "content") -> DataFrame:
    """Pages whose text has more than white space."""
    return pages.where(F.length(F.regexp_replace(column, t.WS, "")) > 0)


def page_source(pages: DataFrame, embedded: DataFrame, ocr: DataFrame) -> DataFrame:
    """(doc_id, page_num, text, source): embedded text first, then recognised text, else a mark. Inputs have (doc_id, page_num, text)."""
    a = embedded.select("doc_id", "page_num", F.col("text").alias("_e"))
    b = ocr.select("doc_id", "page_num", F.col("text").alias("_o"))
    joined = pages.select("doc_id", "page_num").join(a, ["doc_id", "page_num"], "left").join(b, ["doc_id", "page_num"], "left")
    source = F.when(F.col("_e").isNotNull(), "embedded").when(F.col("_o").isNotNull(), "ocr").otherwise("none")
    return joined.select("doc_id", "page_num", F.coalesce("_e", "_o", F.lit(t.NOT_FOUND)).alias("text"), source.alias("source"))


NOTES = {"picture": r"\(--! ([^)]*)\)", "heading": r"\(--# ([^)]*)\)", "note": r"\(--\* ([^)]*)\)", "as_is": r"\(-- (as is)\)", "redaction": "(■)"}


def annotations(pages: DataFrame) -> DataFrame:
    """(doc_id, page_num, kind, n, text) for each inline note of a page, n from 1 within kind."""
    found = F.flatten(F.array(*[F.transform(F.regexp_extract_all("content", F.lit(p), F.lit(1)), _note(k)) for k, p in NOTES.items()]))
    return pages.select("doc_id", "page_num", F.inline(found))


def _note(kind: str):
    return lambda text, i: F.struct(F.lit(kind).alias("kind"), (i + 1).alias("n"), text.alias("text"))


def page_stats(pages: DataFrame, threshold: int = 10) -> DataFrame:
    """Pages, greatest number, blank and kept pages of each document, and which are blank."""
    blank = F.col("is_blank")
    return flag_blank(pages, threshold).groupBy("doc_id").agg(
        F.count("*").alias("n_pages"), F.max("page_num").alias("max_page"), F.count_if(blank).alias("n_blank"), F.count_if(~blank).alias("n_kept"),
        F.array_sort(F.collect_list(F.when(blank, F.col("page_num")))).alias("blank_pages"),
    )


def page_ranges(pages: DataFrame) -> DataFrame:
    """(doc_id, start_page, end_page) of runs of consecutive page numbers."""
    once = pages.select("doc_id", "page_num").distinct()
    island = F.col("page_num") - F.row_number().over(Window.partitionBy("doc_id").orderBy("page_num"))
    return once.withColumn("_i", island).groupBy("doc_id", "_i").agg(F.min("page_num").alias("start_page"), F.max("page_num").alias("end_page")).drop("_i")


def marker_counts(df: DataFrame, column: str = "content") -> DataFrame:
    """Add n_begin and n_end."""
    return df.withColumn("n_begin", F.regexp_count(column, F.lit(r"### -- Begin Page \d+"))).withColumn("n_end", F.regexp_count(column, F.lit("### -- End")))


def upsert_pages(old: DataFrame, new: DataFrame) -> DataFrame:
    """Pages of both; where a number is in both, that of ``new``."""
    both = old.withColumn("_g", F.lit(0)).unionByName(new.withColumn("_g", F.lit(1)))
    order = Window.partitionBy("doc_id", "page_num").orderBy(F.desc("_g"), F.desc("pos"))
    return both.withColumn("_r", F.row_number().over(order)).where(F.col("_r") == 1).drop("_r", "_g")


def head_tail(pages: DataFrame, front: int = 4, back: int = 4) -> DataFrame:
    """First and last pages of each document without failed ones, in order and without repeats."""
    good = pages.where(~t.is_error(F.col("content")))
    every = Window.partitionBy("doc_id")
    ranked = good.withColumn("_r", F.row_number().over(every.orderBy("pos"))).withColumn("_n", F.count("*").over(every))
    return ranked.where((F.col("_r") <= front) | (F.col("_r") > F.col("_n") - back)).drop("_r", "_n")


def order_pages(pages: DataFrame) -> DataFrame:
    """Add place: the rank of a page by number, and by position where numbers are equal."""
    return pages.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_num", "pos")))


def outline(pages: DataFrame) -> DataFrame:
    """(doc_id, page_num, line_no, level, heading): headings of legal style by level, and layout blocks."""
    levels = [("article", r"^第[0-9]+"), ("number", r"^[0-9]+[ .　]"), ("paren", r"^\([0-9]+\)"), ("kana", r"^[ア-ン][ 　]"), ("paren_kana", r"^\([ア-ン]\)"), ("letter", r"^[a-z][ .　]"), ("paren_letter", r"^\([a-z]\)"), ("block", r"^### --")]
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(levels):
        kind = F.when(F.col("heading").rlike(pattern), name).otherwise(kind)
    lines = pages.select("doc_id", "page_num", F.posexplode(F.split(t.body_of(F.col("content")), "\n")).alias("line_no", "heading"))
    return lines.withColumn("level", kind).where(F.col("level").isNotNull()).select("doc_id", "page_num", "line_no", "level", "heading")


#: Ranks of headings: a heading's parent has a smaller one.
LEVELS = ["article", "number", "paren", "kana", "paren_kana", "letter", "paren_letter"]


def heading_parents(pages: DataFrame) -> DataFrame:
    """(doc_id, page_num, line_no, level, heading, parent_page, parent_line): headings with the last heading of higher rank before them, if any.

    Pages are taken in the order of ``pos``; layout blocks are no headings, see ``block_spans``.
    """
    found = outline(pages.select(F.struct("doc_id", "pos").alias("doc_id"), "page_num", "content")).where(F.col("level") != "block")
    rank = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("level"))
    rows = found.select("doc_id.doc_id", "doc_id.pos", "page_num", "line_no", "level", "heading", rank.alias("_rank"))
    before = Window.partitionBy("doc_id").orderBy("pos", "line_no").rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct("page_num", "line_no")
    above = F.array(*[F.last(F.when(F.col("_rank") < k, place), True).over(before) for k in range(1, len(LEVELS) + 1)])
    parents = rows.withColumn("_above", above).withColumn("_p", F.get("_above", (F.col("_rank") - 1).cast("int")))
    return parents.select("doc_id", "page_num", "line_no", "level", "heading", F.col("_p.page_num").alias("parent_page"), F.col("_p.line_no").alias("parent_line"))


def block_spans(pages: DataFrame) -> DataFrame:
    """(doc_id, page_num, kind, open_line, close_line, depth) of layout blocks, from ``### --kind`` to ``### --``, lines of a page's body from 0.

    Blocks may be nested, ``depth`` from 1. A block that the page doesn't close has a null close_line; a ``### --`` that closes nothing is
    passed over, as are lines like ``### -- title --``.
    """
    lines = pages.select("doc_id", "pos", "page_num", F.posexplode(F.split(t.body_of(F.col("content")), "\n")).alias("line_no", "line"))
    kind = F.regexp_extract("line", rf"^### --((?!{t.WS}|-).*?){t.WS}*\z", 1)
    step = F.when(kind != "", 1).when(F.col("line").rlike(rf"^### --{t.WS}*\z"), -1)
    marks = lines.where(F.col("line").startswith("### --")).select("doc_id", "pos", "page_num", "line_no", kind.alias("kind"), step.alias("step")).where(F.col("step").isNotNull())
    page = Window.partitionBy("doc_id", "pos").orderBy("line_no")
    upto = page.rowsBetween(Window.unboundedPreceding, 0)
    summed = marks.withColumn("_sum", F.sum("step").over(upto))
    # Closing marks that close nothing lower the sum below all before; counted from that least sum, the depth never falls below 0.
    deep = summed.withColumn("_after", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(upto)))
    before = F.coalesce(F.lag("_after").over(page), F.lit(0))
    level = deep.withColumn("depth", F.when(F.col("step") > 0, F.col("_after")).otherwise(before)).where(F.col("depth") > 0)
    # Opening and closing marks of one depth alternate: what follows an opening one is its own.
    following = F.lead(F.when(F.col("step") < 0, F.col("line_no"))).over(Window.partitionBy("doc_id", "pos", "depth").orderBy("line_no"))
    spans = level.withColumn("close_line", following).where(F.col("step") > 0)
    return spans.select("doc_id", "page_num", "kind", F.col("line_no").alias("open_line"), "close_line", F.col("depth").cast("int").alias("depth"))
