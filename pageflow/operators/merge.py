"""Merging pages into flowing text, and checks of their order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageflow.functions import text as t
from pageflow.operators.pages import page_markers


def by_doc():
    """A document's pages in order."""
    return Window.partitionBy("doc_id").orderBy("pos")


def merge_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, merged): bodies joined directly where the text continues, else by a blank line.

    A page continues the one before if that one's End or its own Begin says so. Three line ends or more become two.
    Text before the first page is kept, if ``pages`` were parsed with ``keep_head``; no page continues it.
    """
    marked = page_markers(pages).withColumn("_joined", F.lag("end_continues", 1, False).over(by_doc()) | F.col("begin_continues"))
    body = t.strip_legacy(t.trim(F.regexp_replace(F.regexp_replace("content", t.BEGIN_STRICT, ""), t.END, "")))
    glue = F.when(F.col("_joined") | (F.row_number().over(by_doc()) == 1), "").otherwise("\n\n")
    parts = marked.select("doc_id", F.struct("pos", F.concat(glue, body).alias("text")).alias("p"))
    joined = parts.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["text"]), "").alias("merged"))
    return joined.withColumn("merged", F.regexp_replace("merged", "\n{3,}", "\n\n"))


def audit_sequence(pages: DataFrame) -> DataFrame:
    """(doc_id, code, page_prev, page_cur): jumps between neighbours, and a first page that isn't 1."""
    before = pages.select("doc_id", "pos", F.col("page_num").alias("page_cur"), F.lag("page_num").over(by_doc()).alias("page_prev"), F.row_number().over(by_doc()).alias("_r"))
    code = F.when((F.col("_r") > 1) & (F.col("page_cur") != F.col("page_prev") + 1), "JUMP").when((F.col("_r") == 1) & (F.col("page_cur") != 1), "FIRST_NOT_1")
    return before.withColumn("code", code).where(F.col("code").isNotNull()).select("doc_id", "code", "page_prev", "page_cur")


def audit_printed(pages: DataFrame) -> DataFrame:
    """(doc_id, code, page_prev, page_cur, printed_prev, printed_cur): printed numbers that go back or skip."""
    shown = page_markers(pages).where(F.col("printed").isNotNull())
    rows = shown.select("doc_id", F.col("page_num").alias("page_cur"), F.col("printed").alias("printed_cur"), F.lag(F.struct("page_num", "printed")).over(by_doc()).alias("b"))
    rows = rows.where(F.col("b").isNotNull()).select("doc_id", F.col("b.page_num").alias("page_prev"), "page_cur", F.col("b.printed").alias("printed_prev"), "printed_cur")
    step = F.col("printed_cur") - F.col("printed_prev")
    code = F.when(step <= 0, "REVERSED").when(step != F.col("page_cur") - F.col("page_prev"), "SUSPECT_GAP")
    return rows.withColumn("code", code).where(F.col("code").isNotNull())


def find_boundaries(pages: DataFrame, title: str = r"(?m)^# |\(--# ") -> DataFrame:
    """(doc_id, entry_no, start_page, end_page): documents inside a bundle; one starts at a titled page that nothing runs into."""
    rank = F.row_number().over(by_doc())
    marked = page_markers(pages).withColumn("_before", F.lag("end_continues", 1, False).over(by_doc())).withColumn("_r", rank)
    starts = F.col("content").rlike(title) & ~F.col("_before")
    numbered = marked.withColumn("_s", starts).withColumn("entry_no", F.sum(F.when(F.col("_s") | (F.col("_r") == 1), 1).otherwise(0)).over(by_doc()).cast("int"))
    return numbered.groupBy("doc_id", "entry_no").agg(F.min("page_num").alias("start_page"), F.max("page_num").alias("end_page"))
