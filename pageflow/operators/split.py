"""Splitting documents by page ranges. ``defs`` have (doc_id, entry_no, filename, start_page, end_page)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageflow.operators.intervals import in_ranges, union
from pageflow.operators.pages import renumber


def split_docs(pages: DataFrame, defs: DataFrame) -> DataFrame:
    """Pages of each entry, numbered from 1: (doc_id, entry_no, filename, pos, old_page, page_num, content).

    Pages meet entries in blocks of page numbers, so a document of very many pages and entries has many tasks. Overlapping
    entries repeat pages; entries without pages give none (see ``split_missing``). A document's ``pos`` are distinct.
    """
    entries = defs.select("doc_id", "entry_no", "filename", "start_page", "end_page")
    joined = in_ranges(pages.select("doc_id", "pos", "page_num", "content"), entries, "doc_id", "page_num", "start_page", "end_page", ["pos"])
    return renumber(joined.select("doc_id", "entry_no", "filename", "pos", "page_num", "content"), ("doc_id", "entry_no"))


def split_gaps(pages: DataFrame, defs: DataFrame) -> DataFrame:
    """(doc_id, entry_no, start_page, end_page): ranges of pages that an entry names and the document lacks.

    A gap lies between two neighbours of what the entry has, so that ranges of any length cost what the document has of them.
    Entries whose start is after their end name nothing.
    """
    asked = defs.where(F.col("start_page") <= F.col("end_page")).select("doc_id", "entry_no", "start_page", "end_page")
    held = in_ranges(pages.select("doc_id", "page_num").distinct(), asked, "doc_id", "page_num", "start_page", "end_page", ["page_num"]).select("doc_id", "entry_no", "page_num", "end_page")
    # What bounds the entry stands one before its start; what follows its last page is one past its end.
    low = asked.select("doc_id", "entry_no", (F.col("start_page").cast("long") - 1).alias("page_num"), "end_page")
    order = Window.partitionBy("doc_id", "entry_no").orderBy("page_num")
    following = F.coalesce(F.lead("page_num").over(order), F.col("end_page").cast("long") + 1)
    gaps = held.withColumn("page_num", F.col("page_num").cast("long")).unionByName(low).withColumn("next", following)
    return gaps.where(F.col("next") > F.col("page_num") + 1).select("doc_id", "entry_no", (F.col("page_num") + 1).cast("int").alias("start_page"), (F.col("next") - 1).cast("int").alias("end_page"))


def split_missing(pages: DataFrame, defs: DataFrame) -> DataFrame:
    """(doc_id, entry_no, missing): pages that an entry names and the document lacks, in order. For very long ranges take ``split_gaps``."""
    absent = split_gaps(pages, defs).select("doc_id", "entry_no", F.explode(F.sequence("start_page", "end_page")).alias("page_num"))
    return absent.groupBy("doc_id", "entry_no").agg(F.array_sort(F.collect_list("page_num")).alias("missing"))


def split_uncovered(pages: DataFrame, defs: DataFrame) -> DataFrame:
    """(doc_id, page_num) of the pages in no entry: those after the end of the last of the entries' united ranges that starts before them."""
    ranges = union(defs, "doc_id", "start_page", "end_page")
    none = F.lit(None)
    numbers = pages.select("doc_id", F.col("page_num").cast("long").alias("n"), "page_num", none.cast("long").alias("end_page")).distinct()
    both = numbers.unionByName(ranges.select("doc_id", F.col("start_page").alias("n"), none.cast("int").alias("page_num"), "end_page"))
    # At one number a range comes before a page.
    order = Window.partitionBy("doc_id").orderBy("n", F.asc_nulls_first("page_num")).rowsBetween(Window.unboundedPreceding, 0)
    reached = both.withColumn("_end", F.last("end_page", True).over(order)).where(F.col("end_page").isNull())
    return reached.where(F.col("n").isNull() | F.col("_end").isNull() | (F.col("n") > F.col("_end"))).select("doc_id", "page_num")


def split_manifest(defs: DataFrame, page_counts: DataFrame) -> DataFrame:
    """(doc_id, entry_no, source_page, target_page) with ranges clamped to (doc_id, total); entries past the end are left out."""
    clamped = defs.join(page_counts, "doc_id").withColumn("end_page", F.least("end_page", "total")).where(F.col("start_page") <= F.col("end_page"))
    return clamped.select("doc_id", "entry_no", F.posexplode(F.sequence("start_page", "end_page")).alias("i", "source_page")).select(
        "doc_id", "entry_no", "source_page", (F.col("i") + 1).alias("target_page")
    )


def coverage(defs: DataFrame) -> DataFrame:
    """(doc_id, covered): distinct pages that entries cover, by the union of their ranges."""
    ranges = union(defs, "doc_id", "start_page", "end_page")
    return ranges.groupBy("doc_id").agg(F.sum(F.col("end_page") - F.col("start_page") + 1).alias("covered"))


def pending_pages(target: DataFrame, done: DataFrame) -> DataFrame:
    """Pages of ``target`` that ``done`` lacks."""
    return target.join(done.select("doc_id", "page_num"), ["doc_id", "page_num"], "left_anti")
