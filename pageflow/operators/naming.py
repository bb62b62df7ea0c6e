"""Names for documents: excerpts to judge them by, decisions read from answers, clean and unique file names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageflow.functions import text as t
from pageflow.operators.pages import head_tail, parse_pages, render_pages
from pageflow.sources.folders import new_folder

#: The document types that a decision may name, and what stands for no title.
TYPES = ["図書", "記事", "ちらし", "パンフレット", "書簡", "証憑", "帳票", "契約", "法務", "会議資料", "報告資料", "その他"]
OTHER, NO_TITLE, TITLE_CHARS = "その他", "表題不明", 80
OUTPUTS = ["_paged.md", "_ERROR_paged.md", "_merged.md", "_ERROR_merged.md"]
#: Fixed value: what a document's job state adds to its path.
STATE = ".batch_state.txt"
#: A name with a number behind it.
NUMBERED = r"^(.*) \(([1-9]\d*)\)\z"


def sanitize_title(title: Column) -> Column:
    """A title fit for a file name: 80 characters at most, a fixed one if nothing is left."""
    value = F.regexp_replace(t.normalize_ws(title), r'[<>:"/\\|?*\x00-\x1F]', " ")
    value = F.regexp_replace(F.regexp_replace(value, "_+", " "), rf"{t.WS}{{2,}}", " ")
    value = F.regexp_replace(F.regexp_replace(value, rf"^(?:{t.WS}|\.)+", ""), rf"(?:{t.WS}|\.)++\z", "")
    value = F.when(F.length(value) > TITLE_CHARS, t.trim(F.left(value, F.lit(TITLE_CHARS)))).otherwise(value)
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(NO_TITLE))


def normalize_date(raw: Column, run_date: str) -> Column:
    """YYYY-MM-DD with 00 for an unknown month or day; anything else becomes ``run_date``. Days aren't checked by month."""
    value = t.trim(F.coalesce(raw, F.lit("")))
    part = lambda i: F.regexp_extract(value, r"^(\d{4})-(\d{2})-(\d{2})\z", i)
    fine = value.rlike(r"^\d{4}-\d{2}-\d{2}\z") & (part(1) != "0000") & (part(2).try_cast("int") <= 12) & (part(3).try_cast("int") <= 31)
    return F.when(fine, value).otherwise(F.lit(run_date))


def parse_decision(df: DataFrame, run_date: str, column: str = "raw") -> DataFrame:
    """Add date, document_type and title from an answer: fenced or bare JSON, else its first line as title."""
    value = t.trim(F.coalesce(F.col(column), F.lit("")))
    fenced = F.regexp_extract(value, r"(?is)^```(?:json)?\s*(.*?)\s*```\z", 1)
    clean = F.when(value.rlike(r"(?is)^```(?:json)?\s*.*?\s*```\z"), t.trim(fenced)).otherwise(value)
    schema = "date string, documentType string, type string, title string, documentTitle string, name string"
    options = {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}
    out = df.withColumn("_clean", clean).withColumn("_object", F.regexp_extract("_clean", r"(?s)\{.*\}", 0))
    json = F.coalesce(F.when(t.is_json(F.col("_object")), F.col("_object")), F.when(t.is_json(F.col("_clean")), F.col("_clean")))
    # A list has no fields, but would be read as its first element.
    out = out.withColumn("_json", json).withColumn("_d", F.from_json(F.when(F.col("_json").startswith("{"), F.col("_json")), schema, options))
    kind = F.when(F.col("_d.documentType").isin(*TYPES), F.col("_d.documentType")).when(F.col("_d.type").isin(*TYPES), F.col("_d.type")).otherwise(OTHER)
    first = F.coalesce(*[F.nullif(F.col(f"_d.{c}"), F.lit("")) for c in ("title", "documentTitle", "name")], F.lit(""))
    read = F.col("_json").isNotNull()
    out = out.withColumn("date", F.when(read, normalize_date(F.col("_d.date"), run_date)).otherwise(F.lit(run_date)))
    out = out.withColumn("document_type", F.when(read, kind).otherwise(OTHER))
    out = out.withColumn("title", sanitize_title(F.when(read, first).otherwise(F.get(F.split("_clean", "\n"), F.lit(0)))))
    return out.drop("_clean", "_object", "_json", "_d")


def is_named(path: Column) -> Column:
    """Whether a file's stem already is date_type_title."""
    stem = F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"(?<=.)\.[^.]*\z", "")
    return stem.rlike(r"^\d{4}-\d{2}-\d{2}_[^_]+_.+\z")


def excerpt(docs: DataFrame) -> DataFrame:
    """(doc_id, excerpt): first and last four pages of either dialect, else the text's ends."""
    pages = render_pages(head_tail(parse_pages(docs))).withColumnRenamed("content", "_a")
    dashes = render_pages(head_tail(parse_pages(docs, dialect="dash"))).withColumnRenamed("content", "_b")
    joined = docs.join(pages, "doc_id", "left").join(dashes, "doc_id", "left")
    return joined.select("doc_id", F.coalesce(F.nullif("_a", F.lit("")), F.nullif("_b", F.lit("")), t.head_tail_text(F.col("content"))).alias("excerpt"))


def stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*\z", "")


def candidate_paths(path: Column) -> Column:
    """Files that may hold a document's text: itself and its outputs, without repeats, in order."""
    return F.array_distinct(F.array(path, *[F.concat(stem(path), F.lit(s)) for s in OUTPUTS]))


def companion_files(docs: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, path, kind, output): the outputs that exist for each document. ``files`` have path."""
    every = docs.select("doc_id", "path", F.posexplode(F.array(*[F.lit(s) for s in OUTPUTS])).alias("kind", "suffix"))
    wanted = every.withColumn("output", F.concat(stem(F.col("path")), F.col("suffix")))
    return wanted.join(files.select(F.col("path").alias("output")).distinct(), "output").select("doc_id", "path", "kind", "output")


def excerpt_source(preferred: DataFrame, companions: DataFrame) -> DataFrame:
    """(doc_id, excerpt): the first that isn't empty: the preferred one, then by kind. Inputs have (doc_id[, kind], excerpt)."""
    both = preferred.select("doc_id", F.lit(-1).alias("kind"), "excerpt").unionByName(companions.select("doc_id", "kind", "excerpt"))
    return both.where(F.col("excerpt") != "").groupBy("doc_id").agg(F.min_by("excerpt", "kind").alias("excerpt"))


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Add ``out``: the number from 1 of each row among those with its ``keys``, in ``order``.

    Rows are dealt to tasks by ranges of key and order, so that a key of very many rows has several; a task numbers its own rows,
    and the numbers start where those of the ranges before end. Ties in ``order`` are numbered in any order.
    """
    spark = df.sparkSession
    path = new_folder(spark, "numbered")
    df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()).write.parquet(path)  # ranges are drawn once
    dealt = spark.read.parquet(path)
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*keys, "_range").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    return dealt.withColumn("_own", own).join(starts, [*keys, "_range"]).withColumn(out, F.col("_start") + F.col("_own")).select(*df.columns, out)


def state_file(path: Column) -> Column:
    return F.concat(path, F.lit(STATE))


def _blocked(existing: DataFrame) -> DataFrame:
    """(_stem, _ext) in lower case that no new document may bear; a null ``_ext`` stands for all.

    A file's own name is one; an output blocks all documents of its stem, a job's state that document.
    """
    path = F.lower("target")
    parted = lambda p: (stem(p).alias("_stem"), F.regexp_extract(p, r"(\.[^./]*)?\z", 0).alias("_ext"))
    files = existing.select(path.alias("p")).distinct()
    outputs = "(" + "|".join(re.escape(o.lower()) for o in OUTPUTS) + r")\z"
    states = files.where(F.col("p").endswith(STATE)).select(F.expr(f"left(p, length(p) - {len(STATE)})").alias("p"))
    names = files.unionByName(states).select(*parted(F.col("p")))
    stems = files.where(F.col("p").rlike(outputs)).select(F.regexp_replace("p", r"(_error)?_(paged|merged)\.md\z", "").alias("_stem"), F.lit(None).cast("string").alias("_ext"))
    # "_error_paged.md" also ends like "_paged.md": the stem with "_error" is then blocked, too.
    both = files.where(F.col("p").rlike(outputs)).select(F.regexp_replace("p", r"_(paged|merged)\.md\z", "").alias("_stem"), F.lit(None).cast("string").alias("_ext"))
    return names.unionByName(stems).unionByName(both).distinct()


def unique_names(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """(path, target): first takers keep a name, later ones get `` (2)``, `` (3)`` ….

    ``wanted`` have (path, folder, name, ext), ``existing`` (target): all files that are there. A name is taken if the file itself,
    one of its outputs or its job state exists. A document that bears its name already keeps it. Names are compared without
    case; documents are served by path. A numbered name may be another document's own: numbers that a wanted or existing name
    bears are passed over, so one round settles all. Paths are unique; very many documents may want one name: no task holds
    them all. Outputs that two documents of one stem would share are told by ``rename_plan``.
    """
    base, key = F.concat_ws("/", "folder", "name"), ["_base", "_ext"]
    rows = wanted.withColumn("_base", F.lower(base)).withColumn("_ext", F.lower("ext"))
    at_home = F.lower("path") == F.concat("_base", "_ext")
    stay, move = rows.where(at_home), rows.where(~at_home)
    groups = move.select(*key).distinct()
    # Numbers that a group's documents can't have: of files that exist, and of names that documents bear or (from 2) want.
    blocked = _blocked(existing)
    borne = stay.select(F.col("_base").alias("_stem"), "_ext").distinct()
    want = rows.select(F.col("_base").alias("_stem"), "_ext").distinct()
    first = blocked.unionByName(borne).select(F.col("_stem").alias("_base"), F.col("_ext").alias("_e"), F.lit(1).cast("long").alias("_no"))
    part = lambda i: F.regexp_extract("_stem", NUMBERED, i)
    later = blocked.unionByName(want).where(F.col("_stem").rlike(NUMBERED)).select(part(1).alias("_base"), F.col("_ext").alias("_e"), part(2).try_cast("long").alias("_no"))
    busy = first.unionByName(later.where(F.col("_no") >= 2)).join(groups, "_base").where(F.col("_e").isNull() | (F.col("_e") == F.col("_ext")))
    # Before the i-th taken number b there are b - i free ones. A document of rank r gets r plus the taken numbers with fewer
    # free ones before them than r: its place in one order of ranks and taken numbers.
    passed = numbered(busy.select(*key, "_no").distinct(), key, ["_no"], "_i").select(*key, (F.col("_no") - F.col("_i")).alias("_v"), F.lit(1).alias("_kind"), F.lit(None).cast("string").alias("path"))
    ranks = numbered(move.select(*key, "path"), key, ["path"], "_v").select(*key, "_v", F.lit(0).alias("_kind"), "path")
    places = numbered(ranks.unionByName(passed), key, ["_v", "_kind"], "_no").where(F.col("_kind") == 0).select("path", "_no")
    number = F.when(F.col("_no") == 1, "").otherwise(F.concat(F.lit(" ("), F.col("_no").cast("string"), F.lit(")")))
    named = move.join(places, "path").select("path", F.concat_ws("/", "folder", F.concat("name", number, "ext")).alias("target"))
    return named.unionByName(stay.select("path", F.concat_ws("/", "folder", F.concat("name", "ext")).alias("target")))


def rename_plan(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """(source, target, clash): renames of documents, their outputs and their job state, where the source exists.

    ``pairs`` have (path, target), ``files`` all paths that are there. Renames to the same name (without case) are left out;
    ``clash`` marks targets that two rows share or that exist already.
    """
    outputs = F.array(*[F.struct(F.concat(stem(F.col("path")), F.lit(s)).alias("source"), F.concat(stem(F.col("target")), F.lit(s)).alias("target")) for s in OUTPUTS])
    state = F.array(F.struct(state_file(F.col("path")).alias("source"), state_file(F.col("target")).alias("target")))
    every = pairs.select(F.inline(F.concat(F.array(F.struct(F.col("path").alias("source"), "target")), outputs, state)))
    there = every.where(F.lower("source") != F.lower("target")).join(files.select(F.col("path").alias("source")).distinct(), "source", "left_semi")
    counts = there.groupBy(F.lower("target").alias("_key")).agg((F.count("*") > 1).alias("_shared"))
    taken = files.select(F.lower("path").alias("_key"), F.lit(True).alias("_taken")).distinct()
    joined = there.withColumn("_key", F.lower("target")).join(counts, "_key").join(taken, "_key", "left")
    return joined.select("source", "target", (F.col("_shared") | F.coalesce("_taken", F.lit(False))).alias("clash"))
