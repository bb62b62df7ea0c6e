"""Operator 9: benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into windows of consecutive words, and a window into short shingles. A document
holds a window only if it holds all of its shingles, so one necessary prefix token suffices to find candidates:
the window's rarest shingle in the corpus. Candidates must fit the document (the window starts at its first word or later and
ends at its last or before) and are verified word by word. Everything is DataFrame functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageflow.llm.common import ascii_lower, cut, stored

#: What separates words, after A-Z were lowered: every ASCII character but digits and a-z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A benchmark with at most so many shingles is sent to all executors; a larger one is joined by shuffling.
BROADCAST_SHINGLES = 2_000_000
#: The ids of so many documents with places to look at are sent to all executors at most.
BROADCAST_DOCS = 2_000_000


def words_of(text: Column) -> Column:
    """Words of a text as an array; null gives an empty one."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def n_words_of(text: Column) -> Column:
    """How many words ``words_of`` gives, without making them."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")


def _at(words: Column, i: Column, k: int) -> list[Column]:
    return [F.get(words, i + j) for j in range(k)]


def _positions(words: Column, k: int) -> Column:
    """Positions from 0 at which k words follow."""
    last = F.size(words) - k
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _hashes(words: Column, k: int) -> Column:
    """Hash of the shingle of k words at each position."""
    return F.transform(_positions(words, k), lambda i: F.xxhash64(*_at(words, i, k)))


def benchmark_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """Distinct windows: (item_id, words, n); an item of fewer words is one window, one without words none."""
    words = benchmark.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    return (
        words.select("item_id", "w", F.explode(starts).alias("s"))
        .select("item_id", F.slice("w", F.col("s") + 1, window).alias("words"))
        .distinct()
        .withColumn("n", F.size("words"))
    )


def find_windows(docs: DataFrame, benchmark: DataFrame, window: int = 13, shingle: int = 3) -> DataFrame:
    """Where benchmark windows occur: (doc_id, text_hash, start, n, item_id), one row for each.

    Documents are told apart by (doc_id, xxhash64 of the text), so repeated rows are found once. Null and empty
    texts and items hold nothing. An item without an id marks hits but is not listed. A third of all documents may hold the same
    passage: no step gathers a passage's documents. The corpus is read twice, once to count the benchmark's shingles and once to
    look for one anchor a window, the rarest of them; a document's words are compared where the anchor says that the window starts.
    """
    if window < 1 or shingle < 1:
        raise ValueError("window and shingle must be positive")
    parts = cut(
        benchmark_windows(benchmark, window)
        .withColumn("k", F.least(F.lit(shingle), F.col("n")))
        .groupBy("words", "n", "k")
        .agg(F.array_sort(F.collect_set("item_id")).alias("items"))
        .withColumn("window_id", F.sha2(F.concat_ws(" ", "words"), 256))
    )
    lengths = [r["k"] for r in parts.select("k").distinct().orderBy("k").collect()]  # at most ``shingle`` rows
    text = F.coalesce(F.col("text"), F.lit(""))
    source = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), words_of(F.col("text")).alias("w"))
    if not lengths:
        return source.where(F.lit(False)).select("doc_id", "text_hash", F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit(None).cast(dict(benchmark.dtypes)["item_id"]).alias("item_id"))
    each = [parts.where(F.col("k") == k).select("window_id", "k", F.posexplode(_hashes(F.col("words"), k)).alias("at", "hash")) for k in lengths]
    need = cut(reduce(DataFrame.unionByName, each))
    small = need.count() <= BROADCAST_SHINGLES
    sent = F.broadcast if small else (lambda df: df)
    # The outer form keeps Spark from testing the whole array in a filter of its own before it is exploded.
    at = lambda k: F.posexplode_outer(_hashes(F.col("w"), k)).alias("pos", "hash")

    # Counted by hash, so that map tasks hand on a row a shingle; equal hashes only change which anchor is taken.
    counted = [source.select(at(k)).select("hash").join(sent(need.where(F.col("k") == k).select("hash").distinct()), "hash").groupBy("hash").agg(F.count("*").alias("count")) for k in lengths]
    frequency = cut(reduce(DataFrame.unionByName, [c.withColumn("k", F.lit(k)) for c, k in zip(counted, lengths, strict=True)]))
    rarity = Window.partitionBy("window_id").orderBy("count", "at")
    anchors = (
        need.join(frequency, ["k", "hash"], "left").na.fill(0, ["count"])
        .withColumn("rank", F.row_number().over(rarity)).where((F.col("rank") == 1) & (F.col("count") > 0))  # a window with a shingle that no document has occurs nowhere
        .join(parts.select("window_id", "n", "words"), "window_id")
        .select("hash", "k", F.col("at").alias("anchor"), "n", "words", "window_id")
    )
    anchors = cut(anchors)
    # Exploded rows are small: a document's words beside each of its positions would be copied for every one.
    start = (F.col("pos") - F.col("anchor")).alias("start")
    places = [source.select("doc_id", "text_hash", F.size("w").alias("size"), at(k)).join(sent(anchors.where(F.col("k") == k)), "hash").select("doc_id", "text_hash", "size", start, "n", "words", "window_id") for k in lengths]
    places = reduce(DataFrame.unionByName, places).where((F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.col("size")))
    by_doc = places.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "n", "words", "window_id")).alias("places"))
    by_doc = stored(by_doc.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "places"), "decontaminate-places")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    texts, ids = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), "text"), by_doc.select("_id", "_hash")
    if ids.count() <= BROADCAST_DOCS:  # only texts with places are shuffled to them
        texts = texts.join(F.broadcast(ids), same, "left_semi")
    held = texts.join(by_doc, same).select("doc_id", "text_hash", "places", words_of(F.col("text")).alias("w"))
    # The words come out of a generator, so that the lambda below doesn't part the text again for every place.
    held = held.select("doc_id", "text_hash", "places", F.explode(F.array("w")).alias("w"))
    right = F.filter("places", lambda p: F.slice("w", p["start"] + 1, p["n"]) == p["words"])
    hits = held.select("doc_id", "text_hash", F.explode(right).alias("p")).select("doc_id", "text_hash", "p.start", "p.n", "p.window_id").distinct()
    return hits.join(parts.select("window_id", F.explode_outer("items").alias("item_id")), "window_id").select("doc_id", "text_hash", "start", "n", "item_id")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, percent: int = 5, shingle: int = 3) -> DataFrame:
    """Rows of ``docs`` with n_words, n_hit, n_items, items and contaminated.

    A word inside any occurrence of a window is hit; a document is contaminated when it has hits and they are
    at least ``percent`` of its words. Null and empty texts have no words and are clean. Repeated rows are
    judged alike. Columns of ``docs`` with the names above are replaced; other columns stay.
    """
    spans = find_windows(docs, benchmark, window, shingle)
    covered = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end")))),
        F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("words")),
        lambda a, s: F.struct(
            F.greatest(a["to"], s["end"]).alias("to"),
            (a["words"] + F.greatest(s["end"] - F.greatest(a["to"], s["start"]), F.lit(0))).cast("long").alias("words"),
        ),
        lambda a: a["words"],
    )
    found = spans.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(
        covered.alias("n_hit"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
    )
    rest = docs.drop("n_words", "n_hit", "n_items", "items", "contaminated", "_hash", "_id")
    keyed = rest.withColumn("_hash2", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("n_words", n_words_of(F.col("text")))
    return (
        keyed.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash2") == F.col("_hash")), "left")
        .withColumn("n_hit", F.coalesce("n_hit", F.lit(0)).cast("long"))
        .withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(100) * F.col("n_hit") >= F.lit(percent) * F.col("n_words")))
        .select(*rest.columns, "n_words", "n_hit", "n_items", "items", "contaminated")
    )


def op9_query(spark, sf_dir: str) -> DataFrame:
    """Contamination of every document by the whole benchmark."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    digest = F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")
