"""A corpus pipeline of five stages; each stage's rows are written and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageflow.llm import decontaminate, jaccard, langid, mix, shard
from pageflow.llm.common import TEXT_ROWS, WORD, new_folder, scratch

#: SQL can't express compression, multinomial draws or k-d trees; the stages are tested against plain forms.
ORACLE_SQL = None


def without(docs: DataFrame, names: list[str]) -> tuple[DataFrame, list]:
    """``docs`` with columns of these names put aside, and what brings all columns back under their own names."""
    new = {c: f"_own_{i}" if c in names else c for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in new.items()]), [F.col(f"`{n}`").alias(c) for c, n in new.items()]


def small_batches(spark: SparkSession) -> None:
    """Have whole texts sent to Python workers by a thousand: ten thousand long ones take an executor hundreds of MB beside its heap.

    The setting stays: a stage's rows are computed after it has returned them.
    """
    spark.conf.set(*TEXT_ROWS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is told with a margin; what the classifier rejects goes.

    Null texts and texts without a letter are rejected, as are ties between languages; without any labelled row all are. Repeated rows
    are judged alike, whole texts of any length are read, an empty table stays empty. Columns named as the classifier's keep their values.
    """
    small_batches(spark)
    dictionaries = langid.fit_dictionaries(docs.where(langid.training_rows(docs)))
    rows, back = without(docs, ["lang_pred", "score", "rejected"])
    return langid.identify_language(rows, dictionaries).where(~F.col("rejected")).select(*back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of similar ones: that with the smallest doc_id, then the smallest hash of the text.

    Groups link at a Jaccard similarity of 0.8 over five-word shingles. A document is a doc_id and a text: different texts under one
    doc_id are different documents, repeated rows are one and stay once (of rows that differ in other columns the one with the least hash), and a document without a doc_id stays only where its
    group has none with one. Rows without words (null, empty or blank texts) are in no group and all stay. An empty
    table stays empty; other columns play no part.
    """
    found = jaccard.similar_components(docs, k=5, percent=80)
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    stay = found.where(F.col("n_shingles") > 0).groupBy("component").agg(F.min(place).alias("p")).select(F.col("p.doc_id").alias("_id"), F.col("p.text_hash").alias("_stay"))
    keyed, back = without(docs, ["_hash", "_id", "_stay"])
    keyed = keyed.withColumn("_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    has_words = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    kept = keyed.where(has_words).join(stay, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_stay")), "left_semi")
    # Of rows equal in doc_id and text but not in all columns, the one with the least hash of all stays, in every run.
    every = F.struct(*keyed.columns)
    once = kept.groupBy("doc_id", "_hash").agg(F.min_by(every, F.xxhash64(*keyed.columns)).alias("_row")).select("_row.*")
    return once.unionByName(keyed.where(~has_words)).select(*back)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the benchmark doesn't contaminate.

    Null, empty and wordless texts are clean; so are all if the benchmark is empty. Repeated rows are judged alike, whole texts are
    read. Columns named as the operator's keep their values.
    """
    rows, back = without(docs, ["n_words", "n_hit", "n_items", "items", "contaminated", "_hash", "_hash2", "_id"])
    found = decontaminate.contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(~F.col("contaminated")).select(*back)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mix the sources to their target weights; a row for each piece of text that the mix takes, with the columns of ``docs``.

    Rows without words (null, empty or blank texts) are in no piece. Null is a source of its own. Rows equal in doc_id, source and text
    count as often as they occur. A very long text gives many pieces; an empty table stays empty.
    """
    small_batches(spark)
    rows, back = without(docs, ["_hash", "_id", "_source", "_parts", "source_no", "text_hash"])
    return mix.Mix(rows).documents().select(*back)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deal the rows to 24 shards of near equal bytes: all rows of ``docs`` with ``size`` and ``shard``.

    Nulls come first in each dimension, equal values are parted by a hash of the row, rows equal in doc_id and text stay together.
    Columns named ``size`` and ``shard`` are replaced; an empty table stays empty.
    """
    return shard.kd_tree(docs, shards=24)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_free),
    ("mixing", mixed),
    ("sharding", sharded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, the rows between two stages kept in the shared folder. Other columns and rows as the stages say."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, f"pipeline-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
