"""Operator 8: sharding by a k-d tree over document metadata.

A node that is to become k shards is split along its widest metadata dimension at the weighted quantile that
gives one side its share of the bytes, until each leaf is one shard of about the target bytes. Quantiles come
from histograms that are refined around the wanted weight; the driver sees a row a node. DataFrame functions only.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageflow.llm.common import cut, running_total

#: Bits of a dimension's value, of what orders equal values, and of these those that part equal rows; histogram bins of a refinement.
VALUE_BITS, TIE_BITS, COPY_BITS, BINS = 20, 40, 20, 4096
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def document_size(text: Column) -> Column:
    """UTF-8 bytes of a text, none for null, plus 8."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def _keys(docs: DataFrame, dimensions: list[str]) -> DataFrame:
    """Add ``_keys``: for each dimension its value, scaled to VALUE_BITS, followed by TIE_BITS: a hash of doc_id and text, then one of the row's place.

    Numbers are scaled between the table's least and largest (nulls and NaN lowest), other values by their hash.
    """
    kinds = dict(docs.dtypes)
    numeric = [d for d in dimensions if kinds[d] in NUMBERS]
    as_number = lambda d: F.when(~F.isnan(F.col(d).cast("double")), F.col(d).cast("double"))
    top = 1 << VALUE_BITS
    bounds = docs.agg(*[f(as_number(d)).alias(f"{n}_{i}") for i, d in enumerate(numeric) for n, f in (("lo", F.min), ("hi", F.max))]).first() if numeric else {}
    values = []
    for d in dimensions:
        if d in numeric:
            i = numeric.index(d)
            low, high = bounds[f"lo_{i}"], bounds[f"hi_{i}"]
            if low is None or not high > low or high - low == float("inf"):
                values.append(F.lit(0))
            else:
                values.append(F.coalesce(F.least(F.floor((as_number(d) - low) / (high - low) * (top - 1)), F.lit(top - 1)), F.lit(0)))
        else:
            values.append(F.when(F.col(d).isNull(), 0).otherwise(F.pmod(F.xxhash64(F.col(d).cast("string")), F.lit(top))))
    hashed = F.pmod(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))), F.lit(1 << (TIE_BITS - COPY_BITS)))
    # Only rows that are equal in all else are told apart by their places, and any of them may go anywhere.
    tie = hashed * (1 << COPY_BITS) + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << COPY_BITS))
    return docs.withColumn("_keys", F.array(*[(v.cast("long") * (1 << TIE_BITS) + tie).cast("long") for v in values]))


def _small(rows: DataFrame, table: list[tuple], schema: str) -> DataFrame:
    """A driver-made table of one row a node, small enough for each task; Arrow brings it to the JVM directly."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    columns = {n: pa.array([r[i] for r in table], kinds[t]) for i, (n, t) in enumerate(fields)}
    return F.broadcast(rows.sparkSession.createDataFrame(pa.table(columns)))


def _quantiles(rows: DataFrame, nodes: dict[int, dict]) -> dict[int, int]:
    """For each node the key that splits its weight nearest to ``want``: rows up to it go left."""
    open_ = {n: dict(x, base=0) for n, x in nodes.items()}
    done: dict[int, int] = {}
    while open_:
        table = [(n, x["dim"], x["lo"], x["hi"], max(1, -(-(x["hi"] - x["lo"] + 1) // BINS)), float(x["want"] - x["base"])) for n, x in open_.items()]
        inside = rows.join(_small(rows, table, "node int, dim int, lo long, hi long, step long, want double"), "node")
        inside = inside.withColumn("_key", F.get("_keys", F.col("dim"))).where(F.col("_key").between(F.col("lo"), F.col("hi")))
        bins = inside.groupBy("node", "want", F.call_function("div", F.col("_key") - F.col("lo"), F.col("step")).alias("bin")).agg(F.sum("size").alias("w"))
        order = Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        crossed = bins.withColumn("upto", F.sum("w").over(order)).where(F.col("upto") >= F.col("want"))
        first = crossed.groupBy("node").agg(F.min_by(F.struct("bin", "w", "upto"), "bin").alias("x")).select("node", "x.*").collect()
        found = {r["node"]: r for r in first}
        step = {t[0]: t[4] for t in table}
        for n in list(open_):
            x, r = open_[n], found.get(n)
            if r is None:  # rounding: all weight lies before
                done[n] = x["hi"]
                del open_[n]
                continue
            before = x["base"] + r["upto"] - r["w"]
            low = x["lo"] + r["bin"] * step[n]
            high = min(x["hi"], low + step[n] - 1)
            if step[n] == 1 or r["w"] <= x["weight"] / 20_000:
                right_of = before + r["w"] - x["want"]
                done[n] = high if right_of <= x["want"] - before else low - 1
                del open_[n]
            else:
                x.update(lo=low, hi=high, base=before)
    return done


def kd_tree(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, dimensions=("source", "lang", "n_chars", "doc_id"), max_shards: int = 1_000_000) -> DataFrame:
    """``docs`` with ``size`` and ``shard``, from 0: as many shards as given, or enough for ``target_bytes`` each.

    ``docs`` needs doc_id and text; dimensions that it lacks are left out. Any column may hold nulls: they come
    lowest. Equal values are parted by a hash of the row, and equal rows by their places in the input, so that neither a value that most rows
    share nor a row that is there very often makes a shard too large. Texts are never shuffled. Empty tables give
    empty tables, and there may be empty shards where rows are few. Columns named ``size`` and ``shard`` are replaced.
    """
    if (shards is None) == (target_bytes is None) or (shards or target_bytes) < 1:
        raise ValueError("give shards or target_bytes, at least 1")
    rest = docs.drop("size", "shard", "_keys", "node")
    dims = [d for d in dimensions if d in rest.columns] or ["doc_id"]
    keyed = _keys(rest, dims).withColumn("size", document_size(F.col("text")))
    rows = cut(keyed.select("_keys", "size").withColumn("node", F.lit(0)))
    if shards is None:
        total = rows.agg(F.sum("size")).first()[0] or 0
        shards = max(1, -(-total // target_bytes))
    if shards > max_shards:
        raise ValueError(f"{shards} shards; at most {max_shards} are made")
    parts = {0: (shards, 0)}  # node -> (its shards, the first of them)
    splits: list[list[tuple]] = []
    while any(k > 1 for k, _ in parts.values()):
        widths = [F.struct(F.min(F.get("_keys", F.lit(i))).alias("lo"), F.max(F.get("_keys", F.lit(i))).alias("hi")) for i in range(len(dims))]
        seen = {r["node"]: r for r in rows.groupBy("node").agg(F.sum("size").alias("weight"), F.array(*widths).alias("range")).collect()}
        nodes = {}
        for n, (k, _) in parts.items():
            if k > 1 and n in seen:
                r = seen[n]["range"]
                dim = max(range(len(dims)), key=lambda i: ((r[i]["hi"] >> TIE_BITS) - (r[i]["lo"] >> TIE_BITS), -i))
                nodes[n] = {"dim": dim, "lo": r[dim]["lo"], "hi": r[dim]["hi"], "weight": seen[n]["weight"], "want": seen[n]["weight"] * (k // 2) / k}
        places = _quantiles(rows, nodes)
        table, after = [], {}
        for n, (k, first) in parts.items():
            left, right = 2 * n + 1, 2 * n + 2
            if k == 1:
                after[n] = (k, first)
                continue
            table.append((n, nodes[n]["dim"] if n in nodes else 0, places.get(n, -1), left, right))
            after[left], after[right] = (k // 2, first), (k - k // 2, first + k // 2)
        splits.append(table)
        rows = _descend(rows, table)
        parts = after
    placed = keyed.withColumn("node", F.lit(0))
    for table in splits:
        placed = _descend(placed, table)
    names = _small(placed, [(n, first) for n, (_, first) in parts.items()], "node int, shard int")
    return placed.join(names, "node").select(*rest.columns, "size", "shard")


def _descend(rows: DataFrame, table: list[tuple]) -> DataFrame:
    """Move rows from split nodes to their children."""
    small = _small(rows, table, "node int, _dim int, _cut long, _left int, _right int")
    child = F.when(F.get("_keys", F.col("_dim")) <= F.col("_cut"), F.col("_left")).otherwise(F.col("_right"))
    moved = rows.join(small, "node", "left").withColumn("node", F.when(F.col("_dim").isNull(), F.col("node")).otherwise(child))
    return moved.select(*rows.columns)


def numbered(sharded: DataFrame) -> DataFrame:
    """Add ``text_crc32`` and ``slot``: gapless numbers from 0 within each shard, in a fixed order."""
    ready = sharded.withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")))).withColumn("_one", F.lit(1).cast("long"))
    return running_total(ready, ["shard"], ["doc_id", "text_crc32", "size"], "_one", "slot").drop("_one")


def op8_query(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sharded = kd_tree(docs, shards=24)
    small = cut(sharded.select("doc_id", "size", "shard", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit(1).cast("long").alias("_one")))
    slots = running_total(small, ["shard"], ["doc_id", "text_crc32", "size"], "_one", "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
