"""Connected components by alternating star contraction, on tables of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageflow.llm.common import delete_folder, new_folder, stored, stored_at


def _smallest(links: DataFrame) -> DataFrame:
    """(u, m): the smallest id among u and what it links to."""
    return links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _is_forest(pairs: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u: then v is u's component."""
    ends = pairs.select(F.col("u").alias("id"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(pairs.select(F.col("v").alias("id"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    sums = ends.groupBy("id").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return sums.where((F.col("below") > 1) | ((F.col("below") == 1) & (F.col("above") == 1))).isEmpty()


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable from each id that occurs in ``links``.

    Each round joins every node's neighbours to the smallest one: first the larger ones (large star), then the
    smaller ones (small star); it ends when all nodes hang from their smallest. Links are aggregated before they are shuffled, and
    a node with very many links is a join key, which adaptive execution can split. Self links name a node
    without joining it; null ends are left out. Links stay in tables: the driver gets one truth value a round.
    """
    spark = links.sparkSession
    both = stored(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull()).distinct(), "links")
    path = new_folder(spark, "stars")
    pairs = stored_at(both.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), path)
    for _ in range(max_rounds):
        if _is_forest(pairs):
            break
        ways = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = ways.join(_smallest(ways), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        low = _smallest(large)
        small = (
            large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .where(F.col("u") != F.col("v"))
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            .distinct()
        )
        before, path = path, new_folder(spark, "stars")
        pairs = stored_at(small, path)
        delete_folder(spark, before)
    else:
        raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    every = both.select(F.explode(F.array("u", "v")).alias("id"), F.lit(None).cast(both.schema["v"].dataType).alias("component"))
    named = every.unionByName(pairs.select(F.col("u").alias("id"), F.col("v").alias("component")))
    return named.groupBy("id").agg(F.coalesce(F.min("component"), F.col("id")).alias("component"))


def joined_components(found: DataFrame, links: DataFrame) -> DataFrame:
    """``found`` (id, component) after further links (a, b) have joined components and added ids."""
    at = lambda end: F.coalesce(F.col(f"{end}.component"), F.col(f"l.{end}"))
    named = links.alias("l").join(found.alias("a"), F.col("l.a") == F.col("a.id"), "left").join(found.alias("b"), F.col("l.b") == F.col("b.id"), "left")
    new = stored(named.select(at("a").alias("a"), at("b").alias("b")).distinct(), "links")
    if new.where(F.col("a") != F.col("b")).isEmpty():
        alone = new.select(F.col("a").alias("id"), F.col("a").alias("component"))
        return found.unionByName(alone.join(found.select("component").distinct(), "component", "left_anti").select("id", "component").distinct())
    merged = connected_components(new)
    known = found.withColumnRenamed("component", "old").unionByName(merged.select("id", F.col("id").alias("old"))).distinct()
    return known.join(merged.select(F.col("id").alias("old"), "component"), "old", "left").groupBy("id").agg(F.min(F.coalesce("component", "old")).alias("component"))
