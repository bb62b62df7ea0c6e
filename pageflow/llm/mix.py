"""Operator 2: mixing sources to target weights.

The words of each source form one stream that is packed into blocks of fixed length. Each output shard draws
multinomial source counts; the slots of a source, numbered over all shards, run through a pseudorandom
permutation of its blocks, and slots and blocks are joined by (source, block).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageflow.llm.common import cut, running_total, word_count

MASK = (1 << 64) - 1


def targets(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """Share ``total`` by weight; what exceeds ``cap`` times a size is shared anew among the others."""
    out = [0.0] * len(sizes)
    open_, left = [i for i, s in enumerate(sizes) if s > 0], float(total)
    while open_ and left > 0:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * unit > cap * sizes[i]]
        if not full:
            for i in open_:
                out[i] = weights[i] * unit
            break
        for i in full:
            out[i] = float(cap * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def draw(slots: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Source counts of one output shard, and how many slots of each source come in earlier shards.

    ``slots`` has each source's slots over all shards. Halves of the shards split them again and again: the
    left half draws multinomial counts in proportion to what is left of each source, and a draw above what is
    left or below what the right half can hold is moved by the least amount. Every shard follows the same path
    from the same seeds, so shards need nothing from each other and all slots are dealt.
    """
    left, before = slots.astype(np.int64).copy(), np.zeros(len(slots), dtype=np.int64)
    low, high = 0, shards
    while high - low > 1:
        middle = (low + high) // 2
        total = int(left.sum())
        size = total * (middle - low) // (high - low)
        rng = np.random.default_rng([seed, low, high])
        got = np.minimum(rng.multinomial(size, left / total), left) if total else np.zeros_like(left)
        short = size - int(got.sum())
        if short > 0:  # the rest goes to sources that still have slots, in equal parts of their room
            room = left - got
            more = room * short // max(1, int(room.sum()))
            order = np.argsort(-(room - more), kind="stable")
            spare = short - int(more.sum())
            while spare > 0:
                for i in order:
                    if spare and more[i] < room[i]:
                        more[i] += 1
                        spare -= 1
            got = got + more
        if shard < middle:
            left, high = got, middle
        else:
            before, left, low = before + got, left - got, middle
    return left, before


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(key & MASK)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Place of each index in a pseudorandom permutation of range(n): a Feistel network, walked until inside."""
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    x = index.astype(np.uint64)
    todo = np.ones(len(x), dtype=bool)
    while todo.any():
        a, b = x[todo] >> np.uint64(half), x[todo] & low
        for r in range(4):
            a, b = b, a ^ (_mixed(b, key * 4 + r) & low)
        x[todo] = (a << np.uint64(half)) | b
        todo &= x >= np.uint64(n)
    return x.astype(np.int64)


def source_sizes(sized: DataFrame, max_sources: int = 1_000_000) -> list[tuple]:
    """(source, words) by code point, null last; one row a source comes to the driver, ``max_sources`` at most."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("n")).limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    return sorted(((r["source"], r["n"]) for r in rows), key=lambda r: (r[0] is None, r[0] or ""))


class Mix:
    """A mix of ``docs``, ready to be looked at in words, pieces or texts.

    ``docs`` needs ``text`` and ``source``. Weights repeat over the sources in order of code point, null last.
    Rows with equal (doc_id, source, text) are told apart by place only. Null and empty texts have no words:
    they join no block and are taken 0 times. Sources without words have target 0. An empty table mixes to
    nothing. Rerunning gives the same mix for the same rows, however they are partitioned. A source takes its
    target to within one and a half blocks.
    """

    def __init__(self, docs: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, cap: int = 2, block: int = 128, shard_blocks: int = 4096, seed: int = 17):
        self.docs, self.block, self.cap, self.seed, self.shard_blocks = docs, block, cap, seed, shard_blocks
        text = F.coalesce(F.col("text"), F.lit(""))
        self.sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64(text).alias("text_hash")))
        sizes = source_sizes(self.sized)
        self.sources = [s for s, _ in sizes]
        words = [n for _, n in sizes]
        self.sizes = words
        self.targets = targets(words, [weights[i % len(weights)] for i in range(len(words))], share * sum(words), cap)
        self.blocks = np.array([-(-n // block) for n in words], dtype=np.int64)
        mean = np.array(words, dtype=float) / np.maximum(self.blocks, 1)  # the last block of a source is short
        self.slots = np.minimum(np.rint(np.array(self.targets) / np.maximum(mean, 1)).astype(np.int64), cap * self.blocks)
        self.slots = np.maximum(self.slots, (np.array(self.targets) > 0).astype(np.int64)) if len(words) else np.zeros(0, dtype=np.int64)

    def source_table(self) -> DataFrame:
        """A row a source: its number, words and target."""
        rows = [(i, s, n, t) for i, (s, n, t) in enumerate(zip(self.sources, self.sizes, self.targets, strict=True))]
        return self.docs.sparkSession.createDataFrame(rows, "source_no int, source string, source_size long, target double")

    def slot_table(self) -> DataFrame:
        """A row an output slot: (shard, source_no, slot, block). Slots of a source run over all shards."""
        spark, slots, blocks = self.docs.sparkSession, self.slots, self.blocks
        total, seed = int(slots.sum()), self.seed
        shards = max(1, -(-total // self.shard_blocks))
        schema = "shard long, source_no int, slot long, block long"

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard in batch.column(0).to_pylist():
                    counts, before = draw(slots, shards, shard, seed)
                    for s in np.flatnonzero(counts):
                        slot = np.arange(before[s], before[s] + counts[s])
                        place = np.empty(len(slot), dtype=np.int64)
                        for epoch in np.unique(slot // blocks[s]):
                            own = slot // blocks[s] == epoch
                            place[own] = permuted(slot[own] % blocks[s], int(blocks[s]), seed * 1_000_003 + int(s) * 1009 + int(epoch))
                        n = len(slot)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), pa.array(np.full(n, s, dtype=np.int32)), pa.array(slot), pa.array(place)], ["shard", "source_no", "slot", "block"])

        return spark.range(shards).mapInArrow(fill, schema)

    @cached_property
    def placed(self) -> DataFrame:
        """Rows with words: (doc_id, source_no, size, text_hash, start): ``start`` is the place in the source's stream."""
        known = F.broadcast(self.source_table().select("source_no", F.col("source").alias("_source"))) if len(self.sources) < 100_000 else self.source_table().select("source_no", F.col("source").alias("_source"))
        rows = self.sized.where(F.col("size") > 0).join(known, F.col("source").eqNullSafe(F.col("_source")))
        return cut(running_total(rows.select("doc_id", "source_no", "size", "text_hash"), ["source_no"], ["doc_id", "text_hash", "size"], "size", "start"))

    def pieces(self) -> DataFrame:
        """What each slot takes of each row: (doc_id, source_no, text_hash, start, shard, slot, from_word, to_word)."""
        b = F.lit(self.block)
        rows = self.placed
        first, last = F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b)
        cut_up = rows.withColumn("block", F.explode(F.sequence(first, last)))
        slots = self.slot_table().hint("merge")  # its size is not seen before it runs, and it grows with the mix
        return cut_up.join(slots, ["source_no", "block"]).select(
            "doc_id", "source_no", "text_hash", "size", "start", "shard", "slot",
            F.greatest(F.col("block") * b - F.col("start"), F.lit(0)).alias("from_word"),
            F.least((F.col("block") + 1) * b - F.col("start"), F.col("size")).alias("to_word"),
        )

    def taken(self) -> DataFrame:
        """A row for each row of ``docs``: (doc_id, source, size, source_size, target, taken)."""
        words = self.pieces().groupBy("source_no", "start", "doc_id", "size").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
        rows = self.placed.alias("r")
        same = (F.col("r.source_no") == F.col("w.source_no")) & (F.col("r.start") == F.col("w.start"))
        full = rows.join(words.alias("w"), same, "left").select("r.doc_id", "r.source_no", "r.size", F.coalesce("w.taken", F.lit(0).cast("long")).alias("taken"))
        table = self.source_table()
        with_words = full.join(table, "source_no")
        without = self.sized.where(F.col("size") == 0).alias("d").join(table.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
        columns = ["doc_id", "source", "size", "source_size", "target", "taken"]
        return with_words.select(*columns).unionByName(without.select("d.doc_id", "d.source", "d.size", "s.source_size", "s.target", F.lit(0).cast("long").alias("taken")))

    def documents(self) -> DataFrame:
        """The mixed rows, with the columns of ``docs``: a row for each piece, its text cut at words.

        ``n_chars`` is that of the piece. Texts are shuffled once, beside their pieces, and cut in the tasks.
        """
        docs = self.docs
        keyed = docs.withColumn("_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
        one = keyed.dropDuplicates(["doc_id", "source", "_hash"])
        known = self.source_table().select("source_no", F.col("source").alias("_source"))
        parts = (
            self.pieces()
            .groupBy("doc_id", "source_no", "text_hash")
            .agg(F.array_sort(F.collect_list(F.struct("shard", "source_no", "slot", "from_word", "to_word"))).alias("_parts"))
            .join(known, "source_no")
            .select(F.col("doc_id").alias("_id"), "_source", "text_hash", "_parts")
        )
        both = one.join(parts, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_hash") == F.col("text_hash")))
        both = both.select(*docs.columns, "_parts")
        text_at, parts_at = docs.columns.index("text"), len(docs.columns)
        chars_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
        names = docs.columns

        def cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, texts, size = [], [], 0
                for i in range(batch.num_rows):
                    data = batch.column(text_at)[i].as_py()
                    starts = word_starts(data)
                    for p in batch.column(parts_at)[i].as_py():
                        rows.append(i)
                        texts.append(data[starts[p["from_word"]] : starts[p["to_word"]]].rstrip() if p["to_word"] < len(starts) else data[starts[p["from_word"]] :])
                        size += len(texts[-1])
                        if size > 4_000_000:
                            yield piece_batch(batch, rows, texts)
                            rows, texts, size = [], [], 0
                if rows:
                    yield piece_batch(batch, rows, texts)

        def piece_batch(batch, rows, texts):
            at = pa.array(rows)
            # The whole text isn't taken along: it would be copied once a piece.
            columns = [pa.array(texts, pa.string()) if i == text_at else c.take(at) for i, c in enumerate(batch.columns[:parts_at])]
            if chars_at is not None:
                columns[chars_at] = pa.array([len(t) for t in texts]).cast(columns[chars_at].type)
            return pa.RecordBatch.from_arrays(columns, names)

        return both.mapInArrow(cut_texts, T.StructType(docs.schema.fields))


WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def word_starts(text: str) -> list[int]:
    """Where the words begin, in code points."""
    return [m.start() for m in WORDS.finditer(text)]


def op2_query(spark, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return Mix(docs).taken().drop("source")
