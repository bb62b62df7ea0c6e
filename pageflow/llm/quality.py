"""Quality rules: plain counts of a text, and how much likelier its n-grams are in trusted documents than in all of them.

Tokens are runs of letters and digits (everything beyond ASCII counts as such) or runs of other visible characters. Tokens and pairs of
neighbours are hashed into buckets; the buckets' counts over the trusted documents and over the whole corpus are two multinomials. A
document's score is the mean, over its tokens and pairs, of the logarithm of their ratio, and a fixed threshold decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from pageflow.llm.hashing import WordHasher, word_spans

#: Weights are whole numbers of this part of a nat, so that a document's sum doesn't depend on the order of its tokens.
UNIT = 1 << 20
#: The characters that count as symbols, and the rules' bounds.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50

_CLASS = np.array([0 if b in b" \t\n\v\f\r" else 1 if b >= 128 or chr(b).isalnum() else 2 for b in range(256)], dtype=np.uint8)
_SYMBOL = np.array([b in SYMBOLS.encode() for b in range(256)])
_MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)]

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
JUDGED = [*[pa.field(c, pa.int64()) for c in COUNTS], pa.field("base_failed", pa.bool_()), pa.field("score", pa.float64()), pa.field("kept", pa.bool_())]
JUDGED_TYPE = from_arrow_schema(pa.schema(JUDGED))


class Reader:
    """Counts and n-gram buckets of texts."""

    def __init__(self, bits: int):
        self.hasher, self.shift = WordHasher(), np.uint64(64 - bits)

    def _open(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
        return data, self.hasher.sums(data)

    def _buckets(self, data: np.ndarray, sums: np.ndarray) -> np.ndarray:
        kind = _CLASS[data]
        edges = np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(data)]]) if len(data) else np.zeros(1, np.int64)
        starts, ends = edges[:-1], edges[1:]
        shown = kind[starts] > 0
        h = self.hasher.spans(sums, starts[shown], ends[shown])
        pairs = h[:-1] * _MIX[0] + h[1:]
        pairs = (pairs ^ (pairs >> np.uint64(29))) * _MIX[2]
        return (np.concatenate([h, pairs]) >> self.shift).astype(np.int64)

    def buckets(self, text: str | None) -> np.ndarray:
        """The bucket of each token and each pair of neighbours."""
        return self._buckets(*self._open(text))

    def judged(self, text: str | None, weights: np.ndarray) -> tuple[list[int], float]:
        """COUNTS and the score."""
        data, sums = self._open(text)
        starts, ends = word_spans(data)
        inside = (_CLASS[data] > 0) & ((data & 0xC0) != 0x80)
        words = self.hasher.spans(sums, starts, ends)
        lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")] if text and "\n" in text else []
        found = self._buckets(data, sums)
        score = int(weights[found].sum()) / (len(found) * UNIT) if len(found) else 0.0
        return [len(starts), int(inside.sum()), int(_SYMBOL[data].sum()), len(lines) - len(set(lines)), _repeated(words)], score


def _repeated(words: np.ndarray) -> int:
    """Words in windows of three that occur twice or more."""
    if len(words) < 4:
        return 0
    windows = words[:-2] * _MIX[0] + (words[1:-1] ^ (words[1:-1] >> np.uint64(31))) * _MIX[1] + words[2:] * _MIX[2]
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    again = twice[np.minimum(np.searchsorted(twice, windows), len(twice) - 1)] == windows
    hit = np.zeros(len(words), dtype=bool)
    for i in range(3):
        hit[i : i + len(windows)] |= again
    return int(hit.sum())


def _texts(batch: pa.RecordBatch, column: str) -> Iterator[str | None]:
    """One text after the other, not all of a batch at once."""
    return (x.as_py() for x in batch.column(column))


def fit_ratio(docs: DataFrame, trusted: str = "trusted", bits: int = 18, prior: float = 20.0) -> np.ndarray:
    """Weights of the 2 ** ``bits`` buckets, from (text, ``trusted``); the trusted documents are a part of the corpus.

    All documents are counted, repeated rows as often as they occur. Each bucket has ``prior`` further counts in the corpus and as many times
    the trusted share in the trusted documents: a bucket of which little is known weighs about nothing. Null texts give no counts. Without a
    trusted document, or without any text, all weights are 0.
    """
    size = 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, totals, waiting, held = Reader(bits), np.zeros((2, size), np.int64), ([], []), 0

        def add() -> None:
            for total, parts in zip(totals, waiting, strict=True):
                if parts:
                    total += np.bincount(np.concatenate(parts), minlength=size)
                    parts.clear()

        for batch in batches:
            for text, good in zip(_texts(batch, "text"), _texts(batch, "trusted"), strict=True):
                found = reader.buckets(text)
                for kind in range(2 if good else 1):
                    waiting[kind].append(found)
                held += len(found)
                if held > 1_000_000:
                    add()
                    held = 0
        add()
        used = np.flatnonzero(totals[0])
        for at in range(0, len(used), 10_000):
            part = used[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *[pa.array(t[part]) for t in totals]], ["bucket", "n", "n_trusted"])

    rows = docs.select("text", F.coalesce(F.col(f"`{trusted}`"), F.lit(False)).alias("trusted"))
    counted = rows.mapInArrow(run, "bucket int, n long, n_trusted long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("n_trusted").alias("t"))
    table = counted.toArrow()  # a row a bucket
    n, t = np.zeros(size), np.zeros(size)
    n[table["bucket"].to_numpy()], t[table["bucket"].to_numpy()] = table["n"].to_numpy(), table["t"].to_numpy()
    if not t.sum():
        return np.zeros(size, np.int32)
    share = t.sum() / n.sum()
    return np.rint(np.log((t / share + prior) / (n + prior)) * UNIT).astype(np.int32)


def judge(docs: DataFrame, weights: np.ndarray, threshold: float = -0.1) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score and kept; columns of these names are replaced.

    A document fails the base rules with fewer than 50 words, or if more than half of its words stand in repeated windows of three words. Any
    other is kept if its score, in nats a token or pair, is ``threshold`` at least. A null or empty text has no words and fails. Whole texts are
    read, rows are judged one by one, repeated ones alike; an empty table stays empty. Texts may have any length: one is held at a time.
    """
    rows = docs.drop(*[f.name for f in JUDGED])
    names, bits = rows.columns, int(math.log2(len(weights)))
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, w = Reader(bits), sent.value
        for batch in batches:
            made = [[] for _ in JUDGED]
            for text in _texts(batch, "text"):
                counts, score = reader.judged(text, w)
                failed = counts[0] < LEAST_WORDS or 100 * counts[4] > MOST_REPEATED * counts[0]
                for column, x in zip(made, [*counts, failed, score, not failed and score >= threshold], strict=True):
                    column.append(x)
            new = [pa.array(x, f.type) for x, f in zip(made, JUDGED, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*names, *[f.name for f in JUDGED]])

    return rows.mapInArrow(run, StructType([*rows.schema, *JUDGED_TYPE]))


def trusted_rows(docs: DataFrame, labels: DataFrame, most: int = 1_000_000) -> DataFrame:
    """(text, trusted): labelled of good quality and not as toxic. A document of which any label says otherwise isn't trusted.

    At most about ``most`` labelled documents are trusted, drawn by a hash of doc_id, so that their ids can be sent to all executors.
    Rows without a doc_id aren't trusted.
    """
    bad = (F.coalesce("quality", F.lit(0)) != 1) | (F.coalesce("toxic", F.lit(0)) == 1)
    good = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(bad).alias("bad")).where(~F.col("bad"))
    if (n := good.count()) > most:
        good = good.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < int(most / n * (1 << 32)))
    ids = F.broadcast(good.select(F.col("doc_id").alias("_id"), F.lit(True).alias("trusted")))
    return docs.select(F.col("doc_id").cast("long").alias("_doc"), "text").join(ids, F.col("_doc") == F.col("_id"), "left").select("text", "trusted")


def op11_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules over all ``documents``, with the good and not toxic of ``labels`` as trusted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    weights = fit_ratio(trusted_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return judge(docs, weights).drop("text")
