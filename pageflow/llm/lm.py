"""Operator 6: an interpolated modified Kneser-Ney bigram model over the whole corpus.

Tasks count words and bigrams in sorted runs of hashes, dealt to buckets of the hash range. Each bucket merges its
runs and writes sorted hash arrays to the shared folder; contexts and continuations are counted from the bigrams
in the same way. Scoring tasks memory-map the arrays and look up a batch's sorted hashes at once.

Words are hashed to 64 bits. A bigram is known by 32 bits of each word, so that contexts (left half) and
continuations (right half) can be counted from it: of a million words, about a hundred pairs share such a half
and are counted together above the word level. Counts of words are by 64 bits.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageflow.llm.common import new_folder, stored

#: Hashes of the end token and of the start context: no word's hash, as words are hashed to even numbers.
END, START = 0x5DEECE66D0000001, 0x2545F4914F6C0003
LOW = np.uint64(0xFFFFFFFF)
BUCKET_BYTES = 16_000_000
SCHEMA = "kind string, bucket int, keys binary, a binary, b binary, c binary, d binary, totals array<bigint>"
NAMES = ["kind", "bucket", "keys", "a", "b", "c", "d", "totals"]
TYPES = [pa.string(), pa.int32(), *[pa.binary()] * 5, pa.list_(pa.int64())]


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit keys, so that key ranges are evenly filled."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bucket_edges(keys: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32), np.arange(n + 1, dtype=np.uint64))


def pack(a: np.ndarray) -> bytes:
    """Sorted keys as byte planes of their differences, compressed; other numbers as byte planes."""
    import zstandard

    a = a.astype(np.uint64)
    planes = np.diff(a, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(planes).view(np.uint64).ravel(), dtype=np.uint64)


def summed(keys: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """Distinct sorted keys with the sums of each column."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return [keys[first], *[np.add.reduceat(c[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64) for c in columns]]


def runs(kind: str, buckets: int, keys: np.ndarray, *columns: np.ndarray):
    """A row for each bucket of sorted distinct keys."""
    edges = bucket_edges(keys, buckets)
    for b in np.flatnonzero(np.diff(edges)):
        s = slice(edges[b], edges[b + 1])
        packed = [pack(c[s]) for c in columns]
        yield [kind, int(b), pack(keys[s]), *packed, *[None] * (4 - len(packed)), None]


def record(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(TYPES)], NAMES)


class Hasher:
    """Hashes of a text's words, lower-cased A-Z."""

    def __init__(self):
        import xxhash

        self.digest, self.known = xxhash.xxh3_64_intdigest, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        known = self.known
        if len(known) > 500_000:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.digest(w) & ~1 & 0xFFFFFFFFFFFFFFFF
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def tokens_of(hashes: np.ndarray) -> np.ndarray:
    return np.append(hashes, np.uint64(END))


def bigrams_of(tokens: np.ndarray) -> np.ndarray:
    before = np.concatenate([[np.uint64(START)], tokens[:-1]])
    return (before & ~LOW) | (tokens >> np.uint64(32))


def _count(buckets: int, flush: int = 4_000_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, words, pairs, waiting = Hasher(), [], [], 0

        def counted():
            for kind, held in (("word", words), ("pair", pairs)):
                keys, counts = np.unique(mixed(np.concatenate(held)), return_counts=True)
                for row in runs(kind, buckets, keys, counts):
                    yield record([row])

        for batch in batches:
            for text in batch.column(0):
                tokens = tokens_of(hasher(text.as_py()))
                words.append(tokens)
                pairs.append(bigrams_of(tokens))
                waiting += len(tokens)
                if waiting > flush:
                    yield from counted()
                    words, pairs, waiting = [], [], 0
        if waiting:
            yield from counted()

    return run


def unmixed(x: np.ndarray) -> np.ndarray:
    """Undo ``mixed``."""
    x = x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))
    x = x * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))
    x = x * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


def _gathered(table: pa.Table, columns: int) -> list[np.ndarray]:
    return summed(*[np.concatenate([unpack(x) for x in table.column(c).to_pylist()]) for c in NAMES[2 : 3 + columns]])


def _tally(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3, 4; how many there are; their sum; how many are 3 or more."""
    return [*[int((counts == i).sum()) for i in (1, 2, 3, 4)], len(counts), int(counts.sum()), int((counts >= 3).sum())]


def _merge_counts(model: str, buckets: int):
    """Merge a bucket of words or bigrams, write its arrays and pass on what contexts and continuations need."""

    def run(table: pa.Table) -> pa.Table:
        kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
        keys, counts = _gathered(table, 1)
        write_arrays(model, kind, bucket, keys, counts)
        rows = [[f"{kind}-total", bucket, *[None] * 5, _tally(counts)]]
        if kind == "pair":
            plain = unmixed(keys)
            one = np.ones(len(keys), dtype=np.int64)
            left = summed(mixed(plain >> np.uint64(32)), counts, counts == 1, counts == 2, counts >= 3)
            rows += runs("context", buckets, *left)
            rows += runs("ending", buckets, *summed(mixed(plain & LOW), one))
        return pa.Table.from_batches([record(rows)])

    return run


def _merge_parts(model: str):
    def run(table: pa.Table) -> pa.Table:
        kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
        keys, *columns = _gathered(table, 4 if kind == "context" else 1)
        write_arrays(model, kind, bucket, keys, *columns)
        return pa.Table.from_batches([record([[f"{kind}-total", bucket, *[None] * 5, _tally(columns[0])]])])

    return run


def _place(uri: str) -> str | None:
    """The local path of a file: URI; None for other stores."""
    parsed = urlparse(uri)
    return parsed.path if parsed.scheme in ("", "file") else None


def write_arrays(model: str, kind: str, bucket: int, keys: np.ndarray, *columns: np.ndarray) -> None:
    """Write the arrays of a bucket; a repeated task replaces a file by an equal one in one step."""
    for i, a in enumerate((keys, *columns)):
        name = f"{kind}-{bucket}-{i}"
        data = (a.astype(np.uint64) if i == 0 else a.astype(np.int64) if a.size and a.max() > 0xFFFFFFF0 else a.astype(np.uint32)).tobytes()
        if (folder := _place(model)) is not None:
            os.makedirs(folder, exist_ok=True)
            part = f"{folder}/.{name}-{uuid.uuid4().hex}"
            with open(part, "wb") as f:
                f.write(data)
            os.replace(part, f"{folder}/{name}")
        else:
            from pyarrow import fs

            store, base = fs.FileSystem.from_uri(model)
            store.create_dir(base, recursive=True)
            with store.open_output_stream(f"{base}/{name}") as f:
                f.write(data)


class Arrays:
    """A model's sorted arrays, mapped when a bucket is first used. Other stores are copied beside the worker."""

    def __init__(self, model: str, buckets: int, present: dict[str, np.ndarray]):
        self.model, self.buckets, self.present, self.open, self.folder = model, buckets, present, {}, _place(model)
        if self.folder is None:
            self.folder = tempfile.mkdtemp(prefix="lm-")
            atexit.register(shutil.rmtree, self.folder, ignore_errors=True)

    def _array(self, kind: str, bucket: int, i: int, kinds: tuple) -> np.ndarray:
        path = f"{self.folder}/{kind}-{bucket}-{i}"
        if _place(self.model) is None and not os.path.exists(path):
            from pyarrow import fs

            store, base = fs.FileSystem.from_uri(self.model)
            if store.get_file_info(f"{base}/{kind}-{bucket}-{i}").type == fs.FileType.File:
                fs.copy_files(f"{base}/{kind}-{bucket}-{i}", path, source_filesystem=store)
        if not os.path.exists(path) or not os.path.getsize(path):
            return np.zeros(0, dtype=kinds[0])
        size = os.path.getsize(path)
        width = kinds[0] if len(kinds) == 1 or size == 4 * kinds[2] else kinds[1]
        return np.memmap(path, dtype=width, mode="r")

    def _bucket(self, kind: str, bucket: int, columns: int) -> list[np.ndarray]:
        if (kind, bucket) not in self.open:
            keys = self._array(kind, bucket, 0, (np.uint64,))
            held = self.present.get(kind)
            if not len(keys) and held is not None and bucket >> 6 < len(held) and int(held[bucket >> 6]) >> (bucket & 63) & 1:
                raise FileNotFoundError(f"{self.model}/{kind}-{bucket}-0 is missing: a model's folder must be shared by all workers, and whole")
            values = [self._array(kind, bucket, i, (np.uint32, np.int64, len(keys))) for i in range(1, columns + 1)]
            if any(len(v) != len(keys) for v in values):
                raise FileNotFoundError(f"{self.model}/{kind}-{bucket}-*: arrays are missing or cut short")
            self.open[kind, bucket] = [keys, *values]
        return self.open[kind, bucket]

    def find(self, kind: str, keys: np.ndarray, columns: int = 1) -> list[np.ndarray]:
        """Values of each key, 0 where it is unknown."""
        distinct, at = np.unique(mixed(keys), return_inverse=True)
        out = [np.zeros(len(distinct), dtype=np.int64) for _ in range(columns)]
        edges = bucket_edges(distinct, self.buckets)
        for b in np.flatnonzero(np.diff(edges)):
            have, *values = self._bucket(kind, int(b), columns)
            if len(have):
                own = distinct[edges[b] : edges[b + 1]]
                place = np.minimum(np.searchsorted(have, own), len(have) - 1)
                hit = have[place] == own
                for o, v in zip(out, values, strict=True):
                    o[edges[b] : edges[b + 1]][hit] = v[place[hit]]
        return [o[at] for o in out]


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Discounts by count 0, 1, 2, 3 or more."""
    if min(n1, n2, n3, n4) == 0:
        return np.array([0.0, 0.5, 0.75, 0.9])  # too little text to estimate them
    y = n1 / (n1 + 2 * n2)
    return np.clip([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], 0.0, [0.0, 1.0, 2.0, 3.0])


class Model:
    """A fitted model: the folder of its arrays, the totals that scoring needs, and a bit for each bucket of a kind that has an array."""

    def __init__(self, folder: str, buckets: int, totals: dict[str, list[int]], present: dict[str, np.ndarray]):
        self.folder, self.buckets, self.totals, self.present = folder, buckets, totals, present

    def scores(self, arrays: Arrays, tokens: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count, add-one log10 and model log10 probability of each token."""
        words, found, ends = (self.totals.get(k, [0] * 7) for k in ("word", "pair", "ending"))
        n, v = words[5], words[4]
        (count,) = arrays.find("word", tokens)
        base = np.log10((count + 1) / (n + v + 1))
        (ending,) = arrays.find("ending", tokens >> np.uint64(32))
        low = discounts(*ends[:4])
        kinds = max(found[4], 1)
        spare = (low[1] * ends[0] + low[2] * ends[1] + low[3] * ends[6]) / kinds if found[4] else 1.0
        unigram = np.maximum(ending - low[np.minimum(ending, 3)], 0) / kinds + spare / (v + 1)
        (both,) = arrays.find("pair", pairs)
        total, ones, twos, more = arrays.find("context", pairs >> np.uint64(32), 4)
        high = discounts(*found[:4])
        seen = total > 0
        below = np.where(seen, (high[1] * ones + high[2] * twos + high[3] * more) / np.maximum(total, 1), 1.0)
        p = np.maximum(both - high[np.minimum(both, 3)], 0) / np.maximum(total, 1) + below * unigram
        return count, base, np.log10(p)


def fit(texts: DataFrame) -> Model:
    """Learn from ``texts.text``, null being empty. Words and bigrams are counted over all rows.

    The number of buckets follows the bytes, so that a bucket's bigrams fit a task. The arrays stay in the
    shared folder while the model is used; ``delete_folder(spark, model.folder)`` removes them.
    """
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-size // BUCKET_BYTES))
    folder = new_folder(spark, "lm")
    counted = texts.select("text").mapInArrow(_count(buckets), SCHEMA)
    merged = stored(counted.groupBy("kind", "bucket").applyInArrow(_merge_counts(folder, buckets), SCHEMA), "lm-parts")
    parts = merged.where(F.col("kind").isin("context", "ending")).groupBy("kind", "bucket").applyInArrow(_merge_parts(folder), SCHEMA)
    last = stored(parts.select("kind", "bucket", "totals"), "lm-totals")
    every = merged.where(F.col("totals").isNotNull()).select("kind", "bucket", "totals").unionByName(last)
    sums = every.groupBy("kind").agg(F.array(*[F.sum(F.col("totals")[i]) for i in range(7)]).alias("totals")).collect()  # a row a kind
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bucket") % 64).cast("int"))
    words = every.groupBy("kind", F.floor(F.col("bucket") / 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits")).collect()  # a row for 64 buckets
    present = {r["kind"]: np.zeros(buckets // 64 + 1, dtype=np.uint64) for r in words}
    for r in words:
        present[r["kind"]][r["word"]] = np.uint64(r["bits"] & 0xFFFFFFFFFFFFFFFF)
    return Model(folder, buckets, {r["kind"].removesuffix("-total"): list(r["totals"]) for r in sums}, {k.removesuffix("-total"): v for k, v in present.items()})


def score(docs: DataFrame, model: Model, chunk: int = 500_000) -> DataFrame:
    """``docs`` with n_tokens, n_known, train_tokens, base_score and score; columns of these names are replaced.

    A text's tokens are its words and one end, so null and empty texts have the end alone. ``score`` is the
    log10 probability of the text, ``base_score`` that of add-one unigrams; perplexity is 10 ** (-score / n_tokens).
    With nothing learned, all tokens are unknown and both scores are finite. Repeated rows score alike;
    empty tables give empty tables. Rows are not shuffled.
    """
    new = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]
    rest = docs.drop(*[n for n, _ in new])
    text_at, names = rest.columns.index("text"), [*rest.columns, *[n for n, _ in new]]
    train = model.totals.get("word", [0] * 7)[5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, arrays = Hasher(), Arrays(model.folder, model.buckets, model.present)
        for batch in batches:
            columns: list[list[np.ndarray]] = [[], [], [], []]
            held: list[np.ndarray] = []

            def scored(held=held, columns=columns):
                lengths = np.array([len(t) for t in held])
                count, base, own = model.scores(arrays, np.concatenate(held), np.concatenate([bigrams_of(t) for t in held]))
                starts = np.cumsum(lengths) - lengths
                for c, v in zip(columns, (lengths, np.add.reduceat((count > 0).astype(np.int64), starts), np.add.reduceat(base, starts), np.add.reduceat(own, starts)), strict=True):
                    c.append(v)
                held.clear()

            waiting = 0
            for text in batch.column(text_at):
                held.append(tokens_of(hasher(text.as_py())))
                waiting += len(held[-1])
                if waiting > chunk:
                    scored()
                    waiting = 0
            if held:
                scored()
            n, known, base, own = (np.concatenate(c) if c else np.zeros(0) for c in columns)
            made = [pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(np.full(len(n), train)), pa.array(base), pa.array(own)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names)

    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, *[T.StructField(n, t) for n, t in new]]))


def remainder(doc_id: Column, modulus: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(modulus))


def op6_query(spark, sf_dir: str) -> DataFrame:
    """Scores of every document by a model of six sevenths of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs.where(remainder(F.col("doc_id"), 7) != 2))
    rows = docs.select("doc_id", (remainder(F.col("doc_id"), 7) == 2).alias("held_out"), "text")
    return score(rows, model).drop("text")
