"""Fill-in-the-middle: texts cut in three by their doc_id and put together in another order, and back.

A text leaves its row as pieces of some thousand characters, each with its document and its place in the output. One shuffle brings a document's
pieces together, sorted by place (``repartition`` and ``sortWithinPartitions``: the DataFrame form of repartitionAndSortWithinPartitions), so that tasks
read outputs as streams and hold a piece at a time. What is read from an output, sorted again by place in the text, is the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The marks before prefix, suffix and middle, and the order of the parts in each form's output.
PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
ORDER = {"plain": (), "psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
#: Characters of a piece.
PIECE = 20_000

#: The rows of pieces: place -1 is the document's head, with its numbers; the others have text.
PIECES = "key binary, place int, piece string, doc_id long, n long, form string, prefix_chars long, middle_chars long"
NAMES = ["key", "place", "piece", "doc_id", "n", "form", "prefix_chars", "middle_chars"]


def units(text: str) -> np.ndarray:
    """Where the units of a text start, in code points: runs of A-Z and a-z, and any other character by itself."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = ((points | 32) >= 97) & ((points | 32) <= 122) & (points < 128)
    inside = np.zeros(len(points), dtype=bool)
    inside[1:] = letter[1:] & letter[:-1]
    return np.flatnonzero(~inside)


def cut(doc_id: int | None, text: str, plain_share: int = 10, spm_share: int = 20) -> tuple[int, str, int, int]:
    """(units, form, where the prefix ends, where the middle ends) by the digest of the doc_id; a null one has an empty number."""
    digest = sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    starts = units(text)
    n = len(starts)
    if not text or any(m in text for m in MARKS) or h[2] % 100 >= 100 - plain_share:
        return n, "plain", 0, 0
    places = sorted(int(starts[u]) if (u := x % (n + 1)) < n else len(text) for x in h[:2])
    return n, "spm" if h[3] % 100 < spm_share else "psm", *places


def _chunks(text: str, size: int) -> Iterator[str]:
    for at in range(0, len(text), size):
        yield text[at : at + size]


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


_TYPES = [pa.binary(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]


def pieces(docs: DataFrame, plain_share: int = 10, spm_share: int = 20, size: int = PIECE) -> DataFrame:
    """PIECES of (doc_id, text), in the order of the outputs: each document in one partition, sorted by key and place.

    A document's key is a digest of its doc_id and text and the part of the input it lies in. Rows equal in all of these share their places:
    each piece then stands there as often as the row. Null and empty texts have a head only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for doc, raw, part in zip(*((x.as_py() for x in c) for c in batch.columns), strict=True):
                text = raw or ""
                n, form, a, b = cut(doc, text, plain_share, spm_share)
                key = blake2b(f"{doc}:{part}:".encode() + text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                parts = {PREFIX: text[:a], MIDDLE: text[a:b], SUFFIX: text[b:]}
                out = [x for m in ORDER[form] for x in (m, *_chunks(parts[m], size))] if ORDER[form] else _chunks(text, size)
                rows.append((key, -1, None, doc, n, form, *((None, None) if form == "plain" else (a, b - a))))
                rows += [(key, i, x, None, None, None, None, None) for i, x in enumerate(out)]
                held += len(text)
                if held > 2_000_000:
                    yield _batch(rows, _TYPES, NAMES)
                    rows, held = [], 0
        yield _batch(rows, _TYPES, NAMES)

    cut_up = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.spark_partition_id().alias("part")).mapInArrow(run, PIECES)
    return cut_up.repartition("key").sortWithinPartitions("key", "place")


class Parts:
    """Tells the parts of an output that comes in pieces; a mark may lie across two of them."""

    def __init__(self, form: str):
        self.marks, self.rank, self.held = list(ORDER[form]), -1 if ORDER[form] else 0, ""

    def __call__(self, piece: str) -> Iterator[tuple[int, str]]:
        """(rank in the text, text)."""
        text = self.held + piece
        self.held = ""
        while self.marks and (at := text.find(self.marks[0])) >= 0:
            if at:
                yield self.rank, text[:at]
            mark = self.marks.pop(0)
            self.rank, text = (PREFIX, MIDDLE, SUFFIX).index(mark), text[at + len(mark) :]
        if self.marks and len(text) > 2:
            text, self.held = text[:-2], text[-2:]
        elif self.marks:
            text, self.held = "", text
        if text:
            yield self.rank, text

    def end(self) -> Iterator[tuple[int, str]]:
        if self.marks:
            raise ValueError("an output lacks a mark")
        yield from ()


READ = "key binary, rank int, place int, piece string, doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, copies long"
_READ_NAMES = [x.split()[0] for x in READ.split(", ")]
_READ_TYPES = [pa.binary(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]


def _streamed(batches: Iterator[pa.RecordBatch], places: tuple[str, ...]) -> Iterator[tuple[bool, dict]]:
    """(whether its place is new, row): rows that share a place are copies of each other."""
    before = None
    for batch in batches:
        columns = [c for c in batch.columns]
        for i in range(batch.num_rows):
            row = {name: c[i].as_py() for name, c in zip(batch.schema.names, columns, strict=True)}
            here = tuple(row[p] for p in places)
            yield here != before, row
            before = here


def read_outputs(placed: DataFrame) -> DataFrame:
    """The outputs of ``pieces`` read as streams: READ, sorted by place in the text.

    Of each document the head, now with the digest of the output and the number of equal rows, and the text again in pieces: what stands
    behind the marks, told from the output and its form alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, head, digest, parts, copies, at = [], 0, None, None, None, 0, 0

        def ended() -> None:
            if head:
                list(parts.end())
                rows.append((head["key"], -1, 0, None, *(head[c] for c in NAMES[3:]), digest.hexdigest(), copies))

        for new, row in _streamed(batches, ("key", "place")):
            if row["place"] < 0:
                if new:
                    ended()
                    head, digest, parts, copies, at = row, sha256(), Parts(row["form"]), 0, 0
                copies += 1
            elif new:
                digest.update(row["piece"].encode("utf-8", "surrogatepass"))
                for rank, text in parts(row["piece"]):
                    rows.append((head["key"], rank, at, text, *[None] * 7))
                    held, at = held + len(text), at + 1
            if held > 2_000_000:
                yield _batch(rows, _READ_TYPES, _READ_NAMES)
                rows, held = [], 0
        ended()
        yield _batch(rows, _READ_TYPES, _READ_NAMES)

    return placed.mapInArrow(run, READ).sortWithinPartitions("key", "rank", "place")


def digests(docs: DataFrame, plain_share: int = 10, spm_share: int = 20, size: int = PIECE) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256), a row for each of (doc_id, text).

    Null texts are empty ones, a null doc_id has an empty number; empty texts are plain. Repeated rows give as many equal rows. Texts may have any
    length: from the first stage on only pieces are held. An empty table stays empty; other columns play no part.
    """
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, head, digest = [], None, None

        def ended() -> None:
            if head:
                rows.extend([(*(head[c] for c in names[:-1]), digest.hexdigest())] * head["copies"])

        for _, row in _streamed(batches, ("key",)):
            if row["rank"] < 0:
                ended()
                head, digest = row, sha256()
            else:
                digest.update(row["piece"].encode("utf-8", "surrogatepass"))
            if len(rows) > 5_000:
                yield _batch(rows, types, names)
                rows = []
        ended()
        yield _batch(rows, types, names)

    return read_outputs(pieces(docs, plain_share, spm_share, size)).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def outputs(docs: DataFrame, plain_share: int = 10, spm_share: int = 20, size: int = PIECE) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of (doc_id, text): the training texts. A row holds a whole output, as its text's row did."""
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, head, text, copies, held = [], None, [], 0, 0

        def ended() -> None:
            if head:
                rows.extend([(*(head[c] for c in names[:-1]), "".join(text))] * copies)

        for new, row in _streamed(batches, ("key", "place")):
            if row["place"] < 0:
                if new:
                    ended()
                    head, text, copies = row, [], 0
                copies += 1
            elif new:
                text.append(row["piece"])
                held += len(row["piece"])
            if held > 4_000_000 and rows:
                yield _batch(rows, types, names)
                rows, held = [], 0
        ended()
        yield _batch(rows, types, names)

    return pieces(docs, plain_share, spm_share, size).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def op13_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all ``documents``: of the outputs, and of the texts read from them again."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
