"""Source divergence audit: how far the term frequencies of a language's sources are apart.

The terms that enough documents hold are found by iceberg prefix refinement: prefixes of a few bytes are counted by distinct documents,
those below the threshold are discarded, and only terms under a prefix that stays are looked at with a longer one, until the terms are complete.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pageflow.llm.common import stored
from pageflow.llm.hashing import WordHasher

SCALE = 1_000_000_000
#: Prefixes that stay are known to the next pass by a bit of their hash: 8 MB, however many there are.
BITS = 26
#: Entries that a task holds before it gives them out, and bytes of text that are worked on at once.
HELD, PIECE = 600_000, 1 << 20
#: Letters and everything beyond ASCII make terms, A-Z in lower case; other bytes part them.
_TERM = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], dtype=np.uint8)
_MIX = np.uint64(0x9E3779B97F4A7C15)

COUNTED = "lang string, source string, item binary, complete boolean, n long, docs long"


def _code(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _mixed(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    h = (h ^ code) * _MIX
    return h ^ (h >> np.uint64(32))


class Pieces:
    """The terms of an Arrow batch's texts, in pieces of some documents, or of a part of one."""

    def __init__(self):
        self.hasher = WordHasher()

    def __call__(self, texts: pa.Array) -> Iterator[tuple]:
        """(low, sums, starts, ends, row, rows, bounds, more) of each piece.

        ``low`` are the bytes, 0 where no term is; ``row`` is the row of each term, ``rows`` and ``bounds`` are the piece's rows and
        where each ends; ``more`` tells that the piece goes on with the row of the piece before.
        """
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, side="right")) - 1)
            low, end, more = int(offsets[at]), int(offsets[to]), False
            while True:
                cut = end
                if end - low > 2 * PIECE:  # one long text: it is parted between two terms
                    gaps = np.flatnonzero(_TERM[data[low + PIECE : end]] == 0)
                    cut = low + PIECE + int(gaps[0]) if len(gaps) else end
                yield self._terms(_TERM[data[low:cut]], np.clip(offsets[at + 1 : to + 1] - low, 0, cut - low), np.arange(at, to), more)
                if cut == end:
                    break
                low, more = cut, True
            at = to

    def _terms(self, low: np.ndarray, bounds: np.ndarray, rows: np.ndarray, more: bool) -> tuple:
        n = len(low)
        inside = np.zeros(n + 1, dtype=bool)
        inside[:n] = low > 0
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        begins = bounds[:-1]
        first[begins] = inside[begins]
        ends_at = bounds[bounds > 0] - 1
        last[ends_at] = inside[ends_at]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        return low, self.hasher.sums(low), starts, ends, rows[np.searchsorted(bounds, starts, side="right")], rows, bounds, more

    def hashes(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.hasher.spans(sums, starts, ends)


def _lives(bits: np.ndarray, prefixes: np.ndarray, lang: np.ndarray) -> np.ndarray:
    place = _mixed(prefixes, lang) >> np.uint64(64 - BITS)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


class Tally:
    """Occurrences and documents by group and item, of pieces given one after the other; items are told apart by 64 bits meanwhile."""

    def __init__(self):
        self.keys, self.counts, self.groups, self.items, self.size, self.seen = [], [], [], [], 0, None

    def add(self, h: np.ndarray, group: np.ndarray, row: np.ndarray, text: bytes, starts: np.ndarray, ends: np.ndarray, more: bool) -> None:
        """``more``: as for the piece; rows come in order, and a row that goes on is alone in its piece."""
        if not more:
            self.seen = None
        if not len(h):
            return
        key = _mixed(h, (group.astype(np.uint64) + np.uint64(1)) * _MIX)
        order = np.argsort(key, kind="stable")
        key, row = key[order], row[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        at = np.flatnonzero(new)
        new[1:] |= row[1:] != row[:-1]
        n, docs, pick = np.diff(np.append(at, len(key))), np.add.reduceat(new.astype(np.int64), at), order[at]
        key = key[at]
        if more and self.seen is not None:
            docs[np.isin(key, self.seen)] = 0
        self.seen = key if self.seen is None else np.union1d(key, self.seen)
        self._hold(key, np.stack([n, docs]), group[pick], [text[i:j] for i, j in zip(starts[pick].tolist(), ends[pick].tolist(), strict=True)])

    def _hold(self, key: np.ndarray, counts: np.ndarray, group: np.ndarray, items: list[bytes]) -> None:
        self.keys.append(key)
        self.counts.append(counts)
        self.groups.append(group)
        self.items += items
        self.size += len(key)

    def full(self) -> bool:
        """Whether much is held still when equal items are put together."""
        if self.size > HELD:
            self._merge()
        return self.size > HELD // 2

    def _merge(self) -> None:
        key, counts, group, items = np.concatenate(self.keys), np.concatenate(self.counts, axis=1), np.concatenate(self.groups), self.items
        key, first, place = np.unique(key, return_index=True, return_inverse=True)
        total = np.zeros((2, len(key)), np.int64)
        for i in range(2):
            np.add.at(total[i], place, counts[i])
        self.keys, self.counts, self.groups, self.items, self.size = [], [], [], [], 0
        self._hold(key, total, group[first], [items[i] for i in first.tolist()])

    def give(self) -> Iterator[tuple]:
        """(group, item, n, docs) arrays; nothing is held any more."""
        if self.size:
            self._merge()
            group, counts, items = self.groups[0], self.counts[0], self.items
            self.keys, self.counts, self.groups, self.items, self.size = [], [], [], [], 0
            for at in range(0, len(items), 10_000):
                yield group[at : at + 10_000], pa.array(items[at : at + 10_000], pa.binary()), *counts[:, at : at + 10_000]


class Names:
    """Numbers of names, and the names' codes."""

    def __init__(self):
        self.number: dict = {}
        self.names: list = []

    def of(self, names: list) -> np.ndarray:
        for x in set(names) - self.number.keys():
            self.number[x] = len(self.names)
            self.names.append(x)
        return np.array([self.number[x] for x in names], dtype=np.int64)


def _rows(texts: DataFrame) -> DataFrame:
    return texts.select("lang", "source", "text")


def _count(texts: DataFrame, above: int, level: int, alive) -> DataFrame:
    """COUNTED by (lang, source, item, complete) of one level.

    Complete items are terms of more than ``above`` bytes and at most ``level``, with occurrences and documents in a source; the others are
    prefixes of ``level`` bytes of longer terms, with documents only, their source null. Either has a prefix of ``above`` bytes that is alive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, langs, groups, terms, prefixes = Pieces(), Names(), Names(), Tally(), Tally()

        def give() -> Iterator[pa.RecordBatch]:
            for tally, complete, names in ((terms, True, groups.names), (prefixes, False, [(x, None) for x in langs.names])):
                for group, items, n, docs in tally.give():
                    lang, source = ([names[g][i] for g in group.tolist()] for i in range(2))
                    columns = [pa.array(lang, pa.string()), pa.array(source, pa.string()), items, pa.array([complete] * len(items)), pa.array(n if complete else n * 0), pa.array(docs)]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "item", "complete", "n", "docs"])

        for batch in batches:
            lang, source = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            lang_no, group_no = langs.of(lang), groups.of(list(zip(lang, source, strict=True)))
            codes = np.array([_code(x) for x in langs.names], dtype=np.uint64)
            for low, sums, starts, ends, row, _, _, more in pieces(batch.column(2)):
                text, size = low.tobytes(), ends - starts
                at = np.flatnonzero(size > above)
                if alive:
                    at = at[_lives(alive.value, pieces.hashes(sums, starts[at], starts[at] + above), codes[lang_no[row[at]]])]
                for tally, of, group, length in ((terms, at[size[at] <= level], group_no, size), (prefixes, at[size[at] > level], lang_no, np.minimum(size, level))):
                    s, e = starts[of], starts[of] + length[of]
                    tally.add(pieces.hashes(sums, s, e), group[row[of]], row[of], text, s, e, more)
                if terms.full() or prefixes.full():
                    yield from give()
        yield from give()

    return _rows(texts).mapInArrow(run, COUNTED).groupBy("lang", "source", "item", "complete").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _alive(spark: SparkSession, prefixes: DataFrame):
    """The bit table of (lang, item), all items of equal length, as a broadcast, or None if there is no prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, langs = WordHasher(), Names()
        for batch in batches:
            lang = langs.of(batch.column(0).to_pylist())
            codes = np.array([_code(x) for x in langs.names], dtype=np.uint64)
            data = b"".join(batch.column(1).to_pylist())
            ends = np.cumsum([len(x) for x in batch.column(1).to_pylist()]).astype(np.int64)
            h = hasher.spans(hasher.sums(np.frombuffer(data, dtype=np.uint8)), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends)
            place = _mixed(h, codes[lang]) >> np.uint64(64 - BITS)
            yield pa.RecordBatch.from_arrays([pa.array((place >> np.uint64(3)).astype(np.int32)), pa.array(np.left_shift(1, (place & np.uint64(7)).astype(np.int32)))], ["at", "b"])

    words = prefixes.select("lang", "item").mapInArrow(run, "at int, b int").groupBy("at").agg(F.bit_or("b").alias("b"))
    table = words.toArrow()  # a row for each of 2 ** 23 bytes at most
    if not table.num_rows:
        return None
    bits = np.zeros(1 << (BITS - 3), dtype=np.uint8)
    bits[table["at"].to_numpy()] = table["b"].to_numpy()
    return spark.sparkContext.broadcast(bits)


def _reduced(texts: DataFrame, above: int, alive) -> DataFrame:
    """``texts`` with only their terms of more than ``above`` bytes under a prefix that is alive; rows without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, langs = Pieces(), Names()
        for batch in batches:
            lang_no = langs.of(batch.column(0).to_pylist())
            codes = np.array([_code(x) for x in langs.names], dtype=np.uint64)
            left: list[list[bytes]] = [[] for _ in range(batch.num_rows)]
            for low, sums, starts, ends, row, rows, bounds, _ in pieces(batch.column(2)):
                at = np.flatnonzero(ends - starts > above)
                at = at[_lives(alive.value, pieces.hashes(sums, starts[at], starts[at] + above), codes[lang_no[row[at]]])]
                step = np.zeros(len(low) + 1, dtype=np.int8)
                step[starts[at]] += 1
                step[ends[at]] -= 1
                stays = np.cumsum(step, dtype=np.int8)[:-1] > 0
                inner = ends[at][~np.isin(ends[at], bounds)]
                stays[inner] = True  # what parts it from the next term
                text, upto = np.where(low == 0, np.uint8(32), low)[stays].tobytes(), np.concatenate([[0], np.cumsum(stays)])
                begin = 0
                for r, end in zip(rows.tolist(), upto[bounds].tolist(), strict=True):
                    if end > begin:
                        left[r].append(text[begin:end])
                    begin = end
            keep = [i for i, x in enumerate(left) if x]
            taken = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.array([b" ".join(left[i]).decode("utf-8", "surrogatepass") for i in keep], pa.string())], ["lang", "source", "text"])

    return _rows(texts).mapInArrow(run, "lang string, source string, text string")


def kept_terms(docs: DataFrame, least: int = 3, first: int = 8) -> DataFrame:
    """(lang, term, by): the terms that at least ``least`` documents of a language hold, ``by`` their occurrences as (source, n) sorted by source.

    ``docs`` have (lang, source, text). Levels are ``first`` bytes, twice that, and so on until no longer prefix stays. The corpus is read for the first level and once
    more to put aside the longer terms under prefixes that stay; further levels read those. A table of bits tells which prefixes stay; one that stays by an equal hash only is discarded by its count later. Each row is a document.
    """
    spark = docs.sparkSession
    texts, above, level, alive, kept = docs, 0, first, None, None
    while True:
        counted = stored(_count(texts, above, level, alive), "terms")
        complete = counted.where("complete").groupBy("lang", "item").agg(F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("by"))
        found = complete.where(F.col("docs") >= least).select("lang", F.decode("item", "UTF-8").alias("term"), "by")
        kept = found if kept is None else kept.unionByName(found)
        alive = _alive(spark, counted.where(~F.col("complete") & (F.col("docs") >= least)))
        if alive is None:
            return stored(kept, "kept-terms")
        if texts is docs:
            texts = stored(_reduced(docs, level, alive), "open-terms")
        above, level = level, 2 * level


def _div(a: Column, b: Column) -> Column:
    """Whole quotient."""
    return F.call_function("div", a, b)


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)), in two steps so that counts up to 9e13 stay within long."""
    up, all_ = (n + 1) * 100_000, total + terms
    return 1 + _div(up, all_) * 10_000 + _div((up % all_) * 10_000, all_)


def distance(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def source_groups(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, total, lang_total, n_terms) of every (lang, source) that occurs, also those without terms."""
    totals = kept.select("lang", F.explode("by").alias("b")).groupBy("lang", F.col("b.source").alias("source")).agg(F.sum("b.n").alias("total"))
    terms = kept.groupBy("lang").agg(F.count("*").alias("n_terms"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(terms, "lang", "left")
    filled = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "n_terms")])
    return filled.withColumn("lang_total", F.sum("total").over(Window.partitionBy("lang")))


#: Languages and sources that are sent to all executors; with more, their rows are joined like any others.
BROADCAST_GROUPS = 100_000


def audit(docs: DataFrame, least: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): distances of a language's sources from each other, and the terms that mark a source.

    A part ``pair`` row tells the sum of (p - q)^2 / q over all kept terms for another source of the language, q that source's shares; a part
    ``term`` row tells it for a term that is likelier in the source than in the language, the ``top`` largest of them. Shares are whole numbers,
    see ``share``. Null lang, source and text are read as ''. A language without kept terms has pairs of value 0. Rows are documents,
    repeated ones as often as they occur; texts of any length are read whole; an empty table gives no rows; other columns play no part.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = kept_terms(rows, least)
    groups = stored(source_groups(rows, kept), "groups")
    hint = F.broadcast if groups.count() <= BROADCAST_GROUPS else (lambda df: df)
    mine = hint(groups)
    p = share(F.col("n"), F.col("total"), F.col("n_terms"))
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("n_terms"))
    p0 = share(F.lit(0).cast("long"), F.col("total"), F.col("n_terms"))
    lang_n = F.aggregate("by", F.lit(0).cast("long"), lambda a, b: a + b["n"])
    present = kept.select("lang", F.col("term").alias("item"), lang_n.alias("lang_n"), F.inline("by"))
    shares = present.join(mine, ["lang", "source"]).select("lang", "source", "item", p.alias("p"), q.alias("q"), p0.alias("p0"))
    scored = shares.where(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), "item", distance(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    # A pair's sum is that over no occurrence at all, and what the terms of one source, of the other and of both change in it.
    theirs = hint(groups.select("lang", F.col("source").alias("item"), F.when(F.col("n_terms") > 0, p0).alias("q0")))
    alike = shares.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("n")).join(theirs, "lang").where(F.col("source") != F.col("item"))
    row = lambda a, b, x, y, x0, y0: F.struct(F.col(a).alias("source"), F.col(b).alias("item"), (F.col("n") * (distance(F.col(x), F.col(y)) - distance(F.col(x0), F.col(y0)))).alias("f"))
    single = alike.select("lang", F.inline(F.array(row("source", "item", "p", "q0", "p0", "q0"), row("item", "source", "q0", "p", "q0", "p0"))))
    sums = single.unionByName(_shared(shares)).groupBy("lang", "source", "item").agg(F.sum("f").alias("f"))
    pairs = groups.select("lang", "source", "n_terms", F.when(F.col("n_terms") > 0, p0).alias("p0")).join(theirs, "lang").where(F.col("source") != F.col("item"))
    value = F.coalesce(F.col("n_terms") * distance(F.col("p0"), F.col("q0")), F.lit(0)) + F.coalesce("f", F.lit(0))
    paired = pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
    return paired.withColumn("rank", F.row_number().over(order)).unionByName(best).withColumn("rank", F.col("rank").cast("int"))


#: Pairs of sources of a term that are worked on at once.
PAIRS = 1_000_000


def _shared(shares: DataFrame) -> DataFrame:
    """(lang, source, item, f): for terms in two sources, what is left when each source's own part is taken off; a row a pair and batch."""

    def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) ** 2 // q

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, by = batch.column(0).dictionary_encode(), batch.column(1)
            entries = by.flatten()
            source = entries.field("source").dictionary_encode()
            name, p, p0 = source.indices.to_numpy().astype(np.int64), entries.field("p").to_numpy(), entries.field("p0").to_numpy()
            ends = np.cumsum(held := np.diff(by.offsets.to_numpy()))
            starts, size = np.repeat(ends - held, held), np.repeat(held, held)
            group, most, made = np.repeat(lang.indices.to_numpy().astype(np.int64), held), len(source.dictionary), []
            done, before = 0, np.concatenate([[0], np.cumsum(size)])
            while done < len(name):
                upto = max(done + 1, int(np.searchsorted(before, before[done] + PAIRS, side="right")) - 1)
                a = np.repeat(np.arange(done, upto), size[done:upto])
                b = np.repeat(starts[done:upto], size[done:upto]) + np.arange(len(a)) - np.repeat(before[done:upto] - before[done], size[done:upto])
                a, b = a[a != b], b[a != b]
                f = apart(p[a], p[b]) - apart(p[a], p0[b]) - apart(p0[a], p[b]) + apart(p0[a], p0[b])
                keys, place = np.unique((group[a] * most + name[a]) * most + name[b], return_inverse=True)
                total = np.zeros(len(keys), np.int64)
                np.add.at(total, place, f)
                made.append((keys, total))
                done = upto
            for keys, total in made:
                columns = [lang.dictionary.take(pa.array(keys // most // most)), source.dictionary.take(pa.array(keys // most % most)), source.dictionary.take(pa.array(keys % most)), pa.array(total)]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "item", "f"])

    terms = shares.groupBy("lang", "item").agg(F.collect_list(F.struct("source", "p", "p0")).alias("by")).where(F.size("by") > 1)
    return terms.select("lang", "by").mapInArrow(run, "lang string, source string, item string, f long")


def op12_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all ``documents``."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
