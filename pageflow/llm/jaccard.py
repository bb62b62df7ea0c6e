"""Operator 3: exact n-gram Jaccard join with a token-group matrix.

Documents become sets of word shingles. Equal sets form one class. Classes are partitioned into groups: classes that
are similar to one centre and near each other in size. The matrix says which tokens a group holds, for the tokens that
the prefix principle needs: in a common order, which puts frequent tokens last, the first token that two similar
sets share stands early in both. A query's tokens are looked up in the matrix; of the groups found, the union of
tokens, stored once a group, bounds the overlap, and only groups that qualify are opened and compared exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageflow.llm.common import TEXT_ROWS, cut, delete_folder, new_folder, scratch, setting, stored, stored_at
from pageflow.llm.components import connected_components, joined_components
from pageflow.llm.hashing import WordHasher, sorted_distinct
from pageflow.llm.lm import pack, unpack

WORD_SEED_A, WORD_SEED_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Tokens sent to every task as frequent ones, the most frequent first; an order is right with any choice of them.
MOST_FREQUENT = 2_000_000
#: Tokens are counted without so many of their 64 bits; the counts only serve the order.
CUT_BITS = np.uint64(16)
#: So many ids are sent to all executors at most; more are joined by shuffling.
BROADCAST_IDS = 2_000_000
#: Bytes of text whose tokens meet in one bucket.
BUCKET_BYTES = 4_000_000
#: Queries that meet one group in one row.
CHUNK = 64


class Shingler:
    """Sets of hashed word shingles. Lower-cases A-Z; words are parted by blank, \\t, \\n, \\v, \\f and \\r."""

    def __init__(self, k: int):
        self.k, self.hasher = k, WordHasher()

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct shingles; with fewer than k words the whole sequence is one."""
        h = self.hasher(text)
        if not len(h):
            return h
        k = min(self.k, len(h))
        out = np.full(len(h) - k + 1, k, dtype=np.uint64)
        for i in range(k):
            out = (out * WORD_SEED_A) ^ h[i : len(h) - k + 1 + i]
            out ^= out >> np.uint64(31)
            out *= WORD_SEED_B
        return sorted_distinct(out)


def at_least(n: int | np.ndarray, percent: int):
    """Least overlap that a set of n needs with any partner."""
    return -(-n * percent // 100)


def class_key(tokens: np.ndarray) -> int:
    """A 63-bit name of a set."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little") >> 1


def prefix(tokens: np.ndarray, percent: int, frequent: np.ndarray) -> np.ndarray:
    """The tokens, first in the common order, of which any similar set shares one."""
    order = tokens * WORD_SEED_A  # another order than that of the buckets
    order >>= np.uint64(1)
    if len(frequent):
        short = tokens >> CUT_BITS
        at = np.minimum(np.searchsorted(frequent, short), len(frequent) - 1)
        order |= (frequent[at] == short).astype(np.uint64) << np.uint64(63)
    n = len(tokens)
    size = n - at_least(n, percent) + 1
    return tokens[np.argsort(order, kind="stable")[:size]] if size < n else tokens


def buckets_of(tokens: np.ndarray, n: int) -> np.ndarray:
    return ((tokens >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def _slices(keys: np.ndarray, n: int):
    """Bucket by bucket, where sorted tokens lie."""
    edges = np.searchsorted(buckets_of(keys, n), np.arange(n + 1, dtype=np.uint64))
    for b in np.flatnonzero(np.diff(edges)):
        yield int(b), slice(edges[b], edges[b + 1])


def _first_pass(k: int, buckets: int, flush: int = 500_000):
    """Rows of sets (doc_id, text_hash, n, class) and, by bucket, all tokens with the number of sets here that hold them.

    A bucket's row holds one token at least, so there are never more rows than tokens.
    """
    names = ["doc_id", "text_hash", "n", "class", "counted", "bucket", "tokens", "counts"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, held, waiting = Shingler(k), [], 0

        def counted():
            keys, counts = run_lengths(np.sort(np.concatenate(held)))
            rows = [(b, pack(keys[s]), pack(counts[s])) for b, s in _slices(keys << CUT_BITS, buckets)]
            none = [None] * len(rows)
            columns = [none, none, none, none, [True] * len(rows), *zip(*rows, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            n, key = [], []
            for text in batch.column(2):
                tokens = sets(text.as_py())
                n.append(len(tokens))
                key.append(class_key(tokens))
                if len(tokens):
                    held.append(tokens >> CUT_BITS)
                    waiting += len(tokens)
                if waiting > flush:
                    yield counted()
                    held, waiting = [], 0
            none = [None] * len(n)
            columns = [batch.column(0), batch.column(1), n, key, [False] * len(n), none, none, none]
            yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(columns, types, strict=True)], names)
        if held:
            yield counted()

    return run


def run_lengths(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and how often each occurs."""
    starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, dtype=np.int64)
    return a[starts], np.diff(starts, append=len(a))


def _count_bucket(least: int):
    def run(table: pa.Table) -> pa.Table:
        tokens = np.concatenate([unpack(x.as_py()) for x in table.column("tokens")])
        counts = np.concatenate([unpack(x.as_py()) for x in table.column("counts")]).astype(np.int64)
        order = np.argsort(tokens)
        keys, lengths = run_lengths(tokens[order])
        total = np.add.reduceat(counts[order], np.cumsum(lengths) - lengths)
        many = total > least
        return pa.table({"token": keys[many].view(np.int64), "n": total[many]})

    return run


def _most_frequent(counts: DataFrame, most: int = MOST_FREQUENT) -> np.ndarray:
    """Sorted tokens of ``counts`` (token, n): all, or those above the least count that leaves ``most`` at most."""
    level = F.floor(F.log2("n") * 16).cast("int")
    levels = counts.groupBy(level.alias("level")).agg(F.count("*").alias("tokens")).orderBy(F.desc("level")).collect()  # at most 64 * 16 rows
    total, least = 0, None
    for row in levels:
        total += row["tokens"]
        if total > most:
            break
        least = row["level"]
    if least is None:
        return np.zeros(0, dtype=np.uint64)
    kept = counts.where(level >= least).select("token").toArrow().column("token").to_numpy()
    return np.sort(kept.view(np.uint64))


def _second_pass(k: int, percent: int, buckets: int, frequent, flush: int = 500_000):
    """By bucket: prefix tokens in the final order with the classes that hold them, their sizes and the token's place."""
    names = ["bucket", "tokens", "classes", "sizes", "places"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, late, waiting = Shingler(k), frequent.value, 0
        held: dict[int, np.ndarray] = {}
        size: dict[int, int] = {}

        def packed():
            keys = np.concatenate(list(held.values()))
            lengths = [len(x) for x in held.values()]
            classes = np.repeat(np.fromiter(held, np.int64, len(held)), lengths)
            sizes = np.repeat(np.fromiter((size[c] for c in held), np.int64, len(held)), lengths)
            places = np.concatenate([np.arange(x) for x in lengths])
            order = np.argsort(keys)
            keys, classes, sizes, places = keys[order], classes[order], sizes[order], places[order]
            rows = [(b, pack(keys[s]), classes[s].tobytes(), planes(sizes[s]), planes(places[s])) for b, s in _slices(keys, buckets)]
            types = [pa.int32()] + [pa.binary()] * 4
            return pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            for text in batch.column(0):
                tokens = sets(text.as_py())
                if len(tokens) and (c := class_key(tokens)) not in held:
                    held[c], size[c] = prefix(tokens, percent, late), len(tokens)
                    waiting += len(held[c])
                if waiting > flush:
                    yield packed()
                    held, size, waiting = {}, {}, 0
        if held:
            yield packed()

    return run


def planes(a: np.ndarray) -> bytes:
    """Numbers below 2^32 as compressed byte planes."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes())


def from_planes(data: bytes) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1).T
    return np.ascontiguousarray(raw).view(np.uint32).ravel().astype(np.int64)


def _shared_in_bucket(table: pa.Table) -> pa.Table:
    """(token, class, n, place) of the tokens that two classes at least hold."""
    read = {"tokens": unpack, "classes": lambda x: np.frombuffer(x, np.int64), "sizes": from_planes, "places": from_planes}
    tokens, classes, sizes, places = (np.concatenate([f(x.as_py()) for x in table.column(c)]) for c, f in read.items())
    order = np.lexsort((classes, tokens))
    tokens, classes, sizes, places = tokens[order], classes[order], sizes[order], places[order]
    new = np.ones(len(tokens), dtype=bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (classes[1:] != classes[:-1])
    tokens, classes, sizes, places = tokens[new], classes[new], sizes[new], places[new]
    same = np.zeros(len(tokens) + 1, dtype=bool)
    same[1:-1] = tokens[1:] == tokens[:-1]
    shared = same[1:] | same[:-1]
    return pa.table({"token": tokens[shared].view(np.int64), "class": classes[shared], "n": sizes[shared], "place": places[shared]})


def _needed(x: Column, y: Column, percent: int) -> Column:
    """Prefix tokens that sets of these sizes share at least, if they are similar."""
    overlap = F.ceil(F.lit(percent) * (x + y) / F.lit(100 + percent) - 1e-9)
    return overlap - F.ceil(F.lit(percent) * F.greatest(x, y) / F.lit(100) + 1e-9) + 1


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _texts(docs: DataFrame, classes: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(class, packed text) of the wanted classes, each by one of its documents."""
    ids = classes.join(wanted.distinct(), "class").select("class", F.col("representative").alias("_id"))
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    rows = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("_id"))).select("class", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        sets, pack = Shingler(k), zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            keys, packed = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if class_key(sets(text)) == key:  # another row may have the same doc_id
                    keys.append(key)
                    packed.append(pack(text.encode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(packed, pa.binary())], ["class", "packed"])

    return stored(rows.mapInArrow(run, "class long, packed binary").dropDuplicates(["class"]), "jaccard-texts")


def _opener(k: int):
    """Packed text -> set."""
    import zstandard

    sets, unpack = Shingler(k), zstandard.ZstdDecompressor().decompress
    return lambda packed: sets(unpack(packed).decode("utf-8", "surrogatepass"))


def _united(k: int):
    """Adds to a group's row its union: the upper halves of all members' tokens, sorted and distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _opener(k)
        for batch in batches:
            unions = []
            for members in batch.column(3).to_pylist():
                held = np.concatenate([tokens(m["packed"]) >> np.uint64(32) for m in members])
                unions.append(pack(sorted_distinct(held)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(unions, pa.binary())], ["component", "part", "least", "members", "union"])

    return run


def _compare(k: int, percent: int):
    """Rows (members, union, least, queries) -> links (a, b): the union bounds each query's overlap, groups that qualify are opened.

    Equal upper halves of unequal tokens only raise the bound.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _opener(k)
        for batch in batches:
            a, b = [], []
            for i in range(batch.num_rows):
                union, least, members = unpack(batch.column(1)[i].as_py()), batch.column(2)[i].as_py(), None
                for query in batch.column(3)[i].as_py():
                    own = tokens(query["packed"])
                    halves = own >> np.uint64(32)
                    at = np.minimum(np.searchsorted(union, halves), len(union) - 1)
                    bound = int((union[at] == halves).sum())
                    if bound * 100 < percent * len(own) or bound * (100 + percent) < percent * (len(own) + least):
                        continue
                    if members is None:
                        members = [(m["class"], tokens(m["packed"])) for m in batch.column(0)[i].as_py()]
                    for other, t in members:
                        if _similar(own, t, percent):  # one link joins the query to all that the group is linked to
                            a.append(query["q"])
                            b.append(other)
                            break
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _verified(pairs: DataFrame, texts: DataFrame, members: DataFrame, k: int, percent: int, records: int = 32) -> DataFrame:
    """Links found among the pairs (q, component, part); ``members`` has (component, part, class, n).

    A group's members and union are stored once and sent along with ``CHUNK`` queries at a time, so that a group that very
    many ask is opened in many tasks.
    """
    spark = pairs.sparkSession
    key = ["component", "part"]
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(records)):
        gathered = members.join(texts, "class").groupBy(*key).agg(F.min("n").alias("least"), F.collect_list(F.struct("class", "packed")).alias("members"))
        schema = "component long, part long, least long, members array<struct<class: long, packed: binary>>, union binary"
        united = stored(gathered.mapInArrow(_united(k), schema), "jaccard-groups")
        asked = pairs.groupBy(*key).agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
        dealt = pairs.join(asked, key).withColumn("chunk", F.pmod(F.xxhash64("q"), F.col("chunks")))
        queries = (
            dealt.join(texts.withColumnRenamed("class", "q"), "q")
            .groupBy(*key, "chunk").agg(F.collect_list(F.struct("q", "packed")).alias("queries"))
        )
        rows = queries.join(united, key).select("members", "union", "least", "queries")
        return cut(rows.mapInArrow(_compare(k, percent), "a long, b long").distinct())


def _matrix(postings: DataFrame, found: DataFrame, sizes: DataFrame, percent: int, group_size: int) -> tuple[DataFrame, DataFrame]:
    """Postings of open tokens with their class's component and group, and all groups' members (component, part, class, n).

    A group holds classes of one component of ``found`` whose sizes lie in one step of 5 %, about ``group_size`` of them.
    Tokens that only one component holds are left out. ``low`` marks a token that stands early enough in its set to be the
    first one shared with a set that isn't smaller.
    """
    found = found.withColumnRenamed("id", "class").join(sizes, "class")
    found = found.withColumn("step", F.floor(F.log(F.col("n")) / F.log(F.lit(1.05))).cast("long"))
    counts = found.groupBy("component", "step").agg(F.count("*").alias("here"))
    whole = found.groupBy("component").agg(F.count("*").alias("size"))
    placed = cut(
        found.join(counts, ["component", "step"]).join(whole, "component")
        .select("class", "component", "size", (F.pmod(F.xxhash64("class"), F.ceil(F.col("here") / group_size)) * 1024 + F.col("step")).alias("part"))
    )
    spread = (
        postings.join(placed, "class", "left")
        .withColumn("component", F.coalesce("component", "class")).withColumn("size", F.coalesce("size", F.lit(1))).withColumn("part", F.coalesce("part", F.lit(0)).cast("long"))
        .withColumn("low", F.col("place") * (100 + percent) <= F.lit(100 - percent) * F.col("n"))
    )
    several = spread.groupBy("token").agg(F.min("component").alias("a"), F.max("component").alias("b")).where(F.col("a") < F.col("b")).select("token")
    spread = stored(spread.join(several, "token"), "jaccard-open")
    return spread, spread.select("component", "part", "class", "n").distinct()


def _candidates(spread: DataFrame, percent: int, by_part: bool) -> DataFrame:
    """(q, component, size, part): which group each query has to be compared with, for one group a component or, ``by_part``, for each.

    Of two components the smaller one asks. For two similar sets, let t be the first token that both hold: it stands at
    place ``n - overlap`` at most in each, and it is low in the set that isn't larger. So a token's rows are split: low rows
    meet all others, rows that aren't low meet low ones only, and very frequent tokens, which come late, meet few.
    """
    key = ["token", "component", "size"] + (["part"] if by_part else [])
    parts = [] if by_part else [F.min_by("part", F.struct("place", "class")).alias("part")]
    matrix = spread.groupBy(*key).agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("place").alias("first"), F.max("low").alias("low"), *parts)
    q = spread.withColumn("meets", F.explode(F.when(F.col("low"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True))))).alias("q")
    g = matrix.alias("g")
    n = F.col("q.n")
    low = F.greatest(F.col("g.lo"), F.ceil(n * percent / 100 - 1e-9))
    high = F.least(F.col("g.hi"), F.floor(n * 100 / percent + 1e-9))
    fits = (
        (F.struct("q.size", "q.component") < F.struct("g.size", "g.component"))
        & (low <= high)
        & (F.col("q.place") * (100 + percent) <= n * 100 - low * percent)
        & (F.col("g.first") * (100 + percent) <= high * 100 - n * percent)
    )
    joined = q.join(g, (F.col("q.token") == F.col("g.token")) & (F.col("q.meets") == F.col("g.low")) & fits)
    found = joined.select(F.col("q.class").alias("q"), "g.component", "g.size", "g.part")
    if by_part:
        return found.distinct()
    return found.groupBy("q", "component", "size").agg(F.min("part").alias("part"))


def similar_components(docs: DataFrame, k: int = 4, percent: int = 85, frequent_above: int = 16, group_size: int = 32) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component, component_id) for each row of ``docs``.

    Two rows link when 100 * intersection >= ``percent`` * union of their sets of k-word shingles;
    ``component_id`` is the smallest doc_id that links reach. Rows without words have no shingles and link with
    nothing: their component_id is their own doc_id. Rows with equal sets are linked, null doc_ids too; a
    component of null doc_ids only has a null component_id. ``component`` names the component also where a doc_id occurs
    with several texts, and is null without words; ``text_hash`` is xxhash64 of the text, null as empty. Repeated rows are kept.
    Empty tables give empty tables; other columns of ``docs`` play no part. Hashes of 64 bits stand for shingles and sets.
    """
    path = new_folder(docs.sparkSession, "jaccard")
    with scratch(docs.sparkSession), setting(docs.sparkSession, *TEXT_ROWS):
        return stored_at(_components(docs, k, percent, frequent_above, group_size), path)


def _components(docs: DataFrame, k: int, percent: int, frequent_above: int, group_size: int) -> DataFrame:
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-size // BUCKET_BYTES))
    path = new_folder(spark, "jaccard-first")
    schema = "doc_id long, text_hash long, n long, class long, counted boolean, bucket int, tokens binary, counts binary"
    source.mapInArrow(_first_pass(k, buckets), schema).write.partitionBy("counted").parquet(path)
    first = spark.read.schema(schema).parquet(path)
    sets = first.where(~F.col("counted")).select("doc_id", "text_hash", "n", "class")
    classes = cut(sets.where(F.col("n") > 0).groupBy("class").agg(F.min("doc_id").alias("representative"), F.min("n").alias("n")))
    sizes = classes.select("class", "n")

    counts = first.where("counted").select("bucket", "tokens", "counts").groupBy("bucket").applyInArrow(_count_bucket(frequent_above), "token long, n long")
    frequent = spark.sparkContext.broadcast(_most_frequent(cut(counts)))
    delete_folder(spark, f"{path}/counted=true")  # what is needed of them is in a table of its own
    packed = source.select("text").mapInArrow(_second_pass(k, percent, buckets, frequent), "bucket int, tokens binary, classes binary, sizes binary, places binary")
    postings = stored(packed.groupBy("bucket").applyInArrow(_shared_in_bucket, "token long, class long, n long, place long"), "jaccard-postings")

    # First links: each class is compared with one centre. A token's centre is the class that shares most of its own
    # prefix tokens: of a family of copies, one that was changed least. A class takes the centre of most of its tokens.
    weight = postings.groupBy("class").agg(F.count("*").alias("shared"))
    weighed = postings.join(weight, "class")
    centre = weighed.groupBy("token").agg(F.max(F.struct(F.col("shared") / F.col("n"), "class", "n")).alias("c"))
    centre = centre.select("token", F.col("c.class").alias("centre"), F.col("c.n").alias("m"))
    stars = (
        postings.join(centre, "token").where(F.col("class") != F.col("centre"))
        .groupBy("class", "n", "centre", "m").agg(F.count("*").alias("common"))
        .where((F.col("common") >= _needed(F.col("n"), F.col("m"), percent)) & (F.lit(100) * F.least("n", "m") >= F.lit(percent) * F.greatest("n", "m")))
        .groupBy("class").agg(F.max_by("centre", F.struct("common", -F.col("centre"))).alias("centre"))
    )
    stars = cut(stars)
    star_texts = _texts(source, classes, stars.select("class").unionByName(stars.select(F.col("centre").alias("class"))), k)
    alone = stars.select(F.col("centre").alias("component"), F.lit(0).cast("long").alias("part"), F.col("centre").alias("class")).distinct().join(sizes, "class")
    asked = stars.select(F.col("class").alias("q"), F.col("centre").alias("component"), F.lit(0).cast("long").alias("part"))
    found = cut(connected_components(_verified(asked, star_texts, alone, k, percent)))

    # Then queries against one group of each component that they may belong to; what is still apart, against all groups that it may.
    tried = None
    for by_part in (False, True):
        spread, members = _matrix(postings, found, sizes, percent, group_size)
        candidates = _candidates(spread, percent, by_part)
        if by_part:  # a component of the same size is the same one, and its groups are
            candidates = candidates.join(tried, ["q", "component", "size", "part"], "left_anti")
        tried = candidates = cut(candidates)
        if candidates.isEmpty():
            continue
        members = cut(members.join(candidates.select("component", "part").distinct(), ["component", "part"]))
        texts = _texts(source, classes, candidates.select(F.col("q").alias("class")).unionByName(members.select("class")), k)
        found = cut(joined_components(found, _verified(candidates, texts, members, k, percent)))

    joined = found.withColumnRenamed("id", "class")
    least = joined.join(classes, "class").groupBy("component").agg(F.min("representative").alias("component_id"))
    known = classes.select("class", "representative").join(joined.join(least, "component"), "class", "left")
    known = known.select("class", F.coalesce("component", "class").alias("component"), F.when(F.col("component").isNull(), F.col("representative")).otherwise(F.col("component_id")).alias("component_id"))
    with_words = sets.where(F.col("n") > 0).join(known, "class")
    without = sets.where(F.col("n") == 0).withColumn("component_id", F.col("doc_id")).withColumn("component", F.lit(None).cast("long"))
    columns = ["doc_id", "text_hash", F.col("n").alias("n_shingles"), "component", "component_id"]
    return with_words.select(*columns).unionByName(without.select(*columns))


def op3_query(spark, sf_dir: str) -> DataFrame:
    """Component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return similar_components(docs).select("doc_id", "n_shingles", "component_id")
