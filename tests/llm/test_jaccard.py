import random

import numpy as np

from pageflow.llm import jaccard
from tests.llm import brute


def check(spark, docs, **options):
    got = jaccard.similar_components(spark.createDataFrame(docs, "doc_id long, text string"), **options).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute.jaccard_components(docs, options.get("k", 4), options.get("percent", 85)), key=str)


def test_whole_table(spark, sf001):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf001}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, jaccard.op3_query(spark, sf001).collect())) == sorted(brute.jaccard_components(docs))


def test_near_copies_at_the_edge(spark):
    random.seed(11)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for family in range(12):
        base = random.choices(words, k=random.choice([6, 12, 40, 90, 160]))
        for _ in range(14):
            text = list(base)
            for _ in range(random.randint(0, max(1, len(text) // 14))):
                text[random.randrange(len(text))] = random.choice(words)
            docs.append((len(docs), " ".join(text[: len(text) - random.randint(0, 3)])))
            base = text if random.random() < 0.3 else base
    passage = " ".join(random.choices(words, k=30))
    docs += [(1000 + i, passage + " " + " ".join(random.choices(words, k=20))) for i in range(40)]
    check(spark, docs, frequent_above=3, group_size=4)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " \n"), (None, "a b"), (5, "A b"), (5, "c d e f g"), (6, "c d e f g"), (7, "a b"), (None, None), (8, "x " * 3000), (9, "x x x x"), (None, "only null"), (None, "only null"), (3, "c d e f g")]
    check(spark, docs)
    check(spark, docs[:3])
    check(spark, docs[:0] + [(4, "z")])
    empty = spark.createDataFrame([], "doc_id long, text string, class string, n int")
    assert jaccard.similar_components(empty).count() == 0


def test_prefix_bound():
    """No pair that is similar shares fewer prefix tokens than the count filter asks for."""
    rng = np.random.default_rng(2)
    none = np.zeros(0, dtype=np.uint64)
    for _ in range(300):
        n = int(rng.integers(1, 200))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        keep = a[rng.random(len(a)) > rng.random() * 0.12]
        b = np.unique(np.concatenate([keep, rng.integers(0, 2**63, int(rng.integers(0, 1 + n // 12))).astype(np.uint64)]))
        if len(b) and jaccard._similar(a, b, 85):
            x, y = len(a), len(b)
            need = -(-85 * (x + y) // 185) - -(-85 * max(x, y) // 100) + 1
            assert len(np.intersect1d(jaccard.prefix(a, 85, none), jaccard.prefix(b, 85, none))) >= max(1, need)


def test_first_shared_token():
    """The first token that similar sets share stands early in both, and is low in the set that isn't larger."""
    rng = np.random.default_rng(3)
    none = np.zeros(0, dtype=np.uint64)
    for percent in (85, 80, 60):
        for _ in range(200):
            a = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 200))).astype(np.uint64))
            keep = a[rng.random(len(a)) > rng.random() * 0.2]
            b = np.unique(np.concatenate([keep, rng.integers(0, 2**63, int(rng.integers(0, 1 + len(a) // 10))).astype(np.uint64)]))
            if not len(b) or not jaccard._similar(a, b, percent):
                continue
            x, y = jaccard.prefix(a, percent, none), jaccard.prefix(b, percent, none)
            token = next(t for t in x if t in b)
            i, j, n, m = int(np.flatnonzero(x == token)[0]), int(np.flatnonzero(y == token)[0]), len(a), len(b)
            assert i * (100 + percent) <= 100 * n - percent * m and j * (100 + percent) <= 100 * m - percent * n
            small, place = (n, i) if n <= m else (m, j)
            assert place * (100 + percent) <= (100 - percent) * small


def test_link_to_a_component_of_larger_sets(spark):
    """A (24) links with B (26) only, whose component holds sets of 24 to 27: the need isn't least at an end."""
    sets = jaccard.Shingler(1)
    words = sorted((f"w{i}" for i in range(28)), key=lambda w: int((sets(w) * jaccard.WORD_SEED_A)[0] >> np.uint64(1)))
    z, b, c, a = words[:1], words[1:4], words[4:27], words[27:]
    docs = [(1, c + a), (2, b + c), (3, b + c[:21]), (4, z + b + c)]
    check(spark, [(i, " ".join(x)) for i, x in docs], k=1)
