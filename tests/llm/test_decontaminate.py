import random

from pageflow.llm import decontaminate
from tests.llm import brute


def same(spark, docs, items):
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    rows = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in got.collect()), key=str)
    want = sorted(((a, b, c, d, f) for a, b, c, d, _, f in brute.decontaminate(docs, items)), key=str)
    assert rows == want


def test_whole_tables(spark, sf001):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf001}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf001}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted(map(tuple, decontaminate.op9_query(spark, sf001).collect())) == sorted(brute.decontaminate(docs, items))


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(40))
    docs = [(1, None), (2, ""), (3, "a b"), (None, long), (4, long), (4, long), (4, long.upper() + " É é"), (5, "x " * 5000 + long), (6, "W1-w2.w3 " * 9), (7, "é\tÉ x")]
    same(spark, docs, [(1, long), (2, "a"), (3, "w1 W2"), (None, "w1 w2 w3"), (5, ""), (6, None), (7, "É"), (1, long)])
    same(spark, docs, [(6, None)])
    before = decontaminate.BROADCAST_SHINGLES, decontaminate.BROADCAST_DOCS
    decontaminate.BROADCAST_SHINGLES = decontaminate.BROADCAST_DOCS = 0
    try:
        same(spark, docs, [(1, long), (2, "a"), (3, "w1 W2"), (None, "w1 w2 w3"), (7, "É")])
    finally:
        decontaminate.BROADCAST_SHINGLES, decontaminate.BROADCAST_DOCS = before


def test_passages_that_almost_fit(spark):
    """Windows at the ends of texts, overlapping, cut short, and parted by one word; frequent anchors."""
    random.seed(2)
    item = [random.choice("abcdefgh") for _ in range(60)]
    docs = []
    for i in range(120):
        lo = random.randint(0, 50)
        piece = item[lo : lo + random.randint(1, 40)]
        if i % 3 == 0:
            piece[random.randrange(len(piece))] = "zz"
        docs.append((i, " ".join([random.choice("abcdefgh") for _ in range(random.randint(0, 3))] + piece + ["q"] * random.randint(0, 2))))
    same(spark, docs, [(1, " ".join(item)), (2, " ".join(item[5:20])), (3, "a b c")])


def test_empty_tables(spark):
    same(spark, [(1, "a")], [(1, "a a a a")])
    docs = spark.createDataFrame([(1, "a b", "own", "own")], "doc_id long, text string, items string, start string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, none).where("contaminated").count() == 0
    assert decontaminate.contamination(docs.limit(0), spark.createDataFrame([(1, "a b")], none.schema)).count() == 0
    assert decontaminate.contamination(docs, spark.createDataFrame([(1, "A-B")], none.schema)).first()["n_hit"] == 2
