from collections import Counter

from tests.llm import brute

import corpus_pipeline
from pageflow.llm import mix


def test_stages_against_plain_forms(spark, sf001, tmp_path):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf001}/benchmark.parquet").select("item_id", "text").collect()]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, sf001)
        if name != "sharding":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = rows = docs.collect()
        ids = {r["doc_id"] for r in rows}
        if name == "language":
            assert len(ids) > 0.95 * len(before)
        if name == "near_duplicates":
            groups = brute.jaccard_components(sorted(before.items()), k=5, percent=80)
            assert ids == {c if n else d for d, n, c in groups}
        if name == "decontamination":
            assert ids == {r[0] for r in brute.decontaminate(list(before.items()), items) if not r[5]}
        if name == "mixing":
            words = Counter()
            for r in rows:
                assert r["text"] in before[r["doc_id"]]
                words[r["doc_id"]] += len(mix.word_starts(r["text"]))
            assert all(n <= 2 * len(mix.word_starts(before[d])) for d, n in words.items())
            assert abs(sum(words.values()) - 1.5 * sum(len(mix.word_starts(t)) for t in before.values())) <= 192 * 20
    assert len(kept["sharding"]) == len(kept["mixing"]) and {r["shard"] for r in kept["sharding"]} == set(range(24))
    assert corpus_pipeline.run(spark, sf001).count() == len(kept["sharding"])


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, repeats, one doc_id with two texts, empty tables, and columns named as the operators' own."""
    long = " ".join(f"w{i % 700}x" for i in range(30_000))
    words = lambda a, n=40: " ".join(f"{a}{i}" for i in range(n))
    rows = [(1, words("a")), (1, words("q")), (1, words("a")), (2, words("a")), (None, words("a")), (None, words("n")), (3, None), (4, ""), (5, " \n"), (6, long), (7, long + " z"), (None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, shard string, n_words string, component string, _hash string"
    docs = spark.createDataFrame([(d, t, "en" if i % 2 else None, None if i % 3 else "s", None, f"own{i}", "own", "own", "own", "own") for i, (d, t) in enumerate(rows)], schema)
    spark.createDataFrame([(1, words("zz")), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert set(docs.columns) <= set(out.columns)
        got[name] = [(r["doc_id"], r["text"], r["score"]) for r in out.collect()]
        assert all(r["_hash"] == r["n_words"] == r["component"] == "own" for r in out.collect())
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    key = lambda x: (x[0] or 0, x[1] or "")
    assert sorted({(d, t) for d, t, _ in got["near_duplicates"]}, key=key) == sorted([(1, words("a")), (1, words("q")), (None, words("n")), (3, None), (4, ""), (5, " \n"), (6, long), (None, None)], key=key)
    assert len(got["near_duplicates"]) == 8
    assert len(got["decontamination"]) == len(got["sharding"]) == len(rows)
    assert {t for _, t, _ in got["language"]} <= {t for _, t in rows if t and t.strip()}
    assert all(s.startswith("own") for name in got for _, _, s in got[name])
    assert sum(len(mix.word_starts(t)) for _, t, _ in got["mixing"]) > 0


def test_the_same_of_repeated_rows_stays_in_every_run(spark, tmp_path):
    words = " ".join(f"w{i}" for i in range(30))
    rows = [(1, words, "en", s) for s in "abcdefgh"] + [(2, words, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = {tuple(map(tuple, corpus_pipeline.near_duplicates(spark, docs.repartition(n, "source"), str(tmp_path)).collect())) for n in (1, 3, 8)}
    assert len(found) == 1 and len(next(iter(found))) == 1
