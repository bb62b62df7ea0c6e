import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pageflow.llm import lm


def tokens(text):
    return [*re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()), "end"]


def plain_model(texts):
    words, pairs = Counter(), Counter()
    for t in texts:
        ts = tokens(t)
        words.update(ts)
        pairs.update(zip(["start", *ts], ts))
    context, follow, ends = Counter(), defaultdict(lambda: [0, 0, 0]), Counter()
    for (u, v), c in pairs.items():
        context[u] += c
        follow[u][min(c, 3) - 1] += 1
        ends[v] += 1
    d = lm.discounts(*[sum(c == i for c in pairs.values()) for i in (1, 2, 3, 4)])
    e = lm.discounts(*[sum(c == i for c in ends.values()) for i in (1, 2, 3, 4)])
    n, v, kinds = sum(words.values()), len(words), len(pairs)
    spare = sum(e[min(c, 3)] for c in ends.values()) / kinds if kinds else 1.0

    def p(u, w):
        low = max(ends[w] - e[min(ends[w], 3)], 0) / max(kinds, 1) + spare / (v + 1)
        if not context[u]:
            return low
        c = pairs[u, w]
        return max(c - d[min(c, 3)], 0) / context[u] + sum(x * y for x, y in zip(d[1:], follow[u])) / context[u] * low

    return words, n, v, p


def compare(rows, texts, trained):
    words, n, v, p = plain_model(trained)
    for r, text in zip(rows, texts, strict=True):
        ts = tokens(text)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ts), sum(words[t] > 0 for t in ts), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((words[t] + 1) / (n + v + 1)) for t in ts))
        assert r["score"] == pytest.approx(sum(math.log10(p(u, w)) for u, w in zip(["start", *ts], ts)))


def test_whole_table(spark, sf001):
    rows = lm.op6_query(spark, sf001).orderBy("doc_id").collect()
    docs = spark.read.parquet(f"{sf001}/documents.parquet").orderBy("doc_id").collect()
    held = [zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2 for r in docs]
    assert [r["held_out"] for r in rows] == held
    compare(rows, [r["text"] for r in docs], [r["text"] for r, h in zip(docs, held) if not h])
    assert sum(r["score"] for r in rows if r["held_out"]) > sum(r["base_score"] for r in rows if r["held_out"])


def test_odd_rows(spark):
    texts = [None, "", "a b a b a", "A B", "a b a b a", "unknown words here", "x " * 20000]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    model = lm.fit(docs.where("doc_id < 5"))
    compare(lm.score(docs, model).orderBy("doc_id").collect(), texts, texts[:5])
    none = lm.fit(docs.limit(0))
    assert all(math.isfinite(r["score"]) for r in lm.score(docs, none).collect())
    assert lm.score(docs.limit(0), model).count() == 0


def test_packing():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    assert (lm.unpack(lm.pack(keys)) == keys).all() and (lm.unmixed(lm.mixed(keys)) == keys).all()
    other = rng.integers(0, 9, 50).astype(np.uint64)
    assert (lm.unpack(lm.pack(other)) == other).all() and len(lm.unpack(lm.pack(keys[:0]))) == 0


def test_a_missing_array_is_an_error(spark):
    """Rather than words that nobody knows."""
    import os

    docs = spark.createDataFrame([(i, f"some words {i} and more {i % 7}") for i in range(300)], "doc_id long, text string")
    model = lm.fit(docs)
    folder = model.folder.removeprefix("file://")
    lost = next(f for f in sorted(os.listdir(folder)) if f.startswith("pair-") and f.endswith("-0"))
    os.rename(f"{folder}/{lost}", f"{folder}/.{lost}")
    with pytest.raises(Exception, match="is missing"):
        lm.score(docs, model).collect()
    os.rename(f"{folder}/.{lost}", f"{folder}/{lost}")
    os.truncate(f"{folder}/{lost[:-1]}1", 0)
    with pytest.raises(Exception, match="missing or cut short"):
        lm.score(docs, model).collect()
