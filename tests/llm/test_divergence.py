import random
import re
from collections import Counter, defaultdict

from pageflow.llm import divergence as d


def plain(rows, least=3, top=200):
    """The contract, word by word."""
    rows = [tuple(x or "" for x in r) for r in rows]
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    words = [(a, s, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(t))) for a, s, t in rows]
    docs = defaultdict(Counter)
    for a, _, w in words:
        docs[a].update(set(w))
    kept = {a: {t for t, n in c.items() if n >= least} for a, c in docs.items()}
    counts = defaultdict(Counter)
    for a, s, w in words:
        counts[a, s].update(t for t in w if t in kept[a])
        counts[a, None].update(t for t in w if t in kept[a])
    out = []
    for a, s in {(a, s) for a, s, _ in words}:
        share = lambda g, t: 1 + 10**9 * (counts[a, g][t] + 1) // (sum(counts[a, g].values()) + len(kept[a]))  # noqa: E731, B023
        f = lambda g, h, t: (share(g, t) - share(h, t)) ** 2 // share(h, t)  # noqa: E731, B023
        pairs = [(sum(f(s, o, t) for t in kept[a]), o) for b, o in {(b, o) for b, o, _ in words} if b == a and o != s]
        terms = [(f(s, None, t), t) for t in kept[a] if counts[a, s][t] and share(s, t) > share(None, t)]
        for part, found in (("pair", pairs), ("term", terms)):
            ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))
            out += [(a, s, part, item, value, i + 1) for i, (value, item) in enumerate(ordered) if part == "pair" or i < top]
    return sorted(out)


def same(spark, rows, **options):
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    assert sorted(map(tuple, d.audit(df, **options).select("lang", "source", "part", "item", "value", "rank").collect())) == plain(rows, **options)


def corpus(n, seed, longest=40):
    random.seed(seed)
    vocabulary = ["".join(random.choice("abcé日Z") for _ in range(random.randint(1, longest))) for _ in range(60)]
    vocabulary += [v[: random.randint(1, 9)] + "x" for v in vocabulary]
    return [(random.choice(["en", "de", None]), random.choice(["a", "b", "c", None]), " ".join(random.choice(vocabulary) for _ in range(random.randint(0, 30)))) for _ in range(n)]


def test_many_levels(spark):
    same(spark, corpus(60, 1), top=15)


def test_long_texts_in_pieces(spark, monkeypatch):
    """Terms of a document that lies in several pieces count it once."""
    rows = corpus(12, 2) + [("en", "a", "lone rare " * 4000 + "end"), ("en", "b", "rare é-é " + "w" * 9000), ("en", "c", "w" * 9000 + " lone"), ("en", "c", "w" * 9000)]
    same(spark, rows * 2)
    df = spark.createDataFrame(rows, "lang string, source string, text string").coalesce(1).na.fill("")
    before = d.PIECE
    whole = sorted(map(str, d.kept_terms(df).collect()))
    import pyarrow as pa

    texts = pa.array([r[2] for r in rows])
    d.PIECE = 64
    try:
        found = defaultdict(list)
        for low, _, starts, ends, row, *_ in d.Pieces()(texts):
            for i, j, r in zip(starts.tolist(), ends.tolist(), row.tolist(), strict=True):
                found[r].append(low[i:j].tobytes().decode())
        tally, pieces, n = d.Tally(), d.Pieces(), 0
        for low, sums, starts, ends, row, _, _, more in pieces(texts):
            tally.add(pieces.hashes(sums, starts, ends), row * 0, row, low.tobytes(), starts, ends, more)
            n += 1
        counted = {bytes(i.as_py()).decode(): (int(x), int(y)) for _, items, ns, ds in tally.give() for i, x, y in zip(items, ns, ds, strict=True)}
    finally:
        d.PIECE = before
    want = [re.findall(r"[a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[2])) for r in rows]
    assert n > 100 and [found[i] for i in range(len(rows))] == want
    assert counted == {t: (sum(w.count(t) for w in want), sum(t in w for w in want)) for t in {t for w in want for t in w}}
    assert whole == sorted(map(str, d.kept_terms(df).collect()))


def test_odd_rows(spark):
    same(spark, [("en", "a", None), (None, None, None), ("en", None, "12 .,"), ("fr", "a", "x y")])
    same(spark, [("en", "a", "same text Same"), ("en", "a", "same text Same"), ("en", "a", "same text Same"), ("en", "b", "")])
    same(spark, [("en", s, "tie tied ties") for s in "abcd"])
    df = spark.createDataFrame([(1, "en", "a", "x", "own", 3)], "doc_id long, lang string, source string, text string, item string, rank int")
    assert d.audit(df).count() == 0 and d.audit(df.limit(0)).count() == 0
    assert d.audit(df, least=1).count() == 0  # p isn't above q where there is one source


def test_groups_beyond_the_broadcast_and_many_pairs_at_once(spark, monkeypatch):
    monkeypatch.setattr(d, "BROADCAST_GROUPS", 0)
    same(spark, corpus(50, 3, 12))


def test_pairs_in_chunks(spark):
    rows = [("en", f"s{i}", "common " + ("even " if i % 2 else "odd ") * (i % 5)) for i in range(40)]
    same(spark, rows)
