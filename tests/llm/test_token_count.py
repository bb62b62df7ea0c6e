import re

from pageflow.llm import token_count


def plain(word, pieces, unknown):
    """Best segmentation of one word by itself."""
    text, best = token_count.START + word, [(0.0, 0)]
    for end in range(1, len(text) + 1):
        n = len(text[end - 1].encode())
        options = [(best[end - 1][0] + unknown * n, best[end - 1][1] + n)]
        options += [(best[s][0] + pieces[text[s:end]], best[s][1] + 1) for s in range(end) if text[s:end] in pieces]
        best.append(max(options, key=lambda o: o[0]))
    return best[-1][1]


def test_whole_table(spark, sf001):
    pieces = token_count.load_pieces()
    unknown = min(pieces.values()) - 10
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf001}/documents.parquet").collect()}
    known = {}
    rows = token_count.op5_query(spark, sf001).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]] or "")
        assert r["n_pretokens"] == len(words)
        for w in words:
            if w not in known:
                known[w] = plain(w, pieces, unknown)
        assert r["n_tokens"] == sum(known[w] for w in words)


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (None, "x", "c"), (3, "一\U0001f600一 the the", "d"), (3, "a" * 5000, "e")]
    out = token_count.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")).collect()
    assert [r["n_tokens"] == 0 for r in out] == [True, True, False, False, False]
    assert token_count.count_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_forgetting_keeps_counts():
    pieces = {token_count.START: -1.0, "a": -1.0, "ab": -1.5, token_count.START + "ab": -2.0}
    small, large = token_count.TrieCounter(pieces, most_known=2), token_count.TrieCounter(pieces)
    for words in (["ab", "abab"], ["aab", "zé"], ["ab", "b"]):
        small.learn(set(words))
        large.learn(set(words))
        assert small.count(words) == large.count(words) == sum(plain(w, pieces, -12.0) for w in words)
