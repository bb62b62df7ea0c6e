"""Operator 5: token counts of unigram tokenisation, by dynamic programming over a shared trie.

Each batch's distinct pre-tokens that are new to a worker are sorted, which walks their trie depth first: the forward
scores of a prefix are computed once and kept on a stack for all pre-tokens below it, and the token count of
the best segmentation is stored where a pre-token ends.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Where the public vocabulary files lie, and the one that is read by default.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Marks the start of a pre-token in the vocabulary's pieces.
START = "▁"


def load_pieces(path: str = VOCABULARY) -> dict[str, float]:
    """Pieces with log probabilities. A vocabulary that only ranks its pieces gets Zipf's law: 1 / (rank + 2)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    normal = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    scores = [model.get_score(i) for i in normal]
    ranked = all(s == int(s) for s in scores)
    total = sum(1 / (r + 2) for r in range(len(normal)))
    return {model.id_to_piece(i): math.log(1 / (r + 2) / total) if ranked else scores[r] for r, i in enumerate(normal)}


class TrieCounter:
    """Token counts of pre-tokens. A character that no piece holds costs one token a UTF-8 byte."""

    def __init__(self, pieces: dict[str, float], most_known: int = 1_000_000):
        self.pieces, self.longest, self.most = pieces, max(map(len, pieces), default=1), most_known
        self.unknown = min(pieces.values(), default=0.0) - 10.0
        self.known: dict[str, int] = {}

    def learn(self, words: set[str]) -> None:
        """Store the counts of new pre-tokens; what is stored is forgotten when it is too much."""
        if len(self.known) + len(words) > self.most:
            self.known = {}
        new = sorted(w for w in words if w not in self.known)
        best, counts, before = [0.0], [0], ""
        for word in new:
            text = START + word
            shared = 0
            for a, b in zip(text, before):
                if a != b:
                    break
                shared += 1
            del best[shared + 1 :], counts[shared + 1 :]  # forward scores of the shared prefix stay
            for end in range(shared + 1, len(text) + 1):
                byte_tokens = len(text[end - 1].encode("utf-8", "surrogatepass"))
                top, n = best[end - 1] + self.unknown * byte_tokens, counts[end - 1] + byte_tokens
                for start in range(max(0, end - self.longest), end):
                    score = self.pieces.get(text[start:end])
                    if score is not None and best[start] + score > top:
                        top, n = best[start] + score, counts[start] + 1
                best.append(top)
                counts.append(n)
            self.known[word] = counts[-1]
            before = text

    def count(self, words: list[str]) -> int:
        return sum(map(self.known.__getitem__, words))


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, batch_words: int = 200_000) -> DataFrame:
    """``docs`` with n_pretokens and n_tokens; columns of these names are replaced.

    Pre-tokens are the words between blanks, tabs and line ends, each with the vocabulary's start mark. Null and
    empty texts have none. Among segmentations of equal score the one found with the longest last piece counts.
    The vocabulary is read once by the driver and sent to the tasks; rows are not shuffled, repeated rows get
    equal counts and empty tables give empty tables. A worker stores up to a million counts at a time.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(load_pieces(vocabulary))
    rest = docs.drop("n_pretokens", "n_tokens")
    text_at, names = rest.columns.index("text"), [*rest.columns, "n_pretokens", "n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TrieCounter(pieces.value)
        for batch in batches:
            words, tokens, held, waiting = [], [], [], 0

            def counted(held=held, tokens=tokens):
                counter.learn(set().union(*held))
                tokens.extend(counter.count(w) for w in held)
                held.clear()

            for text in batch.column(text_at):
                text = text.as_py()
                own = [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split()] if text else []
                words.append(len(own))
                held.append(own)
                waiting += len(own)
                if waiting > batch_words:
                    counted()
                    waiting = 0
            counted()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names)

    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType())]))


def op5_query(spark, sf_dir: str) -> DataFrame:
    """Token counts of every document."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
