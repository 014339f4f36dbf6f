"""Token counts by dynamic programming shared over a trie.

A pre-token is a word with the word mark before it. Its tokens are the best
segmentation into pieces under a unigram model (the sum of the pieces' scores).
The forward scores of a prefix do not depend on what follows, so a task inserts
its different pre-tokens in a trie, computes each node's forward score and
token count once, however many words share the prefix, and keeps the count at
the word's last node. Documents are then sums of kept counts; nothing is
shuffled, and each task's trie has a bounded number of nodes: beyond a fixed
depth a word has none, its scores go through a window as wide as the longest piece.

The pieces come from a public file. One made by merging pairs has no
probabilities, its scores are minus the ranks of the merges; a piece's probability
is then taken from its rank by Zipf's law. Nothing is trained.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter, deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm.common import workers_ready

MARK = "▁"
#: A worker's trie and words are begun anew beyond these numbers (about 150 MB).
NODES, WORDS = 800_000, 400_000
#: Characters of a pre-token that have nodes; a longer one's count is not kept.
DEPTH = 512


def read_pieces(path: str | None = None) -> dict[str, float]:
    """Pieces and scores of a sentencepiece model file (None: the public ``piece_bpe_32k.model``)."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))}


def zipf_scores(pieces: dict[str, float]) -> dict[str, float]:
    """Log probabilities by Zipf's law: a piece's probability is to one over its rank,
    the highest score first, equal scores in the order of the pieces."""
    ranked = sorted(pieces, key=lambda p: (-pieces[p], p))
    total = math.log(sum(1 / r for r in range(1, len(ranked) + 1)) or 1.0)
    return {p: -math.log(r) - total for r, p in enumerate(ranked, 1)}


class Trie:
    """Forward scores and token counts of prefixes. A character that is no piece
    costs the least score less ``penalty`` and counts as its UTF-8 bytes."""

    def __init__(self, pieces: dict[str, float], penalty: float = 10.0):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.unknown = min(pieces.values(), default=0.0) - penalty
        self.clear()

    def clear(self) -> None:
        self.next: dict[tuple[int, str], int] = {}
        self.score, self.count = array("d", [0.0]), array("q", [0])
        self.terminal: dict[bytes, int] = {}

    def step(self, pretoken: str, end: int, scores: Sequence[float], counts: Sequence[int], first: int) -> tuple[float, int]:
        """Score and tokens of the first ``end`` characters from those of shorter prefixes, the first of which has ``first`` characters."""
        best, n, pieces = float("-inf"), 0, self.pieces
        for start in range(max(0, end - self.longest), end):
            piece = pieces.get(pretoken[start:end])
            if piece is None:
                if start < end - 1 or best > float("-inf"):
                    continue
                piece, width = self.unknown, len(pretoken[start].encode("utf-8", "replace"))
            else:
                width = 1
            total = scores[start - first] + piece
            if total > best:
                best, n = total, counts[start - first] + width
        return best, n

    def tokens(self, pretoken: str) -> int:
        """Tokens of the best segmentation; of equals, that with the longest last piece."""
        node, scores, counts = 0, [0.0], [0]
        for end, char in enumerate(pretoken[:DEPTH], 1):
            known = self.next.get((node, char))
            if known is None:
                best, n = self.step(pretoken, end, scores, counts, 0)
                known = self.next[node, char] = len(self.score)
                self.score.append(best)
                self.count.append(n)
            node = known
            scores.append(self.score[node])
            counts.append(self.count[node])
        if len(pretoken) > DEPTH:  # no nodes: the last places alone are kept
            scores, counts = deque(scores, maxlen=self.longest), deque(counts, maxlen=self.longest)
            for end in range(DEPTH + 1, len(pretoken) + 1):
                best, n = self.step(pretoken, end, scores, counts, end - len(scores))
                scores.append(best)
                counts.append(n)
        return counts[-1]

    def learn(self, words: set[bytes]) -> None:
        """Inserts the words that are new and keeps their counts, but not those of words over ``DEPTH`` bytes."""
        if len(self.score) > NODES or len(self.terminal) > WORDS:
            self.clear()
        for w in words.difference(self.terminal):
            if len(w) <= DEPTH:
                self.terminal[w] = self.tokens(MARK + w.decode("utf-8", "replace"))

    def total(self, words: list[bytes]) -> int:
        """Tokens of all words. The bounds hold within a text too: each new word may begin the trie anew."""
        total, kept = 0, self.terminal
        for w, times in Counter(words).items():
            count = kept.get(w)
            if count is None:
                if len(w) > DEPTH:
                    count = self.tokens(MARK + w.decode("utf-8", "replace"))
                else:
                    self.learn({w})
                    kept = self.terminal
                    count = kept[w]
            total += times * count
        return total


_TRIES: dict[tuple[str | None, bool], Trie] = {}


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None,
                 ranked: bool = True) -> DataFrame:
    """One row a row of ``docs``: ``id_col``, n_pretokens, n_tokens.

    Pre-tokens are the runs between ASCII white space. Null, empty and blank
    texts have none. ``model``: path of a sentencepiece file that the executors
    can open. ``ranked``: its scores are ranks (see ``zipf_scores``), else log
    probabilities. Words of any length are counted whole. Other columns are neither read nor returned."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (model, ranked) not in _TRIES:
            found = read_pieces(model)
            _TRIES[model, ranked] = Trie(zipf_scores(found) if ranked else found)
        trie = _TRIES[model, ranked]
        for batch in batches:
            pretokens, tokens = [], []
            for text in batch.column(1).cast(pa.large_binary()):
                words = (text.as_py() or b"").split()
                pretokens.append(len(words))
                tokens.append(trie.total(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pretokens, pa.int64()), pa.array(tokens, pa.int64())],
                                             names=["id", "n_pretokens", "n_tokens"])

    workers_ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("n_pretokens", T.LongType()),
                           T.StructField("n_tokens", T.LongType())])
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
