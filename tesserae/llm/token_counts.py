"""Token counts by a linear longest-match automaton.

A word is split greedily: the longest vocabulary piece that begins it, then again and again the longest continuation
piece; a word with no such split is one unknown token. The automaton reads each character once. Its states are the
nodes of two tries, of word-initial and of continuation pieces; where a node has no edge for the next character,
its failure link leads to the continuation node that spells what is left after popping the pieces matched so
far, and the number of popped pieces is stored beside the link. Summing these numbers gives the length of the
split without building it. Both follow by breadth-first search (Song et al. 2021, "Fast WordPiece Tokenization").

Words are runs of characters other than ASCII blanks. Equal words of a slice are counted once, and a bounded memo
keeps a worker's words. The vocabulary is a fixed public one: pieces with a leading U+2581 begin words.

Defined results: a null or empty text has 0 words and 0 tokens; repeated rows are counted one by one; an empty table
gives an empty table; only the id and text columns are read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import _arrow
from tesserae.session import table

MARK = "▁"
MEMO_WORDS = 500_000


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pieces(path: str) -> list[str]:
    """All pieces that stand for text; the mark tells those that begin words."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return [model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


class Automaton:
    """Nodes 0 and 1 are the roots of initial and continuation pieces; -1 is no link."""

    def __init__(self, vocabulary: Iterable[str]):
        self.edges: list[dict[str, int]] = [{}, {}]
        whole = [False, False]
        for piece in vocabulary:
            node, rest = (0, piece[1:]) if piece.startswith(MARK) else (1, piece)
            for c in rest:
                if (to := self.edges[node].get(c)) is None:
                    to = self.edges[node][c] = len(self.edges)
                    self.edges.append({})
                    whole.append(False)
                node = to
            if node != 1:
                whole[node] = True
        self.link, self.pops = [-1] * len(self.edges), [0] * len(self.edges)
        if whole[0]:  # the mark by itself
            self.link[0], self.pops[0] = 1, 1
        todo = deque([0, 1])
        while todo:
            node = todo.popleft()
            for c, to in self.edges[node].items():
                if whole[to]:
                    self.link[to], self.pops[to] = 1, 1
                else:
                    at, popped = self.link[node], self.pops[node]
                    while at >= 0 and c not in self.edges[at]:
                        popped += self.pops[at]
                        at = self.link[at]
                    if at >= 0:
                        self.link[to], self.pops[to] = self.edges[at][c], popped
                todo.append(to)

    def count(self, word: str) -> int:
        """Number of tokens of a word; 0 if it has no split."""
        edges, link, pops = self.edges, self.link, self.pops
        node = popped = 0
        for c in word:
            while (to := edges[node].get(c)) is None:
                popped += pops[node]
                node = link[node]
                if node < 0:
                    return 0
            node = to
        while node != 1:
            popped += pops[node]
            node = link[node]
            if node < 0:
                return 0
        return popped


@lru_cache(maxsize=2)
def automaton(path: str) -> tuple[Automaton, dict[bytes, int]]:
    return Automaton(pieces(path)), {}


def token_counts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown): an unknown word is one token."""
    path = path or vocabulary_path()
    names = ["doc_id", "n_words", "n_tokens", "n_unknown"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, memo = automaton(path)
        for batch in batches:
            for part in _arrow.slices(batch, 1):
                words, at = _arrow.words(part.column(1))
                coded = words.dictionary_encode()
                distinct = coded.dictionary.to_pylist()
                new = [w for w in distinct if w not in memo]
                if len(memo) + len(new) > MEMO_WORDS:
                    memo.clear()
                    new = distinct
                memo.update((w, machine.count(w.decode())) for w in new)
                counts = np.fromiter(map(memo.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()] if distinct else np.empty(0, np.int64)
                tokens, unknown = (np.concatenate([[0], np.cumsum(x)]) for x in (np.maximum(counts, 1), counts == 0))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.int64()) for x in (np.diff(at), tokens[at[1:]] - tokens[at[:-1]], unknown[at[1:]] - unknown[at[:-1]]))], names)
        memo.clear()
        _arrow.release()

    return df.select(doc_id, text).mapInArrow(run, f"doc_id {df.schema[doc_id].dataType.simpleString()}, n_words long, n_tokens long, n_unknown long")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
