"""Token counts by trie-shared dynamic programming over a unigram model.

The vocabulary is that of a public tokenizer; as tokenizers are never trained
here, a piece's unigram log probability follows from its place in the
vocabulary (Zipf-Mandelbrot). The distinct pre-tokens of a block of text are
inserted in a trie of arrays, level by level: a node is a prefix, with its sign
and its parent. The forward score of every node is computed once, for all nodes
of a level together: its last signs are walked back along the parents and, in
step, down a trie of the reversed pieces; each piece met there is a last token.
Terminal nodes store the token counts of their pre-tokens. A pre-token of more
than LEVELS signs, or with a NUL in it, is computed by itself, sign by sign.

A character that no piece covers falls back to its UTF-8 bytes. Ties of score
go to the path with fewer tokens.

Defined results: null and empty texts have 0 words and 0 tokens. Repeated
documents are each counted; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import textops as X

MARK = "▁"
#: The signs of all pre-tokens whose counts stay in a worker's memory (about 100 MB); then they are computed anew. Long ones are never kept.
CACHE_SIGNS = 3 << 20
BLOCK_CHARS = 1 << 20
LEVELS = 48
LEAST = 1e-9


def unigram(name: str = "piece_bpe_32k.model") -> tuple[dict[str, float], int, float]:
    """(log probability by piece, characters of the longest, log probability of one fallback byte)."""
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    total = math.log(sum(1 / (r + 2.7) for r in range(len(pieces))))
    table = {p: -math.log(r + 2.7) - total for r, p in enumerate(pieces)}
    return table, max(map(len, pieces)), min(table.values()) - 4


def count_sorted(words: list[str], table: dict[str, float], longest: int, byte: float) -> dict[str, int]:
    """Tokens of each pre-token; words are sorted and distinct."""
    out, before = {}, ""
    best, tokens = [0.0], [0]
    for word in words:
        marked = MARK + word
        shared, most = 0, min(len(before), len(marked))
        while shared < most and before[shared] == marked[shared]:
            shared += 1
        del best[shared + 1 :], tokens[shared + 1 :]
        for j in range(shared + 1, len(marked) + 1):
            b = len(marked[j - 1].encode("utf-8", "surrogatepass"))
            top, least = best[j - 1] + b * byte, tokens[j - 1] + b
            for i in range(max(0, j - longest), j):
                p = table.get(marked[i:j])
                if p is not None:
                    s, t = best[i] + p, tokens[i] + 1
                    if s > top + LEAST or (s > top - LEAST and t < least):
                        top, least = s, t
            best.append(top)
            tokens.append(least)
        out[word] = tokens[-1]
        before = marked
    return out


class Trie:
    """The reversed pieces as arrays, and the scores of pre-tokens by them."""

    def __init__(self, table: dict[str, float], longest: int, byte: float):
        self.table, self.longest, self.byte = table, longest, byte
        edges: dict[tuple[int, int], int] = {}
        score = [-np.inf]
        for piece, p in table.items():
            state = 0
            for c in map(ord, reversed(piece)):
                nxt = edges.get((state, c))
                if nxt is None:
                    nxt = edges[state, c] = len(score)
                    score.append(-np.inf)
                state = nxt
            score[state] = p
        keys = np.array([(s << 21) + c for s, c in edges], np.int64)
        order = np.argsort(keys)
        self.keys, self.next, self.score = keys[order], np.array(list(edges.values()), np.int64)[order], np.array(score)
        self.first = np.full(0x110000, -1, np.int32)  # what most steps ask: the root's edges
        at_root = self.keys >> 21 == 0
        self.first[self.keys[at_root]] = self.next[at_root]

    def step(self, state: np.ndarray, sign: np.ndarray) -> np.ndarray:
        """The next states; -1 for none."""
        if not len(self.keys):
            return np.full(len(state), -1)
        key = (state << 21) + sign
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.next[at], -1)

    def counts(self, words: list[str]) -> dict[str, int]:
        """Tokens of each of the distinct words, which may come in any order."""
        short = [w for w in words if len(w) < LEVELS and "\0" not in w]
        out = count_sorted(sorted(w for w in words if len(w) >= LEVELS or "\0" in w), self.table, self.longest, self.byte)
        if short:
            out |= self._short(short)
        return out

    def _short(self, words: list[str]) -> dict[str, int]:
        text = np.unique(np.array([MARK + w for w in words]))  # in the order of code points
        sign = np.ascontiguousarray(text).view(np.uint32).reshape(len(text), -1).astype(np.int64)
        length = (sign != 0).sum(1)
        same = np.cumprod(sign[1:] == sign[:-1], 1, dtype=np.int8).sum(1)
        shared = np.r_[0, np.minimum(same, length[:-1])]  # signs in common with the word before
        tokens = np.zeros(len(text), np.int64)
        #: for each level: the sign, the parent's place in the level above, score and tokens of its nodes; the root is level 0
        signs, parents, best, least = [None], [None], [np.zeros(1)], [np.zeros(1, np.int64)]
        place = np.zeros(len(text), np.int64)  # of each word's node in the level above
        for d in range(1, sign.shape[1] + 1):
            new = (shared < d) & (length >= d)
            rows = np.flatnonzero(new)
            if not len(rows):
                break
            signs.append(sign[rows, d - 1])
            parents.append(place[rows])
            place = np.cumsum(new) - 1
            c = signs[d]
            b = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
            top = best[d - 1][parents[d]] + b * self.byte
            met = [(np.arange(len(rows)), top, least[d - 1][parents[d]] + b)]
            nodes, at, state = np.arange(len(rows)), np.arange(len(rows)), np.zeros(len(rows), np.int64)
            top = top.copy()
            for k in range(1, min(d, self.longest) + 1):
                state = self.step(state, signs[d - k + 1][at]) if k > 1 else self.first[c].astype(np.int64)
                on = state >= 0
                if not on.any():
                    break
                nodes, at, state = nodes[on], parents[d - k + 1][at[on]], state[on]
                piece = np.flatnonzero(self.score[state] > -np.inf)
                if len(piece):
                    s = best[d - k][at[piece]] + self.score[state[piece]]
                    met.append((nodes[piece], s, least[d - k][at[piece]] + 1))
                    top[nodes[piece]] = np.maximum(top[nodes[piece]], s)
            fewest = np.full(len(rows), np.iinfo(np.int64).max)
            for n, s, t in met:
                good = s > top[n] - LEAST
                fewest[n[good]] = np.minimum(fewest[n[good]], t[good])
            best.append(top)
            least.append(fewest)
            ends = np.flatnonzero(length == d)
            tokens[ends] = fewest[place[ends]]
        return {w[1:]: n for w, n in zip(text.tolist(), tokens.tolist(), strict=True)}


def count_tokens(docs: DataFrame, model: str = "piece_bpe_32k.model", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words and n_tokens of every document."""

    def run(batches):
        trie = Trie(*unigram(model))
        cache: dict[str, int] = {}
        held = 0
        for batch in batches:
            words_out, tokens_out = [], []
            block: list[list[str]] = []
            size = 0

            def flush():
                nonlocal cache, block, size, held
                distinct = set().union(*block)
                fresh = trie.counts(list(distinct - cache.keys()))
                cache |= fresh
                for words in block:
                    words_out.append(len(words))
                    tokens_out.append(sum(map(cache.__getitem__, words)))
                for w in [w for w in fresh if len(w) >= LEVELS]:
                    del cache[w], fresh[w]
                held += sum(map(len, fresh))
                if held > CACHE_SIGNS:
                    cache, held = fresh, sum(map(len, fresh))
                block, size = [], 0

            for t in batch.column(1):
                t = t.as_py() or ""
                block.append(t.split())
                size += len(t)
                if size >= BLOCK_CHARS:
                    flush()
            if block:
                flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words_out, pa.int64()), pa.array(tokens_out, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(X.tidy(run), "doc_id long, n_words long, n_tokens long")
