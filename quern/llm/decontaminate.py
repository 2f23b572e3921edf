"""Benchmark decontamination: an FM-index per training shard.

A shard is one Arrow batch of documents. Its text is the sequence of word ids,
reduced to the runs of benchmark vocabulary that are long enough to hold a
window (a word outside the vocabulary can be in no occurrence, so nothing is
lost). The suffix array gives the BWT, a wavelet matrix gives ranks, all
benchmark windows are searched backwards at once, and occurrences are located
by walking to sampled suffix positions. Occurrences merge into removal spans.

Nothing is shuffled: each document is wholly inside its shard.

Defined results: a null or empty text has no words and no hits; a null or empty
item has no window; items with the same item_id count as one; repeated
documents are each reported; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import textops as X

#: The benchmark is a fixed query set: more bytes of items than this are refused, not broadcast. Its windows take some ten times as much.
MAX_ITEM_BYTES = 48 << 20
SAMPLE = 8
HIT_SCHEMA = "n_words long, n_hit long, item_ids array<string>, spans array<struct<start:int,end:int>>"


class Phrases:
    """The windows of the benchmark items as sequences of vocabulary ids (1 and up)."""

    def __init__(self, items: list[tuple[object, str | None]], window: int):
        ids = sorted({str(i) for i, _ in items if i is not None})
        number = {x: k for k, x in enumerate(ids)}
        kept = [(number[str(i)], t) for i, t in items if i is not None and t]
        data, offsets = X.utf8(pa.array([t for _, t in kept], pa.large_string()))
        low = X.lower_table()[data]
        starts, stops, first = X.split_words(low, offsets, X.ALNUM)
        h = X.hash_words(low, starts, stops, X.Powers(), X.byte_values())
        self.ids, self.vocabulary = ids, np.unique(h)
        seq = (np.searchsorted(self.vocabulary, h) + 1).astype(np.int32)
        item, size = np.array([x for x, _ in kept], np.int32), np.diff(first)
        self.window = window
        #: length -> (patterns, bounds and list of the items that own each)
        self.groups = {}
        for n in sorted(set(np.minimum(size[size > 0], window).tolist())):
            rows = np.flatnonzero(size >= window if n == window else size == n)
            times = size[rows] - n + 1
            starts = np.repeat(first[rows] - np.cumsum(times) + times, times) + np.arange(times.sum())
            patterns, which = np.unique(np.lib.stride_tricks.sliding_window_view(seq, n)[starts], axis=0, return_inverse=True)
            own = np.unique((which.reshape(-1).astype(np.int64) << 32) + np.repeat(item[rows], times))
            self.groups[n] = (patterns, np.searchsorted(own >> 32, np.arange(len(patterns) + 1)), (own & 0xFFFFFFFF).astype(np.int64))
        self.shortest = min(self.groups, default=0)
        self.bitmap = np.zeros(1 << 20, bool)
        self.bitmap[(self.vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def word_ids(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int64)
        if len(self.vocabulary):
            at = np.flatnonzero(self.bitmap[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
            k = np.minimum(np.searchsorted(self.vocabulary, h[at]), len(self.vocabulary) - 1)
            same = self.vocabulary[k] == h[at]
            out[at[same]] = k[same] + 1
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of text in order, by prefix doubling. Every 0 is a separator of its own, below all words."""
    zero = text == 0
    rank = np.where(zero, np.cumsum(zero) - 1, text + int(zero.sum()))
    n, step = len(text), 1
    _, rank = np.unique(rank, return_inverse=True)
    while True:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank.astype(np.int64) * (n + 2) + second
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.zeros(n, np.int64)
        new[order] = np.cumsum(np.r_[0, key[1:] != key[:-1]])
        rank, step = new, step * 2
        if rank[order[-1]] == n - 1 or step >= n:
            return order


class FMIndex:
    """Rank, backward search and locate over a text of ids in which 0 separates runs."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        sa = suffix_array(text)
        self.n, self.bwt = n, text[sa - 1]  # the row of suffix 0 is preceded by the last symbol, a separator
        self.less = np.cumsum(np.r_[0, np.bincount(text)])
        self.levels = []
        row, width = self.bwt, max(1, int(text.max()).bit_length())
        for b in range(width - 1, -1, -1):
            bit = (row >> b) & 1
            self.levels.append((b, np.r_[0, np.cumsum(bit)].astype(np.int32), n - int(bit.sum())))
            row = np.r_[row[bit == 0], row[bit == 1]]
        before = np.r_[0, text[:-1]]
        sampled = (before[sa] == 0) | (sa % SAMPLE == 0)  # run starts too: no walk crosses a separator
        self.sampled, self.samples, self.slot = sampled, sa[sampled], np.cumsum(sampled) - 1

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c stands before row i of the BWT, by the wavelet matrix."""
        j = np.zeros_like(i)
        for b, ones, zeros in self.levels:
            up = ((c >> b) & 1).astype(bool)
            i = np.where(up, zeros + ones[i], i - ones[i])
            j = np.where(up, zeros + ones[j], j - ones[j])
        return i - j

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        known = len(self.less) - 1
        for t in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[:, t].astype(np.int64)
            there = c < known
            c = np.where(there, c, 0)
            lo, hi = (np.where(there, self.less[c] + self.rank(c, x), 0) for x in (lo, hi))
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        steps, rows = np.zeros(len(rows), np.int64), rows.copy()
        while len(todo := np.flatnonzero(~self.sampled[rows])):
            c = self.bwt[rows[todo]]
            rows[todo] = self.less[c] + self.rank(c, rows[todo])
            steps[todo] += 1
        return self.samples[self.slot[rows]] + steps


def scan(column, phrases: Phrases) -> list[tuple[int, int, list[str], list[tuple[int, int]], bool]]:
    """Per row of a text column: words, hit words, ids of the items found, merged spans in code points, whether a full window is hit."""
    data, offsets = X.utf8(column)
    n = len(offsets) - 1
    table, powers, values = X.lower_table(), X.Powers(), X.byte_values()
    n_words = np.zeros(n, np.int64)
    parts: list[list[np.ndarray]] = []
    for i, j in X.blocks(offsets):
        bounds = offsets[i : j + 1] - offsets[i]
        low = table[data[offsets[i] : offsets[j]]]
        starts, stops, first = X.split_words(low, bounds, X.ALNUM)
        n_words[i:j] = np.diff(first)
        if not phrases.shortest or not len(starts):
            continue
        ids = phrases.word_ids(X.hash_words(low, starts, stops, powers, values))
        row = np.repeat(np.arange(i, j), np.diff(first))
        good = ids > 0
        opens = good & ~(np.r_[False, good[:-1]] & np.r_[False, row[1:] == row[:-1]])
        run = np.cumsum(opens) - 1
        at = np.flatnonzero(good)
        if not len(at):
            continue
        keep = at[np.bincount(run[at])[run[at]] >= phrases.shortest]
        if len(keep):
            chars = X.char_offsets(data[offsets[i] : offsets[j]])
            base = chars[bounds[row[keep] - i]]
            parts.append([ids[keep], row[keep], np.r_[True, np.diff(run[keep]) != 0], chars[starts[keep]] - base, chars[stops[keep]] - base])
    items: list[set] = [set() for _ in range(n)]
    spans: list[list] = [[] for _ in range(n)]
    n_hit, full = np.zeros(n, np.int64), np.zeros(n, bool)
    if parts:
        ids, row, opens, begin, end = (np.concatenate(x) for x in zip(*parts, strict=True))
        place = np.arange(len(ids)) + np.cumsum(opens) - 1  # a separator ends each run
        text = np.zeros(place[-1] + 2, np.int64)
        text[place] = ids
        back = np.full(len(text), -1, np.int64)
        back[place] = np.arange(len(ids))
        index = FMIndex(text)
        cover = np.zeros(len(text) + 1, np.int64)
        for length, (patterns, bounds, owners) in phrases.groups.items():
            lo, hi = index.search(patterns)
            found = np.flatnonzero(hi > lo)
            if not len(found):
                continue
            times = (hi - lo)[found]
            which = np.repeat(found, times)
            rows = np.repeat(lo[found], times) + np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
            at = index.locate(rows)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + length, -1)
            docs = row[back[at]]
            full[docs] |= length == phrases.window
            for d, p in np.unique(np.c_[docs, which], axis=0).tolist():
                items[d].update(owners[bounds[p] : bounds[p + 1]].tolist())
        hit = back[np.flatnonzero((np.cumsum(cover)[:-1] > 0) & (text > 0))]
        np.add.at(n_hit, row[hit], 1)
        joined = np.r_[False, (np.diff(hit) == 1) & ~opens[hit[1:]]] if len(hit) else np.zeros(0, bool)
        for k, more in zip(hit.tolist(), joined.tolist(), strict=True):
            own = spans[row[k]]
            if more:
                own[-1] = (own[-1][0], int(end[k]))
            else:
                own.append((int(begin[k]), int(end[k])))
    return [(int(n_words[k]), int(n_hit[k]), sorted(phrases.ids[x] for x in items[k]), spans[k], bool(full[k])) for k in range(n)]


def read_phrases(items: DataFrame, window: int, item_id: str = "item_id", text: str = "text"):
    """The broadcast windows of the items; their size is checked first."""
    size = items.agg(F.sum(F.octet_length(text))).first()[0] or 0
    if size > MAX_ITEM_BYTES:
        raise ValueError(f"{size} bytes of benchmark items; split them into sets of at most {MAX_ITEM_BYTES}")
    rows = [(r[0], r[1]) for r in items.select(item_id, text).toLocalIterator()]
    return items.sparkSession.sparkContext.broadcast(Phrases(rows, window))


def benchmark_hits(docs: DataFrame, items: DataFrame, window: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_hit, item_ids (sorted as strings) and merged removal spans."""
    shared = read_phrases(items, window)

    def run(batches):
        for batch in batches:
            rows = scan(batch.column(1), shared.value)
            out = [batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.list_(pa.string()))))]
            out.append(pa.array([[{"start": a, "end": b} for a, b in r[3]] for r in rows], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_words", "n_hit", "item_ids", "spans"])

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return chosen.mapInArrow(X.tidy(run), "doc_id long, " + HIT_SCHEMA)


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 8, text: str = "text", full: bool = False) -> DataFrame:
    """docs without the rows that hold any window of any item; all columns stay as they are.

    An item shorter than the window is one window of its own length. With full,
    such a hit alone drops no row: a row goes for a window of full length, or
    for hits of two items.
    """
    shared = read_phrases(items, window)
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            rows = scan(batch.column(at), shared.value)
            yield batch.filter(pa.array([not (r[4] or len(r[2]) >= 2) if full else r[1] == 0 for r in rows], pa.bool_()))

    return docs.mapInArrow(X.tidy(run), docs.schema)
