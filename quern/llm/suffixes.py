"""Suffix-array dedup on sparse suffixes at minimiser positions.

Words are between white space, A-Z lower-cased. Of every WINDOW neighbouring
K-grams of words, those with the least hash mark positions; they depend on the
text alone, so equal passages mark equal places. The suffixes at marked
positions, each with at least REACH words, are sorted over the whole corpus
(range partitions, so that a hot key is split), and those whose first REACH words
several documents have are kept. They are sorted again, once with the EXTEND words
behind them and once with those before them: rows that have words in common are
neighbours, so a row's longest match to the right and to the left shows in the
runs of equal words that it lies in. Of a run, for every length, the least and
the greatest document tell whether it holds another document, or an earlier one
(a lesser doc_id). A run that goes on in the next partition is joined with its
rest there by a few numbers for each border. The words that extend a match are
compared by 24 bits of their hashes, so about one in 16 million unequal words is
taken for equal and lengthens a passage by itself.

A match of two documents of MIN_WORDS words or more has a marked position within
its first and its last WINDOW starts, and marked ones between are at most WINDOW
apart. So EXTEND = WINDOW - 1 words either way reach both its ends: every word of
every such match is covered, whichever documents share it. What is found has at
least MIN_WORDS words and is made of matches of at least REACH words each.

Defined results: null, empty and short texts have no suffix; rows with a null
doc_id are left alone; repeated rows of a doc_id are one document. Repeats
inside one document alone are not reported. Other columns are not read.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import textops as X
from quern.llm.common import materialise, range_parts

MIN_WORDS, WINDOW, K = 50, 16, 8
REACH, EXTEND = MIN_WORDS - WINDOW + 1, WINDOW - 1
#: Rows of whole keys that are compared at once; a key alone may have more, at most a partition's share of it.
CHUNK = 200_000


def _sliding(x: np.ndarray, window: int, least: bool) -> np.ndarray:
    """The least (or greatest) of every ``window`` neighbours; window is a power of two."""
    step = 1
    while step < window:
        x = (np.minimum if least else np.maximum)(x[: len(x) - step], x[step:])
        step *= 2
    return x


def marked(column, reach: int = REACH, window: int = WINDOW, k: int = K):
    """Yield (first row, words' hashes, each row's first word, marked words, their keys) for blocks of rows."""
    data, offsets = X.utf8(column)
    lower, powers, values = X.lower_table(), X.Powers(), X.byte_values()
    for i, j in X.blocks(offsets):
        low = lower[data[offsets[i] : offsets[j]]]
        starts, stops, first = X.split_words(low, offsets[i : j + 1] - offsets[i], X.SPACED)
        h = X.hash_words(low, starts, stops, powers, values)
        n = len(h)
        if n < max(reach, window + k - 1):
            yield i, h, first, np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        up, down = powers.get(n + 1)
        total = np.r_[np.zeros(1, np.uint64), np.cumsum(h * up[:n])]

        def spell(at, words, total=total, down=down):
            return X.mix((total[at + words] - total[at]) * down[at])

        gram = spell(np.arange(n - k + 1), k)
        left = np.repeat(first[1:], np.diff(first)) - np.arange(n)  # words from each to its row's end
        least = _sliding(gram, window, True)
        least[left[: len(least)] < window + k - 1] = 0  # no window begins so near to a row's end
        # a window's least value is a gram's own where it is the greatest of the windows that hold the gram
        padded = np.r_[np.zeros(window - 1, np.uint64), least, np.zeros(window - 1, np.uint64)]
        at = np.flatnonzero(_sliding(padded, window, False) == gram)
        at = at[left[at] >= reach]
        yield i, h, first, at, spell(at, reach).view(np.int64)


def _suffixes(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, h, first, at, key in marked(batch.column(1)):
                if len(at):
                    row = np.searchsorted(first, at, "right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[row + i].astype(np.int64)), pa.array((at - first[row]).astype(np.int32))], names=["key", "doc_id", "at"])

    return docs.mapInArrow(X.tidy(run), "key long, doc_id long, at int")


def shared_rows(batches):
    """Those of the columns (key, doc_id, at), sorted so, whose key two documents have.

    A stream: it holds a key's rows until a second document comes. The first and
    the last key may go on in other partitions, so they are kept.
    """
    key = doc = None
    held: list = []
    several = first = True
    for rows in batches:
        k, d = rows[0], rows[1]
        if not len(k):
            continue
        head = int(np.searchsorted(k, key, "right")) if key is not None else 0
        if head:  # the open key goes on
            several |= d[head - 1] != doc
            held.append([c[:head] for c in rows])
            if several:
                yield from held
                held = []
        if head == len(k):
            continue
        if first and key is not None:
            yield from held
        tail = int(np.searchsorted(k, k[-1]))
        if head < tail:  # keys that begin and end here
            begin = np.flatnonzero(np.r_[True, k[head + 1 : tail] != k[head : tail - 1]])
            own = d[head:tail]
            keep = np.minimum.reduceat(own, begin) != np.maximum.reduceat(own, begin)
            keep[0] |= key is None
            keep = np.repeat(keep, np.diff(np.r_[begin, len(own)]))
            yield [c[head:tail][keep] for c in rows]
        first = key is None and not tail
        key, doc, several, held = k[-1], d[tail], d[tail] != d[-1], [[c[tail:] for c in rows]]
        if several:
            yield from held
            held = []
    yield from held


def _shared_keys(suffixes: DataFrame, parts: int) -> DataFrame:
    def run(batches):
        columns = ([b.column(k).to_numpy(zero_copy_only=False) for k in range(3)] for b in batches)
        for rows in shared_rows(columns):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows], names=["key", "doc_id", "at"])

    return suffixes.repartitionByRange(parts, "key", "doc_id", "at").sortWithinPartitions("key", "doc_id", "at").mapInArrow(X.tidy(run), "key long, doc_id long, at int")


def _binary(words: np.ndarray) -> pa.Array:
    """Rows of 24-bit words as binary values; their order as bytes is the order of the words."""
    n, size = len(words), 3 * words.shape[1]
    data = np.ascontiguousarray(words.astype(">u4")).view(np.uint8).reshape(n, -1, 4)[:, :, 1:].tobytes()
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * size).astype(np.int32)), pa.py_buffer(data)])


def _words_of(column) -> np.ndarray:
    """The reverse of _binary."""
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int32)[column.offset : column.offset + len(column) + 1]
    out = np.zeros((len(column), EXTEND, 4), np.uint8)
    out[:, :, 1:] = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, EXTEND, 3)
    return out.reshape(-1, 4).view(">u4").astype(np.uint32).reshape(-1, EXTEND)


def _contexts(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """Two rows for each suffix: (key, doc_id, at, words) with the EXTEND words behind its REACH words, and with those before it, nearest first.

    The second has a key of its own and at less than 0 (-1 - at). A word is 24
    bits of a hash; 0 is past the text's end.
    """
    wanted = shared.groupBy("doc_id").agg(F.sort_array(F.collect_set("at")).alias("places"))
    both = docs.join(wanted, "doc_id").select("doc_id", "text", "places")

    def run(batches):
        for batch in batches:
            ids, places = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
            for i, h, first, at, key in marked(batch.column(1)):
                if not len(at):
                    continue
                row = np.searchsorted(first, at, "right") - 1
                place = at - first[row]
                wanted_at = np.concatenate([(np.int64(r) << 32) + places[i + int(r)].values.to_numpy(zero_copy_only=False).astype(np.int64) for r in np.unique(row)])
                keep = np.isin((row.astype(np.int64) << 32) + place, wanted_at)
                row, place, at, key = row[keep], place[keep].astype(np.int32), at[keep], key[keep]
                short = np.r_[np.maximum(h >> np.uint64(40), np.uint64(1)).astype(np.uint32), np.uint32(0)]
                for a in range(0, len(at), 20_000):
                    s = slice(a, a + 20_000)
                    behind, before = at[s, None] + REACH + np.arange(EXTEND), at[s, None] - 1 - np.arange(EXTEND)
                    right = short[np.where(behind < first[row[s] + 1][:, None], behind, len(h))]
                    left = short[np.where(before >= first[row[s]][:, None], before, len(h))]
                    turned = X.mix(key[s].view(np.uint64) + np.uint64(0x3C6EF372FE94F82B)).view(np.int64)
                    doc = ids[row[s] + i].astype(np.int64)
                    columns = np.r_[key[s], turned], np.r_[doc, doc], np.r_[place[s], -1 - place[s]]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), _binary(np.r_[right, left])], names=["key", "doc_id", "at", "words"])

    return both.mapInArrow(X.tidy(run), "key long, doc_id long, at int, words binary")


def equal_words(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of words, how many lead both; what is past a text's end equals nothing."""
    same = (a == b) & (a != 0)
    return np.where(same.all(1), same.shape[1], same.argmin(1))


def depths(key: np.ndarray, words: np.ndarray) -> np.ndarray:
    """For sorted rows, how many words each has in common with the row before: -1 where the key is another."""
    out = np.full(len(key), -1)
    if len(key) > 1:
        out[1:] = np.where(key[1:] == key[:-1], equal_words(words[1:], words[:-1]), -1)
    return out


def reaches(depth: np.ndarray, doc: np.ndarray):
    """(most words in common with another document, with an earlier one, the least such document); -1 for none."""
    another, earlier, kept = np.full(len(doc), -1), np.full(len(doc), -1), np.zeros(len(doc), np.int64)
    for n in range(EXTEND + 1):
        begin = np.flatnonzero(depth < n)
        if len(begin) == len(doc):
            break
        size = np.diff(np.r_[begin, len(doc)])
        least, most = (np.repeat(f.reduceat(doc, begin), size) for f in (np.minimum, np.maximum))
        another[least != most] = n
        earlier[least < doc] = n
        kept[least < doc] = least[least < doc]
    return another, earlier, kept


class Border:
    """What a partition of sorted rows says about its runs at one end, for every length."""

    def __init__(self, key, words, depth, doc, end: bool):
        k = -1 if end else 0
        self.key, self.words, self.least, self.most, self.whole = int(key[k]), words[k].copy(), [], [], []
        for n in range(EXTEND + 1):
            cuts = np.flatnonzero(depth[1:] < n) + 1
            own = doc[(cuts[-1] if len(cuts) else 0) :] if end else doc[: cuts[0] if len(cuts) else len(doc)]
            self.least.append(int(own.min()))
            self.most.append(int(own.max()))
            self.whole.append(not len(cuts))


def join_borders(borders: list[tuple[int, Border, Border]]) -> dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]]:
    """(partition, end) -> least and greatest document of the runs there, for every length; borders are in order of the partitions."""
    out: dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]] = {}
    for part, first, last in borders:
        for end, b in ((False, first), (True, last)):
            out[part, end] = np.array(b.least), np.array(b.most)
    links = []
    for (p, _, a), (q, b, _) in zip(borders, borders[1:], strict=False):
        links.append((p, q, int(equal_words(a.words[None], b.words[None])[0]) if a.key == b.key else -1))
    whole = {part: first.whole for part, first, _ in borders}
    for n in range(EXTEND + 1):
        chain: list[tuple[int, bool]] = []

        def close(n=n):
            for f, k in ((min, 0), (max, 1)):
                if chain:
                    value = f(int(out[c][k][n]) for c in chain)
                    for c in chain:
                        out[c][k][n] = value
            chain.clear()

        for p, q, depth in links:
            if depth < n:
                close()
                continue
            if not chain:
                chain.append((p, True))
                if whole[p][n]:
                    chain.append((p, False))
            chain.append((q, False))
            if whole[q][n]:
                chain.append((q, True))
            else:
                close()
        close()
    return out


#: another, earlier: words in common beyond the REACH ones. to_first, to_last: words in common with the partition's border rows, where part is given.
ROWS = "doc_id long, at int, another int, earlier int, kept long, part int, to_first int, to_last int, border binary"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("at", pa.int32()), ("another", pa.int32()), ("earlier", pa.int32()), ("kept", pa.int64()), ("part", pa.int32()), ("to_first", pa.int32()), ("to_last", pa.int32()), ("border", pa.binary())])


def _table(*columns) -> pa.RecordBatch:
    n = len(columns[0])
    columns = [*columns, *[None] * (len(SCHEMA) - len(columns))]
    return pa.RecordBatch.from_arrays([pa.nulls(n, f.type) if c is None else pa.array(np.asarray(c)).cast(f.type) for c, f in zip(columns, SCHEMA, strict=True)], schema=SCHEMA)


def compared(batches, part: int):
    """Tables of ROWS for columns (key, doc_id, at, words), sorted by key, words and doc_id: one partition.

    Whole keys are done as they come; the first and the last key, which other
    partitions may have too, at the end.
    """
    held: list = []
    edge: list = []

    def whole(last: bool):
        """What is held, but for the partition's first key and the one that is not complete."""
        key, doc, at, words = rows = [np.concatenate(x) for x in zip(*held, strict=True)]
        begin = 0 if edge else int(np.searchsorted(key, key[0], "right"))
        end = max(begin, int(np.searchsorted(key, key[-1])))
        if not edge:
            edge.append([c[:begin] for c in rows])
        held[:] = [[c[end:] for c in rows]]
        if last:
            edge.extend(held)
        s = slice(begin, end)
        return [_table(doc[s], at[s], *reaches(depths(key[s], words[s]), doc[s]))] if begin < end else []

    for rows in batches:
        if len(rows[0]):
            held.append(rows)
            if sum(len(r[0]) for r in held) >= CHUNK and held[0][0][0] != held[-1][0][-1]:
                yield from whole(False)
    if not held:
        return
    yield from whole(True)
    key, doc, at, words = (np.concatenate(x) for x in zip(*edge, strict=True))
    depth, full = depths(key, words), (words != 0).sum(1)
    known = reaches(depth, doc)
    to_first = np.minimum.accumulate(np.r_[full[0], depth[1:]])
    to_last = np.minimum.accumulate(np.r_[depth[1:], full[-1]][::-1])[::-1]
    for a in range(0, len(key), 50_000):
        s = slice(a, a + 50_000)
        yield _table(doc[s], at[s], *(x[s] for x in known), np.full(len(key[s]), part), to_first[s], to_last[s])
    ends = pickle.dumps([vars(Border(key, words, depth, doc, end)) for end in (False, True)])
    yield pa.RecordBatch.from_arrays([pa.array([{"part": part, "border": ends}.get(f.name)], f.type) for f in SCHEMA], schema=SCHEMA)


def _compare(contexts: DataFrame, parts: int) -> DataFrame:
    """The compared rows, with two rows for the borders of each partition (doc_id null)."""

    def run(batches):
        from pyspark import TaskContext

        columns = ([*(b.column(k).to_numpy(zero_copy_only=False) for k in range(3)), _words_of(b.column(3))] for b in batches if b.num_rows)
        yield from compared(columns, TaskContext.get().partitionId())

    order = ["key", "words", "doc_id", "at"]
    return materialise(contexts.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(X.tidy(run), ROWS))


def _settled(found: DataFrame) -> DataFrame:
    """The rows of _compare with the runs that cross borders taken whole."""

    def border(state: dict) -> Border:
        b = Border.__new__(Border)
        b.__dict__.update(state)
        return b

    # two rows a partition, not of the data
    ends = sorted((r["part"], pickle.loads(bytes(r["border"]))) for r in found.where("doc_id is null").select("part", "border").toLocalIterator())
    shared = found.sparkSession.sparkContext.broadcast(join_borders([(p, border(a), border(b)) for p, (a, b) in ends]))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, at, another, earlier, kept = (batch.column(k).to_numpy(zero_copy_only=False).copy() for k in range(5))
            part = batch.column(5).fill_null(-1).to_numpy(zero_copy_only=False)
            for p in np.unique(part[part >= 0]).tolist():
                rows = np.flatnonzero(part == p)
                for end, column in ((False, 6), (True, 7)):
                    depth = batch.column(column).to_numpy(zero_copy_only=False)[rows]
                    least, most = shared.value[p, end]
                    for n in range(EXTEND + 1):
                        inside = rows[depth >= n]
                        if not len(inside):
                            break
                        if least[n] != most[n]:
                            another[inside] = np.maximum(another[inside], n)
                        later = inside[(doc[inside] > least[n]) & ((earlier[inside] < n) | (earlier[inside] == n) & (kept[inside] > least[n]))]
                        earlier[later], kept[later] = n, least[n]
            keep = another >= 0
            doc, at, another, earlier, kept = (x[keep] for x in (doc, at, another, earlier, kept))
            right, place, none = at >= 0, np.where(at >= 0, at, -1 - at), earlier < 0
            spans = [(np.where(right, place, place - n).astype(np.int32), (place + REACH + np.where(right, n, 0)).astype(np.int32)) for n in (another, earlier)]
            columns = [pa.array(doc), *map(pa.array, spans[0]), *(pa.array(c, mask=none) for c in (*spans[1], kept))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "end", "later_start", "later_end", "kept"])

    return found.where("doc_id is not null").drop("border").mapInArrow(X.tidy(run), "doc_id long, start int, end int, later_start int, later_end int, kept long")


def merge_spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Spans of documents (numbered from 0) merged where they touch; only those of MIN_WORDS or more stay, sorted."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order].astype(np.int64), start[order].astype(np.int64), end[order].astype(np.int64)
    if not len(doc):
        return doc, start, end
    reach = np.maximum.accumulate((doc << 32) + end)
    begin = np.flatnonzero(np.r_[True, (doc[1:] << 32) + start[1:] > reach[:-1]])
    last = np.r_[begin[1:], len(doc)] - 1
    doc, start, end = doc[begin], start[begin], reach[last] & 0xFFFFFFFF
    keep = end - start >= MIN_WORDS
    return doc[keep], start[keep], end[keep]


SPANS = "array<struct<start:int,end:int>>"


def _by_document(found: DataFrame) -> DataFrame:
    """(doc_id, spans, later, kept_in) of the matches, document by document as they come sorted."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def lists(n, doc, values, kind):
        offsets = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), values).cast(kind)

    def done(rows):
        ids, doc = np.unique(rows[0], return_inverse=True)
        n, again = len(ids), rows[6]
        spans, later = merge_spans(doc, rows[1], rows[2]), merge_spans(doc[again], rows[3][again], rows[4][again])
        kept = np.unique(np.c_[doc[again], rows[5][again]].reshape(-1, 2), axis=0)
        kept = kept[np.isin(kept[:, 0], later[0])]
        structs = [pa.StructArray.from_arrays([pa.array(x[k].astype(np.int32)) for k in (1, 2)], names=["start", "end"]) for x in (spans, later)]
        columns = [pa.array(ids), lists(n, spans[0], structs[0], span), lists(n, later[0], structs[1], span), lists(n, kept[:, 0], pa.array(np.ascontiguousarray(kept[:, 1]), pa.int64()), pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "spans", "later", "kept_in"]).filter(pa.array(np.isin(np.arange(n), spans[0])))

    def run(batches):
        held: list = []
        for batch in batches:
            if batch.num_rows:
                again = batch.column(5).is_valid().to_numpy(zero_copy_only=False)
                held.append([*(batch.column(k).fill_null(0).to_numpy(zero_copy_only=False) for k in range(6)), again])
            if sum(len(r[0]) for r in held) >= CHUNK and held[0][0][0] != held[-1][0][-1]:
                rows = [np.concatenate(x) for x in zip(*held, strict=True)]
                last = int(np.searchsorted(rows[0], rows[0][-1]))
                yield done([c[:last] for c in rows])
                held = [[c[last:] for c in rows]]
        if held:
            yield done([np.concatenate(x) for x in zip(*held, strict=True)])

    return found.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(X.tidy(run), f"doc_id long, spans {SPANS}, later {SPANS}, kept_in array<long>")


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, spans, later and kept_in of every document that shares a passage of MIN_WORDS words with another.

    spans: all shared passages, in words, merged. later: what of them an earlier
    document (a lesser doc_id) has too; the rest is a first place. kept_in:
    earlier documents that have them.
    """
    docs = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    parts = range_parts(docs)
    shared = materialise(_shared_keys(_suffixes(docs), parts))
    compared_rows = _compare(_contexts(docs, shared), parts)  # contexts are read twice, by the range sample too: cheaper than a copy on disk
    return _by_document(_settled(compared_rows))


def remove_passages(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the passages of column later of found: of each shared passage the first document keeps its place; other columns stay."""
    mark = "later"
    while {mark, f"{mark}_id"} & set(docs.columns):
        mark = "_" + mark
    cut = found.where("size(later) > 0").select(F.col("doc_id").alias(f"{mark}_id"), F.col("later").alias(mark))
    both = docs.join(cut, F.col(doc_id).cast("long") == F.col(f"{mark}_id"), "left").drop(f"{mark}_id")
    at, spans_at = docs.columns.index(text), len(docs.columns)

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for k, spans in enumerate(batch.column(spans_at).to_pylist()):
                if spans and texts[k]:
                    data = texts[k].encode()
                    raw = np.frombuffer(data, np.uint8)
                    starts, stops, _ = X.split_words(raw, np.array([0, len(raw)]), X.SPACED)
                    done, parts = 0, []
                    for s in spans:
                        end = min(s["end"], len(starts))
                        if s["start"] < end:
                            parts.append(data[done : starts[s["start"]]])
                            done = int(starts[end]) if end < len(starts) else int(stops[-1])
                    texts[k] = b"".join([*parts, data[done:]]).decode()
            columns = list(batch.columns[:spans_at])
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:spans_at])

    return both.mapInArrow(X.tidy(run), docs.schema)
