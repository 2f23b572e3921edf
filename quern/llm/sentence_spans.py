"""Substring dedup by sliding sentence spans.

A text is cut into sentences (after . ! ? and at line ends); one of more than
MAX_WORDS words counts as several of that length. From every sentence a run
begins: the shortest of at least MIN_SENTENCES sentences and min_words words. Its
words, lower-cased (A-Z), are hashed. With min_words 1, as in op9, these are all
runs of MIN_SENTENCES sentences, and longer repeated runs are unions of them; a
higher floor (MIN_WORDS unless given) leaves out short runs that repeat alone. All runs of all documents are joined by
hash; the first place (least doc_id, then least offset) keeps its sentences, and
those that any other place covers are removed.

Whether a text has the run before is seen where the text is read, so that the
first document is a plain minimum: hot runs are hashed to one row a task before
the shuffle. The join back with the repeated hashes shuffles at every size, and
is split where it is skewed.

Defined results: null and empty texts, and texts with no run, lose nothing;
rows with a null doc_id are left alone; repeated rows of a doc_id are one
document, each of whose texts keeps its first places. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import textops as X
from quern.llm.common import materialise

MIN_SENTENCES, MIN_WORDS, MAX_WORDS = 2, 25, 20


def runs(column, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, max_words: int = MAX_WORDS):
    """Yield (row, hash, start, end, whether the row has the run before) arrays; offsets are code points."""
    data, offsets = X.utf8(column)
    lower, powers, values = X.lower_table(), X.Powers(), X.byte_values()
    line, stop = X.byte_class((10, 10), (13, 13)), X.byte_class((33, 33), (46, 46), (63, 63))
    for i, j in X.blocks(offsets):
        part, bounds = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        low = lower[part]
        starts, stops, first = X.split_words(low, bounds, X.SPACED)
        if not len(starts):
            continue
        h = X.hash_words(low, starts, stops, powers, values)
        row = np.repeat(np.arange(j - i), np.diff(first))
        breaks = np.r_[0, np.cumsum(line[part])]
        ends = stop[part[stops - 1]]  # a sentence ends with this word
        opens = np.r_[True, (row[1:] != row[:-1]) | ends[:-1] | (breaks[starts[1:]] > breaks[stops[:-1]])]
        at = np.flatnonzero(opens)
        length = np.diff(np.r_[at, len(h)])
        # long sentences are cut into several
        pieces = -(-length // max_words)
        step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = np.repeat(at, pieces) + step * max_words
        finish = np.r_[begin[1:], len(h)]
        owner = row[begin]
        last = np.searchsorted(owner, np.arange(j - i), "right")  # sentences before the end of each row
        need = np.searchsorted(finish, begin + min_words)  # the sentence that completes min_words
        final = np.maximum(need, np.arange(len(begin)) + min_sentences - 1)
        good = np.flatnonzero(final < last[owner])
        if not len(good):
            continue
        up, down = powers.get(len(h) + 1)
        total = np.r_[np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)])]
        a, b = begin[good], finish[final[good]]
        key = X.mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
        chars = X.char_offsets(part)
        base = chars[bounds[:-1]][owner[good]]
        order = np.lexsort((a, key, owner[good]))
        again = np.zeros(len(a), bool)
        again[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (owner[good][order[1:]] == owner[good][order[:-1]])
        yield owner[good] + i, key.view(np.int64), chars[starts[a]] - base, chars[stops[b - 1]] - base, again


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, spans (merged, in code points, to remove) and kept_in (documents that keep their first places).

    Only documents that lose sentences have a row.
    """

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for row, key, start, end, again in runs(batch.column(1), min_words=min_words):
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[row].astype(np.int64)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(again)], names=["key", "doc_id", "start", "end", "again"])

    chosen = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    places = chosen.mapInArrow(X.tidy(run), "key long, doc_id long, start int, end int, again boolean")
    first = places.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    first = materialise(first.where("n > 1").select("key", "first_id"))
    later = places.join(first.hint("merge"), "key").where("doc_id <> first_id or again").select("doc_id", "start", "end", "first_id")

    merged = F.expr("""aggregate(array_sort(collected), cast(array() as array<struct<start:int,end:int>>), (done, x) ->
        case when size(done) > 0 and element_at(done, -1).end >= x.start
        then concat(slice(done, 1, size(done) - 1), array(struct(element_at(done, -1).start as start, greatest(element_at(done, -1).end, x.end) as end)))
        else concat(done, array(struct(x.start as start, x.end as end))) end)""")
    grouped = later.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("collected"), F.array_sort(F.collect_set("first_id")).alias("kept_in"))
    return grouped.select("doc_id", merged.alias("spans"), "kept_in")


def remove_spans(docs: DataFrame, spans: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with the spans cut out of their texts; other columns stay, whatever their names."""
    mark = "_spans"
    while {mark, f"{mark}_id"} & set(docs.columns):
        mark += "_"
    found = docs.join(spans.select(F.col("doc_id").alias(f"{mark}_id"), F.col("spans").alias(mark)), F.col(doc_id).cast("long") == F.col(f"{mark}_id"), "left")
    cut = F.expr(f"""concat_ws('', transform(sequence(0, size({mark})), i -> substring(`{text}`,
        case when i = 0 then 1 else {mark}[i - 1].end + 1 end,
        case when i = size({mark}) then length(`{text}`) else {mark}[i].start end - case when i = 0 then 0 else {mark}[i - 1].end end)))""")
    return found.withColumn(text, F.when(F.col(mark).isNull(), F.col(text)).otherwise(cut)).select(*docs.columns)
