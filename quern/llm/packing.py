"""Packing: bounded-space online packing of tokenised documents.

Each task reads its partition once and keeps a fixed number of open windows.
Whole windows of a long document leave at once; the rest goes, uncut, into the
open window in which it fits best. When none has room, a new window opens, and
if all places are taken the fullest is emitted first. What is open at the end
of a partition is merged: the leftovers of all partitions are laid end to end
(a prefix sum of one number a partition) and cut at every full window, so that
only the last window of all is padded.

Defined results: a null or empty text is a document of the end id alone;
repeated rows are packed each for itself; other columns are not read.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import textops as X
from quern.llm.common import materialise

END_TEXT = "<|endoftext|>"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "slot", "ids")
#: Leftover windows get ids from here on; those of partitions are the partition number and a counter.
LEFT = 1 << 62


def byte_bpe(name: str = "byte_bpe_50k"):
    """The byte-level BPE of name.json, encoded from the same vocabulary given as ranks (ids are equal; the tests compare them)."""
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END_TEXT: 50256})


class Packer:
    """Open windows of one partition."""

    def __init__(self, size: int, places: int):
        self.size, self.places, self.windows, self.done = size, places, [], []

    def add(self, ids: np.ndarray, doc) -> None:
        n, at = len(ids), 0
        while n - at >= self.size:
            self.done.append([(doc, at, ids[at : at + self.size], n)])
            at += self.size
        if at == n:
            return
        rest = n - at
        best = min((w for w in self.windows if w[0] >= rest), key=lambda w: w[0], default=None)
        if best is None:
            if len(self.windows) >= self.places:
                fullest = min(self.windows, key=lambda w: w[0])
                self.windows.remove(fullest)
                self.done.append(fullest[1])
            best = [self.size, []]
            self.windows.append(best)
        best[0] -= rest
        best[1].append((doc, at, ids[at:], n))
        if not best[0]:
            self.windows.remove(best)
            self.done.append(best[1])


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def pack(docs: DataFrame, size: int = 2048, places: int = 64, end_id: int = 1, tokenizer: str = "byte_bpe_50k", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    schema = pa.schema([(f, pa.binary() if f == "ids" else pa.int64()) for f in FIELDS])

    def first(batches):
        from pyspark import TaskContext

        part, count, bpe = TaskContext.get().partitionId(), 0, byte_bpe(tokenizer)
        packer = Packer(size, places)

        def rows(windows, left):
            nonlocal count
            out = []
            for w in windows:
                offset = 0
                for doc, start, ids, total in w:
                    out.append((doc, start, len(ids), None if left else crc(ids), total, None if left else (part << 32) + count, offset, part if left else None, ids.astype("<u4").tobytes() if left else None))
                    offset += len(ids)
                count += 1
            return pa.RecordBatch.from_pylist([dict(zip(FIELDS, r, strict=True)) for r in out], schema)

        for batch in batches:
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = bpe.encode(t.as_py() or "", allowed_special="all")
                ids.append(end_id)
                packer.add(np.array(ids, np.int64), doc)
                if len(packer.done) >= 256:
                    yield rows(packer.done, False)
                    packer.done = []
        yield rows(packer.done, False)
        yield rows(sorted((w[1] for w in packer.windows), key=lambda w: -sum(len(p[2]) for p in w)), True)

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    once = materialise(chosen.mapInArrow(X.tidy(first), ", ".join(f"{f} {'binary' if f == 'ids' else 'long'}" for f in FIELDS)))
    left = once.where("slot is not null")
    # one number a partition, not a row: the tokens that it left
    totals = dict(left.groupBy("slot").agg(F.sum("length")).toLocalIterator())
    before, sums = {}, 0
    for slot in sorted(totals):
        before[slot], sums = sums, sums + totals[slot]
    shared = docs.sparkSession.sparkContext.broadcast(before)

    def second(batches):
        at: dict[int, int] = {}
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                ids, slot = np.frombuffer(r["ids"], "<u4"), r["slot"]
                place, done = at.setdefault(slot, shared.value[slot]), 0
                while done < len(ids):
                    take = min(len(ids) - done, size - place % size)
                    out.append((r["doc_id"], r["start"] + done, take, crc(ids[done : done + take]), r["doc_tokens"], LEFT + place // size, place % size))
                    place, done = place + take, done + take
                at[slot] = place
            yield pa.RecordBatch.from_pylist([dict(zip(FIELDS, r, strict=False)) for r in out], pa.schema(list(schema)[:7]))

    # the rows of a partition that hold leftovers stay together: the checkpoint keeps its partitions
    return once.where("slot is null").select(*FIELDS[:7]).unionByName(left.mapInArrow(X.tidy(second), PIECES))
