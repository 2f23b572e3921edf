"""N-gram Jaccard join by PartEnum signatures.

A document's set holds its distinct word shingles (64-bit hashes). Sizes are cut
into bands so that sets which can link lie in the same band or in neighbouring
ones; each set acts in its own band, and in the next if it is large enough to
link with a set there. Within a band two linked sets
differ in at most k features. The feature domain is hashed into n1 parts, so
that at least one part has at most k2 = 1 difference; that part is cut into n2
again, and of the subsets of n2 - 1 of them at least one is free of differences.
Each subset's features hash to one signature, so linked sets share one: no link
is lost.

Where such signatures would hold few features, unlike sets would share empty
ones by chance. Large sets are then cut into more parts (k2 = 0), and only parts
of FILLED features or more sign. The larger of two linked sets has more filled
parts than they can have differences, so they share a filled one. That count is
checked for every set: a band in which one set falls short signs all its parts.

Exact copies (equal sets) are one class from the start. Each signature's rows
are joined to its least member, the hub, only (one row a member, however many
members); near copies melt into components. Then pairs of different components
in the star of one hub whose sketches (a parity bit vector, a lower bound of the
difference) do not rule out a link are compared exactly, so the result is exact.

Defined results: null, empty and blank texts have 0 shingles and link with
nothing; a text with fewer words than a shingle is one shingle; a row with a
null doc_id has its set size and a null component; repeated rows of a doc_id
count as one document (the least text speaks for it) and are each returned;
other columns are not read.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import textops as X
from quern.llm.common import connected_components, materialise, small_side

SKETCH = 16  # 64-bit words of the parity sketch
#: Signatures of fewer features on average are too few; then parts of FILLED features sign, PARTS of them for each feature of the band's largest set.
FEW, FILLED, PARTS = 6, 2, 0.4


def difference(size: int, percent: int) -> int:
    """The most features in which two sets of together ``size`` may differ: 100 i >= percent u."""
    return size * (100 - percent) // (100 + percent)


class Bands:
    """Size bands and the PartEnum plan (n1, n2, k2) of each."""

    def __init__(self, percent: int):
        self.percent, self.low, self.high, self.parts = percent, [1], [], {}

    def of(self, size: int) -> int:
        while not self.high or self.high[-1] < size:
            self.high.append(self.low[-1] * 10_000 // self.percent**2)
            self.low.append(self.high[-1] + 1)
        return int(np.searchsorted(self.high, size))

    def _bounds(self, band: int) -> tuple[int, int]:
        while len(self.high) <= band:
            self.of(self.low[-1])
        return self.low[band], self.high[band]

    def filled(self, band: int) -> int:
        """Parts of a band whose filled parts sign, or 0: there must be enough by five standard deviations."""
        if band not in self.parts:
            low, high = self._bounds(band)
            m, enough = int(PARTS * high), high < FEW * (difference(2 * high, self.percent) + 2)
            for size in (low, high):
                mean = size / max(m, 1)
                sparse = math.exp(-mean) * sum(mean**i / math.factorial(i) for i in range(FILLED))
                enough &= m * (1 - sparse) - difference(2 * size, self.percent) - 1 >= 5 * math.sqrt(m * sparse * (1 - sparse))
            self.parts[band] = m if enough else 0
        return self.parts[band]

    def plan(self, band: int) -> tuple[int, int, int]:
        high = self._bounds(band)[1]
        k = difference(2 * high, self.percent)
        return (1, 1, 0) if k == 0 else ((k + 2) // 2, 3 if k <= 6 or high < FEW * (k + 2) else 2, 1)

    def acts_in(self, size: int) -> tuple[int, ...]:
        band = self.of(size)
        return (band, band + 1) if 100 * size >= self.percent * self.low[band + 1] else (band,)


def shingle_sets(column, width: int):
    """For each row its sorted distinct shingles (an empty array without words)."""
    data, offsets = X.utf8(column)
    table, powers, values = X.lower_table(), X.Powers(), X.byte_values()
    none = np.zeros(0, np.uint64)
    for i, j in X.blocks(offsets):
        low = table[data[offsets[i] : offsets[j]]]
        starts, stops, first = X.split_words(low, offsets[i : j + 1] - offsets[i], X.SPACED)
        h = X.hash_words(low, starts, stops, powers, values)
        whole = X.mix(h)
        for k in range(1, width):
            whole = X.mix(whole[: len(h) - k] + h[k:]) if len(h) > k else none
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(whole[a : b - width + 1])
            elif b > a:
                s = X.mix(h[a : a + 1] ^ np.uint64(b - a))
                for k in range(a + 1, b):
                    s = X.mix(s + h[k : k + 1])
                yield s
            else:
                yield none


def _places(features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each feature where it falls, and a value in two halves (sums of which are exact in doubles)."""
    value = X.mix(features ^ np.uint64(0x5BE0CD19137E2179))
    return X.mix(features + np.uint64(0x1F83D9ABFB41BD6B)), (value & np.uint64(0xFFFFFFFF)).astype(np.float64), (value >> np.uint64(32)).astype(np.float64)


def falls_short(features: np.ndarray, bands: Bands) -> int | None:
    """The set's band, if its filled parts are too few to be sure of a shared one."""
    band = bands.of(len(features)) if len(features) else 0
    m = bands.filled(band) if len(features) else 0
    if not m:
        return None
    counts = np.bincount((_places(features)[0] % np.uint64(m)).astype(np.int64), minlength=m)
    return band if (counts >= FILLED).sum() <= difference(2 * len(features), bands.percent) else None


def signatures(features: np.ndarray, bands: Bands, short: frozenset = frozenset()) -> np.ndarray:
    """short: the bands in which some set falls short."""
    out = []
    place, lo, hi = _places(features)
    for b in bands.acts_in(len(features)):
        m = bands.filled(b)
        n1, n2, k2 = (m, 1, 0) if m else bands.plan(b)
        part = (place % np.uint64(n1 * n2)).astype(np.int64)
        sums = np.bincount(part, lo, n1 * n2).astype(np.uint64) + (np.bincount(part, hi, n1 * n2).astype(np.uint64) << np.uint64(32))
        sums = sums.reshape(n1, n2)
        for c, subset in enumerate(combinations(range(n2), n2 - k2)):
            salt = np.uint64((b * 64 + c) << 32) + np.arange(n1, dtype=np.uint64)
            own = X.mix(X.mix(salt) + sums[:, list(subset)].sum(1, dtype=np.uint64))
            out.append(own[np.bincount(part, minlength=m) >= FILLED] if m and b not in short else own)
    return np.concatenate(out)


def sketch(features: np.ndarray) -> list[int]:
    bits = np.bincount((features >> np.uint64(54)).astype(np.int64), minlength=SKETCH * 64) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64).tolist()


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def jaccard_components(docs: DataFrame, width: int = 3, percent: int = 90, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links) of every document."""
    every = _texts(docs, doc_id, text)
    docs = every.where("doc_id is not null")
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        docs = docs.groupBy("doc_id").agg(F.min("text").alias("text"))
    s_names = [f"s{k}" for k in range(SKETCH)]

    def prints(batches):
        bands = Bands(percent)
        for batch in batches:
            n, a, b, short = [], [], [], []
            for s in shingle_sets(batch.column(1), width):
                n.append(len(s))
                a.append(int(X.mix(s).sum(dtype=np.uint64).astype(np.int64)))
                b.append(int(X.mix(s ^ np.uint64(0x510E527FADE682D1)).sum(dtype=np.uint64).astype(np.int64)))
                short.append(falls_short(s, bands))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, a, b, short))], names=["doc_id", "n_shingles", "p1", "p2", "short"])

    known = materialise(every.mapInArrow(X.tidy(prints), "doc_id long, n_shingles long, p1 long, p2 long, short long"))
    short = frozenset(r[0] for r in known.where("short is not null").select("short").distinct().toLocalIterator())  # of a few dozen bands
    filled = known.where("n_shingles > 0 and doc_id is not null")
    # only classes of several documents are joined back; the join can be split where a class is hot
    classes = filled.groupBy("n_shingles", "p1", "p2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size")).where("size > 1").drop("size")
    member = filled.join(small_side(materialise(classes)), ["n_shingles", "p1", "p2"], "left")
    member = materialise(member.select("doc_id", F.coalesce("rep", "doc_id").alias("rep")))
    copies = member.where("doc_id <> rep").select("doc_id").distinct()
    distinct = docs.join(small_side(copies), "doc_id", "left_anti")

    def signed(batches):
        bands = Bands(percent)
        for batch in batches:
            ids, sigs = [], []
            done = 0
            for d, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), width), strict=True):
                if len(s):
                    g = signatures(s, bands, short)
                    ids.append(np.full(len(g), d, np.int64))
                    sigs.append(g.view(np.int64))
                    done += len(g)
                if done > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(ids))], names=["sig", "rep"])
                    ids, sigs, done = [], [], 0
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(ids))], names=["sig", "rep"])

    signs = distinct.mapInArrow(X.tidy(signed), "sig long, rep long")
    # whoever shares a signature is linked to the same hub, its least member: stars hold all candidate pairs
    stars = materialise(_stars(signs))
    reps = stars.select(F.col("hub").alias("rep")).unionByName(stars.select("rep")).distinct()
    sketches = materialise(_sketches(docs, reps, width, s_names))
    near = stars.select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    links = materialise(_verified(_closest(_sketched(near, sketches, s_names, percent)), docs, width, percent))
    parts = _parts(links, reps)

    # what is left: pairs of different components in one star
    left = stars.unionByName(stars.select("hub", F.col("hub").alias("rep")).distinct()).join(parts, "rep")
    mixed = left.groupBy("hub").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("hub")
    left = materialise(left.join(small_side(materialise(mixed)), "hub").join(sketches, "rep"))
    a, b = left.alias("a"), left.alias("b")
    bound = f"(a.n + b.n) * {100 - percent}L div {100 + percent}L"
    apart = " + ".join(f"bit_count(a.{s} ^ b.{s})" for s in s_names)
    rest = a.join(b, F.expr(f"a.hub = b.hub and a.rep < b.rep and a.part <> b.part and abs(a.n - b.n) <= {bound} and {apart} <= {bound}"))
    rest = materialise(rest.select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b")).distinct())
    more = materialise(_verified(rest, docs, width, percent))
    parts = _parts(links.unionByName(more), reps)
    moved = materialise(parts.where("part <> rep"))
    final = member.join(small_side(moved), "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("part", "rep")).alias("component_id"))
    return known.select("doc_id", "n_shingles").join(final, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _stars(signs: DataFrame) -> DataFrame:
    """(hub, rep), distinct: members of a signature with its least member.

    A run of equal signatures is read as a stream that remembers the hub only.
    """

    def run(batches):
        sig = hub = None
        for batch in batches:
            s, r = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            if not len(s):
                continue
            new = np.r_[sig is None or s[0] != sig, s[1:] != s[:-1]]
            hubs = np.r_[np.int64(0 if hub is None else hub), r[new]][np.cumsum(new)]
            sig, hub = s[-1], hubs[-1]
            linked = hubs != r
            pairs = np.unique(np.c_[hubs[linked], r[linked]], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], names=["hub", "rep"])

    return signs.repartition("sig").sortWithinPartitions("sig", "rep").mapInArrow(X.tidy(run), "hub long, rep long").distinct()


def _chosen(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of the ids (distinct, in column doc_id), one for each."""
    return docs.join(small_side(ids), "doc_id", "left_semi")


def _sketches(docs: DataFrame, reps: DataFrame, width: int, names: list[str]) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = [[len(s), *sketch(s)] for s in shingle_sets(batch.column(1), width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(SKETCH + 1))], names=["rep", "n", *names])

    found = _chosen(docs, reps.select(F.col("rep").alias("doc_id"))).mapInArrow(X.tidy(run), "rep long, n long, " + ", ".join(f"{s} long" for s in names))
    return found


def _sketched(pairs: DataFrame, sketches: DataFrame, names: list[str], percent: int) -> DataFrame:
    """Pairs that their sizes and sketches leave possible, with the sketches' distance."""
    a, b = (sketches.select(F.col("rep").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("n", *names))) for side in ("a", "b"))
    both = pairs.join(a, "a").join(b, "b").withColumn("apart", F.expr(" + ".join(f"bit_count(a_{s} ^ b_{s})" for s in names)))
    bound = F.expr(f"(a_n + b_n) * {100 - percent}L div {100 + percent}L")
    return both.where((F.abs(F.col("a_n") - F.col("b_n")) <= bound) & (F.col("apart") <= bound)).select("a", "b", "apart")


def _closest(pairs: DataFrame) -> DataFrame:
    """For each b the nearest a; the others are decided later, where they still matter."""
    return pairs.groupBy("b").agg(F.min_by("a", F.struct("apart", "a")).alias("a")).select("a", "b")


def _verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link, compared in full."""
    pairs = materialise(pairs)
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = materialise(_chosen(docs, ids))
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(shingle_sets(batch.column(2), width), shingle_sets(batch.column(3), width), strict=True):
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(len(x) > 0 and 100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(X.tidy(run), "a long, b long")


def _parts(links: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, part) for every rep: its component so far."""
    found = connected_components(links)
    return materialise(reps.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.coalesce("component", "rep").alias("part")))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of linked documents: the first of its component.

    The row with the least doc_id stays. Where rows repeat a doc_id, each of its
    texts is compared as a document of its own, and of rows equal in both one
    stays. Rows with a null doc_id stay, as nothing names them.
    """
    named = docs.where("doc_id is not null")
    if named.groupBy("doc_id").count().where("count > 1").isEmpty():
        groups = jaccard_components(docs, width, percent)
        gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
        return docs.join(small_side(gone), "doc_id", "left_anti")
    single = named.dropDuplicates(["doc_id", "text"])
    # numbers in the order of doc_id, so that the least of a group has its least doc_id
    rows = materialise(single.orderBy("doc_id", "text").withColumn("_row", F.monotonically_increasing_id()))
    groups = jaccard_components(rows.select(F.col("_row").alias("doc_id"), "text"), width, percent)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_row"))
    return rows.join(small_side(gone), "_row", "left_anti").select(*docs.columns).unionByName(docs.where("doc_id is null"))
