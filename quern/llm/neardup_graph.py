"""Embedding near-dedup on a flat robust-pruned graph.

Only vectors of one label and length are compared. Equal vectors are one class.
The classes of a large label are dealt to cells around sampled pivots, each to
its nearest ones, the more of them the more classes (and so pivots) the label
has; a cell is a shard, and one that is too large is cut into blocks, each pair
of blocks being a shard, so that any two vectors of a cell still meet. In each
shard a graph is built: its vectors are dealt to small overlapping clusters around
local pivots, candidates are the nearest in each cluster, a vector's lists from all
its clusters are united and robust-pruned. Every vector searches the graph: greedily
from the shard's medoid to itself, then expanding the range while similarities
stay near the threshold. What it finds is verified by cosine in double precision.

A pair is counted in the first shard that both share, so shards return sums and
the roots of their local components, never pairs. Recall is audited in every
large label, and in the small ones together, against brute force: the mean, over
LINKED or more sampled classes that have links, of the share of their linked
classes that was found. Labels in which AUDIT_MOST sampled classes have fewer
links are judged together. Below MIN_RECALL, a label is searched again with more
overlap and a wider range; what still falls short after ATTEMPTS is compared
exactly, pair by pair.

Defined results: a vector that is null, zero, or has null or non-finite
components, or a null label, links with nothing. Labels of any type are compared
as texts. Repeated rows of a vec_id are
one vector (the least by content); rows with a null vec_id are left out. Other
columns are not read.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import textops as X
from quern.llm.common import connected_components, materialise, small_side

THRESHOLD = 0.93
#: A label of more than LARGE classes is dealt to cells of about 2 * CELL; a cell of more than 2 * BLOCK is cut into blocks.
LARGE, CELL, BLOCK, OVERLAP, ATTEMPTS = 600, 250, 750, 2, 3
DEGREE, CANDIDATES, FAR, ALPHA, HOPS, SLACK = 16, 32, 6, 1.2, 60, 0.06
#: A shard's clusters: each aims at LEAF vectors, of which each is in LEAVES, and has LEAF_MOST at most.
LEAF, LEAVES, LEAF_MOST = 192, 3, 768
#: Pivots are broadcast: so many bytes of them at most; with more vectors the cells grow and are cut into blocks.
PIVOT_BYTES = 64 << 20
#: First and last sample of an audit, linked classes that it needs, bytes of vectors that are broadcast at once.
AUDIT, AUDIT_MOST, LINKED, CHUNK, MIN_RECALL = 500, 2000, 100, 32 << 20, 0.95
SUMS = "rep long, n long, pairs long, root long"


def unit_rows(column) -> list[bytes | None]:
    """Unit vectors as bytes of doubles; None for what links with nothing."""
    out = []
    for v in column:
        values = v.as_py()
        x = np.array(values, np.float64) if values and None not in values else None
        if x is None or not np.isfinite(x).all() or not x.any():
            out.append(None)
            continue
        x = x / np.abs(x).max()
        out.append((x / np.sqrt((x * x).sum())).tobytes())
    return out


def candidates(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n by CANDIDATES nodes, nearest first, and their similarities): the lists of overlapping clusters united; the node itself fills up."""
    n, rng = len(vectors), np.random.default_rng(len(vectors))
    if n <= LEAF_MOST:
        groups = [np.arange(n)]
    else:
        pivots = rng.choice(n, -(-LEAVES * n // LEAF), replace=False)
        home = np.argpartition(-(vectors @ vectors[pivots].T), LEAVES - 1, 1)[:, :LEAVES].ravel()
        order = np.argsort(home, kind="stable")
        groups = []
        for members in np.split(order // LEAVES, np.flatnonzero(np.diff(home[order])) + 1):
            parts = -(-len(members) // LEAF_MOST)
            groups += np.array_split(rng.permutation(members), parts) if parts > 1 else [members]
    node, other, sims = [], [], []
    for g in groups:
        local = (vectors[g] @ vectors[g].T).astype(np.float32)
        c = min(CANDIDATES, len(g))
        near = np.argpartition(-local, c - 1, 1)[:, :c]
        node.append(np.repeat(g, c))
        other.append(g[near].ravel())
        sims.append(np.take_along_axis(local, near, 1).ravel())
    far = rng.integers(0, n, (n, FAR))  # long edges
    node.append(np.repeat(np.arange(n), FAR))
    other.append(far.ravel())
    sims.append(np.einsum("ikj,ij->ik", vectors[far], vectors).astype(np.float32).ravel())
    node, other, sims = np.concatenate(node), np.concatenate(other), np.concatenate(sims)
    _, once = np.unique(node * n + other, return_index=True)
    node, other, sims = node[once], other[once], sims[once]
    order = np.lexsort((-sims, node))
    node, other, sims = node[order], other[order], sims[order]
    rank = np.arange(len(node)) - np.searchsorted(node, node)
    near, value = np.tile(np.arange(n)[:, None], CANDIDATES + FAR), np.ones((n, CANDIDATES + FAR), np.float32)
    keep = rank < CANDIDATES + FAR
    near[node[keep], rank[keep]], value[node[keep], rank[keep]] = other[keep], sims[keep]
    return near, value


def robust_prune(vectors: np.ndarray, order: np.ndarray, sims: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """For each row, out of its candidates (nearest first): the nearest goes in and hides those much nearer to it."""
    n, c = order.shape
    out = np.full((n, degree), -1, np.int64)
    small = vectors.astype(np.float32)
    for a in range(0, n, 256):
        own = order[a : a + 256]
        rows = np.arange(len(own))
        dist = np.maximum(0, 1 - sims[a : a + 256])
        held = small[own]
        between = np.maximum(0, 1 - held @ held.transpose(0, 2, 1))
        open_ = own != (rows + a)[:, None]
        for k in range(degree):
            first = open_.argmax(1)
            some = open_[rows, first]
            if not some.any():
                break
            out[a + np.flatnonzero(some), k] = own[rows, first][some]
            open_ &= alpha * between[rows, first] > dist
            open_[rows, first] = False
    return out


def build(vectors: np.ndarray) -> np.ndarray:
    """Adjacency (n by DEGREE, -1 for none) of the robust-pruned graph of one shard."""
    return robust_prune(vectors, *candidates(vectors))


def undirected(one: np.ndarray, two: np.ndarray, n: int) -> list[np.ndarray]:
    """Neighbours of each of n nodes, edges read both ways: a node that no list names would never be found."""
    code = np.unique(np.r_[one * n + two, two * n + one])
    return np.split(code % n, np.searchsorted(code // n, np.arange(1, n)))


def search(vectors: np.ndarray, adjacency: list[np.ndarray], threshold: float, slack: float, step: int = 256) -> np.ndarray:
    """n by n booleans: who finds whom at or above the threshold, walking the graph only."""
    n = len(vectors)
    found = np.zeros((n, n), bool)
    medoid = int((vectors @ vectors.mean(0)).argmax())
    counts = np.array([len(a) for a in adjacency])
    flat, begin = np.concatenate(adjacency).astype(np.int64) if n else np.zeros(0, np.int64), np.cumsum(counts) - counts
    for a in range(0, n, step):
        q = np.arange(a, min(n, a + step))
        m = len(q)
        sims = np.full((m, n), -2.0)
        done = np.zeros((m, n), bool)

        def visit(rows, nodes, sims=sims, q=q):
            if 4 * len(rows) > sims.size:
                asked = np.zeros(sims.shape, bool)
                asked[rows, nodes] = True
                rows, nodes = np.nonzero(asked & (sims < -1.5))
            else:
                new = sims[rows, nodes] < -1.5
                code = np.unique(rows[new] * n + nodes[new])
                rows, nodes = code // n, code % n
            if 8 * len(rows) > sims.size:  # one product costs less than so many by themselves
                sims[rows, nodes] = (vectors[q] @ vectors.T)[rows, nodes]
            else:
                sims[rows, nodes] = np.einsum("ij,ij->i", vectors[q[rows]], vectors[nodes])

        def expand(rows, nodes, done=done, visit=visit):
            done[rows, nodes] = True
            times = counts[nodes]
            visit(np.repeat(rows, times), flat[np.repeat(begin[nodes], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)])

        visit(np.arange(m), np.full(m, medoid))
        active = np.arange(m)
        for _ in range(HOPS):
            if not len(active):
                break
            open_ = np.where(done[active], -3.0, sims[active])
            best = open_.argmax(1)
            more = open_[np.arange(len(active)), best] > -1.5
            expand(active[more], best[more])
            at_home = done[active, q[active]]  # it has reached itself
            active = active[more & ~at_home]
        while True:
            rows, nodes = np.nonzero((sims >= threshold - slack) & ~done)
            if not len(rows):
                break
            expand(rows, nodes)
        found[q] = sims >= threshold
    np.fill_diagonal(found, False)
    return found | found.T


def _local_roots(found: np.ndarray) -> np.ndarray:
    """For each row the least row reachable."""
    root = np.full(len(found), -1)
    for i in range(len(found)):
        if root[i] < 0:
            root[i], stack = i, [i]
            while stack:
                near = np.flatnonzero(found[stack.pop()] & (root < 0))
                root[near] = i
                stack.extend(near.tolist())
    return root


def _overlap(n: int) -> int:
    """Cells of each class in a large label of n classes: a close pair parts more often the more pivots there are."""
    return OVERLAP + max(0, math.ceil(1.5 * math.log10(n / (2 * CELL))))


def _cells(classes: DataFrame, more: int) -> DataFrame:
    """(rep, size, unit, shards) for every class: the shards it is in; more is added to the overlap."""
    spark = classes.sparkSession
    groups = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    large = groups.where(F.col("n") > LARGE).collect()
    overlap = {(r["label"], r["dim"]): _overlap(r["n"]) + more for r in large}
    # the mean cell has 2 * CELL classes, whatever the overlap
    wanted = {g: n / (2 * CELL) for g, n in overlap.items()}
    fit = min(1.0, PIVOT_BYTES / max(1.0, sum(8 * r["dim"] * r["n"] * wanted[r["label"], r["dim"]] for r in large)))
    shares = spark.createDataFrame([(*g, max(1, int(min(1.0, fit * w) * (1 << 30)))) for g, w in wanted.items()], "label string, dim int, share long")
    picked = classes.join(F.broadcast(shares), ["label", "dim"]).where(F.pmod(F.xxhash64(F.lit(7), "rep"), F.lit(1 << 30)) < F.col("share"))
    pivots: dict[tuple, list] = {}
    room = 2 * PIVOT_BYTES  # the sample has about half of it
    for r in picked.select("label", "dim", "rep", "unit").orderBy("rep").toLocalIterator():
        if room < len(r["unit"]):
            break
        pivots.setdefault((r["label"], r["dim"]), []).append(np.frombuffer(bytes(r["unit"])))
        room -= len(r["unit"])
    shared = spark.sparkContext.broadcast({g: np.array(v) for g, v in pivots.items()})

    def nearest(batches):
        for batch in batches:
            cells: list = [[0]] * batch.num_rows
            labels, dims, units = (batch.column(k).to_pylist() for k in (1, 2, 4))
            rows: dict[tuple, list[int]] = {}
            for k, g in enumerate(zip(labels, dims, strict=True)):
                if g in shared.value:
                    rows.setdefault(g, []).append(k)
            for g, ks in rows.items():
                p, many = shared.value[g], overlap[g]
                own = np.array([np.frombuffer(units[k]) for k in ks])
                for strip in _strips(len(ks), len(p)):
                    order = np.argsort(-(own[strip] @ p.T), 1, kind="stable")[:, :many]
                    for k, c in zip(ks[strip], order.tolist(), strict=True):
                        cells[k] = c
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(cells, pa.list_(pa.int32()))], names=["rep", "label", "dim", "size", "unit", "cells"])

    dealt = classes.select("rep", "label", "dim", "size", "unit").mapInArrow(X.tidy(nearest), "rep long, label string, dim int, size long, unit binary, cells array<int>")
    dealt = materialise(dealt)
    rows = dealt.select("label", "dim", F.explode("cells").alias("cell")).groupBy("label", "dim", "cell").count()
    cuts = rows.where(F.col("count") > 2 * BLOCK).select("label", "dim", "cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    # a block in every cell it is in; a shard for each pair of blocks
    each = dealt.select("rep", "label", "dim", F.explode("cells").alias("cell")).join(small_side(cuts), ["label", "dim", "cell"], "left")
    block = F.pmod(F.xxhash64(F.lit(13), "rep"), F.col("blocks")).cast("int")
    name = F.concat_ws("/", F.hex("label"), "dim", "cell")
    shards = F.when(F.col("blocks").isNull(), F.array(name)).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.concat_ws("/", name, F.least(b, block).cast("string"), F.greatest(b, block).cast("string"))))
    lists = each.select("rep", F.explode(shards).alias("shard")).groupBy("rep").agg(F.array_sort(F.collect_set("shard")).alias("shards"))
    return materialise(dealt.select("rep", "size", "unit").join(lists, "rep"))


def _search_all(members: DataFrame, threshold: float, slack: float) -> DataFrame:
    """(rep, n, pairs, root) for each shard of each class: copies and classes linked that are counted here, and the local root."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep", kind="stable")
        shard, reps, size = pdf["shard"].iloc[0], pdf["rep"].to_numpy(), pdf["size"].to_numpy()
        v = np.array([np.frombuffer(x) for x in pdf["unit"]])
        one, place = np.nonzero((near := build(v)) >= 0)
        found = search(v, undirected(one, near[one, place], len(reps)), threshold, slack)
        # a pair counts in the first shard that both are in
        before = {}
        for k, own in enumerate(pdf["shards"]):
            for s in own:
                if s < shard:
                    before.setdefault(s, []).append(k)
        mine = found.copy()
        for ks in before.values():
            mine[np.ix_(ks, ks)] = False
        return pd.DataFrame({"rep": reps, "n": (mine @ size).astype("int64"), "pairs": mine.sum(1), "root": reps[_local_roots(found)]})

    placed = members.withColumn("shard", F.explode("shards"))
    return materialise(placed.groupBy("shard").applyInPandas(walk, SUMS))


def _by_group(batch: pa.RecordBatch):
    """(label, dim), reps, sizes and units for each label and length in a batch of rep, label, dim, size, unit."""
    reps, sizes = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 3))
    rows: dict[tuple, list[int]] = {}
    for k, g in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
        rows.setdefault(g, []).append(k)
    units = batch.column(4).to_pylist()
    for g, ks in rows.items():
        yield g, reps[ks], sizes[ks], np.array([np.frombuffer(units[k]) for k in ks])


def _strips(rows: int, columns: int):
    """Slices of the rows, each of four million products at most."""
    step = max(1, 4_000_000 // max(1, columns))
    return (slice(a, a + step) for a in range(0, rows, step))


def _linked(classes: DataFrame, sample: DataFrame, threshold: float) -> DataFrame:
    """(rep, true): by brute force, with how many other classes those of the sample link; only if with any."""
    by_group: dict[tuple, tuple[list, list]] = {}
    for r in sample.select("rep", "label", "dim", "unit").toLocalIterator():
        ids, units = by_group.setdefault((r["label"], r["dim"]), ([], []))
        ids.append(r["rep"])
        units.append(np.frombuffer(bytes(r["unit"])))
    shared = classes.sparkSession.sparkContext.broadcast({g: (np.array(i), np.array(u)) for g, (i, u) in by_group.items()})

    def count(batches):
        for batch in batches:
            for g, reps, _, units in _by_group(batch):
                if g in shared.value:
                    ids, chosen = shared.value[g]
                    true = np.zeros(len(ids), np.int64)
                    for s in _strips(len(reps), len(ids)):
                        true += ((units[s] @ chosen.T >= threshold) & (reps[s, None] != ids)).sum(0)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[true > 0]), pa.array(true[true > 0])], names=["rep", "true"])

    return classes.select("rep", "label", "dim", "size", "unit").mapInArrow(X.tidy(count), "rep long, true long").groupBy("rep").agg(F.sum("true").alias("true"))


def _audit(classes: DataFrame, sums: DataFrame, threshold: float) -> dict[str, float]:
    """Recall in each part; parts whose samples have too few links are one in this."""
    spark = classes.sparkSession
    sizes = {r["part"]: (r["n"], r["dim"]) for r in classes.groupBy("part").agg(F.count("*").alias("n"), F.max("dim").alias("dim")).collect()}
    pairs = sums.groupBy("rep").agg(F.sum("pairs").alias("pairs"))
    recall: dict[str, float] = {}
    few: dict[str, tuple[int, float]] = {}
    due = [(p, AUDIT) for p in sorted(sizes, reverse=True)]
    while due:
        now, room = [], CHUNK
        while due and (not now or room >= 8 * sizes[due[-1][0]][1] * due[-1][1]):
            now.append(due.pop())
            room -= 8 * sizes[now[-1][0]][1] * now[-1][1]
        shares = spark.createDataFrame([(p, int(min(1.0, n / sizes[p][0]) * (1 << 30))) for p, n in now], "part string, share long")
        sample = classes.join(F.broadcast(shares), "part").where(F.pmod(F.xxhash64(F.lit(17), "rep"), F.lit(1 << 30)) < F.col("share"))
        seen = _linked(classes.where(F.col("part").isin([p for p, _ in now])), sample, threshold).join(classes.select("rep", "part"), "rep").join(pairs, "rep", "left")
        got = {r["part"]: r for r in seen.groupBy("part").agg(F.count("*").alias("linked"), F.avg(F.least(F.lit(1.0), F.coalesce("pairs", F.lit(0)) / F.col("true"))).alias("recall")).collect()}
        for p, n in now:
            linked = got[p]["linked"] if p in got else 0
            if n >= sizes[p][0] or linked >= LINKED:
                recall[p] = got[p]["recall"] if linked else 1.0
            elif n >= AUDIT_MOST or 8 * sizes[p][1] * 4 * n > CHUNK:
                few[p] = linked, got[p]["recall"] if linked else 1.0
            else:
                due.append((p, 4 * n))
    linked = sum(n for n, _ in few.values())
    return recall | dict.fromkeys(few, sum(n * r for n, r in few.values()) / linked if linked else 1.0)


def _strip_roots(one: np.ndarray, two: np.ndarray, n: int) -> np.ndarray:
    """The least of n nodes reachable from each by the edges."""
    root = np.arange(n)
    while True:
        least, new = np.minimum(root[one], root[two]), root.copy()
        np.minimum.at(new, one, least)
        np.minimum.at(new, two, least)
        if (new == root).all():
            return root
        root = new


def _search_exactly(classes: DataFrame, threshold: float) -> DataFrame:
    """(rep, n, pairs, root) as _search_all, every pair of a label compared: chunk by chunk by broadcast, so that nothing is shuffled."""

    def compare(part: DataFrame, chunk: list) -> DataFrame:
        by_group: dict[tuple, list] = {}
        for r in chunk:
            by_group.setdefault((r["label"], r["dim"]), []).append((r["rep"], r["size"], np.frombuffer(bytes(r["unit"]))))
        shared = part.sparkSession.sparkContext.broadcast({g: tuple(map(np.array, zip(*v, strict=True))) for g, v in by_group.items()})

        def links(batches):
            for batch in batches:
                for g, reps, _, units in _by_group(batch):
                    if g not in shared.value:
                        continue
                    ids, sizes, others = shared.value[g]
                    for s in _strips(len(reps), len(ids)):
                        own = reps[s]
                        found = (units[s] @ others.T >= threshold) & (own[:, None] != ids)
                        one, two = np.nonzero(found)
                        nodes = np.r_[own, ids]
                        root = nodes[_strip_roots(one, two + len(own), len(nodes))]
                        zero = np.zeros(len(ids), np.int64)
                        n, pairs = np.r_[(found @ sizes).astype(np.int64), zero], np.r_[found.sum(1), zero]
                        keep = (pairs > 0) | (root != nodes)
                        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (nodes, n, pairs, root)], names=["rep", "n", "pairs", "root"])

        low, high = chunk[0]["label"], chunk[-1]["label"]
        return materialise(part.where(F.col("label").between(low, high)).select("rep", "label", "dim", "size", "unit").mapInArrow(X.tidy(links), SUMS))

    out, chunk, held = [], [], 0
    for r in classes.select("label", "dim", "rep", "size", "unit").orderBy("label", "dim", "rep").toLocalIterator():
        if chunk and held + len(r["unit"]) > CHUNK:
            out.append(compare(classes, chunk))
            chunk, held = [], 0
        chunk.append(r)
        held += len(r["unit"])
    if chunk:
        out.append(compare(classes, chunk))
    return functools.reduce(DataFrame.unionByName, out)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""

    def normal(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(unit_rows(batch.column(2)), pa.binary())], names=["vec_id", "label", "unit"])

    chosen = vectors.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast("array<double>").alias("embedding"))
    rows = chosen.mapInArrow(X.tidy(normal), "vec_id long, label string, unit binary").groupBy("vec_id").agg(F.min(F.struct("label", "unit")).alias("v"))
    every = materialise(rows.select("vec_id", "v.label", "v.unit").withColumn("print", F.when(F.col("label").isNotNull(), F.sha2("unit", 256))))
    valid = every.where("print is not null")
    grouped = valid.groupBy("label", "print").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"))
    classes = materialise(grouped.select("rep", "size").join(valid.select(F.col("vec_id").alias("rep"), "label", (F.octet_length("unit") / 8).cast("int").alias("dim"), "unit"), "rep"))
    # a part is a large label, or all small ones
    sizes = classes.groupBy("label", "dim").count()
    large = sizes.where(F.col("count") > LARGE).select("label", "dim", F.concat_ws("/", F.hex("label"), "dim").alias("part"))
    classes = materialise(classes.join(small_side(large), ["label", "dim"], "left").withColumn("part", F.coalesce("part", F.lit(""))))
    good, due = [], classes
    for attempt in range(ATTEMPTS):
        found = _search_all(_cells(due, attempt), threshold, SLACK * (1 + attempt))
        recall = _audit(due, found, threshold)
        short = [p for p, share in recall.items() if share < MIN_RECALL]
        good.append(found.join(due.where(~F.col("part").isin(short)).select("rep"), "rep", "left_semi") if short else found)
        due = classes.where(F.col("part").isin(short))
        if not short:
            break
    if short:
        good.append(_search_exactly(due, threshold))
    sums = functools.reduce(DataFrame.unionByName, good)
    parts = connected_components(sums.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    by_class = sums.groupBy("rep").agg(F.sum("n").alias("others")).join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    known = grouped.join(by_class, "rep", "left").select("label", "print", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = every.select("vec_id", "label", "print").join(materialise(known), ["label", "print"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
