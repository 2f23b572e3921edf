"""Quality classifier: positive-unlabelled learning with the non-negative risk.

Trusted positives are rows labelled 1; unlabelled web text is every other text
(of the learning part). A small network on shape features of whole texts
minimises pi * E_P[l(f)] + max(0, E_U[l(-f)] - pi * E_P[l(-f)]), where pi is
the class prior. It is estimated from positives and unlabelled rows alone, by the
best bin of a scorer that tells the two apart: on held-out rows, the least ratio
of the share of unlabelled rows above a score to that of positives, at the score
where its confidence bound is best. The lesser of two folds counts, less two
standard errors (a prior that is too high forbids low scores; one that is too low
hardly matters). Features are computed on executors; the fit uses at most
FIT_POSITIVE and FIT_UNLABELLED rows, chosen by a hash of doc_id.

Defined results: a null text scores as the empty text. Rows of labels with a
null quality say nothing; where rows for one document differ, it is no trusted
positive. With fewer than FEWEST positives or unlabelled rows the prior is 0.5,
and without either every score is. Repeated documents are each scored; columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import textops as X
from quern.llm.common import small_side

FIT_POSITIVE, FIT_UNLABELLED = 6000, 12000
#: Rows of either kind from which on a class prior is estimated, and the risk that its bound may fail.
FEWEST, RISK = 40, 0.1
THRESHOLD = 0.3
COARSE = 16


def class_tables() -> tuple[np.ndarray, np.ndarray]:
    """fine: a class for each ASCII sign, one for each kind of letter. coarse: sixteen kinds of byte."""
    fine = np.zeros(256, np.int64)
    kinds = {**{c: 1 for c in range(97, 123)}, **{c: 2 for c in range(65, 91)}, **{c: 3 for c in range(48, 58)}, **{c: 4 for c in range(128, 256)}}
    rest = iter(range(5, 256))
    for c in range(256):
        fine[c] = kinds[c] if c in kinds else 0 if c < 32 and c not in (9, 10, 13) or c == 127 else next(rest)
    coarse = np.full(256, 15, np.int64)
    for k, signs in enumerate((range(97, 123), range(65, 91), range(48, 58), range(128, 256), b" \t", b"\n\r", b".", b",", b"!?", b"#$%&*", b"|", b"@", b"\"'`", b"()[]{}<>", b"-_=+/\\")):
        coarse[list(signs)] = k
    return fine, coarse


FINE = int(class_tables()[0].max()) + 1
WIDTH = FINE + COARSE * COARSE + 6


def features(column) -> np.ndarray:
    """One row of WIDTH numbers for each text, from all of it."""
    data, offsets = X.utf8(column)
    fine, coarse = class_tables()
    lower, powers, values = X.lower_table(), X.Powers(), X.byte_values()
    out = np.zeros((len(offsets) - 1, WIDTH), np.float32)
    for i, j in X.blocks(offsets):
        n = j - i
        part, bounds = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        sizes = np.diff(bounds)
        row = np.repeat(np.arange(n), sizes)
        total = np.maximum(sizes, 1)[:, None]
        ones = np.bincount(row * FINE + fine[part], minlength=n * FINE).reshape(n, FINE) / total
        kind = coarse[part]
        same = row[1:] == row[:-1]
        two = np.bincount((row[:-1] * COARSE + kind[:-1])[same] * COARSE + kind[1:][same], minlength=n * COARSE * COARSE).reshape(n, -1) / total
        low = lower[part]
        starts, stops, first = X.split_words(low, bounds, X.SPACED)
        words = np.diff(first)
        h = X.hash_words(low, starts, stops, powers, values)
        wrow = np.repeat(np.arange(n), words)
        inner = np.r_[False, (wrow[1:] == wrow[:-1])] if len(wrow) else np.zeros(0, bool)
        again = np.bincount(wrow[inner & np.r_[False, h[1:] == h[:-1]][: len(h)]], minlength=n) if len(h) else np.zeros(n)
        order = np.argsort(X.mix(h ^ X.mix(wrow.astype(np.uint64))), kind="stable") if len(h) else np.zeros(0, np.int64)
        fresh = np.r_[True, (h[order][1:] != h[order][:-1]) | (wrow[order][1:] != wrow[order][:-1])] if len(h) else np.zeros(0, bool)
        distinct = np.bincount(wrow[order][fresh], minlength=n) if len(h) else np.zeros(n)
        some = np.maximum(words, 1)
        length = np.bincount(wrow, (stops - starts).astype(float), minlength=n) / some
        out[i:j, :FINE] = np.log1p(200 * ones)
        out[i:j, FINE : FINE + COARSE * COARSE] = np.log1p(200 * two)
        out[i:j, -6:] = np.c_[np.log1p(20 * again / some), again / some > 0.3, distinct / some, np.log1p(length), np.log1p(words) / 5, words == 0]
    return out


def _sigmoid(z):
    return 0.5 * (1 + np.tanh(z / 2))


def _teller(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 300, batch: int = 512, rate: float = 0.02, seed: int = 3):
    """A linear score, trained to tell positives from unlabelled rows (logistic loss, both kinds of equal weight)."""
    rng = np.random.default_rng(seed)
    mean, scale = unlabelled.mean(0), np.maximum(unlabelled.std(0), 0.02)
    x = [np.clip((a - mean) / scale, -8, 8) for a in (positive, unlabelled)]
    w = np.zeros(positive.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        rows = np.r_[x[0][rng.integers(0, len(x[0]), batch)], x[1][rng.integers(0, len(x[1]), batch)]]
        slope = _sigmoid(rows @ w[:-1] + w[-1]) - np.repeat([1.0, 0.0], batch)
        g = np.r_[rows.T @ slope / len(rows) + 1e-3 * w[:-1], slope.mean()]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return lambda a: np.clip((a - mean) / scale, -8, 8) @ w[:-1] + w[-1]


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 7) -> float:
    """The share of positives among unlabelled rows, without any negative: the best bin of two folds."""
    if min(len(positive), len(unlabelled)) < FEWEST:
        return 0.5
    rng = np.random.default_rng(seed)
    folds = [np.array_split(rng.permutation(len(x)), 2) for x in (positive, unlabelled)]
    found = []
    for learn, hold in ((0, 1), (1, 0)):
        score = _teller(positive[folds[0][learn]], unlabelled[folds[1][learn]])
        p, u = np.sort(score(positive[folds[0][hold]]))[::-1], np.sort(score(unlabelled[folds[1][hold]]))
        above_p = np.arange(1, len(p) + 1) / len(p)
        above_u = 1 - np.searchsorted(u, p, "left") / len(u)
        slack = np.sqrt(np.log(4 / RISK) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u)))
        best = ((above_u + slack) / above_p).argmin()
        found.append(above_u[best] / above_p[best])
    prior = min(1.0, min(found))
    return max(0.0, prior - 2 * (prior * (1 - prior) / min(len(positive), len(unlabelled))) ** 0.5)


class Network:
    """Standardised features, one hidden layer, one output; with no fit it answers the prior."""

    def __init__(self, prior: float):
        self.prior, self.weights = prior, None

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, hidden: int = 24, steps: int = 700, batch: int = 512, rate: float = 3e-3, decay: float = 1e-4, seed: int = 11) -> Network:
        if not len(positive) or not len(unlabelled):
            return self
        rng, pi = np.random.default_rng(seed), min(max(self.prior, 0.02), 0.98)
        self.mean, self.scale = unlabelled.mean(0), np.maximum(unlabelled.std(0), 0.02)
        p, u = ((x - self.mean) / self.scale for x in (positive, unlabelled))
        w = [rng.normal(0, 1 / np.sqrt(p.shape[1]), (p.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.array(np.log(pi / (1 - pi)))]
        m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
        for step in range(1, steps + 1):
            a, b = p[rng.integers(0, len(p), batch)], u[rng.integers(0, len(u), batch)]
            x = np.clip(np.r_[a, b], -8, 8)
            h = np.maximum(x @ w[0] + w[1], 0)
            f = h @ w[2] + w[3]
            fp, fu = f[:batch], f[batch:]
            negative = np.logaddexp(0, fu).mean() - pi * np.logaddexp(0, fp).mean()
            up, uu = _sigmoid(fp) * pi / batch, _sigmoid(fu) / batch  # slopes of the two terms of the negative risk
            slope = np.r_[-pi * _sigmoid(-fp) / batch - up, uu] if negative >= 0 else np.r_[up, -uu]
            back = np.outer(slope, w[2]) * (h > 0)
            grads = [x.T @ back + decay * w[0], back.sum(0), h.T @ slope + decay * w[2], np.array(slope.sum())]
            lr = rate * min(1, 2 * (1 - step / (steps + 1)))
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.weights = [np.asarray(x, np.float32) for x in w]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        w, x = self.weights, np.clip((x - self.mean) / self.scale, -8, 8)
        return _sigmoid((np.maximum(x @ w[0] + w[1], 0) @ w[2] + w[3]).astype(float))


def _sample(docs: DataFrame, rows: int, most: int, salt: int) -> DataFrame:
    """About ``most`` of the rows, chosen by a hash of doc_id."""
    share = 1.0 if rows <= most else most / rows
    return docs.where(F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, text: str = "text") -> Network:
    """docs and labels: with doc_id; may_learn: which doc_id the model may learn from."""
    known = labels.where(may_learn & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality >= 1")
    good = known.count()
    web = docs.where(may_learn).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def vectors(batches):
        for batch in (p for b in batches for p in X.pieces(b)):
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in features(batch.column(1))], pa.binary())], names=["x"])

    def gather(chosen: DataFrame, most: int) -> np.ndarray:
        found = sorted(bytes(r[0]) for r in chosen.mapInArrow(X.tidy(vectors), "x binary").limit(2 * most).toLocalIterator())  # tasks end in any order
        return np.array([np.frombuffer(x, np.float32) for x in found], np.float32).reshape(-1, WIDTH)

    trusted = _sample(known.select("doc_id"), good, FIT_POSITIVE, 1)
    positive = gather(web.join(F.broadcast(trusted.limit(2 * FIT_POSITIVE)), "doc_id", "left_semi"), FIT_POSITIVE)
    unlabelled = gather(_sample(web, web.select("doc_id").count(), FIT_UNLABELLED, 2), FIT_UNLABELLED)
    return Network(estimate_prior(positive, unlabelled)).fit(positive, unlabelled)


def score(docs: DataFrame, model: Network, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in (p for b in batches for p in X.pieces(b)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(features(batch.column(1))), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(X.tidy(run), "doc_id long, score double")


def keep_good(docs: DataFrame, model: Network, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """docs without the rows whose text scores below the threshold; all columns stay as they are."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches):
        for batch in (p for b in batches for p in X.pieces(b)):
            yield batch.filter(pa.array(shared.value.score(features(batch.column(at))) >= threshold, pa.bool_()))

    return docs.mapInArrow(X.tidy(run), docs.schema)
