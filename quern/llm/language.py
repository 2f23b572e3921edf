"""Language ID: a byte convolutional network, trained and applied in numpy.

Bytes are lower-cased and mapped to at most 64 signs (the most frequent bytes of
the training sample). Filters of widths 2 and 4 slide over windows of WINDOW
bytes; each filter keeps its greatest answer, a softmax layer gives the
languages. As a filter is a sum of one weight for each place and sign, two
neighbouring places are looked up together in a table when the net is applied.
All windows of a text are read and their probabilities averaged by length.

Defined results: a null text and a text without any letter are `und` with score
0; with nothing to learn from, so is every text. Repeated documents are each
answered; columns other than doc_id, text and lang are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import textops as X

WINDOW, SIGNS, FILTERS, WIDTHS = 256, 64, 16, (2, 4)
#: The fit reads at most so many documents and windows of each.
FIT_DOCUMENTS, FIT_WINDOWS = 3000, 6
ASCII_LETTERS = X.byte_class((65, 90), (97, 122))


def windows(data: np.ndarray, offsets: np.ndarray, signs: np.ndarray):
    """(windows by WINDOW signs, row and byte count of each); a text's last window is padded with sign 0."""
    sizes = np.diff(offsets)
    each = -(-sizes // WINDOW)
    row = np.repeat(np.arange(len(sizes)), each)
    k = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
    begin = offsets[:-1][row] - offsets[0] + k * WINDOW
    count = np.minimum(WINDOW, sizes[row] - k * WINDOW)
    padded = np.r_[signs[data[offsets[0] : offsets[-1]]], np.zeros(WINDOW, np.uint8)]
    out = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[begin]
    out = np.where(np.arange(WINDOW) < count[:, None], out, 0)
    return out, row, count


class ByteNet:
    def __init__(self, languages: list[str], signs: np.ndarray):
        self.languages, self.signs = languages, signs

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 900, batch: int = 96, rate: float = 0.01, seed: int = 5) -> ByteNet:
        rng, n = np.random.default_rng(seed), len(self.languages)
        w = [rng.normal(0, 0.5, (k, SIGNS, FILTERS)) for k in WIDTHS] + [rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, n)), np.zeros(n)]
        w = [a.astype(np.float32) for a in w]
        m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
        for step in range(1, steps + 1):
            at = rng.integers(0, len(x), batch)
            s, t = x[at].astype(np.int64), y[at]
            pooled, places = [], []
            for k, a in zip(WIDTHS, w, strict=False):
                answers = sum(a[i][s[:, i : WINDOW - k + 1 + i]] for i in range(k))
                place = answers.argmax(1)
                places.append(place)
                pooled.append(np.take_along_axis(answers, place[:, None], 1)[:, 0])
            h = np.maximum(np.concatenate(pooled, 1), 0)
            z = h @ w[-2] + w[-1]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(batch), t] -= 1
            p /= batch
            grads = [np.zeros_like(a) for a in w]
            grads[-2], grads[-1] = h.T @ p, p.sum(0)
            back = (p @ w[-2].T) * (h > 0)
            for c, k in enumerate(WIDTHS):
                g, rows = back[:, c * FILTERS : (c + 1) * FILTERS], np.arange(batch)[:, None]
                for i in range(k):
                    np.add.at(grads[c][i], (s[rows, places[c] + i], np.arange(FILTERS)[None]), g)
            lr = rate * (1 - step / (steps + 1))
            for c, g in enumerate(grads):
                m[c] = 0.9 * m[c] + 0.1 * g
                v[c] = 0.999 * v[c] + 0.001 * g * g
                w[c] -= (lr * (m[c] / (1 - 0.9**step)) / (np.sqrt(v[c] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        self.out, self.bias = w[-2], w[-1]
        #: for each width and pair of neighbouring places: answers by the pair of signs
        self.pairs = [[(a[i][:, None] + a[i + 1][None]).reshape(SIGNS * SIGNS, FILTERS) for i in range(0, k, 2)] for k, a in zip(WIDTHS, w, strict=False)]
        return self

    def windows_of(self, data: np.ndarray, offsets: np.ndarray):
        return windows(data, offsets, self.signs)

    def probabilities(self, s: np.ndarray) -> np.ndarray:
        pair = s[:, :-1].astype(np.intp) * SIGNS + s[:, 1:]
        pooled = []
        for k, tables in zip(WIDTHS, self.pairs, strict=True):
            n = WINDOW - k + 1
            answers = tables[0].take(pair[:, :n], 0)
            for i, t in enumerate(tables[1:], 1):
                answers += t.take(pair[:, 2 * i : 2 * i + n], 0)
            pooled.append(answers.max(1))
        z = np.maximum(np.concatenate(pooled, 1), 0) @ self.out + self.bias
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def answer(self, column, step: int = 256) -> tuple[list[str], np.ndarray]:
        data, offsets = X.utf8(column)
        n = len(offsets) - 1
        names, scores = ["und"] * n, np.zeros(n)
        for i, j in X.blocks(offsets) if self.languages else ():
            s, row, count = self.windows_of(data, offsets[i : j + 1])
            p = np.concatenate([self.probabilities(s[a : a + step]) for a in range(0, len(s), step)]) if len(s) else np.zeros((0, len(self.languages)))
            mean = np.zeros((j - i, len(self.languages)))
            for c in range(len(self.languages)):
                mean[:, c] = np.bincount(row, p[:, c] * count, minlength=j - i)
            mean /= np.maximum(offsets[i + 1 : j + 1] - offsets[i:j], 1)[:, None]
            letters = np.r_[0, np.cumsum(ASCII_LETTERS[data[offsets[i] : offsets[j]]])]
            at = offsets[i : j + 1] - offsets[i]
            some = letters[at[1:]] > letters[at[:-1]]
            for k in range(i, j):
                if some[k - i] or any(c.isalpha() for c in bytes(data[offsets[k] : offsets[k + 1]]).decode("utf-8", "replace")):
                    best = int(mean[k - i].argmax())
                    names[k], scores[k] = self.languages[best], min(1.0, float(mean[k - i, best]))
        return names, scores


def sign_table(data: np.ndarray) -> np.ndarray:
    """Byte -> sign: 0 is padding, 1 to 62 the most frequent lower-cased bytes, 63 all others."""
    low = X.lower_table()
    counts = np.bincount(low[data], minlength=256)
    top = [int(b) for b in np.lexsort((np.arange(256), -counts))[: SIGNS - 2] if counts[b]]
    table = np.full(256, SIGNS - 1, np.uint8)
    table[top] = np.arange(1, len(top) + 1)
    return table[low]


def fit(docs: DataFrame, may_learn: Column, text: str = "text", lang: str = "lang") -> ByteNet:
    """Train on windows spread evenly over whole texts of a bounded sample of labelled rows."""
    learn = docs.where(may_learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    rows = learn.select("doc_id").count()
    share = 1.0 if rows <= FIT_DOCUMENTS else FIT_DOCUMENTS / rows
    chosen = learn.where(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def cut(batches):
        for batch in batches:
            data, offsets = X.utf8(batch.column(1))
            out, names = [], []
            for k, name in enumerate(batch.column(0).to_pylist()):
                t = bytes(data[offsets[k] : offsets[k + 1]])
                many = max(1, min(FIT_WINDOWS, len(t) // WINDOW))
                for i in range(many):
                    at = (len(t) - WINDOW) * i // max(1, many - 1) if len(t) > WINDOW else 0
                    out.append(t[at : at + WINDOW])
                    names.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(out, pa.binary())], names=["lang", "window"])

    got = [(r[0], bytes(r[1])) for r in chosen.select("lang", "text").mapInArrow(X.tidy(cut), "lang string, window binary").limit(2 * FIT_DOCUMENTS * FIT_WINDOWS).toLocalIterator()]
    got = sorted(r for r in got if r[1])
    languages = sorted({r[0] for r in got})
    data = np.frombuffer(b"".join(r[1] for r in got), np.uint8)
    net = ByteNet(languages, sign_table(data))
    if languages:
        offsets = np.cumsum([0, *(len(r[1]) for r in got)])
        s, row, _ = net.windows_of(data, offsets)
        net.fit(s, np.searchsorted(languages, [got[k][0] for k in row]))
    return net


def identify(docs: DataFrame, net: ByteNet, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for batch in batches:
            names, scores = shared.value.answer(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(X.tidy(run), "doc_id long, lang_pred string, score double")
