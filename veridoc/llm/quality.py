"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words.  Each passage is described by numbers read
from its bytes (kinds of characters, word lengths, repetition) and encoded by one hidden layer;
gated attention (a tanh branch times a sigmoid branch) gives each passage its weight, and a
logistic layer scores the weighted sum.  Weights are learned from document labels alone.  Whole
texts are read; nothing but the text enters a score.

Learning uses at most ``max_rows`` labelled documents (a documented bound; by least hash of
their id) and none that is held out.  The rest of the job, scoring, has no bound.

Defined cases: a null or empty text is one passage without words and gets a score like any
other; without any usable label the score is 0.5; repeated rows give equal rows; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridoc.llm.common import release, small_batches
from veridoc.llm.textbytes import buffers, running, slices, span, word_bounds

PASSAGE = 96
SLICE = 1 << 20  # bytes of text worked on at once
CLASSES = 12
THRESHOLD = 0.3
# The class of each byte.
KIND = np.full(256, 11, np.uint8)  # other control or punctuation
KIND[[9, 10, 11, 12, 13, 32]] = 0
KIND[ord("a") : ord("z") + 1] = 1
KIND[ord("A") : ord("Z") + 1] = 2
KIND[ord("0") : ord("9") + 1] = 3
KIND[0x80:] = 4
KIND[ord("!")] = 5
KIND[ord("|")] = 6
for _c in "*$%&#@~^":
    KIND[ord(_c)] = 7
for _c in ".,;:?":
    KIND[ord(_c)] = 8
for _c in "<>{}[]()=/\\_":
    KIND[ord(_c)] = 9
for _c in "'\"-":
    KIND[ord(_c)] = 10
GAP = KIND == 0
N_FEATURES = 22


def passages(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of each passage, (passages, N_FEATURES), and the row each belongs to; every row has one at least."""
    n = off.size - 1
    base, data = off[0], data[off[0] : off[-1]]
    off = off - base
    kind = KIND[data]
    starts, ends = word_bounds(data, off, GAP)
    row = np.searchsorted(off, starts, "right") - 1
    place = np.arange(starts.size) - np.searchsorted(starts, off[:-1])[row] if starts.size else starts
    head = np.flatnonzero(place % PASSAGE == 0)
    empty = np.setdiff1d(np.arange(n), row)
    rows = np.concatenate([row[head], empty])
    out = np.zeros((rows.size, N_FEATURES), np.float32)
    k = head.size
    if k:
        begin = starts[head]
        size = np.diff(np.append(head, starts.size))
        width = np.append(begin[1:], data.size) - begin
        counts = np.stack([np.add.reduceat(kind == c, begin, dtype=np.int64) for c in range(CLASSES)], 1).astype(np.float32)
        length = (ends - starts).astype(np.float32)
        value = span(running(data), starts, ends)
        same = np.zeros(starts.size, bool)
        same[1:] = (value[1:] == value[:-1]) & (row[1:] == row[:-1])
        lag2 = np.zeros(starts.size, bool)
        lag2[2:] = (value[2:] == value[:-2]) & (row[2:] == row[:-2])
        order = np.lexsort((value, np.repeat(np.arange(k), size)))
        group, v = np.repeat(np.arange(k), size)[order], value[order]
        fresh = np.ones(v.size, bool)
        fresh[1:] = (v[1:] != v[:-1]) | (group[1:] != group[:-1])
        distinct = np.bincount(group[fresh], minlength=k)
        loud = (kind[starts] == 2) & (kind[np.minimum(starts + 1, data.size - 1)] == 2)
        tail = kind[ends - 1]
        mean = np.add.reduceat(length, head) / size
        out[:k, :CLASSES] = counts / width[:, None] * 4
        out[:k, 12] = np.log1p(size) / 3
        out[:k, 13] = mean / 6
        out[:k, 14] = np.sqrt(np.maximum(0, np.add.reduceat(length**2, head) / size - mean**2)) / 4
        out[:k, 15] = np.add.reduceat(same, head, dtype=np.int64) / size * 2
        out[:k, 16] = np.add.reduceat(lag2, head, dtype=np.int64) / size * 2
        out[:k, 17] = distinct / size
        out[:k, 18] = np.add.reduceat(loud, head, dtype=np.int64) / size * 2
        out[:k, 19] = np.add.reduceat(tail == 7, head, dtype=np.int64) / size * 2
        out[:k, 20] = np.add.reduceat(tail == 8, head, dtype=np.int64) / size * 2
        out[:k, 21] = np.add.reduceat(tail == 5, head, dtype=np.int64) / size * 2
    by_row = np.argsort(rows, kind="stable")
    return out[by_row], rows[by_row]


class Model:
    """Gated attention over encoded passages."""

    NAMES = ("W", "b", "V", "U", "a", "c", "d")

    def __init__(self, hidden: int = 24, gate: int = 12, seed: int = 3):
        r = np.random.default_rng(seed)
        g = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.mean, self.scale = np.zeros(N_FEATURES, np.float32), np.ones(N_FEATURES, np.float32)
        self.W, self.b, self.V, self.U, self.a = g(N_FEATURES, hidden), np.zeros(hidden, np.float32), g(hidden, gate), g(hidden, gate), g(gate)
        self.c, self.d = g(hidden), np.zeros(1, np.float32)
        self.trained = False

    def forward(self, x: np.ndarray, first: np.ndarray, bag: np.ndarray):
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ self.W + self.b)
        t, s = np.tanh(h @ self.V), 1 / (1 + np.exp(-(h @ self.U)))
        e = (t * s) @ self.a
        e = np.exp(e - np.maximum.reduceat(e, first)[bag])
        alpha = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(alpha[:, None] * h, first)
        p = 1 / (1 + np.exp(-np.clip(z @ self.c + self.d, -30, 30)))
        return x, h, t, s, alpha, z, p

    def score(self, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """rows: the bag of each passage, ascending, each bag present."""
        first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        if not self.trained:
            return np.full(first.size, 0.5)
        return self.forward(x, first, np.repeat(np.arange(first.size), np.diff(np.append(first, rows.size))))[-1]

    def fit(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 256, rate: float = 0.01, seed: int = 5):
        """x: passages of all bags in order; counts: passages of each bag."""
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        ends = np.cumsum(counts)
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        v = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        step = 0
        for epoch in range(epochs):
            lr = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            for idx in np.array_split(r.permutation(y.size), max(1, y.size // batch)):
                own = counts[idx]
                at = np.concatenate([np.arange(ends[i] - counts[i], ends[i]) for i in idx])
                first = np.append(0, np.cumsum(own)[:-1])
                bag = np.repeat(np.arange(idx.size), own)
                xs, h, t, s, alpha, z, p = self.forward(x[at], first, bag)
                g = (p - y[idx]) / idx.size
                dz = g[:, None] * self.c
                dh = alpha[:, None] * dz[bag]
                da = (h * dz[bag]).sum(1)
                de = alpha * (da - np.add.reduceat(alpha * da, first)[bag])
                du = de[:, None] * self.a
                dt, ds = du * s * (1 - t**2), du * t * s * (1 - s)
                dh = (dh + dt @ self.V.T + ds @ self.U.T) * (1 - h**2)
                grads = {"W": xs.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "a": (t * s).T @ de, "c": z.T @ g, "d": np.array([g.sum()])}
                step += 1
                for k, grad in grads.items():
                    w = getattr(self, k)
                    grad = grad + 1e-4 * w
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad**2
                    setattr(self, k, (w - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32))
        self.trained = True
        return self


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 12_000) -> Model:
    """Fits on at most ``max_rows`` labelled documents that are not held out."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    known = known.dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "doc_id")  # max_rows rows at most

    def run(batches):
        for b in batches:
            data, off = buffers(b.column(0))
            for lo, hi in slices(off, SLICE):
                x, bag = passages(data, off[lo : hi + 1])
                cut = np.flatnonzero(np.append(True, bag[1:] != bag[:-1]))
                yield pa.RecordBatch.from_arrays([b.column(1).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.array([p.astype("<f4").tobytes() for p in np.split(x, cut[1:])], pa.binary())], ["doc_id", "y", "x"])
        release()

    found = rows.select("text", "doc_id", "y").mapInArrow(run, "doc_id bigint, y int, x binary").toArrow().sort_by([("doc_id", "ascending"), ("x", "ascending")])
    model = Model()
    if found.num_rows:
        bags = [np.frombuffer(b.as_py(), "<f4").reshape(-1, N_FEATURES) for b in found["x"]]
        model.fit(np.concatenate(bags), np.array([len(b) for b in bags]), found["y"].to_numpy().astype(np.float32))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every document."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            data, off = buffers(b.column(1))
            for lo, hi in slices(off, SLICE):
                x, rows = passages(data, off[lo : hi + 1])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(model.score(x, rows).astype(np.float64))], ["doc_id", "score"])
        release()

    return docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text").mapInArrow(run, "doc_id bigint, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents scored at ``threshold`` or more, in their own columns."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            data, off = buffers(b.column(at))
            keep = np.concatenate([model.score(*passages(data, off[lo : hi + 1])) >= threshold for lo, hi in slices(off, SLICE)]) if b.num_rows else np.zeros(0, bool)
            yield b.filter(pa.array(keep))
        release()

    return docs.mapInArrow(run, docs.schema)
