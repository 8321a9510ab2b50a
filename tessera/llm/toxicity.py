"""Toxicity: cumulative-link ordinal regression over sparse text features.

P(grade <= k) = sigmoid(cut_k - w.x): one weight vector shared by all ordered cuts. x holds
log(1 + count) of a text's words and of its words' beginnings (``PREFIXES`` bytes), hashed; whole
texts count. Of the hashed features those ``FEATURES`` that tell the two labels apart best in the
sample (absolute z value of their document frequencies) are kept. The fit uses at most ``SAMPLE`` labelled rows
(half of each label where there are enough, by a hash of the id), weighted back to the labels' shares
among all learnable rows; scoring is a map over all documents with ``FEATURES`` weights broadcast.

``labels`` marks toxic rows with 0 or 1. Ordered grades are derived from it: 0 for 0; for 1,
grades 1 to ``GRADES`` by equal parts of the share of a text's words that are indicative
(strongly tied to the label) among the sample's toxic rows. ``fit`` itself takes any ordered grades.

Edge cases: null is an empty text; empty texts have the intercepts' severity; without rows of both labels the
severity is the share of label 1; null and repeated labels and labels of unknown documents as in the
quality classifier; repeated documents each give a row; rows with crc32(doc_id) mod 5 = 0 are never learnt from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _VALUES, LOWER, _power, alnum_class, blocks, fold_of, mix, word_bounds
from .quality import labelled_sample

FOLDS = 5
SAMPLE = 16_384
FEATURES = 4096
GRADES = 3
PREFIXES = (4, 6, 8)
BITS = 20
LEAST = 3  # documents of the sample that a feature needs
SCHEMA = "doc_id long, held_out boolean, severity double, p_toxic double, grade int, toxic boolean"
LUT = alnum_class()


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Feature numbers of each word: itself, then its beginnings: len(PREFIXES) + 1 rows."""
    power, inverse = _power(len(data) + 1)
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_VALUES[LOWER][data] * power[: len(data)], out=sums[1:])
    rows = []
    for k, size in enumerate((None, *PREFIXES)):
        stop = ends if size is None else np.minimum(starts + size, ends)
        h = mix((sums[stop] - sums[starts]) * inverse[starts] + np.uint64(k + 1))
        rows.append((h >> np.uint64(64 - BITS)).astype(np.int64))
    return np.array(rows)


def counted(array: pa.Array, chosen: np.ndarray | None = None):
    """(first row, rows, doc, feature, count) by block: each document's distinct features;
    chosen: sorted feature numbers, whose places are then the features."""
    table = None
    if chosen is not None:
        table = np.full(1 << BITS, -1, dtype=np.int64)
        table[chosen] = np.arange(len(chosen))
    for i, j, data, offs in blocks(array):
        starts, ends, first = word_bounds(data, offs, LUT)
        f = hashed(data, starts, ends)
        doc = np.repeat(np.arange(j - i), np.diff(first))
        doc = np.broadcast_to(doc, f.shape).ravel()
        f = f.ravel()
        if table is not None:
            f = table[f]
            doc, f = doc[f >= 0], f[f >= 0]
        key, n = np.unique((doc << BITS) | f, return_counts=True)
        yield i, j - i, key >> BITS, key & ((1 << BITS) - 1), n, np.diff(first)


def select_features(sample: DataFrame, n0: int, n1: int):
    """The feature numbers that separate the labels best, sorted, and those that are indicative of label 1."""

    def run(batches):
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            df = np.zeros((2, 1 << BITS), dtype=np.int32)
            for i, _, doc, f, _, _ in counted(batch.column(1)):
                label = y[i + doc]
                for v in (0, 1):
                    df[v] += np.bincount(f[label == v], minlength=1 << BITS).astype(np.int32)
            some = np.flatnonzero(df.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[0][some]), pa.array(df[1][some])], ["f", "d0", "d1"])

    rows = sample.select("y", "text").mapInArrow(run, "f long, d0 int, d1 int").groupBy("f").agg(F.sum("d0").alias("d0"), F.sum("d1").alias("d1"))
    p0, p1 = F.col("d0") / max(n0, 1), F.col("d1") / max(n1, 1)
    both = (F.col("d0") + F.col("d1")) / max(n0 + n1, 1)
    z = (p1 - p0) / F.sqrt(both * (1 - both) * (1 / max(n0, 1) + 1 / max(n1, 1)) + F.lit(1e-9))
    best = rows.where(F.col("d0") + F.col("d1") >= LEAST).withColumn("z", z).orderBy(F.abs("z").desc(), "f").limit(FEATURES).select("f", "d0", "d1", "z").toPandas().sort_values("f")
    strong = (best.z > 5) & (best.d1 / max(n1, 1) > 20 * best.d0 / max(n0, 1))
    return best.f.to_numpy(dtype=np.int64), strong.to_numpy(dtype=bool)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, weights: np.ndarray, n_features: int, n_grades: int, steps: int = 400, l2: float = 2e-4):
    """Shared weights and ascending cuts of a cumulative-link model, by Adam on the weighted likelihood.

    rows, cols, values: the sparse features of len(grades) texts; grades: 0 to n_grades.
    """
    w = np.zeros(n_features)
    share = np.array([weights[grades <= k].sum() for k in range(n_grades)]) / weights.sum()
    share = np.clip(share, 1e-4, 1 - 1e-4)
    cuts = np.log(share / (1 - share))
    first, gaps = cuts[0], np.log(np.maximum(np.diff(cuts), 1e-2))
    theta = np.concatenate((w, [first], gaps))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    scale = weights / weights.sum()
    for t in range(1, steps + 1):
        w, first, gaps = theta[:n_features], theta[n_features], theta[n_features + 1 :]
        cuts = first + np.concatenate(([0], np.cumsum(np.exp(gaps))))
        edges = np.concatenate(([-np.inf], cuts, [np.inf]))
        eta = np.bincount(rows, weights=values * w[cols], minlength=len(grades))
        up, low = sigmoid(edges[grades + 1] - eta), sigmoid(edges[grades] - eta)
        p = np.maximum(up - low, 1e-12)
        du, dl = up * (1 - up) / p, low * (1 - low) / p
        g_eta = scale * (du - dl)  # of the negative log likelihood
        g_w = np.bincount(cols, weights=values * g_eta[rows], minlength=n_features) + l2 * w
        g_cuts = np.array([-(scale * du)[grades == k].sum() + (scale * dl)[grades == k + 1].sum() for k in range(n_grades)])
        g_gaps = np.array([g_cuts[k + 1 :].sum() * np.exp(gaps[k]) for k in range(n_grades - 1)])
        g = np.concatenate((g_w, [g_cuts.sum()], g_gaps))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - 0.05 * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    w, first, gaps = theta[:n_features], theta[n_features], theta[n_features + 1 :]
    return w, first + np.concatenate(([0], np.cumsum(np.exp(gaps))))


def model_of(documents: DataFrame, labels: DataFrame):
    sample, shares = labelled_sample(documents, labels, "toxic", FOLDS, SAMPLE)
    sizes = {r.y: r.n for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(shares.values())
    prior = shares.get(1, 0) / total if total else 0.0
    if not sizes.get(0) or not sizes.get(1):
        return {"chosen": None, "prior": prior}
    chosen, strong = select_features(sample, sizes[0], sizes[1])

    def run(batches):
        for batch in batches:
            for i, n, doc, f, c, words in counted(batch.column(1), chosen):
                at = np.searchsorted(doc, np.arange(n + 1))
                lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (f, c)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i : i + n], *lists, pa.array(words)], ["y", "f", "c", "words"])

    got = sample.select("y", "text", "id").mapInArrow(run, "y int, f array<int>, c array<int>, words long").toPandas()
    y = got.y.to_numpy(dtype=np.int64)
    rows = np.repeat(np.arange(len(y)), got.f.str.len().to_numpy(dtype=np.int64))
    cols = np.concatenate([np.asarray(x, dtype=np.int64) for x in got.f]) if len(got) else np.zeros(0, np.int64)
    counts = np.concatenate([np.asarray(x, dtype=np.float64) for x in got.c]) if len(got) else np.zeros(0)
    density = np.bincount(rows, weights=counts * strong[cols], minlength=len(y)) / np.maximum(got.words.to_numpy(), 1)
    grades = np.zeros(len(y), dtype=np.int64)
    at = np.flatnonzero(y == 1)
    by = at[np.argsort(density[at], kind="stable")]
    grades[by] = 1 + np.arange(len(by)) * GRADES // len(by)
    weight = np.array([shares[v] / total / sizes[v] for v in (0, 1)])[y]
    w, cuts = fit(rows, cols, np.log1p(counts), grades, weight, len(chosen), GRADES)
    return {"chosen": chosen, "w": w, "cuts": cuts, "prior": prior}


def score(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Expected severity (0 to GRADES), P(grade > 0), the likeliest grade and whether P > 1/2, for every document."""
    shared = documents.sparkSession.sparkContext.broadcast(model_of(documents, labels))

    def run(batches):
        model = shared.value
        for batch in batches:
            n = batch.num_rows
            if model["chosen"] is None:
                above = np.zeros((n, GRADES))
                above[:, 0] = model["prior"]
            else:
                eta = np.zeros(n)
                for i, k, doc, f, c, _ in counted(batch.column(1), model["chosen"]):
                    eta[i : i + k] = np.bincount(doc, weights=np.log1p(c) * model["w"][f], minlength=k)
                above = sigmoid(eta[:, None] - model["cuts"][None, :])  # P(grade > k)
            probability = -np.diff(np.concatenate((np.ones((n, 1)), above, np.zeros((n, 1))), axis=1))
            held = [None if x is None else fold_of(x, FOLDS) == 0 for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(held, pa.bool_()), pa.array(above.sum(axis=1)), pa.array(above[:, 0].copy()), pa.array(probability.argmax(axis=1).astype(np.int32)), pa.array(above[:, 0] > 0.5)],
                ["doc_id", "held_out", "severity", "p_toxic", "grade", "toxic"],
            )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
