"""Quality classifier: similarity-weighted votes of the nearest labelled latent-semantic vectors.

Texts become counts of hashed byte unigrams, bigrams and trigrams and the share of words that
repeat the word before (whole texts, by array operations on the bytes), Hellinger-scaled and weighted by inverse document frequency over all
documents. A singular value decomposition of the labelled sample gives the latent space. At
most ``SAMPLE`` labelled vectors (half of each label where there are enough, chosen by a hash
of the id) are broadcast: 4,096 x 64 floats. Every document's cosines with all of them are
matrix products by blocks, exact over the sample; the ``NEIGHBOURS`` largest vote with their similarity,
each label re-weighted from its share of the sample to its share of all learnable labels.

Only rows whose crc32(doc_id) mod 5 isn't 0 are learnt from; labels, lang, source and ids are
not inputs of a score. Edge cases: null is an empty text; a text without a vector (empty) and a table without
labels score the learnt share of label 1 (0.5 without any label); labels of unknown documents
and null labels are ignored, of repeated labels one is taken; repeated documents each give a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, checkpoint, fold, fold_of, nonspace_class, segment_sums, word_bounds, word_hashes

FOLDS = 5
SAMPLE = 4096
DIMENSIONS = 64
NEIGHBOURS = 15
THRESHOLD = 0.3
BUCKETS = 2048
FEATURES = 256 + BUCKETS + 1
#: How much the bytes of words that repeat the word before them count.
REPEATS = 16
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
WORDS = nonspace_class()
_FILL = 1 << 18
#: The most that an eigenpair's residual may be of the least eigenvalue in the latent space.
EXACT = 1e-7


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Counts of byte n-grams inside each text, and bytes of repeated words: texts x FEATURES."""
    n = len(offs) - 1
    out = np.zeros((n, FEATURES), dtype=np.float32)
    starts, ends, first = word_bounds(data, offs, WORDS)
    h = word_hashes(data, starts, ends)
    again = np.zeros(len(h), dtype=np.int64)
    if len(h):
        again[1:] = np.where(h[1:] == h[:-1], (ends - starts)[1:], 0)
        again[first[first < len(h)]] = 0
    out[:, -1] = segment_sums(again, first) * REPEATS
    for d in range(n):
        b = data[offs[d] : offs[d + 1]]
        if not len(b):
            continue
        own = out[d]
        for at in range(0, len(b), _FILL):  # pieces overlap by two bytes, so that no n-gram is lost
            c = b[at : at + _FILL + 2].astype(np.uint32)
            own[:256] += np.bincount(c[:_FILL], minlength=256)
            if len(c) > 1:
                two = (c[:-1] * np.uint32(0x9E3779B1)) ^ (c[1:] * np.uint32(0x85EBCA6B))
                own[256:-1] += np.bincount((two[:_FILL] * np.uint32(0xC2B2AE35)) >> np.uint32(21), minlength=BUCKETS)
                if len(c) > 2:
                    three = two[:-1] * np.uint32(0x27D4EB2F) + c[2:] * np.uint32(0x165667B1)
                    own[256:-1] += np.bincount((three[:_FILL] * np.uint32(0xC2B2AE35)) >> np.uint32(21), minlength=BUCKETS)
    return out


def feature_blocks(array: pa.Array):
    for i, j, data, offs in blocks(array):
        for k in range(0, j - i, 512):
            part = offs[k : min(k + 512, j - i) + 1]
            yield i + k, i + k + len(part) - 1, features(data[part[0] : part[-1]], part - part[0])


def scaled(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    total = counts[:, :256].sum(axis=1, keepdims=True)
    return np.sqrt(counts / np.maximum(total, 1)) * idf


def document_frequencies(documents: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each feature occurs, and the number of documents; FEATURES rows reach the driver."""

    def run(batches):
        df, n = np.zeros(FEATURES + 1, dtype=np.int64), 0
        for batch in batches:
            for i, j, counts in feature_blocks(batch.column(0)):
                df[:-1] += np.count_nonzero(counts, axis=0)
            n += batch.num_rows
        df[-1] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1)), pa.array(df)], ["f", "n"])

    rows = documents.select("text").mapInArrow(run, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(FEATURES + 1, dtype=np.int64)
    df[rows.f.to_numpy()] = rows.n.to_numpy()
    return df[:-1], int(df[-1])


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, folds: int, bound: int):
    """Texts of at most ``bound`` learnable labelled rows, half of each value where there are
    enough, and the learnable rows of each value. The ids (``bound`` at most) are broadcast."""
    rows = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)").where(fold("id", folds) != 0)
    rows = rows.groupBy("id").agg(F.max("y").alias("y"))
    shares = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    room = {y: min(shares.get(y, 0), max(bound // 2, bound - shares.get(1 - y, 0))) for y in (0, 1)}
    picked = None
    for y in (0, 1):
        part = rows.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(room[y])
        picked = part if picked is None else picked.union(part)
    d = documents.select(F.col("doc_id").cast("long").alias("id"), "text")
    # repeated ids: one row of each
    found = d.join(F.broadcast(picked), "id").groupBy("id").agg(F.max("y").alias("y"), F.min("text").alias("text"))
    return checkpoint(found), shares


def fit(documents: DataFrame, labels: DataFrame, folds: int = FOLDS, bound: int = SAMPLE):
    """The model. The sample's features and the decomposition stay in one task; the driver gets the basis and the vectors."""
    df, n = document_frequencies(documents)
    idf = np.log((n + 1) / (df + 1)).astype(np.float32) + np.float32(0.1)
    sample, shares = labelled_sample(documents, labels, "quality", folds, bound)

    def run(batches):
        x, y, n = np.empty((bound, FEATURES), dtype=np.float32), np.empty(bound, dtype=np.int64), 0  # pages are taken as rows come
        for batch in batches:
            for i, j, counts in feature_blocks(batch.column(1)):
                some = counts.any(axis=1)
                at = slice(n, n + np.count_nonzero(some))
                x[at] = scaled(counts[some], idf)
                y[at] = batch.column(0)[i:j].to_numpy()[some]
                n = at.stop
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (*latent(x[:n]), y[:n])], ["basis", "vectors", "y"])

    got = sample.select("y", "text", "id").coalesce(1).mapInArrow(run, "basis binary, vectors binary, y binary").collect()
    total = sum(shares.values())
    prior = shares.get(1, 0) / total if total else 0.5
    y = np.frombuffer(got[0].y, dtype=np.int64) if got else np.zeros(0, dtype=np.int64)
    if not len(y):
        return {"prior": prior, "idf": idf, "vectors": None}
    basis = np.frombuffer(got[0].basis, dtype=np.float32).reshape(FEATURES, -1)
    vectors = np.frombuffer(got[0].vectors, dtype=np.float32).reshape(len(y), -1)
    weight = np.array([(shares.get(v, 0) / total) / max(1, np.count_nonzero(y == v)) * len(y) for v in (0, 1)], dtype=np.float32)
    return {"prior": prior, "idf": idf, "basis": basis, "vectors": vectors, "y": y, "weight": weight[y]}


def latent(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The basis of the latent space, and the rows' vectors in it.

    Block Lanczos with full orthogonalisation, without the matrix x.T @ x: the Krylov space of a block as wide as the basis grows until
    the largest eigenpairs have residuals of at most ``EXACT`` of the least of them, or until it is invariant, which holds them exactly.
    """
    columns = x.shape[1]
    q = np.linalg.qr(np.random.default_rng(7).standard_normal((columns, min(DIMENSIONS, columns))))[0]
    space, image = np.zeros((columns, 0)), np.zeros((columns, 0))
    while True:
        product = np.zeros_like(q)
        for at in range(0, len(x), 256):
            part = x[at : at + 256].astype(np.float64)
            product += part.T @ (part @ q)
        space, image = np.hstack((space, q)), np.hstack((image, product))
        values, inner = np.linalg.eigh(space.T @ image)
        inner = inner[:, ::-1][:, :DIMENSIONS]
        basis = space @ inner
        residuals = np.linalg.norm(image @ inner - basis * values[::-1][:DIMENSIONS], axis=0)
        if space.shape[1] >= columns or residuals.max() <= EXACT * max(values[::-1][:DIMENSIONS][-1], 1e-12 * values[-1]):
            break
        for _ in range(2):
            product -= space @ (space.T @ product)
        # what is left of the block, without directions that are rounding only
        u, left, _ = np.linalg.svd(product, full_matrices=False)
        q = u[:, left > 1e-12 * values[-1]][:, : columns - space.shape[1]]
        q = np.linalg.qr(q - space @ (space.T @ q))[0]
        if not q.shape[1]:
            break
    basis = np.ascontiguousarray(basis, dtype=np.float32)
    vectors = x @ basis
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    return basis, vectors


def vote(counts: np.ndarray, model) -> np.ndarray:
    """Share of label 1 among the nearest labelled vectors, weighted by similarity."""
    score = np.full(len(counts), model["prior"])
    if model["vectors"] is None:
        return score
    z = scaled(counts, model["idf"]).astype(np.float32) @ model["basis"]
    norm = np.linalg.norm(z, axis=1)
    cosines = (z / np.maximum(norm, 1e-12)[:, None]) @ model["vectors"].T
    k = min(NEIGHBOURS, cosines.shape[1])
    near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
    w = np.maximum(np.take_along_axis(cosines, near, axis=1), 0).astype(np.float64) ** 4 * model["weight"][near]
    total = w.sum(axis=1)
    ok = (norm > 0) & (total > 0)
    score[ok] = (w * model["y"][near]).sum(axis=1)[ok] / total[ok]
    return np.clip(score, 0.0, 1.0)


def _scores(array: pa.Array, model) -> np.ndarray:
    out = np.zeros(len(array))
    for i, j, counts in feature_blocks(array):
        out[i:j] = vote(counts, model)
    return out


def classify(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    shared = documents.sparkSession.sparkContext.broadcast(fit(documents, labels))

    def run(batches):
        for batch in batches:
            score = _scores(batch.column(1), shared.value)
            held = [None if x is None else fold_of(x, FOLDS) == 0 for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.bool_()), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least the threshold, with their columns."""
    shared = documents.sparkSession.sparkContext.broadcast(fit(documents, labels))
    at = documents.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(at), shared.value) >= threshold))

    return documents.mapInArrow(run, documents.schema)
