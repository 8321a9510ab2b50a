"""Embedding near-dedup: all pairs of one label with cosine >= threshold, by dual traversal of cover trees.

Unit vectors are points at the chord distance sqrt(2 - 2 cos). A block's tree has nested
levels of centres with halving radii; every node keeps its exact covering radius. Two trees
are traversed level by level: a pair of nodes survives if the distance of its centres is at
most both covering radii and the threshold distance together. Surviving pairs of points are checked in
double precision. The traversal is by matrix products over a level's centres.

Equal vectors are one point with a count. A label of at most ``CELL`` points is one block. A
larger one is split by pivots (``PIVOTS`` over all labels, shared in proportion; that many vectors are
broadcast): a point belongs to its nearest pivot and also visits each cell of higher number whose pivot is no
further than its own by more than twice the threshold distance; that loses no pair and meets each once. Cells,
and visitors of cells, are cut into chunks of ``CELL`` points, and each task gets one pair of chunks, so
that no group, however hot, is collected in one task. Tasks return counts and spanning edges, not pairs.

Vectors that are null, zero, hold null, NaN or infinite components or have no label link with nothing. Only
vectors of one length are compared. Repeated rows count as vectors of their own; a vector without id
counts as a link of others, but names no component, and isn't kept. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, connected

THRESHOLD = 0.98
CELL = 8192
PIVOTS = 4096
ROWS = 1024


class CoverTree:
    """Nested levels of centres. levels[k]: (centres, parent of each among the level above, covering radii)."""

    def __init__(self, points: np.ndarray, smallest: float):
        n = len(points)
        centres, parents = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
        owner, distance = np.zeros(n, dtype=np.int64), self.chord(points @ points[0])
        self.points, self.levels, radius = points, [], 2.0
        while True:
            self.levels.append((centres, parents, self.radii(owner, distance, len(centres))))
            radius /= 2
            if radius < smallest or len(centres) == n:
                break
            new_owner, new_distance = np.full(n, -1, dtype=np.int64), np.zeros(n)
            made, above = [], []
            by = np.argsort(owner, kind="stable")
            bounds = np.searchsorted(owner[by], np.arange(len(centres) + 1))
            for node in range(len(centres)):
                left = by[bounds[node] : bounds[node + 1]]
                centre = centres[node]  # nested: a centre stays one on all lower levels
                while len(left):
                    d = self.chord(points[left] @ points[centre])
                    near = d <= radius
                    near |= left == centre
                    new_owner[left[near]], new_distance[left[near]] = len(made), np.where(left[near] == centre, 0.0, d[near])
                    made.append(centre)
                    above.append(node)
                    left = left[~near]
                    if len(left):
                        centre = left[0]
            centres, parents, owner, distance = np.array(made), np.array(above), new_owner, new_distance
        self.owner = owner

    @staticmethod
    def chord(cosine: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * cosine, 0))

    @staticmethod
    def radii(owner, distance, n):
        out = np.zeros(n)
        np.maximum.at(out, owner, distance)
        return out


def dual_pairs(a: CoverTree, b: CoverTree, threshold: float):
    """Blocks of (point of a, point of b) whose cosine is at least the threshold."""
    reach = float(np.sqrt(2 - 2 * threshold)) + 1e-7
    alive = np.ones((1, 1), dtype=bool)
    for k in range(max(len(a.levels), len(b.levels))):
        ca, pa_, ra = a.levels[min(k, len(a.levels) - 1)]
        cb, pb, rb = b.levels[min(k, len(b.levels) - 1)]
        if k >= len(a.levels):
            pa_ = np.arange(len(ca))
        if k >= len(b.levels):
            pb = np.arange(len(cb))
        now = np.zeros((len(ca), len(cb)), dtype=bool)
        for at in range(0, len(ca), ROWS):
            rows = slice(at, at + ROWS)
            was = alive[pa_[rows]]
            cols = np.flatnonzero(was.any(axis=0)[pb])
            if len(cols):
                d = CoverTree.chord(a.points[ca[rows]] @ b.points[cb[cols]].T)
                now[rows][:, cols] = was[:, pb[cols]] & (d <= ra[rows, None] + rb[cols][None, :] + reach)
        alive = now
    by_a, by_b = np.argsort(a.owner, kind="stable"), np.argsort(b.owner, kind="stable")
    start_a = np.searchsorted(a.owner[by_a], np.arange(len(alive) + 1))
    for at in range(0, len(alive), ROWS):
        part = alive[at : at + ROWS]
        cols = part.any(axis=0)
        if not cols.any():
            continue
        left = by_a[start_a[at] : start_a[min(at + ROWS, len(alive))]]
        right = by_b[cols[b.owner[by_b]]]
        for i in range(0, len(left), ROWS):
            x = left[i : i + ROWS]
            for j in range(0, len(right), 4 * ROWS):
                y = right[j : j + 4 * ROWS]
                u, v = np.nonzero((a.points[x] @ b.points[y].T >= threshold - 1e-9) & alive[a.owner[x]][:, b.owner[y]])
                if len(u):
                    yield x[u], y[v]


def cosines(raw_a, raw_b) -> np.ndarray:
    dot = np.einsum("ij,ij->i", raw_a, raw_b)
    return dot / (np.sqrt(np.einsum("ij,ij->i", raw_a, raw_a)) * np.sqrt(np.einsum("ij,ij->i", raw_b, raw_b)))


def unit(raw: np.ndarray) -> np.ndarray:
    big = np.abs(raw).max(axis=1, keepdims=True)
    scaled = raw / big
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def joined(root: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The smallest row of each row's component after the links (p, q), by array operations only."""
    while True:
        a, b = root[p], root[q]
        apart = a != b
        if not apart.any():
            return root
        p, q, low, high = p[apart], q[apart], np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        np.minimum.at(root, high, low)
        while True:  # every row hangs under its root again
            up = root[root]
            if (up == root).all():
                break
            root = up


def block_links(ids: np.ndarray, counts: np.ndarray, raw: np.ndarray, side: np.ndarray, within: bool, threshold: float):
    """(id, linked vectors, id of a neighbour) of a task's points: pairs within them, or across sides 0 and 1."""
    x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if within:
        y = x
    links = np.zeros(len(ids), dtype=np.int64)
    root = np.arange(len(ids))

    if len(x) and len(y):
        points = unit(raw)
        smallest = np.sqrt(2 - 2 * threshold) / 2
        ta = CoverTree(points[x], smallest)
        tb = ta if within else CoverTree(points[y], smallest)
        for u, v in dual_pairs(ta, tb, threshold):
            p, q = x[u], y[v]
            if within:
                p, q = p[u < v], q[u < v]
            ok = cosines(raw[p], raw[q]) >= threshold
            p, q = p[ok], q[ok]
            links += np.bincount(p, weights=counts[q], minlength=len(ids)).astype(np.int64) + np.bincount(q, weights=counts[p], minlength=len(ids)).astype(np.int64)
            root = joined(root, p, q)
    some = np.flatnonzero(links)
    return ids[some], links[some], ids[root[some]]


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, cell: int = CELL, pivots: int = PIVOTS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    spark = vectors.sparkSession
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"), F.col("label").cast("string").alias("label"))
    good = F.col("label").isNotNull() & F.col("e").isNotNull() & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0)
    v = v.withColumn("good", F.coalesce(good, F.lit(False)))
    members = v.where("good").select("vec_id", F.concat_ws("/", F.size("e").cast("string"), "label").alias("grp"), "e")
    points = checkpoint(members.groupBy("grp", "e").agg(F.min(F.coalesce("vec_id", F.lit(2**63 - 1))).alias("rep"), F.count(F.lit(1)).alias("n")).withColumn("key", F.xxhash64("grp", "e")))
    sizes = points.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    large = sizes.where(F.col("size") > cell)
    total = large.agg(F.sum("size")).first()[0] or 0
    if total:
        # of each large group its share of the pivots: the points with the smallest keys, about
        share = F.least(F.lit(1.0), F.lit(float(min(pivots, 2 * total // cell))) / F.lit(float(total)))
        drawn = points.join(large.select("grp"), "grp", "left_semi").where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < share * (1 << 30)).orderBy("key", "rep").limit(2 * pivots)
        table: dict[str, list] = {}
        for r in drawn.select("grp", "e").toLocalIterator():
            table.setdefault(r.grp, []).append(r.e)
        shared = spark.sparkContext.broadcast({g: unit(np.array(x, dtype=np.float64)) for g, x in table.items()})
        reach = float(np.sqrt(2 - 2 * threshold)) + 1e-7

        def assign(frames):
            for f in frames:
                out = []
                for g, part in f.groupby("grp", sort=False):
                    if g not in shared.value:
                        out.append(part.assign(cell=0, visits=False))
                        continue
                    p = shared.value[g]
                    for at in range(0, len(part), 2048):
                        some = part.iloc[at : at + 2048]
                        d = CoverTree.chord(unit(np.array(some.e.tolist(), dtype=np.float64)) @ p.T)
                        home = d.argmin(axis=1)
                        out.append(some.assign(cell=home, visits=False))
                        near = (d <= d.min(axis=1)[:, None] + 2 * reach) & (np.arange(len(p))[None, :] > home[:, None])
                        r, c = np.nonzero(near)
                        out.append(some.iloc[r].assign(cell=c, visits=True))
                yield pd.concat(out)[["grp", "e", "rep", "n", "key", "cell", "visits"]] if out else pd.DataFrame({k: [] for k in ["grp", "e", "rep", "n", "key", "cell", "visits"]})

        placed = checkpoint(points.mapInPandas(assign, "grp string, e array<double>, rep long, n long, key long, cell int, visits boolean"))
    else:
        placed = points.withColumns({"cell": F.lit(0), "visits": F.lit(False)})
    chunks = placed.groupBy("grp", "cell").agg(F.ceil(F.sum(F.when(F.col("visits"), 0).otherwise(1)) / cell).cast("int").alias("homes"), F.ceil(F.sum(F.when(F.col("visits"), 1).otherwise(0)) / cell).cast("int").alias("guests"))
    p = placed.join(chunks, ["grp", "cell"])
    p = p.withColumn("chunk", F.pmod("key", F.greatest(F.when(F.col("visits"), F.col("guests")).otherwise(F.col("homes")), F.lit(1))).cast("int"))
    first_n = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    task = lambda kind, a, b, side: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), side.alias("side"))
    chunk = F.col("chunk")
    inside = F.transform(first_n(F.col("homes")), lambda o: task("h", F.least(chunk, o), F.greatest(chunk, o), (chunk > o).cast("int")))
    across = F.transform(first_n(F.col("guests")), lambda o: task("v", chunk, o, F.lit(0)))
    visiting = F.transform(first_n(F.col("homes")), lambda o: task("v", o, chunk, F.lit(1)))
    tasks = p.select("grp", "cell", "e", "rep", "n", F.explode(F.when(F.col("visits"), visiting).otherwise(F.concat(inside, across))).alias("t"))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        i, links, other = block_links(f.rep.to_numpy(), f.n.to_numpy(dtype=np.float64), np.array(f.e.tolist(), dtype=np.float64), f.side.to_numpy(), f.kind.iat[0] == "h" and f.a.iat[0] == f.b.iat[0], threshold)
        return pd.DataFrame({"rep": i, "links": links, "other": other})

    found = checkpoint(tasks.select("grp", "cell", "t.kind", "t.a", "t.b", "t.side", "e", "rep", "n").groupBy("grp", "cell", "kind", "a", "b").applyInPandas(run, "rep long, links long, other long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = connected(found, "rep", "other")
    known = points.join(links, "rep", "left").join(comp, F.col("rep") == F.col("node"), "left")
    known = known.select("grp", "e", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = members.join(known, ["grp", "e"]).select("vec_id", F.col("n_links").cast("long").alias("n_links"), F.when(F.col("component_id") < 2**63 - 1, F.col("component_id")).alias("component_id"))
    out = out.union(v.where("not good").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


ORACLE = """
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98
), reach(a, b) as (
  select vec_id, vec_id from embeddings union select reach.a, links.b from reach join links on reach.b = links.a
), comp as (select a, min(b) as component_id from reach group by a),
n as (select a, count(*) as n_links from links group by a)
select vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from embeddings join comp on comp.a = vec_id left join n on n.a = vec_id
"""
