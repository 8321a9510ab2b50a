"""Derived structure: tree numbers of sentences, parents of nested regions, structure modes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TREE_TYPES = "depth long, euler_in long, euler_out long, nchildren long, ndesc long, sub_min long, sub_max long"


def tree_numbers(heads: list[int]) -> list[tuple]:
    """(depth, euler in, euler out, children, descendants, smallest and largest index below) per token; heads: -1 is a root.

    Children are visited in order. Tokens that no root reaches (a cycle) get depth -1 and no children.
    """
    n = len(heads)
    children: list[list[int]] = [[] for _ in range(n)]
    for i, h in enumerate(heads):
        if 0 <= h < n and h != i:
            children[h].append(i)
    out = [[-1, 0, 0, 0, 0, i, i] for i in range(n)]
    clock = 0
    for root in (i for i, h in enumerate(heads) if not 0 <= h < n or h == i):
        stack = [(root, 0, iter(children[root]))]
        out[root][0], out[root][1] = 0, clock
        clock += 1
        while stack:
            node, depth, rest = stack[-1]
            child = next(rest, None)
            if child is None:
                stack.pop()
                out[node][2] = clock
                clock += 1
                out[node][3] = len(children[node])
                out[node][4] = (out[node][2] - out[node][1] - 1) // 2
                if stack:
                    up = out[stack[-1][0]]
                    up[5], up[6] = min(up[5], out[node][5]), max(up[6], out[node][6])
            else:
                out[child][0], out[child][1] = depth + 1, clock
                clock += 1
                stack.append((child, depth + 1, iter(children[child])))
    return [tuple(x) for x in out]


def with_tree(tokens: DataFrame) -> DataFrame:
    """Adds the tree's columns to tokens with ``s_idx`` and ``head_pos``; grouped by text, so groups aren't tiny.

    A text is worked on in one task, sentence by sentence.
    """
    names = ["depth", "euler_in", "euler_out", "nchildren", "ndesc", "sub_min", "sub_max"]

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("pos")
        parts = []
        for _, s in f.groupby("s_idx", sort=False, dropna=False):
            at = {p: i for i, p in enumerate(s.pos)}
            pos = s.pos.tolist()
            rows = tree_numbers([-1 if pd.isna(h) else at.get(int(h), -1) for h in s.head_pos])
            rows = [(*r[:5], pos[r[5]], pos[r[6]]) for r in rows]
            parts.append(pd.DataFrame(rows, columns=names).assign(_pos=pos))
        return pd.concat(parts)

    numbers = tokens.select("text_idx", "s_idx", "pos", "head_pos").groupBy("text_idx").applyInPandas(run, TREE_TYPES + ", _pos long")
    return tokens.join(numbers, F.col("pos") == F.col("_pos")).drop("_pos")


def with_parents(regions: DataFrame) -> DataFrame:
    """Sets ``par``: the smallest region of the table that strictly contains a region; null without one or if two tie.

    The interval join is within a text (equi-key text_idx).
    """
    r = regions.drop("par")
    a, b = r.alias("a"), r.alias("b")
    inside = (F.col("a.text_idx") == F.col("b.text_idx")) & (F.col("b.start_pos") <= F.col("a.start_pos")) & (F.col("b.end_pos") >= F.col("a.end_pos")) & ((F.col("b.end_pos") - F.col("b.start_pos")) > (F.col("a.end_pos") - F.col("a.start_pos")))
    pairs = a.join(b, inside).select(F.col("a.region_idx").alias("child"), F.col("b.region_idx").alias("up"), (F.col("b.end_pos") - F.col("b.start_pos")).alias("span"))
    least = pairs.groupBy("child").agg(F.min(F.struct("span", "up")).alias("m"), F.min("span").alias("least"))
    ties = pairs.join(least, "child").where("span = least").groupBy("child").agg(F.count(F.lit(1)).alias("n"), F.min("up").alias("par")).select("child", F.when(F.col("n") == 1, F.col("par")).alias("par"))
    return r.join(ties, F.col("region_idx") == F.col("child"), "left").drop("child")


def mode_of(regions: DataFrame) -> DataFrame:
    """One row (overlapping, nested, zerowidth): numbers of regions that cross the ones before, lie in them, or are empty."""
    before = W.partitionBy("text_idx").orderBy("start_pos", F.desc("end_pos")).rowsBetween(W.unboundedPreceding, -1)
    r = regions.withColumn("reach", F.max(F.when(F.col("end_pos") >= F.col("start_pos"), F.col("end_pos"))).over(before))
    return r.agg(
        F.count(F.when((F.col("reach") >= F.col("start_pos")) & (F.col("reach") < F.col("end_pos")), 1)).alias("overlapping"),
        F.count(F.when((F.col("reach") >= F.col("end_pos")) & (F.col("end_pos") >= F.col("start_pos")), 1)).alias("nested"),
        F.count(F.when(F.col("end_pos") < F.col("start_pos"), 1)).alias("zerowidth"),
    )
