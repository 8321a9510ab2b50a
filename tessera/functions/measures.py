"""Association and keyness measures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MEASURES = ("logdice", "mi", "mi3", "t", "tscore", "ll", "dice")


def association(name: str, obs: Column, node: Column, freq: Column, size: Column) -> Column:
    """obs: co-occurrences; node: window positions counted; freq: corpus frequency of the collocate; size: tokens."""
    obs, node, freq, size = (x.cast("double") for x in (obs, node, freq, size))
    expected = node * freq / size
    if name == "dice":
        return 2 * obs / (node + freq)
    if name == "logdice":
        return 14 + F.log2(2 * obs / (node + freq))
    if name == "mi":
        return F.log2(obs / expected)
    if name == "mi3":
        return F.log2(obs * obs * obs / expected)
    if name in ("t", "tscore"):
        return (obs - expected) / F.sqrt(obs)
    if name == "ll":
        cells = [(obs, expected), (node - obs, node * (size - freq) / size), (freq - obs, (size - node) * freq / size), (size - node - freq + obs, (size - node) * (size - freq) / size)]
        return 2 * sum((F.when((o > 0) & (e > 0), o * F.log(o / e)).otherwise(F.lit(0.0)) for o, e in cells), F.lit(0.0))
    raise ValueError(f"unknown measure {name}")


def keyness(focus: Column, ref: Column, n_focus: Column, n_ref: Column) -> Column:
    """Signed G2: negative where the focus has fewer than expected."""
    a, b, n1, n2 = (x.cast("double") for x in (focus, ref, n_focus, n_ref))
    e1, e2 = n1 * (a + b) / (n1 + n2), n2 * (a + b) / (n1 + n2)
    g2 = 2 * (F.when(a > 0, a * F.log(a / e1)).otherwise(F.lit(0.0)) + F.when(b > 0, b * F.log(b / e2)).otherwise(F.lit(0.0)))
    return F.when(a < e1, -g2).otherwise(g2)
