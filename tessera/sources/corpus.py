"""The data model: a corpus is a set of DataFrames and a little metadata.

tokens: one row per position: ``pos`` (a global order; positions of different texts are never
neighbours unless they are numbered so), ``text_idx``, ``s_idx``, one string column per attribute,
and, with a tree, ``head_pos depth euler_in euler_out nchildren ndesc sub_min sub_max``.
regions[type]: ``region_idx start_pos end_pos par text_idx`` and one string column per attribute.
groups[type]: ``gid spans props`` for discontinuous annotations. A flat type's region is a column ``<type>_idx``
on tokens, so that looking it up is an equi-join; others are looked up through ``cover(type)``.

Optional: a column ``<type>@<attr>`` of tokens (or of regions that lie in one of the type) is the attribute of the flat region around
them; ``anc`` of regions holds their own number and those of all their ancestors; ``stretch(before, after)`` gives tokens together
with their neighbours' columns (``<column>+<distance>``, null outside of the text). A corpus has it only if positions of
different texts are never neighbours, sentences, heads and flat regions stay in their text, and every token lies in a sentence.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MISSING = "_"
TREE = ("head_pos", "depth", "euler_in", "euler_out", "nchildren", "ndesc", "sub_min", "sub_max")


@dataclass
class Corpus:
    tokens: DataFrame
    attrs: list[str]
    regions: dict[str, DataFrame] = field(default_factory=dict)
    region_attrs: dict[str, list[str]] = field(default_factory=dict)
    modes: dict[str, str] = field(default_factory=dict)
    multivalue: set[str] = field(default_factory=set)
    kv_pipe: set[str] = field(default_factory=set)
    groups: dict[str, DataFrame] = field(default_factory=dict)
    default_within: str = ""
    stretch: Callable[..., DataFrame] | None = None

    @property
    def spark(self) -> SparkSession:
        return self.tokens.sparkSession

    @property
    def has_tree(self) -> bool:
        return "head_pos" in self.tokens.columns

    def flat(self, kind: str) -> bool:
        return f"{kind}_idx" in self.tokens.columns

    def cover(self, kind: str) -> DataFrame:
        """(pos, region_idx): every region of the type that covers a position; zero-width ones cover none."""
        if self.flat(kind):
            return self.tokens.select("pos", F.col(f"{kind}_idx").alias("region_idx")).where("region_idx is not null")
        r = self.regions[kind].where("end_pos >= start_pos")
        return r.select(F.explode(F.sequence("start_pos", "end_pos")).alias("pos"), "region_idx")

    def size(self) -> int:
        return self.tokens.count()

    def size_row(self) -> DataFrame:
        """(size): one row. Texts of a corpus with ``stretch`` hold all its tokens."""
        if self.stretch is not None:
            return self.regions["text"].agg(F.coalesce(F.sum(F.col("end_pos") - F.col("start_pos") + 1), F.lit(0)).alias("size"))
        return self.tokens.agg(F.count(F.lit(1)).alias("size"))

    def split_name(self, name: str) -> tuple[str, str] | None:
        """(type, attribute) of a composite name, cut at the first underscore."""
        kind, _, attr = name.removeprefix("match.").partition("_")
        if attr and kind in self.regions:
            for a in (attr, name):
                if a in self.region_attrs.get(kind, []):
                    return kind, a
        return None

    # ---- storage

    def save(self, path: str) -> None:
        self.tokens.write.mode("overwrite").parquet(f"{path}/tokens")
        for what, tables in (("regions", self.regions), ("groups", self.groups)):
            for name, df in tables.items():
                df.write.mode("overwrite").parquet(f"{path}/{what}_{name}")
        meta = {"attrs": self.attrs, "regions": sorted(self.regions), "region_attrs": self.region_attrs, "modes": self.modes, "multivalue": sorted(self.multivalue), "kv_pipe": sorted(self.kv_pipe), "groups": sorted(self.groups), "default_within": self.default_within}
        self.spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Corpus:
        meta = json.loads(spark.read.text(f"{path}/meta", wholetext=True).first().value)
        read = lambda what, name: spark.read.parquet(f"{path}/{what}_{name}")
        return cls(spark.read.parquet(f"{path}/tokens"), meta["attrs"], {k: read("regions", k) for k in meta["regions"]}, meta["region_attrs"], meta["modes"], set(meta["multivalue"]), set(meta["kv_pipe"]), {k: read("groups", k) for k in meta["groups"]}, meta["default_within"])

    def with_overlay(self, layer: str, name: str, overlay: Corpus) -> Corpus:
        """The corpus with the overlay's attributes, regions and groups under ``overlay-<layer>-<name>``; sizes must agree."""
        if self.size() != overlay.size():
            raise ValueError("an overlay must have the corpus's size")
        prefix = f"overlay-{layer}-{name}".replace("_", "-")
        extra = overlay.tokens.select(F.col("pos").alias("_pos"), *[F.col(a).alias(f"{prefix}-{a}") for a in overlay.attrs])
        tokens = self.tokens.join(extra, F.col("pos") == F.col("_pos"), "left").drop("_pos")
        rename = lambda d: {f"{prefix}-{k}": v for k, v in d.items()}
        return Corpus(tokens, self.attrs + [f"{prefix}-{a}" for a in overlay.attrs], self.regions | rename(overlay.regions), self.region_attrs | rename(overlay.region_attrs), self.modes | rename(overlay.modes), self.multivalue | {f"{prefix}-{a}" for a in overlay.multivalue}, set(self.kv_pipe), self.groups | rename(overlay.groups), self.default_within)

    def check(self) -> DataFrame:
        """(check, failures): what a consistent corpus has none of."""
        t = self.tokens
        rows = [("repeated positions", t.groupBy("pos").count().where("count > 1")), ("null attribute values", t.where(" or ".join(f"`{a}` is null" for a in self.attrs) or "false"))]
        for kind, r in self.regions.items():
            if self.modes.get(kind) != "zerowidth":
                rows.append((f"{kind}: end before start", r.where("end_pos < start_pos")))
            rows.append((f"{kind}: start isn't a position", r.where("end_pos >= start_pos").join(t.select("pos"), F.col("start_pos") == F.col("pos"), "left_anti")))
        if self.has_tree:
            rows.append(("head isn't a position", t.where("head_pos is not null").select("head_pos").join(t.select(F.col("pos").alias("head_pos")), "head_pos", "left_anti")))
        out = None
        for name, df in rows:
            one = df.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("failures"))
            out = one if out is None else out.union(one)
        return out
