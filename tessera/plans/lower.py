"""Lowering of queries to DataFrames.

A match is a row: ``s<i>``, ``e<i>`` (first and last position of slot i, null where an optional slot is
skipped or a negated relation leaves it open), ``lo``, ``hi`` (extent), for labelled region anchors
``r<i> rs<i> re<i> rp<i>`` (row, start, end, parent), for subtrees ``sub<i>``, for groups ``gid`` ``members`` ``props``.
Names that begin with ``_`` are carried along: ``_v<i>_<column>`` are the columns of the token of slot i, ``_r<i>_<column>`` those
of an anchor's region. Values are read from them instead of being looked up by position; those that nobody reads cost nothing.

Each slot's tokens are filtered before they join, so only candidates are shuffled. Adjacent single tokens are read off one scan
where the corpus has ``stretch``, else adjacency is an equi-join on ``position + 1`` (with the scope's region, where it is flat);
tree relations are equi-joins on the head or on the sentence with Euler numbers; covering regions are carried or equi-joins on
``<type>_idx``, nested ones equi-joins on cells of positions (only for the positions asked for). Existence
conditions are semi and anti joins, inside an ``|`` a flag joined by key.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar
from ..sources.corpus import Corpus
from .language import Both, Call, Containing, CountRelated, CountValues, Either, Everything, Filter, Parallel, Query, QueryError, Related, Scope, Slot, Test

_numbers = itertools.count()
CELL_BITS = 6
PAIRS_MOST = 2_000_000  # pairs under one key beyond which its rows meet in several cells


def fresh(stem: str = "x") -> str:
    return f"_{stem}{next(_numbers)}"


@dataclass
class Matches:
    """A set of matches: the rows and what the labels mean. labels[name] = (kind, slot number, region type)."""

    df: DataFrame
    labels: dict[str, tuple] = field(default_factory=dict)
    slots: int = 0
    group: str = ""
    target: Matches | None = None
    # (before, after, attr): the same rows with ``_c<distance>_<attr>`` of the tokens around, by distance from the first one
    context: Callable | None = None


@dataclass
class Options:
    binding: str = "fanout"
    empty_alignment: bool = False
    max_gap: int = 100


class Lowering:
    def __init__(self, corpus: Corpus, options: Options | None = None, named: dict[str, Matches] | None = None):
        self.c, self.o, self.named = corpus, options or Options(), named if named is not None else {}
        self.t = corpus.tokens

    # ---- names and values

    @functools.cached_property
    def columns(self) -> list[str]:
        return self.t.columns

    def carried(self, kind: str, attr: str) -> str:
        """The column of tokens that holds a flat region's attribute, if there is one."""
        name = f"{kind}@{attr}"
        return name if name in self.columns and self.c.flat(kind) else ""

    def at(self, m: Matches, place: str, column: str) -> Column | None:
        """A token's column at ``lo``, ``hi``, ``s<i>`` or ``e<i>`` out of what the match carries; None if it doesn't."""
        names = set(m.df.columns)
        if place not in ("lo", "hi"):
            own = f"_r{place[2:]}_{column}" if place[0] == "r" and self.same_text(column) else f"_v{place[1:]}_{column}"
            return F.col(own) if own in names else None
        slots = [c[1:] for c in m.df.columns if c[0] == "s" and c[1:].isdigit()]
        if not slots or any(f"_v{i}_{column}" not in names for i in slots):
            return None
        if len(slots) == 1:
            return F.col(f"_v{slots[0]}_{column}")
        side = "s" if place == "lo" else "e"
        return F.coalesce(*[F.when(F.col(f"{side}{i}") == F.col(place), F.col(f"_v{i}_{column}")) for i in slots])

    def same_text(self, column: str) -> bool:
        """Whether the column is the same on all tokens of a text."""
        return self.c.stretch is not None and (column == "text_idx" or column.startswith("text@"))

    def kind_of(self, name: str) -> tuple[str, str, str]:
        """(token, attr, ''), (feature, attr, key) or (region, type, attr)."""
        name = name.removeprefix("match.")
        name = "form" if name == "word" else name
        if name in self.c.attrs:
            return "token", name, ""
        if "/" in name or "#" in name:
            bundle, _, key = name.replace("#", "/", 1).partition("/")
            if bundle in self.c.kv_pipe and bundle in self.c.attrs:
                return "feature", bundle, key
            if f"{bundle}.{key}" in self.c.attrs:
                return "token", f"{bundle}.{key}", ""
        found = self.c.split_name(name)
        if found:
            return "region", *found
        raise QueryError(f"unknown attribute {name}")

    def is_set(self, name: str) -> bool:
        kind, a, b = self.kind_of(name)
        return name in self.c.multivalue or kind == "region"

    def test(self, c: Column, t: Test, as_set: bool, in_region: bool = False) -> Column:
        """The truth of a test on a value; null values fail."""
        if t.regex:
            hit = c.rlike(t.value if t.regex == "part" else rf"\A(?:{t.value})\z")
            return F.coalesce(~hit if t.op == "!=" else hit, F.lit(False))
        value = scalar.fold_text(t.value, t.lower, t.accents)
        left = scalar.folded(c, t.lower, t.accents)
        if t.op in ("=", "!="):
            same = left == F.lit(value)
            if as_set or in_region:
                member = F.array_contains(F.split(left, r"\|"), value)
                same = member if as_set and not in_region else same | member
            return F.coalesce(~same if t.op == "!=" else same, F.lit(False))
        return F.coalesce(scalar.compare(left, t.op, F.lit(t.value)), F.lit(False))

    # ---- token conditions

    def filtered(self, cond, tokens: DataFrame | None = None) -> DataFrame:
        """Tokens that satisfy a condition."""
        t = self.t if tokens is None else tokens
        plain, flags = [], []
        for part in cond.parts if isinstance(cond, Both) else (cond,):
            (flags if self.needs_join(part) else plain).append(part)
        for part in plain:
            if not isinstance(part, Everything):
                _, c = self.predicate(part, t)
                t = t.where(c)
        for part in flags:
            if isinstance(part, Related):
                key, keys = self.related_keys(part)
                if isinstance(key, str):
                    t = t.join(keys, key, "left_anti" if part.negated else "left_semi")
                    continue
            if isinstance(part, Test):
                kind, attr = self.region_of(part)
                if self.c.flat(kind):
                    key, keys = self.region_keys(part, t)
                    t = t.join(keys, key, "left_semi")
                else:
                    t = self.covered(t, "pos", "pos", self.region_hits(part), "left_semi")
                continue
            names = t.columns
            t, c = self.predicate(part, t)
            t = t.where(c).select(*names)
        return t

    def needs_join(self, cond) -> bool:
        if isinstance(cond, (Both, Either)):
            return any(self.needs_join(p) for p in cond.parts)
        if isinstance(cond, Test):
            return cond.attr != "contr_form" and self.kind_of(cond.attr)[0] == "region" and not self.carried(*self.kind_of(cond.attr)[1:]) or cond.attr == "contr_form" and "contr" in self.c.regions
        if isinstance(cond, CountValues):
            return self.kind_of(cond.attr)[0] == "region" and not self.carried(*self.kind_of(cond.attr)[1:])
        return isinstance(cond, (Related, CountRelated))

    def predicate(self, cond, t: DataFrame) -> tuple[DataFrame, Column]:
        """Tokens, perhaps with joined flags, and the condition's truth."""
        if isinstance(cond, Everything):
            return t, F.lit(True)
        if isinstance(cond, (Both, Either)):
            out = None
            for p in cond.parts:
                t, c = self.predicate(p, t)
                out = c if out is None else out & c if isinstance(cond, Both) else out | c
            return t, out
        if isinstance(cond, Test):
            if cond.attr == "contr_form" and "contr" not in self.c.regions:
                return t, F.lit(False)
            kind, a, b = self.kind_of(cond.attr)
            if kind == "token":
                return t, self.test(F.col(f"`{a}`"), cond, a in self.c.multivalue)
            if kind == "feature":
                return t, self.test(scalar.feature(F.col(a), b), cond, False) if cond.op in ("=", "!=") else F.lit(False)
            if self.carried(a, b):
                return t, self.test(F.col(self.carried(a, b)), cond, f"{a}_{b}" in self.c.multivalue, True)
            key, keys = self.region_keys(cond, t)
            return self.flagged(t, key, keys)
        if isinstance(cond, CountValues):
            kind, a, b = self.kind_of(cond.attr)
            if kind == "token":
                n = scalar.n_values(F.col(f"`{a}`"), a in self.c.multivalue)
            elif kind == "feature":
                n = scalar.n_values(scalar.feature(F.col(a), b), False)
            elif self.carried(a, b):
                n = scalar.n_values(F.col(self.carried(a, b)), True)
            else:
                name = fresh("n")
                values = self.region_sets(a, b, t.select("pos")).select("pos", F.size("v").alias(name))
                t = t.join(values, "pos", "left")
                n = F.coalesce(F.col(name), F.lit(0))
            return t, scalar.compare(n, cond.op, cond.n)
        if isinstance(cond, Related):
            key, keys = self.related_keys(cond)
            if not isinstance(key, str):
                t, c = self.counted(t, CountRelated(cond.relation, cond.cond, ">", 0))
            else:
                t, c = self.flagged(t, key, keys)
            return t, ~c if cond.negated else c
        return self.counted(t, cond)

    def flagged(self, t: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, Column]:
        flag = fresh("f")
        return t.join(keys.withColumn(flag, F.lit(True)), key, "left"), F.coalesce(F.col(flag), F.lit(False))

    def region_of(self, t: Test) -> tuple[str, str]:
        return ("contr", "form") if t.attr == "contr_form" else self.kind_of(t.attr)[1:]

    def region_hits(self, t: Test) -> DataFrame:
        kind, attr = self.region_of(t)
        return self.c.regions[kind].where(self.test(F.col(f"`{attr}`"), t, f"{kind}_{attr}" in self.c.multivalue, True))

    def region_keys(self, t: Test, tokens: DataFrame) -> tuple[str, DataFrame]:
        """The column of tokens and the keys whose tokens lie in a region with the value; in any covering one if several."""
        kind, hits = self.region_of(t)[0], self.region_hits(t)
        if self.c.flat(kind):
            return f"{kind}_idx", hits.select(F.col("region_idx").alias(f"{kind}_idx"))
        return "pos", self.covered(tokens.select("pos"), "pos", "pos", hits, "left_semi")

    def cells(self, rows: DataFrame, *more) -> DataFrame:
        """Regions (as ``_a`` to ``_z``) by each cell of 2^CELL_BITS positions that they reach into; zero-width ones cover nothing."""
        spread = F.sequence(F.shiftright("start_pos", CELL_BITS), F.shiftright("end_pos", CELL_BITS))
        return rows.where("end_pos >= start_pos").select(F.explode(spread).alias("_cell"), F.col("start_pos").alias("_a"), F.col("end_pos").alias("_z"), *more)

    def covered(self, df: DataFrame, lo: str, hi: str, rows: DataFrame, how: str) -> DataFrame:
        """Semi or anti join of stretches with the regions that cover them."""
        here = F.shiftright(lo, CELL_BITS) == F.col("_cell")
        return df.join(self.cells(rows), here & (F.col("_a") <= F.col(lo)) & (F.col("_z") >= F.col(hi)), how)

    def region_sets(self, kind: str, attr: str, at: DataFrame) -> DataFrame:
        """(pos, v): the set of values of all covering regions, of the positions asked for."""
        own = self.covering(kind, scalar.components(F.col(f"`{attr}`")), at)
        if self.c.flat(kind):
            return own
        return own.select("pos", F.explode("v").alias("x")).groupBy("pos").agg(F.array_sort(F.collect_set("x")).alias("v"))

    def covering(self, kind: str, value: Column, at: DataFrame) -> DataFrame:
        """(pos, v): a value of every region that covers a position asked for; flat ones are joined by number."""
        rows = self.c.regions[kind]
        if self.c.flat(kind):
            return self.c.cover(kind).join(rows.select("region_idx", value.alias("v")), "region_idx").select("pos", "v")
        points = at.where("pos is not null").distinct().withColumn("_cell", F.shiftright("pos", CELL_BITS))
        return points.join(self.cells(rows, value.alias("v")), "_cell").where("_a <= pos and _z >= pos").select("pos", "v")

    def region_values(self, kind: str, attr: str, at: DataFrame) -> DataFrame:
        """(pos, v): the value, or the distinct values of several covering regions joined by a pipe."""
        joined = self.covering(kind, F.col(f"`{attr}`"), at)
        if self.c.flat(kind):
            return joined
        return joined.groupBy("pos").agg(F.array_join(F.array_sort(F.collect_set("v")), "|").alias("v"))

    def tree(self) -> None:
        if not self.c.has_tree:
            raise QueryError("the corpus has no dependency tree")

    def related_keys(self, r: Related):
        """(column, keys) with which a token has a related token that satisfies the condition; siblings have no single key."""
        self.tree()
        b = self.filtered(r.cond)
        if r.relation == "child":
            return "pos", b.select(F.col("head_pos").alias("pos")).where("pos is not null").distinct()
        if r.relation == "parent":
            return "head_pos", b.select(F.col("pos").alias("head_pos"))
        if r.relation in ("descendant", "ancestor"):
            up, down = (self.t, b) if r.relation == "descendant" else (b, self.t)
            pairs = self.under(up, down)
            return "pos", pairs.select(F.col("up" if r.relation == "descendant" else "down").alias("pos")).distinct()
        return None, None

    def under(self, up: DataFrame, down: DataFrame) -> DataFrame:
        """(up, down): positions of ancestors and their descendants; within a sentence by Euler numbers."""
        u = up.select(F.col("pos").alias("up"), "s_idx", F.col("euler_in").alias("a"), F.col("euler_out").alias("z"))
        d = down.select(F.col("pos").alias("down"), "s_idx", F.col("euler_in").alias("i"))
        return u.join(d, "s_idx").where("i > a and i < z").select("up", "down")

    def counted(self, t: DataFrame, c: CountRelated) -> tuple[DataFrame, Column]:
        self.tree()
        n = fresh("n")
        b = self.filtered(c.cond)
        if c.relation == "child":
            if isinstance(c.cond, Everything):
                return t, scalar.compare(F.col("nchildren"), c.op, c.n)
            t = t.join(b.groupBy("head_pos").agg(F.count(F.lit(1)).alias(n)).select(F.col("head_pos").alias("pos"), n), "pos", "left")
        elif c.relation == "parent":
            t = t.join(b.select(F.col("pos").alias("head_pos"), F.lit(1).alias(n)), "head_pos", "left")
        elif c.relation == "sibling":
            total, own = fresh("n"), fresh("f")
            t = t.join(b.groupBy("head_pos").agg(F.count(F.lit(1)).alias(total)).where("head_pos is not null"), "head_pos", "left")
            t = t.join(b.select("pos", F.lit(1).alias(own)), "pos", "left")
            t = t.withColumn(n, F.when(F.col("head_pos").isNotNull(), F.coalesce(F.col(total), F.lit(0)) - F.coalesce(F.col(own), F.lit(0))))
        else:
            if isinstance(c.cond, Everything):
                return t, scalar.compare(F.col("ndesc" if c.relation == "descendant" else "depth"), c.op, c.n)
            pairs = self.under(self.t, b) if c.relation == "descendant" else self.under(b, self.t)
            key = "up" if c.relation == "descendant" else "down"
            t = t.join(pairs.groupBy(key).agg(F.count(F.lit(1)).alias(n)).withColumnRenamed(key, "pos"), "pos", "left")
        return t, scalar.compare(F.coalesce(F.col(n), F.lit(0)), c.op, c.n)

    # ---- slots

    def scope_of(self, q: Query) -> Scope | None:
        own = [s for s in q.scopes if not s.negated]
        return own[0] if own else Scope(self.c.default_within) if self.c.default_within and not q.scopes else None

    def scope_column(self, scope: Scope | None) -> list[str]:
        return [f"{scope.region}_idx"] if scope is not None and self.c.flat(scope.region) else []

    def runs(self, cond, keys: list[str]) -> DataFrame:
        """Maximal runs of tokens that satisfy the condition: keys, first, n. Texts (and flat scopes) are borders."""
        up = [c for c in self.columns if self.same_text(c) and c != "text_idx"]
        t = self.filtered(cond).select("pos", "text_idx", *[k for k in keys if k != "text_idx"], *up)
        by = list(dict.fromkeys(["text_idx", *keys]))
        island = F.col("pos") - F.row_number().over(W.partitionBy(*by).orderBy("pos"))
        return t.withColumn("island", island).groupBy(*by, "island").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"), *[F.max(c).alias(c) for c in up])

    def carry(self, i: int) -> list[Column]:
        """A single token's columns."""
        return [F.col(f"`{c}`").alias(f"_v{i}_{c}") for c in self.columns if c != "pos"]

    def run_carry(self, i: int, keys: list[str]) -> list[Column]:
        """What all tokens of a run share."""
        return [F.col(f"`{c}`").alias(f"_v{i}_{c}") for c in dict.fromkeys([c for c in self.columns if self.same_text(c)] + keys)]

    def spans(self, slot: Slot, i: int, keys: list[str]) -> DataFrame:
        """(s<i>, e<i>, keys): every stretch of tokens that the slot can be."""
        if self.single(slot):
            return self.filtered(slot.cond).select(F.col("pos").alias(f"s{i}"), F.col("pos").alias(f"e{i}"), *keys, *self.carry(i))
        r = self.runs(slot.cond, keys).select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("at"))
        longest = F.least(F.lit(slot.high), F.col("n") - F.col("at"))
        r = r.where(longest >= slot.low).withColumn("len", F.explode(F.sequence(F.lit(max(slot.low, 1)).cast("long"), longest.cast("long"))))
        return r.select((F.col("first") + F.col("at")).alias(f"s{i}"), (F.col("first") + F.col("at") + F.col("len") - 1).alias(f"e{i}"), *keys, *self.run_carry(i, keys))

    def single(self, slot: Slot) -> bool:
        return slot.kind == "token" and slot.low <= 1 and slot.high == 1

    def neighbours(self, slots: list[tuple[int, Slot]], keys: list[str], before: int = 0, after: int = 0, attr: str = "") -> DataFrame:
        """Adjacent single tokens off one scan; with an attribute of all tokens around them by distance from the first one."""
        k = len(slots)
        t = self.c.stretch(before, max(k - 1, after), k - 1, (attr,))
        t = t.select("*", *[F.col(f"`{attr}" + (f"+{o}`" if o else "`")).alias(f"_c{o}_{attr}") for o in range(-before, after + 1) if attr])
        done: list[str] = []
        for o, (i, slot) in enumerate(slots):
            if o:
                t = t.withColumnsRenamed({f"{c}+{o}": c for c in self.columns}).where("pos is not null")
                for key in keys:
                    t = t.where(F.col(key).eqNullSafe(F.col(f"_v{slots[0][0]}_{key}")))
            t = self.filtered(slot.cond, t)
            done += [f"s{i}", f"e{i}", *[f"_v{i}_{c}" for c in self.columns if c != "pos"]]
            rest = [c for c in t.columns if c not in self.columns]
            t = t.select(*[F.col(f"`{c}`") for c in rest], F.col("pos").alias(f"s{i}"), F.col("pos").alias(f"e{i}"), *self.carry(i), *([F.col(k) for k in keys] if o == k - 1 else []))
        return t.select(*[F.col(f"`{c}`") for c in done], *keys, *[c for c in t.columns if c.startswith("_c")])

    def tiled_runs(self, slot: Slot, keys: list[str]) -> DataFrame:
        """A lone repeated token: maximal runs, cut at the largest length; those of a bare word are left whole."""
        low, high = max(slot.low, 1), slot.high
        if slot.whole:
            return self.runs(slot.cond, keys).select(F.col("first").alias("s0"), (F.col("first") + F.col("n") - 1).alias("e0"), *keys, *self.run_carry(0, keys))
        r = self.runs(slot.cond, keys).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / high))))
        size = F.least(F.lit(high), F.col("n") - F.col("k") * high)
        return r.where(size >= low).select((F.col("first") + F.col("k") * high).alias("s0"), (F.col("first") + F.col("k") * high + size - 1).alias("e0"), *keys, *self.run_carry(0, keys))

    # ---- a query

    def query(self, q: Query | Parallel) -> Matches:
        if isinstance(q, Parallel):
            return self.parallel(q)
        self.validate(q)
        tokens = [s for s in q.slots if s.kind == "token"]
        if len(q.slots) == 1 and q.slots[0].kind == "subtree":
            return self.subtrees(q.slots[0])
        if not tokens:
            return self.enumeration(q)
        m = self.sequence(q)
        for s in q.scopes:
            m = self.scoped(m, s)
        for c in q.containing:
            m = self.contained(m, c)
        for f in q.filters:
            m = self.filter(m, f)
        plain = self.plain_chain(q, set(), 0)
        if len(plain) == len(q.slots) and not any(s.low == 0 for s in q.slots) and not q.containing and not q.filters and not q.scopes:
            keys = self.scope_column(self.scope_of(q))
            m.context = lambda before, after, attr: self.extended(self.neighbours(plain, keys, before, after, attr).drop(*keys), [i for i, _ in plain])
        return m

    def plain_chain(self, q: Query, skipped: set[int], start: int) -> list[tuple[int, Slot]]:
        """The slots from start on that are adjacent single tokens with conditions on themselves only."""
        out: list[tuple[int, Slot]] = []
        if self.c.stretch is None:
            return out
        for i, slot in enumerate(q.slots[start:], start):
            if i in skipped:
                continue
            if not self.single(slot) or self.needs_join(slot.cond) or out and q.relations[i - 1] != "":
                break
            out.append((i, slot))
        return out

    def extended(self, df: DataFrame, order: list[int]) -> DataFrame:
        starts, ends = [F.col(f"s{i}") for i in order], [F.col(f"e{i}") for i in order]
        return df.withColumns({"lo": F.least(*starts) if len(starts) > 1 else starts[0], "hi": F.greatest(*ends) if len(ends) > 1 else ends[0]})

    def validate(self, q: Query) -> None:
        seen: dict[str, str] = {}
        for s in q.slots:
            if s.kind == "anchor":
                if s.region in self.c.groups and len(q.slots) == 1:
                    pass
                elif s.region not in self.c.regions:
                    raise QueryError(f"unknown region type {s.region}")
                for _, peer in s.peers:
                    if seen.get(peer) != "anchor":
                        raise QueryError(f"{peer} must label an earlier anchor")
            if s.label:
                if s.label in seen:
                    raise QueryError(f"label {s.label} is used twice")
                seen[s.label] = s.kind
        for s in q.scopes:
            if s.region in self.c.groups:
                raise QueryError(f"{s.region} is a token group, not a region")
            if s.region not in self.c.regions:
                raise QueryError(f"unknown region type {s.region}")

        def labels(cond):
            if isinstance(cond, Related) and cond.label and cond.label not in seen:
                raise QueryError(f"{cond.label} isn't a label of the query")
            for p in getattr(cond, "parts", ()):
                labels(p)
            if isinstance(cond, (Related, CountRelated)):
                labels(cond.cond)

        for s in q.slots:
            labels(s.cond)

    def sequence(self, q: Query) -> Matches:
        """Union over which optional slots are taken; a match of no token isn't one."""
        order = [i for i, s in enumerate(q.slots) if s.kind == "token"]
        optional = [i for i in order if q.slots[i].low == 0]
        lone = len(order) == 1 and len(q.slots) == 1
        if lone and optional:
            optional = []
        out, columns = None, None
        for skipped in itertools.chain.from_iterable(itertools.combinations(optional, k) for k in range(len(optional) + 1)):
            if len(skipped) == len(order):
                continue
            df = self.chain(q, set(skipped), lone)
            if columns is None:
                columns = dict(df.dtypes)
            own = df.columns
            df = df.select(*[F.col(f"`{c}`") if c in own else F.lit(None).cast(kind).alias(c) for c, kind in columns.items()])
            out = df if out is None else out.unionByName(df)
        labels = {}
        for i, s in enumerate(q.slots):
            if s.label:
                labels[s.label] = ("region" if s.kind == "anchor" else s.kind, i, s.region)
        m = Matches(self.extended(out, order), labels, len(q.slots))
        for i, s in enumerate(q.slots):
            if s.kind == "subtree":
                m = self.bind_subtree(m, i, s.of)
        return m

    def chain(self, q: Query, skipped: set[int], lone: bool) -> DataFrame:
        scope = self.scope_of(q)
        keys = self.scope_column(scope)
        m, last, waiting, read = None, None, [], set()
        for i, slot in enumerate(q.slots):
            if i in read:
                last = i
                continue
            if slot.kind == "subtree":
                continue
            if slot.kind == "anchor":
                if slot.closing and last is not None:
                    m = self.anchor(m, i, slot, F.col("end_pos") == F.col(f"e{last}"), q)
                elif last is not None and not any(s.kind == "token" and k not in skipped for k, s in enumerate(q.slots) if k > i):
                    m = self.anchor(m, i, slot, F.col("start_pos") == F.col(f"e{last}") + 1, q)
                else:
                    waiting.append((i, slot))
                continue
            if i in skipped:
                m = m.withColumns({f"s{i}": F.lit(None).cast("long"), f"e{i}": F.lit(None).cast("long")}) if m is not None else m
                continue
            relation = q.relations[i - 1] if i else ""
            plain = self.plain_chain(q, skipped, i) if m is None else []
            if len(plain) > 1:
                m = self.neighbours(plain, keys)
                read = {k for k, _ in plain}
            elif m is None:
                m = self.tiled_runs(slot, keys) if lone and (slot.low, slot.high) != (1, 1) else self.spans(slot, i, keys)
            else:
                m = self.step(m, last, slot, i, relation, keys)
            if not relation.startswith("!"):
                last = i
            for k, a in waiting:
                m = self.anchor(m, k, a, F.col("end_pos") == F.col(f"s{i}") - 1 if a.closing else F.col("start_pos") == F.col(f"s{i}"), q)
            waiting = []
        return m.drop(*keys)

    def step(self, m: DataFrame, last: int, slot: Slot, i: int, relation: str, keys: list[str]) -> DataFrame:
        b = self.spans(slot, i, keys)
        if relation == "":
            b = b.withColumnsRenamed({k: f"_k_{k}" for k in keys}).withColumn("_at", F.col(f"s{i}") - 1)
            same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
            return m.join(b, [F.col(f"e{last}") == F.col("_at"), *same]).drop("_at", *[f"_k_{k}" for k in keys])
        self.tree()
        negated = relation.startswith("!")
        one = relation[-1]
        how = "left_anti" if negated else "inner"
        b = b.drop(*keys)
        if len(relation) == 1 or negated:
            if one == ">":  # b's head is the slot before
                b, head = self.token_columns(b, i, "head_pos")
                m = m.join(b.withColumn("_h", head), F.col(f"s{last}") == F.col("_h"), how)
            else:
                m, head = self.token_columns(m, last, "head_pos")
                m = m.withColumn("_h", head).join(b, F.col("_h") == F.col(f"s{i}"), how)
        else:
            m, *x = self.token_columns(m, last, "s_idx", "euler_in", "euler_out")
            b, *y = self.token_columns(b, i, "s_idx", "euler_in", "euler_out")
            m = m.withColumns(dict(zip(("_s", "_a", "_z"), x)))
            b = b.withColumns(dict(zip(("_t", "_i", "_o"), y)))
            inside = "_i > _a and _i < _z" if one == ">" else "_a > _i and _a < _o"
            m = m.join(b, F.col("_s") == F.col("_t")).where(inside)
        if negated:
            m = m.withColumns({f"s{i}": F.lit(None).cast("long"), f"e{i}": F.lit(None).cast("long")})
        return m.drop("_h", "_s", "_a", "_z", "_t", "_i", "_o")

    def token_columns(self, df: DataFrame, i: int, *names: str) -> tuple:
        """The frame and columns of the (first) token of slot i: carried ones, else looked up."""
        own = df.columns
        if all(f"_v{i}_{n}" in own for n in names):
            return df, *[F.col(f"_v{i}_{n}") for n in names]
        fresh_names = {n: fresh("t") for n in names}
        p = fresh("p")
        found = self.t.select(F.col("pos").alias(p), *[F.col(n).alias(x) for n, x in fresh_names.items()])
        return df.join(found, F.col(f"s{i}") == F.col(p)).drop(p), *[F.col(x) for x in fresh_names.values()]

    # ---- anchors and regions

    def region_rows(self, slot: Slot) -> DataFrame:
        """Regions of the type with the attributes; one that a type lacks is looked for on containing regions."""
        r = self.c.regions[slot.region]
        for attr, value in slot.attrs:
            own = self.c.region_attrs.get(slot.region, [])
            name = attr if attr in own else f"{slot.region}_{attr}" if f"{slot.region}_{attr}" in own else None
            if name:
                r = r.where(F.col(f"`{name}`") == value)
                continue
            holders = [k for k, names in self.c.region_attrs.items() if attr in names]
            if not holders:
                raise QueryError(f"no region type has the attribute {attr}")
            keys = None
            for k in holders:
                if f"{k}@{attr}" in r.columns and len(holders) == 1:
                    r = r.where(F.col(f"{k}@{attr}") == value)
                    break
                up = self.c.regions[k].where(F.col(f"`{attr}`") == value).select("text_idx", F.col("start_pos").alias("_a"), F.col("end_pos").alias("_z"))
                found = r.join(up, "text_idx").where("_a <= start_pos and _z >= end_pos").select("region_idx")
                keys = found if keys is None else keys.union(found)
            if keys is not None:
                r = r.join(keys.distinct(), "region_idx", "left_semi")
        return r

    def ancestors(self, kind: str) -> DataFrame:
        """(region_idx, anc): reflexive closure of par; as many rounds as regions are deep."""
        r = self.c.regions[kind].select("region_idx", "par")
        out = r.select("region_idx", F.col("region_idx").alias("anc"))
        step = r.where("par is not null").select("region_idx", F.col("par").alias("anc"))
        up = r.select(F.col("region_idx").alias("anc"), "par")
        while not step.isEmpty():
            out = out.union(step)
            step = step.join(up, "anc").where("par is not null").select("region_idx", F.col("par").alias("anc"))
        return out

    def bound(self, i: int, rows: DataFrame) -> DataFrame:
        return rows.select("start_pos", "end_pos", F.col("region_idx").alias(f"r{i}"), F.col("start_pos").alias(f"rs{i}"), F.col("end_pos").alias(f"re{i}"), F.col("par").alias(f"rp{i}"), *[F.col(f"`{c}`").alias(f"_r{i}_{c}") for c in rows.columns])

    def anchor(self, m: DataFrame, i: int, slot: Slot, where: Column, q: Query) -> DataFrame:
        names = m.columns
        m = self.peers(m.join(self.bound(i, self.region_rows(slot)), where).drop("start_pos", "end_pos"), i, slot, q)
        if self.o.binding == "innermost":
            best = W.partitionBy(*[c for c in names if not c.startswith("_")]).orderBy(F.col(f"re{i}") - F.col(f"rs{i}"), f"r{i}")
            m = m.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")
        return m

    def peers(self, m: DataFrame, i: int, slot: Slot, q: Query) -> DataFrame:
        for kind, label in slot.peers:
            j = next(k for k, s in enumerate(q.slots) if s.label == label)
            if kind == "contains":
                m = m.where(f"rs{i} <= rs{j} and re{i} >= re{j}")
            elif q.slots[j].region != slot.region:
                m = m.where("false")
            elif kind == "rchild":
                m = m.where(f"rp{i} = r{j}")
            elif f"_r{j}_anc" in m.columns:
                m = m.where(F.array_contains(f"_r{j}_anc", F.col(f"r{i}")))
            else:
                closure = self.ancestors(slot.region).select(F.col("region_idx").alias("_d"), F.col("anc").alias("_a"))
                m = m.join(closure, (F.col(f"r{j}") == F.col("_d")) & (F.col(f"r{i}") == F.col("_a")), "left_semi")
        return m

    def enumeration(self, q: Query) -> Matches:
        """Regions (or stand-off groups) as matches, without tokens."""
        first = q.slots[0]
        labels = {s.label: ("region", i, s.region) for i, s in enumerate(q.slots) if s.label}
        if first.region in self.c.groups:
            return self.group_enumeration(q)
        m = self.bound(0, self.region_rows(first)).withColumns({"s0": F.col("start_pos"), "e0": F.col("end_pos")}).drop("start_pos", "end_pos")
        own = {c: f"_r0_{c}" if f"_r0_{c}" in m.columns else f"_r0_{c.removeprefix('text@')}" if first.region == "text" else "" for c in self.columns if self.same_text(c)}
        m = m.withColumns({f"_v0_{c}": F.col(f"`{x}`") for c, x in own.items() if x})
        for i, slot in enumerate(q.slots[1:], 1):
            if slot.peers and slot.peers[0][0] == "rchild":
                j = next(k for k, s in enumerate(q.slots) if s.label == slot.peers[0][1])
                m = m.join(self.bound(i, self.region_rows(slot)).drop("start_pos", "end_pos"), F.col(f"rp{i}") == F.col(f"r{j}"))
            else:
                same = F.col("end_pos") == F.col("e0") if slot.closing else F.col("start_pos") == F.col("s0")
                m = m.join(self.bound(i, self.region_rows(slot)), same).drop("start_pos", "end_pos")
            m = self.peers(m, i, slot, q)
        out = Matches(m.withColumns({"lo": F.col("s0"), "hi": F.col("e0")}), labels, len(q.slots))
        for s in q.scopes:
            out = self.scoped(out, s)
        for c in q.containing:
            out = self.contained(out, c)
        for f in q.filters:
            out = self.filter(out, f)
        return out

    def group_enumeration(self, q: Query) -> Matches:
        slot = q.slots[0]
        g = self.c.groups[slot.region]
        for attr, value in slot.attrs:
            g = g.where(F.coalesce(F.try_element_at("props", F.lit(attr)), F.try_element_at("props", F.lit({"type": "code", "code": "type"}.get(attr, attr)))) == value)
        g = g.withColumn("members", F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda x: F.sequence(x["s"], x["e"]))))))
        g = g.select("gid", "props", "members", F.array_min("members").alias("lo"), F.array_max("members").alias("hi"))
        g = g.withColumns({"s0": F.col("lo"), "e0": F.col("hi")})
        for name in slot.where:
            if name not in self.named:
                raise QueryError(f"no query is named {name}")
            g = g.join(self.shared_groups(g, self.named[name]), "gid", "left_semi")
        m = Matches(g, {slot.label: ("group", 0, slot.region)} if slot.label else {}, 1, slot.region)
        for f in q.filters:
            m = self.filter(m, f)
        return m

    def positions(self, m: Matches) -> DataFrame:
        """The rows of a set with one column ``p`` per bound position."""
        if "members" in m.df.columns:
            return m.df.withColumn("p", F.explode("members"))
        slots = [c[1:] for c in m.df.columns if c[0] == "s" and c[1:].isdigit()]
        spans = [F.when(F.col(f"s{i}").isNotNull() & (F.col(f"e{i}") >= F.col(f"s{i}")), F.sequence(f"s{i}", f"e{i}")).otherwise(F.array().cast("array<long>")) for i in slots]
        return m.df.withColumn("p", F.explode(F.array_distinct(F.flatten(F.array(*spans)))))

    def shared_groups(self, g: DataFrame, m: Matches) -> DataFrame:
        hits = self.positions(m).select("p").distinct()
        return g.select("gid", F.explode("members").alias("p")).join(hits, "p", "left_semi").select("gid").distinct()

    # ---- scopes

    def scoped(self, m: Matches, s: Scope) -> Matches:
        how = "left_anti" if s.negated else "left_semi"
        carried = self.carried_scope(m, s)
        if carried is not None:
            df, region, test = carried
            if s.having is None:
                return replace(m, df=df.where(~test if s.negated else test))
            key, idx = fresh("k"), fresh("k")
            hits = self.filtered(s.having).select(F.col(region).alias(idx)).distinct()
            df = df.withColumn(key, F.when(test, F.col("_scope")))
            return replace(m, df=df.join(hits, F.col(key) == F.col(idx), how).drop(key, "_scope"))
        rows = self.c.regions[s.region]
        if s.test is not None:
            kind, attr = self.kind_of(s.test.attr)[1:]
            rows = rows.where(self.test(F.col(f"`{attr}`"), s.test, False, True))
        if s.having is not None:
            hits = self.filtered(s.having)
            if self.c.flat(s.region):
                hits = hits.select(F.col(f"{s.region}_idx").alias("region_idx"))
            else:
                points = hits.select("pos").withColumn("_cell", F.shiftright("pos", CELL_BITS))
                hits = points.join(self.cells(self.c.regions[s.region], "region_idx"), "_cell").where("_a <= pos and _z >= pos").select("region_idx")
            rows = rows.join(hits.distinct(), "region_idx", "left_semi")
        return replace(m, df=self.covered(m.df, "lo", "hi", rows, how))

    def carried_scope(self, m: Matches, s: Scope) -> tuple | None:
        """The matches with their flat region's number as ``_scope``, its column, and whether one region holds them (and its value fits)."""
        region = f"{s.region}_idx"
        if self.c.stretch is None or region not in self.columns:
            return None
        first, last = self.at(m, "lo", region), self.at(m, "hi", region)
        if first is None or last is None:
            return None
        test = F.coalesce(first == last, F.lit(False))
        if s.test is not None:
            kind, attr = self.kind_of(s.test.attr)[1:]
            value = self.at(m, "lo", f"{kind}@{attr}") if kind == s.region and self.carried(kind, attr) else None
            if value is None:
                return None
            test = test & self.test(value, s.test, False, True)
        return (m.df if s.having is None else m.df.withColumn("_scope", first)), region, test

    def contained(self, m: Matches, c: Containing) -> Matches:
        """Extents that hold a region, or a token with all that depends on it; the interval join is within the text."""
        text = self.at(m, "lo", "text_idx")
        extents = m.df.select("lo", "hi").distinct().join(self.t.select(F.col("pos").alias("lo"), "text_idx"), "lo") if text is None else m.df.select("lo", "hi", text.alias("text_idx")).distinct()
        if c.region:
            if c.region not in self.c.regions:
                raise QueryError(f"unknown region type {c.region}")
            r = self.c.regions[c.region].select("text_idx", F.col("start_pos").alias("_a"), F.col("end_pos").alias("_z"))
        else:
            self.tree()
            r = self.filtered(c.cond).select("text_idx", F.col("sub_min").alias("_a"), F.col("sub_max").alias("_z"))
        keys = extents.join(r, "text_idx").where("_a >= lo and _a <= hi and _z <= hi").select("lo", "hi").distinct()
        return replace(m, df=m.df.join(keys, ["lo", "hi"], "left_anti" if c.negated else "left_semi"))

    # ---- subtrees

    def bind_subtree(self, m: Matches, i: int, of: str) -> Matches:
        if of not in m.labels or m.labels[of][0] != "token":
            raise QueryError(f"{of} must label a token")
        k = m.labels[of][1]
        if f"_v{k}_ndesc" in m.df.columns:
            return replace(m, df=m.df.where(f"s{k} is not null").withColumns({f"_top{i}": F.col(f"s{k}"), f"_size{i}": F.col(f"_v{k}_ndesc") + 1}))
        return self.with_members(replace(m, df=m.df.withColumn(f"_top{i}", F.col(f"s{k}"))), i)

    def with_members(self, m: Matches, i: int) -> Matches:
        """The matches with the positions of the subtree of slot i, which are found only where they are asked for."""
        if f"sub{i}" in m.df.columns:
            return m
        sub = self.members_below(m.df.select(F.col(f"_top{i}").alias("pos"))).withColumnRenamed("_sub", f"sub{i}")
        return replace(m, df=m.df.join(sub, F.col(f"_top{i}") == F.col("_top")).drop("_top"))

    def members_below(self, tops: DataFrame) -> DataFrame:
        """(_top, _sub): each of the positions and, sorted, those of itself and all that depends on it."""
        self.tree()
        own = self.t.join(tops.where("pos is not null").distinct(), "pos", "left_semi")
        pairs = self.under(own, self.t).union(own.select(F.col("pos").alias("up"), F.col("pos").alias("down")))
        return pairs.groupBy(F.col("up").alias("_top")).agg(F.array_sort(F.collect_list("down")).alias("_sub"))

    def subtrees(self, slot: Slot) -> Matches:
        """dep_subtree(Q): for each match of the named set the subtree of its first token."""
        if slot.of not in self.named:
            raise QueryError(f"no query is named {slot.of}")
        m = self.named[slot.of]
        df = m.df.join(self.members_below(m.df.select(F.col("lo").alias("pos"))), F.col("lo") == F.col("_top"))
        df = df.select(F.col("lo").alias("s0"), F.col("lo").alias("e0"), F.array_min("_sub").alias("lo"), F.array_max("_sub").alias("hi"), F.col("_sub").alias("sub0"))
        return Matches(df, {slot.label: ("subtree", 0, "")} if slot.label else {}, 1)

    # ---- values of matches

    def start_of(self, m: Matches, label: str) -> str:
        if not label or label == "match":
            return "lo"
        kind, i, _ = self.label(m, label)
        return {"token": f"s{i}", "region": f"rs{i}", "group": "lo", "subtree": "lo"}[kind]

    def label(self, m: Matches, label: str) -> tuple:
        if label not in m.labels:
            raise QueryError(f"{label} isn't a label of the query")
        return m.labels[label]

    def lookup(self, df: DataFrame, at: str, values: DataFrame) -> tuple[DataFrame, Column]:
        """Joins (pos, v) at a position column."""
        p, v = fresh("p"), fresh("v")
        return df.join(values.select(F.col("pos").alias(p), F.col("v").alias(v)), F.col(at) == F.col(p), "left").drop(p), F.col(v)

    def value(self, m: Matches, label: str, attr: str) -> tuple[Matches, Column]:
        """The value of an attribute at a label (or the first token); null where there is none."""
        if label and label != "match" and self.label(m, label)[0] == "region":
            _, i, kind = m.labels[label]
            own = self.c.region_attrs.get(kind, [])
            name = attr if attr in own else f"{kind}_{attr}" if f"{kind}_{attr}" in own else attr.removeprefix(f"{kind}_") if attr.removeprefix(f"{kind}_") in own else None
            if name and f"_r{i}_{name}" in m.df.columns:
                return m, F.col(f"`_r{i}_{name}`")
            if name:
                key, v = fresh("r"), fresh("v")
                values = self.c.regions[kind].select(F.col("region_idx").alias(key), F.col(f"`{name}`").alias(v))
                return replace(m, df=m.df.join(values, F.col(f"r{i}") == F.col(key), "left").drop(key)), F.col(v)
        if "props" in m.df.columns and (not label or m.labels.get(label, ("",))[0] == "group") and attr not in self.c.attrs and self.c.split_name(attr) is None:
            other = {"type": "code", "code": "type"}.get(attr, attr)
            return m, F.coalesce(F.try_element_at("props", F.lit(attr)), F.try_element_at("props", F.lit(other)))
        at = self.start_of(m, label)
        try:
            kind, a, b = self.kind_of(attr)
        except QueryError:
            holders = [k for k, names in self.c.region_attrs.items() if attr in names]
            if not holders:
                raise
            kind, a, b = "region", holders[0], attr
        v = self.at(m, at, (self.carried(a, b) if kind == "region" else a) or "-")
        if v is not None:
            return m, scalar.feature(v, b) if kind == "feature" else v
        if kind == "region":
            values = self.region_values(a, b, m.df.select(F.col(at).alias("pos")))
        else:
            c = F.col(f"`{a}`")
            values = self.t.select("pos", (scalar.feature(c, b) if kind == "feature" else c).alias("v"))
        df, v = self.lookup(m.df, at, values)
        return replace(m, df=df), v

    def token_number(self, m: Matches, label: str, column: str) -> tuple[Matches, Column]:
        self.tree()
        v = self.at(m, self.start_of(m, label), column)
        if v is not None:
            return m, v
        df, v = self.lookup(m.df, self.start_of(m, label), self.t.select("pos", F.col(column).alias("v")))
        return replace(m, df=df), v

    def whole(self, m: Matches, label: str) -> Matches:
        """The matches with what ``extent`` takes of a label."""
        kind, i, _ = self.label(m, label)
        return self.with_members(m, i) if kind == "subtree" else m

    def extent(self, m: Matches, label: str) -> tuple[Column, Column]:
        kind, i, _ = self.label(m, label)
        if kind == "token":
            return F.col(f"s{i}"), F.col(f"e{i}")
        if kind == "region":
            return F.col(f"rs{i}"), F.col(f"re{i}")
        return (F.array_min(f"sub{i}"), F.array_max(f"sub{i}")) if kind == "subtree" else (F.col("lo"), F.col("hi"))

    def size_of(self, m: Matches, label: str) -> Column:
        kind, i, _ = self.label(m, label)
        if kind == "subtree":
            return F.size(f"sub{i}").cast("long") if f"sub{i}" in m.df.columns else F.col(f"_size{i}")
        if kind == "group":
            return F.size("members").cast("long")
        a, z = self.extent(m, label)
        return F.greatest(z - a + 1, F.lit(0)).cast("long")

    def call(self, m: Matches, name: str, args: tuple) -> tuple[Matches, Column]:
        """A function of labels and attributes; null where it is undefined."""
        names = [a or b for a, b in args]
        label = lambda k: args[k][1] if not args[k][0] else args[k][0]
        if name in ("distance", "distabs"):
            return m, F.abs(F.col(self.start_of(m, label(0))) - F.col(self.start_of(m, label(1))))
        if name in ("nchildren", "depth", "ndescendants"):
            return self.token_number(m, label(0), {"ndescendants": "ndesc"}.get(name, name))
        if name == "tcnt":
            return m, self.size_of(m, label(0))
        if name == "contains":
            for x in (names[0], args[1][1]):
                m = self.whole(m, x)
            (a, z), (i, o) = self.extent(m, names[0] if args[0][0] else args[0][1]), self.extent(m, args[1][1])
            return m, ((a <= i) & (z >= o)).cast("long")
        if name in ("rchild", "rcontains"):
            (k1, i, t1), (k2, j, t2) = self.label(m, args[0][1]), self.label(m, args[1][1])
            if k1 != "region" or k2 != "region" or t1 != t2:
                return m, F.lit(0).cast("long")
            if name == "rchild":
                return m, F.coalesce((F.col(f"rp{j}") == F.col(f"r{i}")).cast("long"), F.lit(0).cast("long"))
            if f"_r{j}_anc" in m.df.columns:
                return m, F.coalesce(F.array_contains(f"_r{j}_anc", F.col(f"r{i}")).cast("long"), F.lit(0).cast("long"))
            flag = fresh("f")
            closure = self.ancestors(t1).select(F.col("region_idx").alias("_d"), F.col("anc").alias("_a"), F.lit(1).cast("long").alias(flag))
            df = m.df.join(closure, (F.col(f"r{j}") == F.col("_d")) & (F.col(f"r{i}") == F.col("_a")), "left").drop("_d", "_a")
            return replace(m, df=df), F.coalesce(F.col(flag), F.lit(0).cast("long"))
        m, v = self.value(m, *args[0])
        return self.apply(m, name, v, args[0][1])

    def apply(self, m: Matches, name: str, v: Column, attr: str) -> tuple[Matches, Column]:
        """A function of a value."""
        if name in scalar.DATES:
            return m, scalar.DATES[name](v)
        if name == "strlen":
            return m, F.length(v).cast("long")
        if name == "nvals":
            return m, scalar.n_values(v, self.is_set(attr)).cast("long")
        if name == "f":
            kind, a, b = self.kind_of(attr)
            value, n, key = F.col(f"`{a}`") if kind == "token" else None, fresh("n"), fresh("k")
            if kind != "token":
                raise QueryError("f() takes a token attribute")
            counts = self.t.groupBy(value.alias(key)).agg(F.count(F.lit(1)).alias(n))
            return replace(m, df=m.df.join(counts, v == F.col(key), "left").drop(key)), F.col(n)
        raise QueryError(f"unknown function {name}")

    # ---- global filters

    def filter(self, m: Matches, f: Filter) -> Matches:
        keep = m.df.columns
        if f.kind == "order":
            a, b = F.col(self.start_of(m, f.left)), F.col(self.start_of(m, f.right))
            return replace(m, df=m.df.where(a < b if f.op == "<" else a > b))
        if f.kind == "region":
            if f.left in self.named and f.left not in m.labels:
                return self.named_filter(m, f)
            m, v = self.value(m, f.left, f.right.attr)
            in_region = self.kind_or_region(f.right.attr)
            return replace(m, df=m.df.where(self.test(v, f.right, f.right.attr in self.c.multivalue, in_region)).select(*keep))
        if f.kind == "function":
            m, left = self.call(m, f.left.name, f.left.args)
            right = F.lit(f.right)
            if isinstance(f.right, Call):
                m, right = self.call(m, f.right.name, f.right.args)
            return replace(m, df=m.df.where(F.coalesce(scalar.compare(left, f.op, right), F.lit(False))).select(*keep))
        m, a = self.value(m, *f.left)
        m, b = self.value(m, *f.right)
        return replace(m, df=m.df.where(self.aligned(a, b, f)).select(*keep))

    def kind_or_region(self, attr: str) -> bool:
        try:
            return self.kind_of(attr)[0] == "region"
        except QueryError:
            return True

    def aligned(self, a: Column, b: Column, f: Filter) -> Column:
        """Equality of values, for sets and region values overlap of their parts; a missing value never aligns."""
        some = F.lit(True) if self.o.empty_alignment else scalar.present(a) & scalar.present(b) & (F.size(scalar.components(a)) > 0) & (F.size(scalar.components(b)) > 0)
        sets = self.of_sets(f)
        same = F.arrays_overlap(scalar.components(a), scalar.components(b)) if sets else a == b
        return F.coalesce(some & (~same if f.op == "!=" else same), F.lit(False))

    def named_filter(self, m: Matches, f: Filter) -> Matches:
        """A filter on a named set: matches whose extent meets one of its matches with the value."""
        other, v = self.value(self.named[f.left], "", f.right.attr)
        hits = replace(other, df=other.df.where(self.test(v, f.right, f.right.attr in self.c.multivalue, self.kind_or_region(f.right.attr))))
        points = self.positions(hits).select("p").distinct()
        keep = m.df.columns
        row = fresh("row")
        own = replace(m, df=m.df.withColumn(row, F.struct(*[c for c in keep if c[0] in "slhe" and c[1:] in ("o", "i") or c[0] in "se" and c[1:].isdigit()])))
        keys = self.positions(own).join(points, "p", "left_semi").select(row).distinct()
        return replace(m, df=own.df.join(keys, row, "left_semi").select(*keep))

    # ---- parallel queries

    def parallel(self, p: Parallel) -> Matches:
        """Pairs of a source and a target match. Plain attributes join by equality, sets by a shared part;
        without a filter it is a cross product, as asked for."""
        left, right = self.query(p.source), self.query(p.target)
        equal, rest = [], []
        for f in p.filters:
            if f.kind != "align":
                raise QueryError("a parallel query takes alignment filters")
            one, two = (f.left, f.right) if f.left[0] in left.labels else (f.right, f.left)
            if one[0] not in left.labels or two[0] not in right.labels:
                raise QueryError("an alignment joins a source label to a target label")
            left, a = self.value(left, *one)
            right, b = self.value(right, *two)
            ka, kb = fresh("a"), fresh("b")
            left, right = replace(left, df=left.df.withColumn(ka, a)), replace(right, df=right.df.withColumn(kb, b))
            (equal if f.op == "=" else rest).append((ka, kb, f))
        names = [c for c in left.df.columns if not c.startswith("_")]
        others = [c for c in right.df.columns if not c.startswith("_")]
        r = right.df.select(*[F.col(c).alias(f"t_{c}") for c in others], *[kb for _, kb, _ in equal + rest])
        both = self.meet(left.df.select(*names, *[ka for ka, _, _ in equal + rest]).distinct(), r.distinct(), equal) if equal else left.df.crossJoin(r)
        for ka, kb, f in rest:
            both = both.where(self.aligned(F.col(ka), F.col(kb), f))
        both = both.select(*names, *[f"t_{c}" for c in others])
        return Matches(both, left.labels, left.slots, target=Matches(both, right.labels, right.slots))

    def of_sets(self, f: Filter) -> bool:
        return any(x[1] in self.c.multivalue or self.kind_or_region(x[1]) for x in (f.left, f.right))

    def keyed(self, df: DataFrame, value: str, sets: bool, first: bool, key: str, smaller: str) -> DataFrame:
        """Rows by each part of a value, with the parts that are smaller; a plain value is one part."""
        c = F.col(value)
        parts = scalar.components(c)
        some = c.isNotNull() if self.o.empty_alignment and not first else scalar.present(c) & (F.size(parts) > 0)
        if not sets:
            return df.where(some).withColumn(key, c).withColumn(smaller, F.array().cast("array<string>"))
        if first:
            parts = F.filter(parts, lambda x: x != scalar.MISSING)
        return df.where(some).withColumn(key, F.explode(parts)).withColumn(smaller, F.filter(parts, lambda x: x < F.col(key)))

    def meet(self, x: DataFrame, y: DataFrame, equal: list[tuple]) -> DataFrame:
        """Pairs of rows of two sets that agree in all alignments. They meet by a part of each value and count where these are the smallest
        that they share, so no pair is made twice and none is shuffled. Rows of a key with many pairs meet in a grid of cells."""
        keys, low = [], []
        for n, (ka, kb, f) in enumerate(equal):
            key, a, b = fresh("k"), fresh("a"), fresh("b")
            x, y = self.keyed(x, ka, self.of_sets(f), not n, key, a), self.keyed(y, kb, self.of_sets(f), not n, key, b)
            keys.append(key)
            low.append((a, b))
        counts = [z.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)) for z, name in ((x, "_nx"), (y, "_ny"))]
        cells = F.ceil(F.col("_nx") * F.col("_ny") / PAIRS_MOST)
        heavy = counts[0].join(counts[1], keys).withColumn("_cells", cells).where("_cells > 1")
        heavy = heavy.withColumn("_cols", F.least(F.ceil(F.sqrt("_cells")), "_ny")).withColumn("_rows", F.least(F.ceil(F.col("_cells") / F.col("_cols")), "_nx")).select(*keys, "_rows", "_cols")
        # at most a row for every PAIRS_MOST pairs
        x, y = (z.join(F.broadcast(heavy), keys, "left").fillna(1, ["_rows", "_cols"]).withColumn("_hash", F.xxhash64(*[c for c in z.columns if c in ("lo", "hi", "t_lo", "t_hi")])) for z in (x, y))
        x = x.withColumn("_row", F.pmod("_hash", "_rows")).withColumn("_col", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_cols") - 1)))
        y = y.withColumn("_col", F.pmod("_hash", "_cols")).withColumn("_row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_rows") - 1)))
        by = [*keys, "_row", "_col"]
        n = int(self.c.spark.conf.get("spark.sql.shuffle.partitions"))  # kept as they are: few bytes may make many pairs
        x, y = (z.drop("_hash", "_rows", "_cols").repartition(n, *by) for z in (x, y))
        both = x.join(y, by)
        for a, b in low:
            both = both.where((F.size(a) == 0) | (F.size(b) == 0) | ~F.arrays_overlap(a, b))
        return both
