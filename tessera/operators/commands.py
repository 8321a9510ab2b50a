"""Commands over match sets; each returns a DataFrame.

Counts are partial aggregates before any shuffle; percentages come from a one-row total; nothing is
collected. Orderings and limits are those of the command itself (``group_limit``, ``max_items``, pages).
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import measures, scalar
from ..plans.language import Field, QueryError
from ..plans.lower import Lowering, Matches, fresh


@dataclass
class Settings:
    limit: int = 20
    offset: int = 0
    context: int = 5
    group_limit: int = 1000
    left: int = 5
    right: int = 5
    min_freq: int = 5
    max_items: int = 50
    stoplist: int = 0
    measures: list = field(default_factory=lambda: ["logdice"])
    mv_explode: bool = True


def text_of(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def stretch_values(low: Lowering, m: Matches, label: str, attr: str) -> tuple[Matches, Column]:
    """The attribute's values over a label's tokens, joined by blanks, gaps by `` ... ``."""
    row, v = fresh("row"), fresh("v")
    m = low.whole(m, label)
    kind, i, _ = low.label(m, label)
    places = F.col(f"sub{i}") if kind == "subtree" else F.col("members") if kind == "group" else F.sequence(*low.extent(m, label))
    # keyed by the places themselves, which say what the value is: rows needn't be numbered
    df = m.df.withColumn(row, places)
    each = df.select(row).distinct().withColumn("p", F.explode(row)).join(low.t.select(F.col("pos").alias("p"), F.col(f"`{attr}`").alias("a")), "p")
    parts = each.groupBy(row).agg(F.array_sort(F.collect_list(F.struct("p", "a"))).alias("x"))
    joined = F.aggregate("x", F.struct(F.lit("").alias("s"), F.lit(None).cast("long").alias("at")), lambda acc, e: F.struct(F.concat(acc["s"], F.when(acc["at"].isNull(), "").when(e["p"] == acc["at"] + 1, " ").otherwise(" ... "), e["a"]).alias("s"), e["p"].alias("at")), lambda acc: acc["s"])
    return replace(m, df=df.join(parts.select(F.col(row).alias(row + "k"), joined.alias(v)), F.col(row) == F.col(row + "k"), "left").drop(row, row + "k")), F.col(v)


def value_of(low: Lowering, m: Matches, f: Field) -> tuple[Matches, Column]:
    """A field's value as a string; empty where it is undefined."""
    calls = list(f.calls)
    if calls and calls[-1] in ("forms", "spellout"):
        m, c = stretch_values(low, m, f.label, f.attr or "form")
        calls.pop()
    elif calls and calls[-1] in ("tcnt", "depth", "nchildren", "ndescendants"):
        m, c = low.call(m, calls.pop(), (("", f.label or f.attr),))
    elif f.attr in m.labels and not f.label and m.labels[f.attr][0] == "token":
        m, c = low.value(m, f.attr, "form")
    else:
        m, c = low.value(m, f.label, f.attr)
    for name in reversed(calls):
        m, c = low.apply(m, name, c, f.attr)
    return m, text_of(c)


def field_columns(low: Lowering, m: Matches, fields: list[Field]) -> tuple[DataFrame, list[str]]:
    """The set with a column per field: f0, f1, ..."""
    names = []
    for k, f in enumerate(fields):
        m, c = value_of(low, m, f)
        name = f"f{k}"
        m = replace(m, df=m.df.withColumn(name, c))
        names.append(name)
    return m.df, names


def by_count(df: DataFrame, names: list[str], settings: Settings) -> DataFrame:
    order = [F.desc("count")]
    for n in names:
        order += [scalar.sort_number(F.col(n)).asc_nulls_last(), F.col(n)]
    df = df.orderBy(*order)
    return df.limit(settings.group_limit) if settings.group_limit else df


def named_columns(fields: list[Field]) -> list[str]:
    return ["key"] if len(fields) == 1 else [f"key{k + 1}" for k in range(len(fields))]


def _exploded(low: Lowering, df: DataFrame, fields: list[Field], settings: Settings) -> DataFrame:
    if settings.mv_explode and len(fields) == 1 and not fields[0].calls and fields[0].attr in low.c.multivalue:
        parts = scalar.components(F.col("f0"))
        return df.withColumn("f0", F.explode(F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit("")))))
    return df


def count(low: Lowering, m: Matches, fields: list[Field], settings: Settings) -> DataFrame:
    """One field: key, count, pct. Several: a roll-up with subtotals, their level and pct_of_parent."""
    df, names = field_columns(low, m, fields)
    keys = named_columns(fields)
    if len(fields) == 1:
        rows = _exploded(low, df, fields, settings)
        out = rows.groupBy(F.col("f0").alias("key")).agg(F.count(F.lit(1)).alias("count"))
        total = out.agg(F.sum("count").alias("total")) if rows is df else df.agg(F.count(F.lit(1)).alias("total"))  # the counts are used again
        out = out.crossJoin(F.broadcast(total)).select("key", "count", (F.col("count") * 100.0 / F.col("total")).alias("pct"))  # one row
        return by_count(out, keys, settings)
    out = df.select(*[F.col(n).alias(k) for n, k in zip(names, keys)]).rollup(*keys).agg(F.count(F.lit(1)).alias("count"), F.grouping_id(*keys).alias("gid"))
    out = out.withColumn("level", F.lit(len(keys)) - F.length(F.regexp_replace(F.bin("gid"), "0", ""))).drop("gid")
    up = out.select(*[F.col(k).alias(f"p_{k}") for k in keys], F.col("count").alias("p_count"), F.col("level").alias("p_level"))
    same = [F.col("p_level") == F.col("level") - 1]
    for i, k in enumerate(keys):
        same.append(F.when(F.col("level") > i + 1, F.col(k).eqNullSafe(F.col(f"p_{k}"))).otherwise(F.col(f"p_{k}").isNull()))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    out = out.where("level > 0").join(up, cond).crossJoin(F.broadcast(total))
    return out.select(*keys, "level", "count", (F.col("count") * 100.0 / F.col("total")).alias("pct"), (F.col("count") * 100.0 / F.col("p_count")).alias("pct_of_parent"))


def subcorpus_sizes(low: Lowering, fields: list[Field]) -> DataFrame | None:
    """Tokens of the regions with each key, if all fields are attributes (or their dates) of one region type."""
    kinds = []
    for f in fields:
        if f.label or not set(f.calls) <= set(scalar.DATES):
            return None
        found = low.c.split_name(f.attr) if f.attr not in low.c.attrs else None
        if not found:
            return None
        kinds.append(found)
    if len({k for k, _ in kinds}) != 1:
        return None
    r = low.c.regions[kinds[0][0]]
    cols = []
    for k, (f, (_, attr)) in enumerate(zip(fields, kinds)):
        c = F.col(f"`{attr}`")
        for name in reversed(f.calls):
            c = scalar.DATES[name](c)
        cols.append(text_of(c).alias(f"f{k}"))
    return r.select(*cols, (F.col("end_pos") - F.col("start_pos") + 1).alias("n")).groupBy(*[f"f{k}" for k in range(len(fields))]).agg(F.sum("n").alias("subcorpus_size"))


def freq(low: Lowering, m: Matches, fields: list[Field], settings: Settings) -> DataFrame:
    """key, count, pct, ipm; with subcorpus_size and rf_pct if the fields name parts of the corpus."""
    df, names = field_columns(low, m, fields)
    keys = named_columns(fields)
    rows = _exploded(low, df, fields, settings)
    out = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("count"))
    total = out.agg(F.sum("count").alias("total")) if rows is df else df.agg(F.count(F.lit(1)).alias("total"))
    total = total.crossJoin(low.c.size_row())  # one row
    sizes = subcorpus_sizes(low, fields)
    more = []
    if sizes is not None:
        out = out.join(sizes, names)
        more = ["subcorpus_size", (F.col("count") * 100.0 / F.col("subcorpus_size")).alias("rf_pct")]
    base = F.col("subcorpus_size") if sizes is not None else F.col("size")
    out = out.crossJoin(F.broadcast(total))
    out = out.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "count", (F.col("count") * 100.0 / F.col("total")).alias("pct"), (F.col("count") * 1e6 / base).alias("ipm"), *more)
    return by_count(out, keys, settings)


def freq_compare(low: Lowering, sets: dict[str, Matches], fields: list[Field], settings: Settings) -> DataFrame:
    """Keys of all sets; for each set its count, pct and ipm."""
    union, totals = None, None
    for name, m in sets.items():
        df, names = field_columns(low, m, fields)
        one = df.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).withColumn("q", F.lit(name))
        union = one if union is None else union.unionByName(one)
        total = df.agg(F.count(F.lit(1)).alias(f"total_{name}"))
        totals = total if totals is None else totals.crossJoin(total)  # one row
    keys = named_columns(fields)
    out = union.groupBy(*names).agg(*[F.sum(F.when(F.col("q") == q, F.col("n")).otherwise(0)).alias(f"count_{q}") for q in sets])
    out = out.crossJoin(F.broadcast(totals.crossJoin(low.c.size_row())))
    cols = [F.col(n).alias(k) for n, k in zip(names, keys)]
    for q in sets:
        n = F.col(f"count_{q}")
        cols += [n, (n * 100.0 / F.nullif(F.col(f"total_{q}"), F.lit(0))).alias(f"pct_{q}"), (n * 1e6 / F.col("size")).alias(f"ipm_{q}")]
    return out.select(*cols)


def stats(low: Lowering, m: Matches, metrics: list, fields: list[Field]) -> DataFrame:
    """n_total, and for each metric n_valid and the average or exact median of the values that are numbers."""
    df, names = field_columns(low, m, fields + [f for _, f in metrics])
    groups, values = names[: len(fields)], names[len(fields) :]
    aggs = [F.count(F.lit(1)).alias("n_total")]
    for k, ((metric, _), v) in enumerate(zip(metrics, values), 1):
        x = scalar.number(F.col(v))
        aggs += [F.count(x).alias(f"n_valid{k}"), (F.avg(x) if metric == "avg" else F.median(x)).alias(f"{metric}{k}")]
    if not groups:
        return df.agg(*aggs)
    out = df.groupBy(*groups).agg(*aggs)
    return out.select(*[F.col(g).alias(k) for g, k in zip(groups, named_columns(fields))], *out.columns[len(groups) :])


# ---- collocation and keyness


def stopwords(low: Lowering, attr: str, n: int) -> DataFrame:
    counts = low.t.groupBy(F.col(f"`{attr}`").alias("word")).agg(F.count(F.lit(1)).alias("c"))
    return counts.orderBy(F.desc("c"), "word").limit(n).select("word")


def scored(low: Lowering, seen: DataFrame, attr: str, settings: Settings) -> DataFrame:
    """Association scores of (word, obs); the corpus frequencies of the seen words only are counted in."""
    node = seen.agg(F.sum("obs").alias("node")).crossJoin(low.c.size_row())  # one row
    freqs = low.t.groupBy(F.col(f"`{attr}`").alias("word")).agg(F.count(F.lit(1)).alias("freq"))
    out = seen.where(F.col("obs") >= settings.min_freq).join(freqs, "word")
    if settings.stoplist:
        out = out.join(F.broadcast(stopwords(low, attr, settings.stoplist)), "word", "left_anti")  # stoplist rows at most
    out = out.crossJoin(F.broadcast(node))
    out = out.select("word", "obs", "freq", *[F.round(measures.association(x, F.col("obs"), F.col("node"), F.col("freq"), F.col("size")), 3).alias(x) for x in settings.measures])
    out = out.orderBy(F.desc(settings.measures[0]), "word")
    return out.limit(settings.max_items) if settings.max_items else out


def coll(low: Lowering, m: Matches, attr: str, settings: Settings, on: str = "") -> DataFrame:
    """Collocates in the window around the match, or around a label; matched tokens don't count."""
    if m.context is not None:
        return scored(low, _read_window(low, m, attr, settings, on), attr, settings)
    a, z = (F.col("lo"), F.col("hi")) if not on else (F.col(low.start_of(m, on)),) * 2
    window = F.concat(F.sequence(a - settings.left, a - 1) if settings.left else F.array().cast("array<long>"), F.sequence(z + 1, z + settings.right) if settings.right else F.array().cast("array<long>"))
    df = m.df
    if on:
        slots = [c[1:] for c in df.columns if c[0] == "s" and c[1:].isdigit()]
        own = F.flatten(F.array(*[F.when(F.col(f"s{i}").isNotNull(), F.sequence(f"s{i}", f"e{i}")).otherwise(F.array().cast("array<long>")) for i in slots]))
        window = F.array_except(window, own)
    # equal windows are looked up once, with their number
    places = df.select(F.explode(window).alias("pos")).groupBy("pos").agg(F.count(F.lit(1)).alias("n"))
    word = F.col(f"`{attr}`")
    seen = places.join(low.t.select("pos", word.alias("word")), "pos").where("word <> ''").groupBy("word").agg(F.sum("n").alias("obs"))
    return scored(low, seen, attr, settings)


def _read_window(low: Lowering, m: Matches, attr: str, settings: Settings, on: str) -> DataFrame:
    """(word, obs) in the window around adjacent single tokens, off the scan that finds them: no join by position."""
    slots = sorted(int(c[1:]) for c in m.df.columns if c[0] == "s" and c[1:].isdigit())
    place = slots.index(low.label(m, on)[1]) if on and on != "match" else 0
    last = place if on else len(slots) - 1
    near = {*range(place - settings.left, place), *range(last + 1, last + settings.right + 1)} - set(range(len(slots)))
    if not near:
        return m.df.select(F.lit("").alias("word"), F.lit(0).alias("obs")).limit(0)
    df = m.context(max(0, -min(near)), max(0, max(near)), attr)
    words = df.select(F.explode(F.array(*[F.col(f"`_c{o}_{attr}`") for o in sorted(near)])).alias("word"))
    return words.where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("obs"))


def dcoll(low: Lowering, m: Matches, relations: list[str], attr: str, settings: Settings, on: str = "") -> DataFrame:
    """Collocates by the tree: head, children, descendants, or children with given relations (all children without any)."""
    low.tree()
    node = m.df.select(F.col(low.start_of(m, on)).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    t = low.t
    word = F.col(f"`{attr}`").alias("word")
    parts = []
    labels = [r for r in relations if r not in ("head", "children", "descendants")]
    if not relations or "children" in relations:
        parts.append(node.join(t.select(F.col("head_pos").alias("node"), word), "node"))
    if "head" in relations:
        heads = node.join(t.select(F.col("pos").alias("node"), F.col("head_pos").alias("h")), "node").where("h is not null")
        parts.append(heads.join(t.select(F.col("pos").alias("h"), word), "h").select("node", "n", "word"))
    if "descendants" in relations:
        tops = t.join(node.select(F.col("node").alias("pos")), "pos", "left_semi")
        below = low.under(tops, t)
        parts.append(node.join(below, F.col("node") == F.col("up")).join(t.select(F.col("pos").alias("down"), word), "down").select("node", "n", "word"))
    if labels:
        parts.append(node.join(t.where(F.col("deprel").isin(labels)).select(F.col("head_pos").alias("node"), word), "node"))
    both = parts[0].select("word", "n")
    for p in parts[1:]:
        both = both.union(p.select("word", "n"))
    return scored(low, both.where("word <> ''").groupBy("word").agg(F.sum("n").alias("obs")), attr, settings)


def keyness(low: Lowering, focus: Matches, reference: Matches | None, attr: str, settings: Settings) -> DataFrame:
    """Signed G2 of the focus's words against the reference, or against the rest of the corpus."""
    word = low.t.select(F.col("pos").alias("p"), F.col(f"`{attr}`").alias("word"))

    def counts(m: Matches, name: str) -> DataFrame:
        own = [c for c in m.df.columns if c[0] == "s" and c[1:].isdigit()]
        carried = low.at(m, own[0], attr) if len(own) == 1 else None
        words = low.positions(m).select("p").join(word, "p") if carried is None else m.df.select(carried.alias("word"))
        return words.groupBy("word").agg(F.count(F.lit(1)).alias(name))

    f = counts(focus, "focus_freq")
    if reference is None:
        whole = low.t.groupBy(F.col(f"`{attr}`").alias("word")).agg(F.count(F.lit(1)).alias("all"))
        both = f.join(whole, "word").select("word", "focus_freq", (F.col("all") - F.col("focus_freq")).alias("ref_freq"))
        sizes = f.agg(F.sum("focus_freq").alias("n1")).crossJoin(low.c.size_row()).select("n1", (F.col("size") - F.col("n1")).alias("n2"))  # one row
    else:
        r = counts(reference, "ref_freq")
        both = f.join(r, "word", "full").select("word", F.coalesce("focus_freq", F.lit(0)).alias("focus_freq"), F.coalesce("ref_freq", F.lit(0)).alias("ref_freq"))
        sizes = f.agg(F.sum("focus_freq").alias("n1")).crossJoin(r.agg(F.sum("ref_freq").alias("n2")))
    if settings.stoplist:
        both = both.join(F.broadcast(stopwords(low, attr, settings.stoplist)), "word", "left_anti")
    g2 = measures.keyness(F.col("focus_freq"), F.col("ref_freq"), F.col("n1"), F.col("n2"))
    out = both.crossJoin(F.broadcast(sizes)).where(F.col("focus_freq") + F.col("ref_freq") >= settings.min_freq).withColumn("g2", g2)
    out = out.select("word", "focus_freq", "ref_freq", (F.round("g2", 2) + 0.0).alias("keyness"), F.when(F.col("g2") < 0, "-").otherwise("+").alias("effect"), "g2").orderBy(F.desc("g2"), F.desc("focus_freq"), "word").drop("g2")
    return out.limit(settings.max_items) if settings.max_items else out


# ---- rows


def _row_order(df: DataFrame) -> list[str]:
    return ["lo", "hi", *[c for c in df.columns if c[0] in "ser" and c.lstrip("serp").isdigit()]]


def tabulate(low: Lowering, m: Matches, fields: list[Field], offset: int = 0, limit: int = 1000) -> DataFrame:
    """A row per match with the fields in columns field1, ...; a multivalue field as its sorted parts in JSON."""
    df, names = field_columns(low, m, fields)
    cols = []
    for k, (n, f) in enumerate(zip(names, fields), 1):
        as_set = not f.calls and f.attr in low.c.multivalue
        cols.append((F.to_json(scalar.components(F.col(n))) if as_set else F.col(n)).alias(f"field{k}"))
    df = df.orderBy(*_row_order(df))
    if offset:
        df = df.offset(offset)
    if limit:
        df = df.limit(limit)
    return df.select("lo", "hi", *cols)


def sort(low: Lowering, m: Matches, fields: list[Field]) -> DataFrame:
    """The matches in the order of the fields: numbers and Roman numerals first, then bytes."""
    df, names = field_columns(low, m, fields)
    order = []
    for n in names:
        order += [scalar.sort_number(F.col(n)).asc_nulls_last(), F.col(n)]
    return df.select("lo", "hi", *[F.col(n).alias(k) for n, k in zip(names, named_columns(fields))]).orderBy(*order, "lo", "hi")


def sample(m: Matches, n: int, seed: int = 0) -> Matches:
    """n matches at random."""
    return replace(m, df=m.df.orderBy(F.rand(seed)).limit(n))


def size(m: Matches) -> DataFrame:
    return m.df.agg(F.count(F.lit(1)).alias("size"))


def raw(low: Lowering, m: Matches, attr: str = "form") -> DataFrame:
    """Positions and forms of each match."""
    order = [c for c in _row_order(m.df) if c in m.df.columns]
    p = low.positions(m).select(*order, "p").join(low.t.select(F.col("pos").alias("p"), F.col(attr).alias("w")), "p")
    out = p.groupBy(*order).agg(F.array_sort(F.collect_list(F.struct("p", "w"))).alias("x"))
    return out.select("lo", "hi", F.col("x.p").alias("positions"), F.col("x.w").alias("tokens"))


def concordance(low: Lowering, m: Matches, settings: Settings, attrs: list[str] | None = None) -> DataFrame:
    """Left context, match and right context of a page of matches, by ``context`` tokens; missing values are left out of tokens."""
    order = [c for c in _row_order(m.df) if c in m.df.columns]
    page = m.df.orderBy(*order)
    if settings.offset:
        page = page.offset(settings.offset)
    page = page.limit(settings.limit) if settings.limit else page
    n = settings.context
    around = page.select(*order, F.explode(F.sequence(F.col("lo") - n, F.col("hi") + n)).alias("pos"))
    attrs = attrs or low.c.attrs
    info = F.map_filter(F.create_map(*[x for a in attrs for x in (F.lit(a), F.col(f"`{a}`"))]), lambda _, v: scalar.present(v))
    t = low.t.select("pos", "text_idx", *[F.col(f"`{a}`") for a in dict.fromkeys(["form", *attrs])])
    x = around.join(t, "pos").withColumn("info", info).groupBy(*order).agg(F.array_sort(F.collect_list(F.struct("pos", "form", F.to_json("info").alias("info")))).alias("x"), F.min("text_idx").alias("doc_id"))
    part = lambda cond: F.array_join(F.transform(F.filter("x", cond), lambda e: e["form"]), " ")
    return x.select(
        "doc_id", F.col("lo").alias("match_start"), F.col("hi").alias("match_end"), part(lambda e: e["pos"] < F.col("lo")).alias("left"), part(lambda e: (e["pos"] >= F.col("lo")) & (e["pos"] <= F.col("hi"))).alias("match"),
        part(lambda e: e["pos"] > F.col("hi")).alias("right"), F.transform(F.filter("x", lambda e: (e["pos"] >= F.col("lo")) & (e["pos"] <= F.col("hi"))), lambda e: e["info"]).alias("tokens"),
    )


def kwic(low: Lowering, m: Matches, settings: Settings, width: int = 40) -> DataFrame:
    """Text lines: the last ``width`` characters of the left and the first of the right context."""
    c = concordance(low, m, settings, ["form"])
    left = F.lpad(F.substring(F.col("left"), -width, width), width, " ")
    return c.select("match_start", "match_end", F.concat(left, F.lit(" <! "), F.col("match"), F.lit(" !> "), F.substring("right", 1, width)).alias("line"))


def sentences(low: Lowering, m: Matches, settings: Settings) -> DataFrame:
    """The sentence of each match of a page in CoNLL-U, with the matched tokens' numbers in a comment."""
    order = [c for c in _row_order(m.df) if c in m.df.columns]
    page = m.df.orderBy(*order).limit(settings.limit) if settings.limit else m.df
    page = page.select(*order).join(low.t.select(F.col("pos").alias("lo"), F.col("s_idx").alias("_s")), "lo")
    cols = [F.coalesce(F.col(c), F.lit("_")) if c in low.c.attrs else F.lit("_") for c in ("form", "lemma", "upos", "xpos", "feats")]
    own = low.t.join(page.select(F.col("_s").alias("s_idx")).distinct(), "s_idx", "left_semi")
    nr = F.row_number().over(W.partitionBy("s_idx").orderBy("pos"))
    own = own.withColumn("nr", nr)
    if low.c.has_tree:
        heads = own.select(F.col("pos").alias("head_pos"), F.col("nr").alias("head_nr"))
        own = own.join(heads, "head_pos", "left").withColumn("head", F.coalesce("head_nr", F.lit(0)).cast("string"))
    else:
        own = own.withColumn("head", F.lit("_"))
    rel = F.col("deprel") if "deprel" in low.c.attrs else F.lit("_")
    line = F.concat_ws("\t", F.col("nr").cast("string"), *cols, F.col("head"), rel, F.lit("_"), F.lit("_"))
    s = own.groupBy("s_idx").agg(F.array_sort(F.collect_list(F.struct("pos", "nr", line.alias("line")))).alias("x"))
    out = page.join(s, F.col("_s") == F.col("s_idx"))
    hits = F.array_join(F.transform(F.filter("x", lambda e: (e["pos"] >= F.col("lo")) & (e["pos"] <= F.col("hi"))), lambda e: e["nr"].cast("string")), ",")
    return out.select("lo", "hi", F.concat(F.lit("# match_tokens = "), hits, F.lit("\n"), F.array_join(F.transform("x", lambda e: e["line"]), "\n"), F.lit("\n")).alias("conllu"))


def pairs(low: Lowering, m: Matches) -> DataFrame:
    """Parallel hits: the extents of both sides, a row for each pair."""
    if m.target is None:
        raise QueryError("not a parallel set")
    return m.df.select(F.col("lo").alias("source_start"), F.col("hi").alias("source_end"), F.col("t_lo").alias("target_start"), F.col("t_hi").alias("target_end"))


def combine(op: str, a: Matches, b: Matches) -> DataFrame:
    """Set operations on the extents of two sets."""
    x, y = (m.df.select("lo", "hi").distinct() for m in (a, b))
    return {"union": lambda: x.union(y).distinct(), "intersect": lambda: x.intersect(y), "diff": lambda: x.exceptAll(y)}[op]()


# ---- catalogue


def show_values(low: Lowering, attr: str, settings: Settings) -> DataFrame:
    """Values of an attribute with their counts; parts of multivalue ones."""
    kind, a, b = low.kind_of(attr)
    df, c = (low.c.regions[a], F.col(f"`{b}`")) if kind == "region" else (low.t, scalar.feature(F.col(a), b) if kind == "feature" else F.col(f"`{a}`"))
    value = F.explode(scalar.components(c)) if attr in low.c.multivalue else c
    out = df.select(value.alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("count"))
    return by_count(out, ["key"], settings).withColumnRenamed("key", "value")


def show_regions(low: Lowering, kind: str) -> DataFrame:
    if not kind:
        out = None
        for k, r in low.c.regions.items():
            one = r.agg(F.lit(k).alias("type"), F.count(F.lit(1)).alias("regions"))
            out = one if out is None else out.union(one)
        return out
    attrs = low.c.region_attrs.get(kind, [])
    return low.c.regions[kind].select("region_idx", F.col("start_pos").alias("start"), F.col("end_pos").alias("end"), F.greatest(F.col("end_pos") - F.col("start_pos") + 1, F.lit(0)).alias("tokens"), *attrs)


def show_attributes(low: Lowering) -> DataFrame:
    rows = [("token", a, a in low.c.multivalue) for a in low.c.attrs] + [("region", f"{k}_{a}", f"{k}_{a}" in low.c.multivalue) for k, names in low.c.region_attrs.items() for a in names]
    return low.c.spark.createDataFrame(rows, "kind string, name string, multivalue boolean")


def show_info(low: Lowering) -> DataFrame:
    return low.c.size_row().withColumns({"attributes": F.lit(len(low.c.attrs)), "region_types": F.lit(len(low.c.regions)), "tree": F.lit(low.c.has_tree), "default_within": F.lit(low.c.default_within)})
