"""Mixing sources to target weights by weighted fair queueing.

Each source's documents stand in a shuffled order (md5 of id and text), over up to ``EPOCHS`` rounds. A document is queued in
pieces that end at its own end and at every multiple of its source's quantum (1 / ``QUANTA`` of the target, a word at least). A piece's virtual finish
time is the source's words up to its end, divided by the source's target weight (its target size). All pieces are sorted by (finish time, source) and served until
their running total reaches the total budget; the last one is cut there. What a source has been served by then is what its documents give, in
their order. So each source comes within a quantum of its target, and the total is the budget to the word.

No running sum puts a source or the queue in one task: a source is cut into pieces by the first bits of the shuffle key,
in proportion to the number of rows, the queue into equal spans of virtual time (service is even in it); sums of pieces and spans are partial aggregates, and only sums are
accumulated over a whole source or the queue. ``mix_documents`` range-sorts the texts by virtual finish time.

Edge cases: null text has size 0; sources without words have target 0; null is a source,
the last; rows of a repeated (or null) id go by their texts, only rows equal in both
are interchangeable (they share a key, and so a task); empty tables give no rows; extra columns are left out, or kept in the mix unless they clash with its own.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
#: Quanta of a source's target, and about how many rows are accumulated in one window.
QUANTA = 4096
PIECE_ROWS = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Water filling in closed form: sources in the order of cap over weight are capped as long
    as the level of those that follow is above their ratio. One row per source, so the
    windows without partitions see a table of sources, never documents.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("at", F.row_number().over(by_name))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("at") - 1) % len(weights) + 1).cast("int"))
    s = s.withColumn("weight", weight).withColumn("cap", F.col("source_size") * epochs)
    order = W.orderBy(F.col("cap") / F.col("weight"), "at")
    everything = W.partitionBy(F.lit(1))
    s = s.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(0, W.unboundedFollowing)
    s = s.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("open", F.sum("weight").over(after))
    # the level if this source and all later ones are open
    s = s.withColumn("level_num", F.col("budget") - F.col("capped"))
    fits = F.col("level_num") * F.col("weight") <= F.col("cap") * F.col("open")
    first = F.min(F.when(fits, F.struct(F.col("cap") / F.col("weight"), F.col("at"), F.col("level_num"), F.col("open")))).over(everything)
    s = s.withColumn("first", first)
    level = F.col("first.level_num") * F.col("weight") / F.col("first.open")
    return s.select("source", "source_size", F.when(F.col("first").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), level)).alias("target"))


def _positions(documents: DataFrame, weights, share, epochs, payload=()) -> DataFrame:
    """The documents with size, their source's size and target, and the source's words before them in shuffled order.

    The running sum and the pieces' offsets use one partitioning, by (source, piece).
    """
    bits = min(max(math.ceil(math.log2(max(documents.count(), 1) / PIECE_ROWS)), 4), 28)
    d = documents.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    d = d.withColumn("key", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary")))
    d = d.select("doc_id", "source", "size", "key", *payload)
    d = d.withColumn("skey", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("t"))).withColumn("piece", F.shiftright(F.conv(F.substring("key", 1, 7), 16, 10).cast("int"), 28 - bits))
    pieces = d.groupBy("skey", "piece").agg(F.sum("size").alias("piece_size"))
    sources = pieces.groupBy("skey").agg(F.sum("piece_size").alias("source_size")).withColumn("source", F.when(F.col("skey") != "t", F.substring("skey", 2, 2**31 - 1)))
    goal = targets(sources, weights, share, epochs).select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("t")).alias("skey"), "source_size", "target")
    running = W.partitionBy("skey").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    pieces = pieces.withColumn("offset", F.coalesce(F.sum("piece_size").over(running), F.lit(0))).join(goal, "skey").select("skey", "piece", "offset", "source_size", "target")
    within = W.partitionBy("skey", "piece").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return d.join(pieces, ["skey", "piece"]).withColumn("before", F.col("offset") + F.col("inside"))


def _served(positions: DataFrame, epochs: int, share: float) -> DataFrame:
    """(skey, served): the words that each source has been served when the total budget is used up."""
    d = positions.where("size > 0 and target > 0").select("skey", "before", "size", "source_size", "target", F.explode(F.array(*map(F.lit, range(epochs)))).alias("epoch"))
    start = F.col("before") + F.col("source_size") * F.col("epoch")
    d = d.select("skey", "target", start.alias("start"), (start + F.col("size")).alias("end"), F.greatest(F.lit(1), F.floor(F.col("target") / QUANTA)).alias("quantum"))
    d = d.withColumn("k", F.explode(F.sequence(F.floor(F.col("start") / F.col("quantum")), F.floor((F.col("end") - 1) / F.col("quantum")))))
    d = d.select("skey", F.greatest("start", F.col("k") * F.col("quantum")).alias("start"), F.least("end", (F.col("k") + 1) * F.col("quantum")).alias("end"), "target")
    d = d.withColumn("words", F.col("end") - F.col("start")).withColumn("finish", F.col("end") / F.col("target"))
    size, n = positions.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    budget = int(size * share)
    d = d.withColumn("span", F.floor(F.col("finish") * F.lit(float(max(1, n // PIECE_ROWS)))))
    sums = d.groupBy("span").agg(F.sum("words").alias("span_words"))
    sums = sums.select("span", F.coalesce(F.sum("span_words").over(W.orderBy("span").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    d = d.withColumn("inside", F.coalesce(F.sum("words").over(W.partitionBy("span").orderBy("finish", "skey").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    left = F.lit(budget) - F.col("earlier") - F.col("inside")
    served = d.join(sums, "span").where(left > 0).groupBy("skey").agg(F.max(F.col("start") + F.least("words", left)).alias("served"))
    return served


def _mixed(documents: DataFrame, weights, share, epochs, payload=()) -> DataFrame:
    """Documents with positions and what their source is served; narrow positions decide, the payload joins the decision's few rows."""
    narrow = checkpoint(_positions(documents, weights, share, epochs))
    served = checkpoint(_served(narrow, epochs, share))
    d = _positions(documents, weights, share, epochs, payload) if payload else narrow
    return d.join(served, "skey", "left").withColumn("served", F.coalesce("served", F.lit(0)))


def mixture(documents: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """One row per document with the words that the mix takes of it."""
    d = _mixed(documents, weights, share, epochs)
    rounds = [F.greatest(F.lit(0), F.least(F.col("size"), F.col("served") - F.col("before") - F.col("source_size") * k)) for k in range(epochs)]
    finish = F.when(F.col("target") > 0, (F.col("before") + F.col("size")) / F.col("target"))
    return d.select("doc_id", "size", "source_size", "target", sum(rounds[1:], rounds[0]).cast("long").alias("taken"), finish.alias("finish"))


def mix_documents(documents: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """The mix itself, range-sorted by virtual finish time: a document once for each epoch in which it is
    taken; ``words`` is less than its size only where the budget cuts the text, which then ends there."""
    own = ("doc_id", "source", "text", "n_chars", "size", "key", "skey", "piece", "inside", "offset", "source_size", "target", "before", "served", "epoch", "finish", "words")
    rest = [c for c in documents.columns if c.lower() not in own]
    d = _mixed(documents, weights, share, epochs, ["text", *rest])
    d = d.withColumn("epoch", F.explode(F.array(*map(F.lit, range(epochs)))))
    start = F.col("before") + F.col("source_size") * F.col("epoch")
    d = d.withColumn("words", F.greatest(F.lit(0), F.least(F.col("size"), F.col("served") - start)).cast("long")).where("words > 0")
    d = d.withColumn("finish", (start + F.col("words")) / F.col("target"))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col("words").cast("int")), "")
    d = d.withColumn("text", F.when(F.col("words") < F.col("size"), cut).otherwise(F.col("text")))
    return d.select("doc_id", "source", "epoch", "finish", "words", "text", *rest, F.length("text").cast("long").alias("n_chars")).orderBy("finish", "source", "doc_id", "epoch")


ORACLE = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, md5(coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) as key
  from documents
), s as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as nr from d group by source
), w as (
  select *, case (nr - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight, source_size * 2 as cap, (sum(source_size) over ())::double * 1.5 as budget from s
), l as (
  select *, budget - coalesce(sum(cap) over (order by cap / weight, nr rows between unbounded preceding and 1 preceding), 0)::double as level_num,
         (sum(weight) over (order by cap / weight, nr rows between current row and unbounded following))::bigint as open
  from w
), f as (
  select level_num, open from l where level_num * weight <= (cap * open)::double order by cap / weight, nr limit 1
), t as (
  select source, source_size, coalesce(least(cap::double, f.level_num * weight / f.open), cap::double) as target from w left join f on true
), p as (
  select d.*, t.source_size, t.target,
         coalesce(sum(size) over (partition by d.source order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as before
  from d join t on d.source is not distinct from t.source
), i as (
  select source, target, before + source_size * e as s, before + source_size * e + size as t, greatest(1, floor(target / 4096)::bigint) as q
  from p, (select unnest([0, 1]) as e) where size > 0 and target > 0
), j as (
  select source, target, s, t, q, unnest(range(s // q, (t - 1) // q + 1)) as k from i
), r as (
  select source, greatest(s, k * q) as s, least(t, (k + 1) * q) as t, least(t, (k + 1) * q) / target as finish from j
), c as (
  select source, s, t, finish, (select floor(sum(size) * 1.5)::bigint from d) - coalesce(sum(t - s) over (order by finish, source nulls last rows between unbounded preceding and 1 preceding), 0)::bigint as free from r
), v as (
  select source, max(s + least(t - s, free)) as served from c where free > 0 group by source
)
select doc_id, size, source_size, target,
       (greatest(0, least(size, coalesce(served, 0) - before)) + greatest(0, least(size, coalesce(served, 0) - before - source_size)))::bigint as taken,
       case when target > 0 then (before + size) / target end as finish
from p left join v on p.source is not distinct from v.source
"""
