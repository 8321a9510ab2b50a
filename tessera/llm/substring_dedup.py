"""Substring dedup by hashing lines and their sentences.

Units are the lines of a text and, inside a line of several, its sentences (up to a run of
``.``, ``!``, ``?``); units of fewer than ``LEAST`` words don't count. A unit is normalised to its
lower-cased words without punctuation and identified by a 128-bit digest of them. Digests
are grouped over all documents (partial aggregates); the occurrence with the smallest
(doc_id, start) stays, all others are removed, with their original offsets in code points.

A digest shared by a large part of all rows is one row after aggregation; the join back to
its occurrences is an equi-join whose hot partitions are split at run time (adaptive skew join), and
nothing is gathered per digest.

Edge cases: null, empty and wordless texts have no units; a unit that repeats inside one text keeps its first
place; repeated rows of one id count as one document (its own copy of a unit isn't removed,
each row reports the rest); a null id ranks first; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _power, alnum_class, blocks, fresh, mix, word_bounds, word_hashes

LEAST = 5
LUT = alnum_class()
SCHEMA = "d1 long, d2 long, doc_id long, unit int, start long, end long, n_words long"
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?\n"]] = True


def units(data: np.ndarray, offs: np.ndarray, least: int = LEAST):
    """(document, kind, start, end, words, digest halves) of a block's units; kind 0 line, 1 sentence; offsets in code points."""
    n = len(data)
    starts, ends, _ = word_bounds(data, offs, LUT)
    h = word_hashes(data, starts, ends)
    power, inverse = _power(len(h) + 1)
    sums = []
    for own in (h, mix(h ^ np.uint64(0x5851F42D4C957F2D))):
        s = np.zeros(len(h) + 1, dtype=np.uint64)
        np.cumsum(own * power[: len(h)], out=s[1:])
        sums.append(s)
    stop, line_end = _STOP[data], data == 10
    edge = np.zeros(n + 1, dtype=bool)
    edge[offs] = True
    after_line = edge.copy()
    after_line[1:] |= line_end
    after_stop = edge.copy()
    after_stop[1:n] |= stop[:-1] & ~stop[1:]
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    whole = {}
    out = []
    for kind, marks in ((0, after_line), (1, after_stop)):
        cut = np.flatnonzero(marks)
        a, b = cut[:-1], cut[1:]
        first = np.searchsorted(starts, cut)
        wa, wb = first[:-1], first[1:]
        count = wb - wa
        ok = count >= least
        if kind == 0:
            whole["first"], whole["count"] = first, count
        else:
            line = np.searchsorted(whole["first"], wa, side="right") - 1
            ok &= whole["count"][np.minimum(line, len(whole["count"]) - 1)] > count if len(count) else ok
        a, b, wa, wb, count = a[ok], b[ok], wa[ok], wb[ok], count[ok]
        doc = np.searchsorted(offs, a, side="right") - 1
        d = [mix((s[wb] - s[wa]) * inverse[wa] + count.astype(np.uint64)).view(np.int64) for s in sums]
        base = points[offs[doc]]
        out.append((doc, np.full(len(doc), kind, np.int32), points[a] - base, points[b] - base, count, *d))
    return [np.concatenate(x) for x in zip(*out)]


def unit_table(documents: DataFrame, least: int = LEAST) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for i, _, data, offs in blocks(batch.column(1)):
                doc, kind, start, end, count, d1, d2 = units(data, offs, least)
                yield pa.RecordBatch.from_arrays([pa.array(d1), pa.array(d2), ids.take(pa.array(i + doc)), pa.array(kind), pa.array(start), pa.array(end), pa.array(count)], ["d1", "d2", "doc_id", "unit", "start", "end", "n_words"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def repeated_units(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """One row per removed unit: where it is and which earlier occurrence stays."""
    u = unit_table(documents, least)
    place = F.struct("doc_id", "start")
    kept = u.groupBy("d1", "d2").agg(F.min(place).alias("kept"), F.max(place).alias("last")).where("kept <> last").select(F.col("d1").alias("k1"), F.col("d2").alias("k2"), "kept")
    found = u.join(kept, (F.col("d1") == F.col("k1")) & (F.col("d2") == F.col("k2"))).where(~place.eqNullSafe(F.col("kept")))
    return found.select("doc_id", F.when(F.col("unit") == 0, "line").otherwise("sentence").alias("unit"), "start", "end", "n_words", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.start").alias("kept_start"))


def without_repeats(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """The documents without their repeated units; spans of one document are gathered, never more."""
    own, cuts = fresh(documents, "id", "spans")
    spans = repeated_units(documents, least).groupBy(F.col("doc_id").alias(own)).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias(cuts))
    names = documents.columns
    joined = documents.join(spans, F.col("doc_id").cast("long").eqNullSafe(F.col(own)), "left").select(*documents.columns, cuts)
    at = names.index("text")
    count = names.index("n_chars") if "n_chars" in names else -1

    def run(batches):
        for batch in batches:
            old, new = batch.column(at).to_pylist(), []
            for text, spans in zip(old, batch.column(len(names)).to_pylist()):
                if text is not None and spans:
                    parts, done = [], 0
                    for s in spans:
                        if s["start"] > done:
                            parts.append(text[done : s["start"]])
                        done = max(done, s["end"])
                    text = "".join(parts) + text[done:]
                new.append(text)
            cols = list(batch.columns)[: len(names)]
            cols[at] = pa.array(new, pa.string())
            if count >= 0:
                n = cols[count].to_pylist()
                cols[count] = pa.array([len(b) if a is not b and a != b else k for a, b, k in zip(old, new, n)], cols[count].type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return joined.mapInArrow(run, documents.schema)


_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOW + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = rf"""
with d as (select doc_id, text, row_number() over () as rid from documents where text is not null and text <> ''),
ls as (
  select rid, doc_id, k, part, sum(length(part) + 1) over (partition by rid order by k) - length(part) - 1 as start, length(text) as n
  from (select rid, doc_id, text, unnest(string_split(text, chr(10))) as part, generate_subscripts(string_split(text, chr(10)), 1) as k from d)
), l as (
  select rid, doc_id, k, 'line' as unit, start, least(start + length(part) + 1, n) as "end", {_WORDS.format('part')} as w from ls
), ts as (
  select rid, doc_id, part, sum(length(part)) over (partition by rid order by k) - length(part) as start,
         coalesce(sum(length(part) - length(replace(part, chr(10), ''))) over (partition by rid order by k rows between unbounded preceding and 1 preceding), 0) + 1 as line
  from (select rid, doc_id, unnest(regexp_extract_all(text, '[^.!?\n]+[.!?\n]*|[.!?\n]+')) as part, generate_subscripts(regexp_extract_all(text, '[^.!?\n]+[.!?\n]*|[.!?\n]+'), 1) as k from d)
), t as (
  select ts.rid, ts.doc_id, 'sentence' as unit, ts.start, ts.start + length(part) as "end", {_WORDS.format('part')} as w, len(l.w) as line_words
  from ts join l on l.rid = ts.rid and l.k = ts.line
), u as (
  select doc_id, unit, start, "end", w from l where len(w) >= {LEAST}
  union all select doc_id, unit, start, "end", w from t where len(w) >= {LEAST} and len(w) < line_words
), v as (
  select *, array_to_string(w, ' ') as norm from u
), k as (
  select norm, min((coalesce(doc_id, -9223372036854775808), start)) as kept from v group by norm having count(*) > 1
)
select doc_id, unit, start::bigint as start, "end"::bigint as "end", len(w)::bigint as n_words, kept[1]::bigint as kept_doc_id, kept[2]::bigint as kept_start
from v join k using (norm) where (coalesce(doc_id, -9223372036854775808), start) <> kept
"""
