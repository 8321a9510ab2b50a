"""Benchmark decontamination by an FM-index per training shard.

A shard is a run of whole documents inside a task. Its words are coded by the vocabulary of
the test windows; a maximal run of words outside it is one separator, since no window can
cross it, and a run of vocabulary words shorter than the shortest window is left out for the
same reason. Over that coded text the shard builds a suffix order by prefix doubling, its Burrows-Wheeler transform in a wavelet matrix with block
ranks, and every ``SAMPLE``-th suffix position. All windows are searched backwards at once;
each row of the final ranges is walked to a sampled suffix position; spans are merged by a
difference array over the document's words.

The benchmark is the stated query set: its distinct windows (10 hashes each, with their items) are made by the driver and travel to every task
whole, so it has to fit there. A shard's index is built once; the windows are searched in it block by block, ``WINDOW_BLOCK`` at
once, which bounds the search's own arrays.

Edge cases: null or wordless texts give zero counts and the digest of the empty string;
null and wordless items give no window; items of the same id are one item; an item without
id still marks words but isn't listed; repeated document rows each give a row; an empty
benchmark or table works; other columns don't matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_class, blocks, segment_sums, word_bounds, word_hashes

WINDOW = 10
SHARD_BYTES = 1 << 20
SAMPLE = 16
WINDOW_BLOCK = 200_000
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
LUT = alnum_class()


# ---- the index -------------------------------------------------------------------------


def suffix_order(codes: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes; each separator (0) is a symbol of its own.

    Prefix doubling in which only positions that still tie are sorted again, so the rounds
    follow the longest repeat between separators and later rounds touch repeats alone.
    """
    n = len(codes)
    small = codes.astype(np.uint16) if n and codes.max() < 1 << 16 else codes
    order = np.argsort(small, kind="stable")
    s = codes[order]
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = (s[1:] != s[:-1]) | (s[1:] == 0)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    last = np.concatenate((fresh[1:], [True]))
    tied, h = np.flatnonzero(~(fresh & last)), 1
    while len(tied):
        pos = order[tied]
        key = rank[pos] * (n + 1) + rank[np.minimum(pos + h, n - 1)]
        by = np.argsort(key)
        pos, key = pos[by], key[by]
        order[tied] = pos
        fresh = np.ones(len(tied), dtype=bool)
        fresh[1:] = key[1:] != key[:-1]
        rank[pos] = tied[np.maximum.accumulate(np.where(fresh, np.arange(len(tied)), 0))]
        last = np.concatenate((fresh[1:], [True]))
        tied, h = tied[~(fresh & last)], 2 * h
    return order


class Bits:
    """A bit vector with ranks from counts per 64-bit word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.zeros((n + 63) // 64 * 8 + 8, dtype=np.uint8)
        own = np.packbits(bits, bitorder="little")
        packed[: len(own)] = own
        self.words = packed.view(np.uint64)
        self.counts = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before i."""
        w = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[w] + np.bitwise_count(self.words[w] & low)


class FMIndex:
    """codes: symbols from 1, with the separator 0 at both ends and between any two runs."""

    def __init__(self, codes: np.ndarray, n_codes: int):
        self.n = n = len(codes)
        order = suffix_order(codes)
        bwt = codes[order - 1]
        self.before = np.concatenate(([0], np.cumsum(np.bincount(codes, minlength=n_codes))))
        self.levels = max(1, int(n_codes - 1).bit_length())
        self.matrix, self.zeros = [], []
        cur = bwt
        for level in range(self.levels - 1, -1, -1):
            bit = (cur >> level) & 1 == 1
            self.matrix.append(Bits(bit))
            self.zeros.append(n - int(np.count_nonzero(bit)))
            cur = np.concatenate((cur[~bit], cur[bit]))
        marked = (order % SAMPLE == 0) | (bwt == 0)  # no walk crosses a separator
        self.marked, self.samples = Bits(marked), order[marked]
        self.mark_bits, self.bwt = marked, bwt

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol in the transform before i."""
        lo, hi = np.zeros_like(i), i
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            one = (symbol >> level) & 1 == 1
            a, b = self.matrix[k].rank(lo), self.matrix[k].rank(hi)
            lo = np.where(one, self.zeros[k] + a, lo - a)
            hi = np.where(one, self.zeros[k] + b, hi - b)
        return hi - lo

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of all patterns (rows, padded on the right) by backward search."""
        lo = np.zeros(len(patterns), dtype=np.int64)
        hi = np.full(len(patterns), self.n, dtype=np.int64)
        live = np.arange(len(patterns))
        for back in range(patterns.shape[1]):
            at = lengths[live] - 1 - back
            go = (at >= 0) & (hi[live] > lo[live])
            live, at = live[go], at[go]
            if not len(live):
                break
            c = patterns[live, at]
            ok = c > 0
            hi[live[~ok]] = lo[live[~ok]] = 0
            live, c = live[ok], c[ok]
            base = self.before[c]
            lo[live], hi[live] = base + self.rank(c, lo[live]), base + self.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, walked back to sampled ones."""
        out = np.zeros(len(rows), dtype=np.int64)
        live, cur, steps = np.arange(len(rows)), rows.copy(), 0
        while len(live):
            got = self.mark_bits[cur]
            out[live[got]] = self.samples[self.marked.rank(cur[got])] + steps
            live, cur = live[~got], cur[~got]
            c = self.bwt[cur]
            cur = self.before[c] + self.rank(c, cur)
            steps += 1
        return out


# ---- windows of the benchmark ----------------------------------------------------------


def benchmark_windows(items: list[tuple[str | None, str | None]], size: int = WINDOW):
    """Distinct windows as rows of word hashes (0 pads), their lengths, and for each the items with it."""
    seen: dict[tuple, set] = {}
    for item_id, text in items:
        for i, j, data, offs in blocks(pa.array([text or ""])):
            starts, ends, _ = word_bounds(data, offs, LUT)
            h = word_hashes(data, starts, ends).tolist()
            if h:
                for k in range(max(1, len(h) - size + 1)):
                    seen.setdefault(tuple(h[k : k + size]), set()).add(item_id)
    rows = np.zeros((len(seen), size), dtype=np.uint64)
    lengths = np.zeros(len(seen), dtype=np.int64)
    for r, w in enumerate(seen):
        rows[r, : len(w)] = w
        lengths[r] = len(w)
    return rows, lengths, [sorted(x for x in v if x is not None) for v in seen.values()]


class Shard:
    """The index of a shard's words, coded by the vocabulary of all windows; it serves any number of blocks of windows."""

    def __init__(self, h: np.ndarray, first: np.ndarray, vocab: np.ndarray, least: int):
        self.n, self.first, self.vocab, self.index = len(h), first, vocab, None
        if not len(vocab) or not len(h):
            return
        at = np.searchsorted(vocab, h)
        at[at == len(vocab)] = 0
        code = np.where(vocab[at] == h, at + 1, 0).astype(np.int32)
        # separators: words outside the vocabulary, and the ends of documents
        cuts = first[1:-1][(first[1:-1] > 0) & (first[1:-1] < len(h))]
        brk = np.zeros(len(h) + 1, dtype=bool)
        brk[cuts] = True
        inside = code > 0
        starts = np.flatnonzero(inside & (np.concatenate(([True], ~inside[:-1])) | brk[:-1]))
        ends = np.flatnonzero(inside & (np.concatenate((~inside[1:], [True])) | brk[1:])) + 1
        keep = ends - starts >= least
        starts, ends = starts[keep], ends[keep]
        if not len(starts):
            return
        size = ends - starts
        place = np.concatenate(([1], 1 + np.cumsum(size + 1)))  # where each run begins in the index's text
        text = np.zeros(int(place[-1]), dtype=np.int32)
        self.where = np.zeros(int(place[-1]), dtype=np.int64)
        run = np.repeat(np.arange(len(starts)), size)
        offset = np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)
        text[place[run] + offset] = code[starts[run] + offset]
        self.where[place[run] + offset] = starts[run] + offset
        self.index = FMIndex(text, len(vocab) + 1)

    def hits(self, rows: np.ndarray, lengths: np.ndarray):
        """Hit flags of the shard's words, and (document, window) pairs of windows that occur."""
        hit = np.zeros(self.n + 1, dtype=np.int64)
        none = np.zeros(0, dtype=np.int64)
        if self.index is None or not len(rows):
            return hit[:-1] > 0, none, none
        spot = np.minimum(np.searchsorted(self.vocab, rows), len(self.vocab) - 1)
        lo, hi = self.index.search(np.where(self.vocab[spot] == rows, spot + 1, 0), lengths)
        n = hi - lo
        which = np.repeat(np.arange(len(rows)), n)
        if not len(which):
            return hit[:-1] > 0, none, none
        suffix = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        pos = self.where[self.index.locate(suffix)]
        np.add.at(hit, pos, 1)
        np.add.at(hit, pos + lengths[which], -1)
        doc = np.searchsorted(self.first, pos, side="right") - 1
        pairs = np.unique(doc * len(rows) + which)
        return np.cumsum(hit)[:-1] > 0, pairs // len(rows), pairs % len(rows)


def vocabulary(windows) -> tuple[np.ndarray, int]:
    """The words of all windows, sorted, and the length of the shortest window."""
    rows, lengths, _ = windows
    return np.unique(rows[np.arange(rows.shape[1])[None, :] < lengths[:, None]]), int(lengths.min()) if len(lengths) else 0


def window_blocks(windows, most: int = WINDOW_BLOCK):
    rows, lengths, items = windows
    for k in range(0, len(rows), most):
        yield rows[k : k + most], lengths[k : k + most], items[k : k + most]


def shard_results(array: pa.Array, windows, words: tuple[np.ndarray, int], shard_bytes: int = SHARD_BYTES):
    """For each shard of the array: first row, word bounds, hit flags, and each document's items. words: the windows' vocabulary."""
    for i, j, data, offs in blocks(array, shard_bytes):
        starts, ends, first = word_bounds(data, offs, LUT)
        h = word_hashes(data, starts, ends)
        hit = np.zeros(len(h), dtype=bool)
        items: dict[int, set] = {}
        shard = Shard(h, first, *words)
        for part in window_blocks(windows):
            flags, docs, which = shard.hits(*part[:2])
            hit |= flags
            for d, w in zip(docs.tolist(), which.tolist()):
                items.setdefault(d, set()).update(part[2][w])
        yield i, j, data, offs, starts, ends, first, hit, items


def collect_windows(benchmark: DataFrame, size: int = WINDOW):
    """The benchmark's distinct windows; the item texts are the stated query set and travel to every task."""
    got = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).where("t is not null")
    return benchmark_windows([(r.i, r.t) for r in got.toLocalIterator()], size)


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: words, hit words, items found. A map over the documents; nothing is shuffled."""
    shared = documents.sparkSession.sparkContext.broadcast(collect_windows(benchmark, window))
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches):
        words = vocabulary(shared.value)
        for batch in batches:
            n_words = np.zeros(batch.num_rows, dtype=np.int64)
            n_hit = np.zeros(batch.num_rows, dtype=np.int64)
            n_items = np.zeros(batch.num_rows, dtype=np.int64)
            digest = [empty] * batch.num_rows
            for i, j, _, _, _, _, first, hit, items in shard_results(batch.column(1), shared.value, words):
                n_words[i:j] = np.diff(first)
                n_hit[i:j] = segment_sums(hit, first)
                for d, found in items.items():
                    n_items[i + d] = len(found)
                    digest[i + d] = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words), pa.array(n_hit), pa.array(n_items), pa.array(digest), pa.array(n_hit > 0)],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def remove_hits(text: str, spans: list[tuple[int, int]]) -> str:
    """The text's bytes without the spans, whose places close up to one blank."""
    raw, out, at = text.encode(), [], 0
    for s, e in spans:
        out.append(raw[at:s].rstrip(b" "))
        at = e
    out.append(raw[at:])
    kept = [out[0]] + [x if x[:1] in b" \n.,;:!?" or not x else b" " + x for x in out[1:]]
    return b"".join(kept).decode().strip()


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without their hit words; a document of which no word is left goes.

    Clean documents come back byte for byte; n_chars, where there is such a column, follows the text.
    """
    shared = documents.sparkSession.sparkContext.broadcast(collect_windows(benchmark, window))
    names = documents.columns
    at = names.index("text")
    count = names.index("n_chars") if "n_chars" in names else -1

    def run(batches):
        words = vocabulary(shared.value)
        for batch in batches:
            texts, keep, lengths = {}, np.ones(batch.num_rows, dtype=bool), {}
            for i, j, _, offs, starts, ends, first, hit, _ in shard_results(batch.column(at), shared.value, words):
                found = segment_sums(hit, first)
                for d in np.flatnonzero(found).tolist():
                    a, b = first[d], first[d + 1]
                    if found[d] == b - a:
                        keep[i + d] = False
                        continue
                    h = np.concatenate(([False], hit[a:b], [False]))
                    edge = np.flatnonzero(h[1:] != h[:-1])
                    spans = [(int(starts[a + s] - offs[d]), int(ends[a + e - 1] - offs[d])) for s, e in zip(edge[::2], edge[1::2])]
                    texts[i + d] = remove_hits(batch.column(at)[i + d].as_py(), spans)
            if texts or not keep.all():
                cols = list(batch.columns)
                old = cols[at].to_pylist()
                for k, t in texts.items():
                    old[k] = t
                    lengths[k] = len(t)
                cols[at] = pa.array(old, type=pa.string())
                if count >= 0:
                    n = cols[count].to_pylist()
                    for k, v in lengths.items():
                        n[k] = v
                    cols[count] = pa.array(n, type=cols[count].type)
                batch = pa.RecordBatch.from_arrays(cols, names).filter(pa.array(keep))
            yield batch

    return documents.mapInArrow(run, documents.schema)


ORACLE = r"""
with d as (
  select doc_id, row_number() over () as rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), b as (
  select item_id::varchar as item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark
), bw as (
  select distinct item, least(10, len(w)) as k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as win
  from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)
), dw as (
  select rid, i, k, array_to_string(w[i:i + k - 1], ' ') as win
  from (select rid, w, k, unnest(range(1, len(w) - k + 2)) as i from d, (select distinct k from bw) where len(w) >= k)
), found as (
  select rid, i, bw.k, item from dw join bw on dw.k = bw.k and dw.win = bw.win
), hits as (
  select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + k)) as p from (select distinct rid, i, k from found)) group by rid
), items as (
  select rid, count(*) as n_items, string_agg(item, ',' order by item) as list from (select distinct rid, item from found where item is not null) group by rid
)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(list, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hits using (rid) left join items using (rid)
"""
