"""LM scoring with a log-bilinear model trained by noise-contrastive estimation.

Symbols are the ``SYMBOLS`` x sqrt(V) most frequent of the V distinct training words, and for all rarer words 64 classes by a
hash of a word's last two bytes. The model predicts a symbol from the ``CONTEXT`` symbols before it:
h = sum over k of r[context k] . C_k, score(s | h) = q_s . h + b_s. For a cheap exact normalisation symbols are binned by
frequency (about sqrt of them, bins of equal mass of square roots of counts): p(s | h) = softmax over bins . softmax inside the bin, both by
batched matrix products. Inside a class a rare word has (c + 1) / (sum of c + number of words + 1), as in the base
score, which leaves room for unseen words.

Training is distributed and sees every training token: in each of ``ROUNDS`` rounds each task runs noise-contrastive
estimation over the windows of its own documents, in batches of at most ``PENDING`` tokens, from the shared
parameters, and sends the changes of the rows that it has touched; those are averaged, weighted by how often
each task has met the row. So vocabulary, windows and what is gathered all grow with the corpus; a task
holds the parameters (4 x ``DIMENSIONS`` x symbols numbers, about the square root of the vocabulary), never counts of pairs.

Scoring keeps the ``FREQUENT`` most frequent words with their counts in every task (two
arrays of that length); occurrences of others are pre-aggregated by document and joined
with the count table, so that vocabulary never has to fit anywhere. Documents' own rows go
through the same join under negative keys, which match nothing and spread evenly.

Words are identified by 57-bit keys (51 bits of hash, 6 of class), not compared as strings: of a vocabulary of
V words about V^2 / 2^58 pairs collide (5 million words: 1e-4 expected pairs).

Edge cases: null and empty texts are one end token; an empty table gives no rows; without
training documents N and V are 0 and the model is uniform; a null id is neither held out nor
learnt from; repeated rows each give a row and count each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _VALUES, LOWER, blocks, checkpoint, fold, mix, nonspace_class, word_bounds, word_hashes

FOLDS = 7
HELD = 2
SYMBOLS = 8
CLASSES = 64
FREQUENT = 1 << 18
DIMENSIONS = 32
CONTEXT = 3
NOISE = 64
BATCH = 2048
ROUNDS = 1
#: Steps that a task makes in a round at least, by passing over its windows again (small corpora).
LEAST_STEPS = 1000
RATE = 0.1
LUT = nonspace_class()
KEY_BITS = 57
END = 64 << 6  # key of the end token; words' keys are made different from it
PENDING = 1 << 22
#: Rows of parameters that travel together.
GROUP = 256
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def keys_of(data: np.ndarray, offs: np.ndarray):
    """Keys of all tokens of a block (words, then one end for each text) and the n + 1 bounds of the texts' tokens."""
    starts, ends, first = word_bounds(data, offs, LUT)
    h = word_hashes(data, starts, ends)
    tail = _VALUES[LOWER[data[ends - 1]]] ^ (_VALUES[LOWER[data[np.maximum(ends - 2, starts)]]] >> np.uint64(1))
    key = ((h >> np.uint64(13)) << np.uint64(6) | (mix(tail) & np.uint64(CLASSES - 1))).astype(np.int64)
    key[key == END] += 1 << 6
    n = len(offs) - 1
    bounds = first + np.arange(n + 1)
    out = np.empty(len(key) + n, dtype=np.int64)
    is_end = np.zeros(len(out), dtype=bool)
    is_end[bounds[1:] - 1] = True
    out[is_end] = END
    out[~is_end] = key
    return out, bounds


def class_of(key: np.ndarray) -> np.ndarray:
    return key & (CLASSES - 1)


def token_blocks(batches):
    """(keys, bounds) of all texts, block by block."""
    for batch in batches:
        for _, _, data, offs in blocks(batch.column(0)):
            yield keys_of(data, offs)


def word_counts(training: DataFrame) -> DataFrame:
    """(key, c) of the texts; every task sends sums of what it has read."""

    def run(batches):
        keys, counts, size = [], [], 0

        def merged():
            k, at = np.unique(np.concatenate(keys), return_inverse=True)
            c = np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)
            return k, c

        for own, _ in token_blocks(batches):
            k, c = np.unique(own, return_counts=True)
            keys.append(k)
            counts.append(c)
            size += len(k)
            if size > PENDING:
                k, c = merged()
                if len(k) > PENDING // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c)], ["key", "c"])
                    keys, counts, size = [], [], 0
                else:
                    keys, counts, size = [k], [c], len(k)
        if keys:
            k, c = merged()
            for at in range(0, len(k), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(k[at : at + (1 << 17)]), pa.array(c[at : at + (1 << 17)])], ["key", "c"])

    return training.mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


class Lookup:
    """Places of keys in a sorted array. A table over the keys' first bits (they are hashes) gives the first place at which one can
    stand, from where few steps are left; no search through the whole array."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(4 * len(keys) - 1, 1).bit_length()
        self.shift = KEY_BITS - bits
        self.start = np.minimum(np.searchsorted(keys, np.arange(1 << bits, dtype=np.int64) << self.shift), len(keys) - 1).astype(np.int32)

    def __call__(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each key and whether it is there."""
        last = len(self.keys) - 1
        if last < 0:
            return np.zeros(len(key), dtype=np.int32), np.zeros(len(key), dtype=bool)
        at = self.start[key >> self.shift]
        left = np.flatnonzero(self.keys[at] < key)
        while len(left):
            left = left[at[left] < last]
            at[left] += 1
            left = left[self.keys[at[left]] < key[left]]
        return at, self.keys[at] == key


class Symbols:
    """Symbol numbers of keys: frequent words by rank, then the classes; the last number marks a text's beginning."""

    def __init__(self, shortlist: np.ndarray):
        self.order = np.argsort(shortlist)
        self.find = Lookup(shortlist[self.order])
        self.words = len(shortlist)
        self.n = self.words + CLASSES

    def __call__(self, key: np.ndarray) -> np.ndarray:
        at, known = self.find(key)
        return np.where(known, self.order[at], self.words + class_of(key)) if self.words else class_of(key)

    def contexts(self, symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Tokens x CONTEXT: the symbols before each token, the nearest first."""
        first = np.repeat(bounds[:-1], np.diff(bounds))
        at = np.arange(len(symbols))
        return np.stack([np.where(at - k >= first, symbols[np.maximum(at - k, 0)], self.n) for k in range(1, CONTEXT + 1)], axis=1)


def bins_of(counts: np.ndarray) -> np.ndarray:
    """The bin of each symbol: about sqrt(n) bins along falling counts, of equal sums of square roots of counts."""
    n = len(counts)
    order = np.argsort(-counts, kind="stable")
    mass = np.cumsum(np.sqrt(counts[order] + 1.0))
    k = int(np.ceil(np.sqrt(n)))
    raw = np.minimum((mass - np.sqrt(counts[order] + 1.0)) / mass[-1] * k, k - 1).astype(np.int64)
    out = np.empty(n, dtype=np.int64)
    out[order] = np.unique(raw, return_inverse=True)[1]  # no empty bins
    return out


def row_sums(at: np.ndarray, g: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, how often, sum of its g) of the rows of n that occur in ``at``, in no given order. A row's occurrences are cut into full
    eights and a rest of 1 to 8; the first, second ... of all rests are added as blocks, and so are the halves of all eights."""
    by = np.argsort(at.astype(np.uint16) if n <= 1 << 16 else at, kind="stable")  # 16 bits are sorted by radix
    s = at[by]
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    times = np.diff(np.concatenate((first, [len(s)])))
    eights = (times - 1) >> 3
    rest = times - 8 * eights
    rank = np.argsort((8 - rest).astype(np.uint16), kind="stable")
    first, times, eights = first[rank], times[rank], eights[rank]
    start = first + 8 * eights
    out = np.take(g, by[start], axis=0)
    for k, end in enumerate(len(first) - np.cumsum(np.bincount(rest, minlength=9))[1:8], 1):
        if end == 0:
            break
        out[:end] += np.take(g, by[start[:end] + k], axis=0)
    some = np.flatnonzero(eights)
    if len(some):
        eights = eights[some]
        before = np.cumsum(eights) - eights
        of = np.repeat(first[some] - 8 * before, eights) + 8 * np.arange(before[-1] + eights[-1])
        x = np.take(g, by[of[:, None] + np.arange(8)].ravel(), axis=0).reshape(len(of), -1)
        while x.shape[1] > g.shape[1]:
            half = x.shape[1] // 2
            x = x[:, :half] + x[:, half:]
        out[some] += np.add.reduceat(x, before, axis=0)
    return s[first], times.astype(np.float32), out


def move(table: np.ndarray, total: np.ndarray, touched: np.ndarray, rows: np.ndarray, times: np.ndarray, g: np.ndarray, rate: float) -> None:
    """A step of a size set by each row's own past gradients; the rows differ."""
    past = total[rows] + np.einsum("rd,rd->r", g, g) / g.shape[1]
    total[rows] = past
    g *= (-rate / np.sqrt(past))[:, None]
    g += np.take(table, rows, axis=0)
    table[rows] = g
    touched[rows] += times


class Model:
    """Parameters as rows: context vectors, target vectors with their bias, bin vectors with their bias, position matrices."""

    def __init__(self, counts: np.ndarray, dimensions: int = DIMENSIONS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.n, self.d = len(counts), dimensions
        self.bins = bins_of(counts)
        self.k = int(self.bins.max()) + 1
        self.unigram = (counts + 1.0) / (counts + 1.0).sum()
        self.bin_unigram = np.bincount(self.bins, weights=self.unigram)
        normal = lambda n: rng.normal(0, 0.1, (n, dimensions)).astype(np.float32)
        with_bias = lambda n, p: np.concatenate((normal(n), np.log(p).astype(np.float32)[:, None]), axis=1)
        self.r, self.q, self.qb = normal(self.n + 1), with_bias(self.n, self.unigram), with_bias(self.k, self.bin_unigram)
        self.c = np.stack([np.eye(dimensions, dtype=np.float32) / (k + 1) for k in range(CONTEXT)]).reshape(CONTEXT * dimensions, dimensions)
        self.sums = [np.full(len(x), 1e-2, dtype=np.float32) for x in self.parts()]

    def parts(self) -> list[np.ndarray]:
        return [self.r, self.q, self.qb, self.c]

    def train(self, symbols: np.ndarray, contexts: np.ndarray, rng: np.random.Generator, touched: list[np.ndarray], batch: int = BATCH, noise: int = NOISE, rate: float = RATE, passes: int = 1) -> None:
        """Passes of noise-contrastive estimation over the windows, each in a random order; noise symbols are shared by a batch."""
        d, n, draws = self.d, self.n, -(-len(symbols) // batch)
        # target and bin vectors in one table, so that both go through the same products and the same step
        table, total, times = (np.concatenate(x[1:3]) for x in (self.parts(), self.sums, touched))
        log = np.log(noise * np.concatenate((self.unigram, self.bin_unigram))).astype(np.float32)
        cumulative = (0, np.cumsum(self.unigram)), (n, np.cumsum(self.bin_unigram))
        every, ones = np.arange(len(self.c)), np.ones(len(self.c), dtype=np.float32)
        for _ in range(passes):
            order = rng.permutation(len(symbols))
            random = rng.random((draws, 2, noise))
            neg = np.empty((draws, 2 * noise), dtype=np.int64)
            for k, (low, p) in enumerate(cumulative):
                neg[:, k * noise : (k + 1) * noise] = low + np.minimum(np.searchsorted(p, random[:, k]), len(p) - 1)
            neg.sort(axis=1)
            new = np.ones(neg.shape, dtype=bool)
            new[:, 1:] = neg[:, 1:] != neg[:, :-1]
            for turn in range(draws):
                w = order[turn * batch : (turn + 1) * batch]
                b = len(w)
                ctx, tgt = np.take(contexts, w, axis=0).ravel(), symbols[w]
                rows = np.take(self.r, ctx, axis=0).reshape(b, CONTEXT * d)
                hidden = np.empty((b, d + 1), dtype=np.float32)  # the last column meets the bias
                hidden[:, :d], hidden[:, d] = rows @ self.c, 1
                at = np.concatenate((tgt, n + self.bins[tgt], neg[turn]))
                g = np.zeros((len(at), d + 1), dtype=np.float32)
                # noise: each symbol or bin once, times the number of its draws
                once = np.flatnonzero(new[turn])
                drawn = np.diff(np.concatenate((once, [2 * noise]))).astype(np.float32)[:, None]
                which = neg[turn, once]
                other = np.take(table, which, axis=0)
                minus = -other
                minus[:, d] += log[which]
                g_neg = hidden @ minus.T  # from here on in place: minus the log odds, then the probability of noise
                with np.errstate(over="ignore"):  # of an infinite one the reciprocal is 0
                    np.exp(g_neg, out=g_neg)
                g_neg += 1
                np.reciprocal(g_neg, out=g_neg)
                g_hidden = g_neg @ (other[:, :d] * drawn)
                g[2 * b + once] = (g_neg.T @ hidden) * drawn
                own = np.take(table, at[: 2 * b], axis=0).reshape(2, b, d + 1)
                pos = np.einsum("bd,kbd->kb", hidden, own) - log[at[: 2 * b]].reshape(2, b)
                g_pos = (-1 / (1 + np.exp(np.clip(pos, -30, 30))))[:, :, None]
                np.multiply(hidden, g_pos, out=g[: 2 * b].reshape(2, b, d + 1))
                own *= g_pos
                g_hidden += own[0, :, :d]
                g_hidden += own[1, :, :d]
                g_rows = (g_hidden @ self.c.T).reshape(-1, d)
                move(table, total, times, *row_sums(at, g, len(table)), rate)
                move(self.c, self.sums[3], touched[3], every, ones, rows.T @ g_hidden / b, rate * 0.1)
                move(self.r, self.sums[0], touched[0], *row_sums(ctx, g_rows, len(self.r)), rate)
        for both, parts in ((table, self.parts()), (total, self.sums), (times, touched)):
            parts[1][:], parts[2][:] = both[:n], both[n:]

    def scorer(self):
        """log10 p(symbol | context) of tokens by matrix products over bins and over the symbols of each bin."""
        d = self.d
        moved = [self.r @ self.c[k * d : (k + 1) * d] for k in range(CONTEXT)]
        by = np.argsort(self.bins, kind="stable")
        start = np.searchsorted(self.bins[by], np.arange(self.k + 1))
        inside, across = [np.ascontiguousarray(self.q[by[a:b]].T) for a, b in zip(start, start[1:])], np.ascontiguousarray(self.qb.T)
        longest = max(float(np.sqrt(np.einsum("rd,rd->r", x[:, :d], x[:, :d]).max())) for x in (self.q, self.qb))
        most = max(float(np.abs(x[:, d]).max()) for x in (self.q, self.qb))

        def log_sum(z: np.ndarray, small: bool) -> np.ndarray:
            """small: no value is so large that its exponential must be kept in range."""
            top = 0 if small else z.max(axis=1, keepdims=True)
            if not small:
                z -= top
                top = top[:, 0]
            return top + np.log(np.exp(z, out=z) @ np.ones(z.shape[1], dtype=np.float32))

        def score(symbols: np.ndarray, contexts: np.ndarray) -> np.ndarray:
            bins = self.bins[symbols]
            order = np.argsort(bins.astype(np.uint16) if self.k <= 1 << 16 else bins, kind="stable")
            bins, symbols, contexts = bins[order], symbols[order], np.take(contexts, order, axis=0)  # tokens of a bin stand together
            hidden = np.ones((len(symbols), d + 1), dtype=np.float32)  # the last column meets the bias
            hidden[:, :d] = np.take(moved[0], contexts[:, 0], axis=0)
            for k in range(1, CONTEXT):
                hidden[:, :d] += np.take(moved[k], contexts[:, k], axis=0)
            small = len(hidden) == 0 or float(np.sqrt(np.einsum("td,td->t", hidden, hidden).max())) * longest + most < 60
            log_p = np.einsum("td,td->t", hidden, np.take(self.q, symbols, axis=0)).astype(np.float64)
            log_p += np.einsum("td,td->t", hidden, np.take(self.qb, bins, axis=0))
            for low in range(0, len(symbols), 1024):
                log_p[low : low + 1024] -= log_sum(hidden[low : low + 1024] @ across, small)
            bounds = np.searchsorted(bins, np.arange(self.k + 1))
            for b in np.flatnonzero(np.diff(bounds)):
                step = max(64, (1 << 18) // inside[b].shape[1])
                for low in range(bounds[b], bounds[b + 1], step):
                    part = slice(low, min(low + step, bounds[b + 1]))
                    log_p[part] -= log_sum(hidden[part] @ inside[b], small)
            out = np.empty_like(log_p)
            out[order] = log_p / np.log(10)
            return out

        return score


def fitted(training: DataFrame, symbols: Symbols, counts: np.ndarray, rounds: int = ROUNDS, seed: int = 7) -> Model:
    """The model after rounds of training over all texts, averaged between rounds. Tasks meet the texts in the order in which they
    are read, so reruns agree where the table is split alike."""
    model = Model(counts)
    spark = training.sparkSession
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in model.parts()])))
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast((symbols, model))

        def run(batches):
            symbols, model = shared.value
            before = [x.copy() for x in model.parts()]
            sums = [x.copy() for x in model.sums]
            touched = [np.zeros(len(x), dtype=np.float32) for x in before]
            rng = np.random.default_rng([seed, turn, TaskContext.get().partitionId()])
            held, size, steps = [], 0, 0

            def learn():
                s, ctx = (np.concatenate(x) for x in zip(*held))
                model.train(s, ctx, rng, touched, passes=max(1, -(-(LEAST_STEPS - steps) * BATCH // len(s))))
                return len(s) // BATCH

            for keys, bounds in token_blocks(batches):
                s = symbols(keys)
                held.append((s.astype(np.int32), symbols.contexts(s, bounds).astype(np.int32)))
                size += len(s)
                if size > PENDING:
                    steps += learn()
                    held, size = [], 0
            if held and size:
                learn()
            for part, (old, new) in enumerate(zip(before, model.parts())):
                for low in range(0, len(new), GROUP):
                    rows = slice(low, low + GROUP)
                    some = np.flatnonzero(touched[part][rows])
                    if len(some):
                        own = [offsets[part] + low + some, touched[part][rows][some], (new[rows] - old[rows])[some].astype(np.float16), (model.sums[part][rows] - sums[part][rows])[some]]
                        yield pa.RecordBatch.from_arrays([pa.array([(int(offsets[part]) + low) // GROUP * 4 + part]), *(pa.array([x.tobytes()], pa.binary()) for x in own)], ["grp", "row", "times", "change", "grown"])
            for x, old in zip(model.parts(), before):
                x[:] = old
            for x, old in zip(model.sums, sums):
                x[:] = old

        def averaged(batches):
            total: dict[int, list] = {}
            for batch in batches:
                for g, row, times, change, grown in zip(*(c.to_pylist() for c in batch.columns)):
                    row, times, grown = np.frombuffer(row, np.int64), np.frombuffer(times, np.float32), np.frombuffer(grown, np.float32)
                    change = np.frombuffer(change, np.float16).reshape(len(row), -1).astype(np.float64)
                    own = total.setdefault(g, [int(row.min()) // GROUP * GROUP, None, None, None])
                    if own[1] is None:
                        own[1:] = [np.zeros((2 * GROUP, change.shape[1])), np.zeros(2 * GROUP), np.zeros(2 * GROUP)]
                    at = row - own[0]
                    while at.min() < 0 or at.max() >= 2 * GROUP:
                        raise ValueError("a group of rows is wider than it can be")
                    own[1][at] += change * times[:, None]
                    own[2][at] += times
                    own[3][at] += grown
            for low, change, times, grown in total.values():
                some = np.flatnonzero(times)
                yield pa.RecordBatch.from_arrays([pa.array(low + some), pa.array(list((change[some] / times[some, None]).astype(np.float32)), pa.list_(pa.float32())), pa.array(grown[some].astype(np.float32))], ["row", "change", "grown"])

        sent = training.mapInArrow(run, "grp long, row binary, times binary, change binary, grown binary").repartition("grp")
        got = sent.mapInArrow(averaged, "row long, change array<float>, grown float").toArrow()
        model = apply_changes(model, got, offsets)
        shared.unpersist()
    return model


def apply_changes(model: Model, got: pa.Table, offsets: np.ndarray) -> Model:
    row, grown = got.column(0).to_numpy(), got.column(2).to_numpy()
    lists = got.column(1).combine_chunks()
    flat, at = lists.flatten().to_numpy(), lists.offsets.to_numpy()
    for part, x in enumerate(model.parts()):
        some = np.flatnonzero((row >= offsets[part]) & (row < offsets[part + 1]))
        if len(some):
            take = at[some][:, None] + np.arange(x.shape[1])
            x[row[some] - offsets[part]] += flat[take]
            model.sums[part][row[some] - offsets[part]] += grown[some]
    return model


def score(documents: DataFrame) -> DataFrame:
    """Base and model scores of every document."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    training = docs.where(fold("doc_id", FOLDS) != HELD).select("text")
    counts = checkpoint(word_counts(training))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = counts.orderBy(F.desc("c"), "key").limit(FREQUENT).toArrow()
    top_key, top_count = top.column(0).to_numpy(), top.column(1).to_numpy()
    by = np.lexsort((top_key, -top_count))
    top_key, top_count = top_key[by], top_count[by]
    n_words = min(int(SYMBOLS * np.sqrt(v)), len(top_key))
    symbols = Symbols(top_key[:n_words].copy())
    # mass and number of the words in each class, without the frequent ones
    sums = {r.k: (r.c, r.n) for r in counts.groupBy(F.col("key").bitwiseAND(CLASSES - 1).alias("k")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect()}
    short = class_of(top_key[:n_words])
    mass = np.array([sums.get(k, (0, 0)) for k in range(CLASSES)], dtype=np.float64).T
    mass -= np.array([np.bincount(short, weights=top_count[:n_words], minlength=CLASSES), np.bincount(short, minlength=CLASSES)])
    model = fitted(training, symbols, np.concatenate((top_count[:n_words], mass[0])))
    inside = np.log10(mass.sum(axis=0) + 1)  # a word's own log10(c + 1) is added where it is known
    order = np.argsort(top_key)
    shared = spark.sparkContext.broadcast((Lookup(top_key[order]), np.log10(top_count[order] + 1.0), order, symbols, model, inside))
    base = float(np.log10(n + v + 1))

    def run(batches):
        find, logs, ranks, symbols, model, inside = shared.value
        log_p = model.scorer()
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            held = batch.column(2)
            for i, j, data, offs in blocks(batch.column(1)):
                token, bounds = keys_of(data, offs)
                k = j - i
                doc = np.repeat(np.arange(k), np.diff(bounds))
                at, known = find(token)
                log = np.where(known, logs[at], 0.0) if len(logs) else np.zeros(len(token))
                s = symbols.words + class_of(token)
                if symbols.words:
                    rank = ranks[at]
                    s = np.where(known & (rank < symbols.words), rank, s)
                lm = log_p(s, symbols.contexts(s, bounds))
                rare = s >= symbols.words
                lm[rare] += log[rare] - inside[s[rare] - symbols.words]
                rare_doc, rare_key = doc[~known], token[~known]
                by = np.lexsort((rare_key, rare_doc))
                rare_doc, rare_key = rare_doc[by], rare_key[by]
                new = np.ones(len(by), dtype=bool)
                new[1:] = (rare_doc[1:] != rare_doc[:-1]) | (rare_key[1:] != rare_key[:-1])
                at = np.flatnonzero(new)
                times = np.diff(np.concatenate((at, [len(by)])))
                r = len(at)
                null = lambda kind: pa.nulls(r, kind)
                rid = np.concatenate((row + np.arange(k), row + rare_doc[at]))
                key = np.concatenate((-1 - row - np.arange(k), rare_key[at]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rid), pa.array(key), pa.array(np.concatenate((np.zeros(k, np.int64), times))),
                        pa.concat_arrays([batch.column(0)[i:j], null(pa.int64())]), pa.concat_arrays([held[i:j], null(pa.bool_())]),
                        pa.concat_arrays([pa.array(np.diff(bounds)), null(pa.int64())]),
                        pa.concat_arrays([pa.array(np.bincount(doc, weights=known, minlength=k).astype(np.int64)), null(pa.int64())]),
                        pa.concat_arrays([pa.array(np.bincount(doc, weights=log, minlength=k)), null(pa.float64())]),
                        pa.concat_arrays([pa.array(np.bincount(doc, weights=lm, minlength=k)), null(pa.float64())]),
                    ],
                    ["rid", "key", "times", "doc_id", "held_out", "n_tokens", "known", "log", "lm"],
                )
                row += k

    parts = docs.select("doc_id", "text", (fold("doc_id", FOLDS) == HELD).alias("held_out")).mapInArrow(run, "rid long, key long, times long, doc_id long, held_out boolean, n_tokens long, known long, log double, lm double")
    joined = parts.join(counts, "key", "left")
    add = F.when(F.col("c").isNotNull(), F.col("times") * F.log10(F.col("c") + 1.0)).otherwise(F.lit(0.0))
    per = joined.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        (F.sum(F.coalesce("known", F.lit(0))) + F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0))).cast("long").alias("n_known"),
        F.sum(F.coalesce("log", F.lit(0.0))).alias("log"), F.sum(F.coalesce("lm", F.lit(0.0))).alias("lm"), F.sum(add).alias("rest"),
    )
    return per.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), (F.col("log") + F.col("rest") - F.col("n_tokens") * F.lit(base)).alias("base_score"), (F.col("lm") + F.col("rest")).alias("score"))
