"""The ten operators against SQL or brute force on small tables with every edge case."""

import hashlib
import math
import os
import random
import re
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, decontaminate, embedding_dedup, lm_score, mixing, near_dedup, pii, quality, substring_dedup, toxicity, url_filter

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, key string, score string, digest string, target string"
rng = random.Random(5)
WORDS = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.randint(2, 9))) for _ in range(4000)]


def prose(n, r=rng):
    out = []
    for k in range(n):
        w = r.choice(WORDS)
        out.append(w + (".\n" if k % 37 == 36 else ". " if k % 11 == 10 else " "))
    return "".join(out).strip()


PASSAGE = prose(60)
TEXTS = [prose(80), None, "", "   \n\t ", "!!! ???", "one", prose(30) + "\n" + PASSAGE + "\n" + prose(20), prose(10) + "\n" + PASSAGE, prose(3000), "x" * 60_000, PASSAGE, PASSAGE, "A  B\x0bC\x0cD É", "same five words in here. same five words in here."]
ROWS = [(i, t, "en", ["a", "b", None, "Z", "é"][i % 5], len(t or ""), "s", "k", "sc", "d", "t") for i, t in enumerate(TEXTS)]
ROWS += [ROWS[6], ROWS[0], (None, prose(12), None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def sql(query, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(name + "_p", rows)
        con.execute(f"create view {name} as select * from {name}_p")
    r = con.execute(query)
    return [c[0] for c in r.description], r.fetchall()


def frame(rows, names):
    return pd.DataFrame({n: pd.array([r[i] for r in rows], dtype="Int64" if n in ("doc_id", "n_chars", "item_id", "page_id") else object) for i, n in enumerate(names)})


def same(df, names, rows):
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    assert got == sorted((tuple(map(plain, r)) for r in rows), key=repr)


NAMES = [c.split()[0] for c in DOCS.split(", ")]


# ---- common


def test_words_and_hashes():
    import pyarrow as pa

    texts = ["Ab c9é", None, "", "a", "b" * 70000, "ÀB"]
    got = []
    for _, _, h, first in common.words(pa.array(texts), common.alnum_class(), most=8):
        got += [h[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
    lower = lambda t: "".join(c.lower() if c < "\x80" else c for c in t or "")
    assert got == [[common.hash_text(w) for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))] for t in texts]
    sliced = pa.array(["zz", None, "b c", ""]).slice(1, 2)
    assert [len(h) for _, _, h, _ in common.words(sliced, common.nonspace_class())] == [2]


def test_connected(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (3, 1)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.component for r in common.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {k: v for k, v in got.items() if k < 100} == {1: 1, 2: 1, 3: 1, 5: 5, 7: 7, 8: 7, 9: 7} and {v for k, v in got.items() if k >= 100} == {100}
    assert common.connected(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 1 substring dedup


def test_repeats_match_sql(docs, empty):
    rows = [r for r in ROWS[: len(TEXTS)]]
    some = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    names, want = sql(substring_dedup.ORACLE, documents=frame(rows, NAMES))
    assert len(want) > 5
    same(substring_dedup.repeated_units(some), names, want)
    assert substring_dedup.repeated_units(empty).count() == 0
    clean = {r.doc_id: r.text for r in substring_dedup.without_repeats(some).collect()}
    assert clean[0] == TEXTS[0] and clean[6] == TEXTS[6] and clean[1] is None
    assert clean[11] == "" or len(clean[11].split()) < 6
    assert PASSAGE.split(". ")[1] not in clean[7]


def test_repeats_of_repeated_rows(docs):
    hits = {r.doc_id for r in substring_dedup.repeated_units(docs).collect()}
    assert {7, 10, 11, 13} <= hits and 6 not in hits and 0 not in hits


# ---- 3 decontamination

BENCH = [(1, " ".join(PASSAGE.split()[5:25])), (10, "one"), (2, " ".join(TEXTS[0].split()[:10])), (3, None), (4, ""), (5, prose(40)), (2, " ".join(TEXTS[0].split()[3:14])), (6, "??")]


def test_contamination_matches_sql(spark, docs, empty):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    names, want = sql(decontaminate.ORACLE, documents=frame(ROWS, NAMES), benchmark=frame(BENCH, ["item_id", "text"]))
    assert sum(r[names.index("contaminated")] for r in want) >= 6
    same(decontaminate.contamination(docs, bench), names, want)
    assert decontaminate.contamination(empty, bench).count() == 0
    none = decontaminate.contamination(docs, bench.limit(0)).where("n_hit > 0 or n_items > 0").count()
    assert none == 0


def test_fm_index_finds_all():
    r = np.random.default_rng(1)
    codes = np.concatenate(([0], *[np.append(r.integers(1, 4, n), 0) for n in (50, 1, 0, 300, 17)])).astype(np.int32)
    index = decontaminate.FMIndex(codes, 4)
    patterns = r.integers(1, 4, (60, 5)).astype(np.int64)
    lengths = r.integers(1, 6, 60)
    lo, hi = index.search(patterns, lengths)
    text = codes.tolist()
    for p, n, a, b in zip(patterns.tolist(), lengths.tolist(), lo, hi):
        want = [i for i in range(len(text)) if text[i : i + n] == p[:n]]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_decontaminate_text(spark, docs):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    out = {r.doc_id: r for r in decontaminate.decontaminate(docs.where("doc_id is not null"), bench).collect()}
    assert 5 not in out and out[8].text == TEXTS[8] and out[1].text is None
    item = " ".join(PASSAGE.split()[5:25]).split()
    assert item[3] + " " + item[4] not in out[10].text and out[10].n_chars == len(out[10].text)


# ---- 8 url filters

PAGES = [(1, "http://A.Example.com/en/7?x"), (2, "https://example.com/en/6"), (3, "https://x.example.net/de/8#a"), (4, "https://example.net/de/9"), (5, "https://b.org/es/"), (6, "https://b.org/e"), (7, None), (8, "no scheme"), (9, "http://notexample.com/en/7"), (10, "http://com/en/"), (11, "http://.com/en/1"), (12, ""), (13, "x://y://z.com/en/"), (14, "http://com"), (1, "http://A.Example.com/en/7?x"), (None, "http://q.net/de/"), (15, "http://" + "a." * 300 + "net/de/" + "p" * 5000)]


def test_urls_match_sql(spark):
    pages = spark.createDataFrame([(*r, "h", "v") for r in PAGES], "page_id long, url string, host string, verdict string")
    names, want = sql(url_filter.ORACLE, pages=frame(PAGES, ["page_id", "url"]))
    out = url_filter.judge(pages)
    same(out, names, want)
    got = {r.page_id: (r.rule, r.verdict) for r in out.collect()}
    assert got[1] == ("example.com/en/7", "allow") and got[2] == ("com/en/", "block") and got[3][1] == "block" and got[9] == ("com/en/", "block") and got[7] == (None, "allow")
    assert url_filter.judge(pages.limit(0)).count() == 0
    assert url_filter.judge(pages, []).where("rule is not null").count() == 0


# ---- 9 mixing


def test_mixing_matches_sql(docs, empty):
    names, want = sql(mixing.ORACLE, documents=frame(ROWS, NAMES))
    out = mixing.mixture(docs)
    same(out, names, want)
    got = out.toPandas()
    assert (got.taken <= 2 * got["size"]).all()
    per = got.groupby(got.doc_id.map({r[0]: r[3] for r in ROWS}).fillna("none")).agg(t=("taken", "sum"), g=("target", "max"))
    assert (abs(per.t - per.g) <= 1).all()
    assert abs(got.taken.sum() - 1.5 * got["size"].sum()) <= len(per)
    assert mixing.mixture(empty).count() == 0


def test_mix_documents(docs):
    out = mixing.mix_documents(docs).toPandas()
    want = mixing.mixture(docs).toPandas()
    assert out.words.sum() == want.taken.sum() and out.finish.is_monotonic_increasing and out.finish.max() <= 1.0 + 1e-9
    assert all(len(re.findall(r"[^\x20\x09-\x0D]+", t)) == w for t, w in zip(out.text, out.words))


# ---- 10 personal data

PII = ["mail a.b+c@x-y.example.com, 10.0.0.256 and 10.0.0.1.", "a@b@c.d.e x@y z@.com @q.r", "4111 1111 1111 1111 and 4111-1111-1111-1112 and 4111111111111111111", "+1 (243) 555-5526 +12 3 +1234567890123456 + 1", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.4", "é" * 50 + " ü@ä.com é@x.y", "IBAN DE89370400440532013000 or DE89370400440532013001", "ssn 123-45-6789 and 123-45-6789x", 'token = "ab8ca1b325bc4f85aa6a79e73fc4cbfc"', "1" * 3000, "a" * 5000 + "@b.c", "1 " * 2000, "+1" + "(" * 3000, None, "", "clean text 12 and 2024-01-01."]


def brute_pii(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for kind, pattern, low, high in (("card", r"[0-9]([\x20-]?[0-9])+", 16, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 8, 15)):
        for m in re.finditer(pattern, text):
            d = [int(c) for c in m[0] if c.isdigit()]
            luhn = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0
            if low <= len(d) <= high and (luhn or kind == "phone"):
                out.append((kind, *m.span()))
    return out


def test_pii(spark, docs, empty):
    rows = list(enumerate(PII)) + [(0, PII[0]), (None, PII[0])]
    got = pii.detect(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")).collect()
    assert len(got) == len(rows)
    for r in got:
        base = brute_pii((PII[r.doc_id] if r.doc_id is not None else PII[0]) or "")
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [Counter(k for k, _, _ in base)[k] for k in ("email", "ip", "card", "phone")]
        assert set(f"{k}:{s}:{e}" for k, s, e in base) <= set(r.spans.split(","))
    spans = {r.doc_id: r.spans for r in got}
    assert "iban:5:27" in spans[6] and spans[6].count("iban") == 1 and "ssn:4:15" in spans[7] and "credential" in spans[8] and spans[15] == ""
    assert pii.masked(PII[0]) == "mail [EMAIL], 10.0.0.256 and [IP]." and pii.masked(None) is None and pii.masked(PII[15]) == PII[15]
    assert pii.detect(empty).count() == 0 and pii.mask(docs).where("doc_id = 0").first().text == TEXTS[0]


def test_pii_random():
    r = random.Random(2)
    for _ in range(3000):
        t = "".join(r.choice("a1.@-+ %(2é0") for _ in range(r.randint(0, 40)))
        assert sorted(pii.base_spans(t)) == sorted(brute_pii(t))


# ---- 7 embeddings


@pytest.mark.parametrize("sizes", [{}, {"cell": 50}, {"cell": 20, "pivots": 8}])
def test_embeddings(spark, sizes):
    r = np.random.default_rng(1)
    base = r.normal(size=(40, 8))
    points = np.concatenate([base[r.integers(0, 40, 260)] + r.normal(size=(260, 8)) * 0.12, base[:8], base[:8]]).astype(np.float32)
    rows = [(i, [float(x) for x in p], i % 2) for i, p in enumerate(points)]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 8, 0), (n + 2, [float("nan")] + [1.0] * 7, 0), (n + 3, rows[0][1], None), (n + 4, [None] + [1.0] * 7, 0), (n + 5, [1.0, 2.0], 0), (n + 6, [], 0), (n + 7, [float("inf")] * 8, 1)]
    x = points.astype(float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = np.arange(n) % 2
    linked = (u @ u.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    comp = np.arange(n)
    while True:
        new = np.array([min(comp[i], *comp[linked[i]]) if linked[i].any() else comp[i] for i in range(n)])
        if (new == comp).all():
            break
        comp = new
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), **sizes).toPandas().set_index("vec_id").sort_index()
    assert (got.n_links[:n] == linked.sum(axis=1)).all() and (got.component_id[:n] == comp).all()
    assert (got.n_links[n:] == 0).all() and got.kept[n:].all() and len(got) == len(rows)
    assert (got.kept[:n] == (comp == np.arange(n))).all()


def test_embeddings_empty(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_whole_credentials():
    key = "Ab1/+_-" * 1000
    assert pii.masked(f"token={key} end") == "token=[CREDENTIAL] end"
    assert pii.masked("token: eyJhbGciOiJI.eyJzdWIiOiIx-_.SflKxwRJSMeK. Then") == "token: [CREDENTIAL]. Then"
    assert pii.masked("secret=" + "x" * 600 + "+12345678901+" + "y" * 600) == "secret=[CREDENTIAL][PHONE][CREDENTIAL]"
    assert pii.masked("secret = short.") == "secret = short." and pii.masked("secret = elevenchars.") == "secret = elevenchars."


# ---- 6 near copies


def shingles(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset()


def edited(text, share, r):
    return " ".join(r.choice(WORDS) if r.random() < share else w for w in text.split())


@pytest.fixture(scope="module")
def copies():
    r = random.Random(3)
    texts = []
    for k in range(12):
        t = prose(r.randint(20, 300), r)
        texts += [t] + [edited(t, r.choice([0.01, 0.03, 0.06, 0.1, 0.3]), r) for _ in range(k)] + [t] * (k % 3)
        texts += [t + " " + prose(len(t.split()) // 3, r)]
    texts += [prose(60, r) for _ in range(40)] + [None, "", "", "one", "one two", "one two", "!!", PASSAGE + " " + prose(300, r), PASSAGE + " " + prose(300, r), PASSAGE]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("chunk", [1024, 4])
def test_near_copies(spark, copies, chunk, monkeypatch):
    monkeypatch.setattr(near_dedup, "CHUNK", chunk)
    df = spark.createDataFrame([(*r, "x", "y") for r in copies], "doc_id long, text string, digest string, kept string")
    got = {r.doc_id: r for r in near_dedup.near_duplicates(df).collect()}
    assert len(got) == len(copies)
    first = {}
    for i, t in copies:
        first.setdefault(t or "", i)
    sets = {i: shingles(t) for t, i in first.items()}
    links = {i: 0 for i in sets}
    for a in sets:
        for b in sets:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if a < b and small and large <= 4 * small and len(sets[a] & sets[b]) >= 0.7 * small - 1e-9:
                links[a] += 1
                links[b] += 1
    for i, t in copies:
        assert (got[i].class_id, got[i].n_links) == (first[t or ""], links[first[t or ""]])
        assert got[i].n_copies == sum((x or "") == (t or "") for _, x in copies)
    groups = Counter(r.group_id for r in got.values())
    assert all(sum(r.kept for r in got.values() if r.group_id == g) == 1 for g in groups)
    assert all(r.kept for i, r in got.items() if links[first[copies[i][1] or ""]] == 0 and first[copies[i][1] or ""] == i)
    kept = {r.doc_id: r.text for r in near_dedup.deduplicate(df).collect()}
    assert set(kept) == {i for i, r in got.items() if r.kept} and all(copies[i][1] == t for i, t in kept.items())


def test_near_copies_edges(spark, docs, empty):
    assert near_dedup.near_duplicates(empty).count() == 0
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    assert near_dedup.bandings(0.7, 4.0)[0][0] >= 8 and all((1 - (0.7 / (1 + min(near_dedup.STEP ** (d + 1), 4) - 0.7)) ** r) ** b <= near_dedup.MISS for d, (b, r) in enumerate(near_dedup.bandings(0.7, 4.0)))


def test_prefilter_loses_next_to_nothing():
    for thousandths in (163, 200, 408, 538):
        p, least = thousandths / 1000, int(near_dedup.AGREE[thousandths])
        assert sum(math.comb(near_dedup.VALUES, k) * p**k * (1 - p) ** (near_dedup.VALUES - k) for k in range(least)) <= 1e-6
    plan = near_dedup.bandings(0.7, 4.0)
    n = len(near_dedup.slots_of(plan))
    keys = np.arange(n) << 40  # shared in slot 0, in slot 1 alike in the low 16 bits only
    other = keys + (1 << 39) + (1 << 20)
    other[0] = keys[0]
    sizes = np.full(n, 2)
    sizes[1] = 64
    rows = near_dedup.pack_marks([np.arange(n)] * 2, [keys, other], [sizes] * 2, n)
    assert near_dedup.Marks(rows, plan).slot(np.array([0]), np.array([1]), np.array([0])).tolist() == [0]


def test_held_components(spark):
    r = random.Random(11)
    held = prose(100, r)
    near = " ".join(held.split()[:-4]) + " " + prose(4, r)
    got = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate([held, near, held + " " + prose(120, r)])), "doc_id long, text string")).collect()
    assert {x.group_id for x in got} == {2} and [x.doc_id for x in got if x.kept] == [2]


def test_links_of_any_ratio(spark):
    r = random.Random(12)
    long, parts = [prose(1500, r) for _ in range(2)], [prose(n, r) for n in (3, 12, 26, 60, 200)]
    texts = [long[0] + " " + " ".join(parts), long[1] + " " + parts[1] + " " + parts[4], *parts, edited(parts[4], 0.04, r), prose(30, r)]
    sets = [shingles(t) for t in texts]
    want = [sum(i != j and len(a & b) >= 0.7 * min(len(a), len(b)) - 1e-9 for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    df = spark.createDataFrame([*enumerate(texts), (2, texts[2]), (0, texts[0])], "doc_id long, text string")
    got = {x.doc_id: x for x in near_dedup.near_duplicates(df, far=True).collect()}
    assert [got[i].n_links for i in range(len(texts))] == want and sum(want) >= 14
    assert {i for i, x in got.items() if x.kept} == {0, 1, 8}


def test_one_row_of_repeated_ids(spark):
    r = random.Random(13)
    t, u = prose(100, r), prose(90, r)
    rows = [(1, t, "a"), (1, t, "b"), (1, t + " one more", "c"), (1, u, "d"), (None, prose(50, r), "e"), (2, t, "f")]
    kept = near_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(kept) == 3 and {x.lang for x in kept} >= {"d", "e"} and all(x.doc_id == 1 for x in kept if x.lang != "e")


# ---- 2, 4, 5: learnt operators


def auc(score, y):
    rank = pd.Series(score).rank()
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    return (rank[y.to_numpy() == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


@pytest.fixture(scope="module")
def tables(spark):
    if not os.path.isdir(SF):
        pytest.skip("needs the tables")
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_quality(tables, docs, empty):
    d, labels = tables
    r = quality.classify(d, labels).toPandas()
    assert len(r) == d.count() and r.score.between(0, 1).all() and (r.predicted == (r.score >= 0.3)).all()
    assert (r.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in r.doc_id]).all()
    m = r[r.held_out].merge(labels.toPandas(), on="doc_id")
    assert auc(m.score.to_numpy(), m.quality) > 0.9
    edge = quality.classify(docs, labels).toPandas()
    assert len(edge) == len(ROWS) and edge.score.notna().all()
    assert quality.classify(empty, labels).count() == 0
    assert set(quality.classify(docs, labels.limit(0)).toPandas().score) == {0.5}


def test_toxicity(spark, docs, empty):
    folder = SF.replace("sf0.01", "sf0.1")  # 60 toxic held-out rows; the smaller tables have six
    if not os.path.isdir(folder):
        pytest.skip("needs the tables")
    d, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    r = toxicity.score(d, labels).toPandas()
    m = r[r.held_out].merge(labels.toPandas().rename(columns={"toxic": "y"}), on="doc_id")
    assert len(r) == d.count() and r.severity.between(0, toxicity.GRADES).all() and auc(m.severity.to_numpy(), m.y) > 0.95
    edge = toxicity.score(docs, labels).toPandas()
    assert len(edge) == len(ROWS) and edge.severity.notna().all()
    assert toxicity.score(empty, labels).count() == 0 and (toxicity.score(docs, labels.limit(0)).toPandas().severity == 0).all()


def test_ordinal_fit():
    r = np.random.default_rng(0)
    n = 4000
    x = r.normal(size=n)
    latent = 2 * x + r.logistic(size=n)
    grades = np.digitize(latent, [-1, 1.5])
    w, cuts = toxicity.fit(np.arange(n), np.zeros(n, dtype=int), x, grades, np.ones(n), 1, 2, steps=1500, l2=0.0)
    assert abs(w[0] - 2) < 0.25 and abs(cuts[0] + 1) < 0.25 and abs(cuts[1] - 1.5) < 0.25


def test_lm(tables, docs, empty):
    for df, rows in ((tables[0], [(r.doc_id, r.text) for r in tables[0].collect()]), (docs, [(r[0], r[1]) for r in ROWS])):
        tokens, counts = [], Counter()
        for i, t in rows:
            w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if c < "\x80" else c for c in t or "")) + [None]
            tokens.append((i, w))
            if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
                counts.update(w)
        n, v = sum(counts.values()), len(counts)
        want = sorted(((i is None, i or 0), len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 5)) for i, w in tokens)
        r = lm_score.score(df).collect()
        assert sorted(((x.doc_id is None, x.doc_id or 0), x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 5)) for x in r) == want
        if df is not docs:
            held = [x for x in r if x.held_out]
            assert sum(x.score for x in held) > sum(x.base_score for x in held)
    assert lm_score.score(empty).count() == 0


def test_lm_is_normalised():
    r = np.random.default_rng(0)
    counts = np.sort(r.pareto(1, 90))[::-1] * 100
    model = lm_score.Model(counts, dimensions=6)
    symbols = r.choice(90, 4000, p=counts / counts.sum())
    contexts = np.stack([np.roll(symbols, k) for k in (1, 2, 3)], axis=1)
    model.train(symbols, contexts, r, [np.zeros(len(x), np.float32) for x in model.parts()], batch=256)
    assert model.k > 5 and len(np.unique(model.bins)) == model.k
    some = contexts[:20]
    got = np.stack([model.scorer()(np.full(20, s), some) for s in range(90)])
    assert np.allclose((10**got).sum(axis=0), 1, atol=1e-4)
    for i, ctx in enumerate(some):  # by the formula, one context at a time
        h = sum(model.r[c] @ model.c[6 * k : 6 * k + 6] for k, c in enumerate(ctx))
        z, zb = np.exp(model.q[:, :6] @ h + model.q[:, 6]), np.exp(model.qb[:, :6] @ h + model.qb[:, 6])
        want = [zb[model.bins[s]] / zb.sum() * z[s] / z[model.bins == model.bins[s]].sum() for s in range(90)]
        assert np.allclose(10 ** got[:, i], want, rtol=1e-3)


def test_lm_learns_from_context(spark):
    r = random.Random(4)
    follows = {w: r.sample(WORDS[:60], 2) for w in WORDS[:60]}
    texts = []
    for _ in range(300):
        w, out = r.choice(WORDS[:60]), []
        for _ in range(60):
            out.append(w)
            w = r.choice(follows[w])
        texts.append(" ".join(out))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    held = [x for x in lm_score.score(df).collect() if x.held_out]
    gain = sum(x.score - x.base_score for x in held) / sum(x.n_tokens for x in held)
    assert len(held) > 20 and gain > 0.8  # of log10(60) = 1.78 a word, two in sixty follow


def test_symbols_grow_with_the_vocabulary(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(lm_score, "fitted", lambda training, symbols, counts: seen.append(symbols.words) or lm_score.Model(counts))
    for n in (400, 1600):
        lm_score.score(spark.createDataFrame([(k, " ".join(f"w{i}" for i in range(n))) for k in range(4)], "doc_id long, text string")).collect()
    assert seen[1] > 1.8 * seen[0]



@pytest.mark.parametrize("most,chunk", [(0, 1024), (0, 2), (1 << 22, 1024)])
def test_far_links_both_ways(spark, monkeypatch, most, chunk):
    monkeypatch.setattr(near_dedup, "BROADCAST_MOST", most)
    monkeypatch.setattr(near_dedup, "CHUNK", chunk)
    r = random.Random(21)
    shared = [prose(n, r) for n in (12, 40, 70)]
    texts = [edited(shared[k % 3], 0.02 * (k % 4), r) for k in range(24)] + [prose(r.randint(30, 400), r) + " " + shared[k % 3] + " " + prose(r.randint(30, 200), r) for k in range(30)]
    sets = [shingles(t) for t in texts]
    df = spark.createDataFrame([*enumerate(texts), *((100 + i, t) for i, t in enumerate(texts[::5]))], "doc_id long, text string").repartition(5)
    got = {x.doc_id: x for x in near_dedup.near_duplicates(df, far=True).collect()}
    first = {t: i for i, t in reversed(list(enumerate(texts)))}
    distinct = sorted(first.values())
    want = {i: sum(i != j and len(sets[i] & sets[j]) >= 0.7 * min(len(sets[i]), len(sets[j])) - 1e-9 for j in distinct) for i in distinct}
    assert {i: got[i].n_links for i in distinct} == want and sum(want.values()) > 200
    assert all(got[100 + k].n_links == want[first[t]] and got[100 + k].class_id == first[t] for k, t in enumerate(texts[::5]))


def test_clashing_names_and_repeats(spark):
    r = random.Random(31)
    t = prose(60, r)
    rows = [(1, t, 7, 8, 9, "a"), (1, t, 7, 8, 9, "b"), (None, t, 7, 8, 9, "c"), (None, None, 7, 8, 9, "d"), (2, "", 7, 8, 9, "e"), (3, t + " " + prose(5, r), 7, 8, 9, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id long, _spans long, digest long, key string")
    kept = near_dedup.deduplicate(df).collect()
    assert df.columns == near_dedup.deduplicate(df).columns and all((x._id, x._spans, x.digest) == (7, 8, 9) for x in kept)
    assert sum((x.text or "").startswith(t) for x in kept) == 1 and sum(not x.text for x in kept) == 1
    clean = substring_dedup.without_repeats(df)
    assert clean.columns == df.columns and clean.count() == len(rows)
    out = mixing.mix_documents(df.withColumn("source", df.key))
    assert out.where("words > 0").count() > 0


def test_one_index_serves_all_blocks(spark, monkeypatch):
    built = []
    plain = decontaminate.FMIndex.__init__
    monkeypatch.setattr(decontaminate.FMIndex, "__init__", lambda self, *a: built.append(1) or plain(self, *a))
    import pyarrow as pa

    windows = decontaminate.benchmark_windows([("a", " ".join(TEXTS[0].split()[:40])), ("b", PASSAGE)])
    whole = list(decontaminate.shard_results(pa.array([t or "" for t in TEXTS]), windows, decontaminate.vocabulary(windows)))
    one = len(built)
    monkeypatch.setattr(decontaminate, "WINDOW_BLOCK", 7)
    monkeypatch.setattr(decontaminate, "window_blocks", lambda w: ((w[0][k : k + 7], w[1][k : k + 7], w[2][k : k + 7]) for k in range(0, len(w[0]), 7)))
    parts = list(decontaminate.shard_results(pa.array([t or "" for t in TEXTS]), windows, decontaminate.vocabulary(windows)))
    assert len(built) == 2 * one and len(windows[0]) > 21
    assert all((x[7] == y[7]).all() and x[8] == y[8] for x, y in zip(whole, parts)) and any(x[7].any() for x in whole)


def test_quality_fit_sends_the_driver_little(tables, monkeypatch):
    d, labels = tables
    sent = []
    plain = type(d).collect
    monkeypatch.setattr(type(d), "collect", lambda self: (lambda rows: sent.append(sum(len(v) for r in rows for v in r if isinstance(v, (bytes, bytearray)))) or rows)(plain(self)))
    model = quality.fit(d, labels)
    sample = len(model["y"])
    assert sample > 300 and model["basis"].shape == (quality.FEATURES, quality.DIMENSIONS) and model["vectors"].shape == (sample, quality.DIMENSIONS)
    assert 0 < sum(sent) < sample * quality.FEATURES  # the features alone are four times that


def test_latent_space_is_exact_in_little_memory():
    r = np.random.default_rng(11)
    few = np.repeat(np.eye(3, quality.FEATURES, dtype=np.float32), 5, axis=0)
    same = np.eye(200, quality.FEATURES, dtype=np.float32)
    x = (r.standard_normal((600, 600)) * 0.99 ** np.arange(600) @ r.standard_normal((600, quality.FEATURES))).astype(np.float32)
    for rows in (x, few, same):
        tracemalloc.start()
        basis, vectors = quality.latent(rows)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 70e6  # by way of the square matrix of all features: 85 MB
        assert basis.shape == (quality.FEATURES, quality.DIMENSIONS) and vectors.shape == (len(rows), quality.DIMENSIONS)
        assert np.abs(basis.T @ basis - np.eye(quality.DIMENSIONS)).max() < 1e-5
        values = np.linalg.svd(rows.astype(np.float64), compute_uv=False)[: quality.DIMENSIONS] ** 2
        got = (np.linalg.norm(rows.astype(np.float64) @ basis, axis=0) ** 2)[: len(values)]
        assert np.allclose(got, values, rtol=1e-5, atol=1e-5 * values[0])


@pytest.mark.parametrize("most", [60, 1 << 21])
def test_far_links_send_no_pairs(spark, monkeypatch, most):
    """Beyond the first broadcast too links are counted where the larger texts are read; no text is sent to a bucket."""
    r = random.Random(41)
    base = prose(60, random.Random(7))
    small = [" ".join([*base.split()[:-3], f"w{k}a", f"w{k}b", f"w{k}c"]) for k in range(8)]
    texts = [*small, *(prose(70, r) + " " + base + " " + prose(r.randint(60, 90), r) for _ in range(40)), "", "one"]
    sets = [shingles(t) for t in texts]
    want = {i: sum(i != j and max(len(a), len(b)) > 2 * min(len(a), len(b)) and len(a & b) >= 0.7 * min(len(a), len(b)) - 1e-9 and min(len(a), len(b)) > 0 for j, b in enumerate(sets)) for i, a in enumerate(sets)}
    df = spark.createDataFrame([*enumerate(texts), *((100 + i, t) for i, t in enumerate(texts[::3]))], "doc_id long, text string").repartition(1)
    reps = near_dedup.signature_table(df).groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n_copies"), F.first("size").alias("size")).withColumn("cls", F.xxhash64("digest")).cache()
    monkeypatch.setattr(near_dedup, "BROADCAST_MOST", 0)
    monkeypatch.setattr(near_dedup, "PART_MOST", most)
    monkeypatch.setattr(type(df), "repartition", lambda *a: pytest.fail("texts are sent to buckets"))
    rows = near_dedup.far_links(df, reps, 0.7, 2.0).collect()
    got, ids = Counter(), {x.cls: x.class_id for x in reps.collect()}
    for x in rows:
        got[ids[x.cls]] += x.links
    assert got == Counter({i: n for i, n in want.items() if n}) and sum(got.values()) == 640
    size = {x.cls: x.size for x in reps.collect()}
    assert all(x.holder_size == (size[x.holder] if x.holder != x.cls else 0) for x in rows)


def test_far_links_take_marks_from_the_signatures(spark, monkeypatch):
    """The pass that makes signatures keeps the lowest hashes, so that texts are cut once less; the links stay."""
    r = random.Random(43)
    base = prose(40, random.Random(8))
    texts = [base, " ".join([*base.split()[:-2], "x", "y"]), prose(9, r), "", *(prose(80, r) + " " + base + " " + prose(60, r) for _ in range(6))]
    df = spark.createDataFrame([*enumerate(texts), (50, texts[0])], "doc_id long, text string")
    passes, plain = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, *a: passes.append(f.__name__) or plain(self, f, *a))
    got = []
    for marked in (False, True):
        table = near_dedup.signature_table(df, marked=marked)
        reps = table.groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n_copies"), F.first("size").alias("size"), *[F.first("hs").alias("hs")] * marked).withColumn("cls", F.xxhash64("digest")).cache()
        passes.clear()
        got.append((sorted(near_dedup.far_links(df, reps, 0.7, 2.0).groupBy("cls").agg(F.sum("links"), F.max("holder_size")).collect()), len(passes)))
    assert got[0][0] == got[1][0] and len(got[0][0]) >= 8
    assert got[1][1] == got[0][1] - 1


def test_lowest_hashes_leave_room_in_the_bitmap(spark):
    """All marks are found, and of other hashes fewer pass than in one bitmap for all."""
    n_bits = 1 << 14
    g = np.random.default_rng(3)
    marks = np.concatenate([np.sort(g.integers(0, 2**64, 600, dtype=np.uint64))[:32] for _ in range(200)]).view(np.int64)
    marks = np.concatenate([marks, np.array([0, -1, 2**63 - 1, -(2**63), 2**61, 2**62], dtype=np.int64)])
    df = spark.createDataFrame([(int(h),) for h in marks], "h long")
    bits = near_dedup.bitmap(df.select(near_dedup.levelled_column("h", n_bits).alias("cls")), df, n_bits).value
    plain = near_dedup.bitmap(df.select(F.col("h").alias("cls")), df, n_bits).value
    assert near_dedup.has_bit(bits, near_dedup.levelled(marks, n_bits)).all()
    other = g.integers(0, 2**64, 20_000, dtype=np.uint64).view(np.int64)
    assert near_dedup.has_bit(bits, near_dedup.levelled(other, n_bits)).mean() < 0.6 * near_dedup.has_bit(plain, other).mean()


def test_lm_training_makes_few_passes(monkeypatch):
    """Rows are ordered by radix wherever 16 bits hold their numbers, and the scores stay those of the plain formula."""
    g = np.random.default_rng(5)
    model = lm_score.Model(np.sort(g.integers(1, 500, 300))[::-1].astype(float))
    symbols, contexts = g.integers(0, 300, 5000), g.integers(0, 301, (5000, lm_score.CONTEXT))
    kinds = set()
    plain = np.argsort
    monkeypatch.setattr(np, "argsort", lambda a, *x, **k: kinds.add(np.asarray(a).dtype.itemsize) or plain(a, *x, **k))
    model.train(symbols, contexts, g, [np.zeros(len(x), dtype=np.float32) for x in model.parts()])
    monkeypatch.undo()
    assert kinds == {2}
    d = model.d
    for scale in (1, 200):  # also where exponentials would overflow
        model.q[:, :d] *= scale
        hidden = sum(model.r[contexts[:, k]].astype(float) @ model.c[k * d : (k + 1) * d] for k in range(lm_score.CONTEXT))
        bins = hidden @ model.qb[:, :d].T + model.qb[:, d]
        want = (bins - np.logaddexp.reduce(bins, axis=1, keepdims=True))[np.arange(5000), model.bins[symbols]]
        z = np.where(model.bins[None, :] == model.bins[symbols][:, None], hidden @ model.q[:, :d].T + model.q[:, d], -np.inf)
        want += z[np.arange(5000), symbols] - np.logaddexp.reduce(z, axis=1)
        got = model.scorer()(symbols, contexts)
        assert np.isfinite(got).all() and np.allclose(got, want / np.log(10), rtol=1e-3, atol=1e-3)


def test_lm_step_does_no_work_twice(monkeypatch):
    """A batch's noise symbols and bins, each once, go through one product; a step is that of the plain formulas."""
    g = np.random.default_rng(6)
    model, plain = (lm_score.Model(np.array([4000.0, 900, 300] + [5.0] * 40), dimensions=6) for _ in range(2))
    symbols, contexts = g.integers(0, 43, 700), g.integers(0, 44, (700, lm_score.CONTEXT))
    seen = []
    exp = np.exp
    monkeypatch.setattr(np, "exp", lambda x, *a, **k: seen.append(np.shape(x)) or exp(x, *a, **k))
    touched = [np.zeros(len(x), dtype=np.float32) for x in model.parts()]
    model.train(symbols, contexts, np.random.default_rng(1), touched)
    monkeypatch.undo()
    r = np.random.default_rng(1)
    r.permutation(700)
    draws = [np.searchsorted(np.cumsum(p), r.random(lm_score.NOISE)) for p in (model.unigram, model.bin_unigram)]
    assert [s[1] for s in seen if len(s) == 2 and s[0] == 700] == [sum(len(np.unique(x)) for x in draws)]
    d, k, h = 6, lm_score.CONTEXT, plain.r[contexts].reshape(700, -1).astype(float) @ plain.c
    g_h, want = np.zeros((700, d)), []
    for table, t, neg, p in ((plain.q, symbols, draws[0], model.unigram), (plain.qb, plain.bins[symbols], draws[1], model.bin_unigram)):
        odds = lambda at: h @ table[at, :d].T + table[at, d] - np.log(lm_score.NOISE * p[at])  # noqa: B023, E731
        wrong, right = 1 / (1 + np.exp(-odds(neg))), -1 / (1 + np.exp(odds(np.arange(len(table)))[np.arange(700), t]))
        g_h += right[:, None] * table[t, :d] + wrong @ table[neg, :d]
        x, one = np.zeros(table.shape), np.concatenate((h, np.ones((700, 1))), axis=1)
        np.add.at(x, t, right[:, None] * one)
        np.add.at(x, neg, wrong.T @ one)
        want.append((x, np.bincount(np.concatenate((t, neg)), minlength=len(table))))
    x = np.zeros(plain.r.shape)
    np.add.at(x, contexts.ravel(), (g_h @ plain.c.T).reshape(-1, d))
    want = [(x, np.bincount(contexts.ravel(), minlength=44)), *want, (plain.r[contexts].reshape(700, -1).T @ g_h / 700, np.ones(k * d))]
    for part, (x, times) in enumerate(want):
        assert (touched[part] == times).all()
        total = 1e-2 + (x**2).mean(axis=1)
        step = (lm_score.RATE * (0.1 if part == 3 else 1) / np.sqrt(total))[:, None] * x
        assert np.allclose(model.parts()[part], plain.parts()[part] - step, atol=1e-4) and np.allclose(model.sums[part], total, rtol=1e-3)


def test_lm_symbols_need_no_search(monkeypatch):
    g = np.random.default_rng(8)
    key = g.integers(0, 1 << 57, 3000)
    key[:200] = (1 << 40) + np.arange(200)  # also where keys aren't spread
    for n in (0, 1, 150, 2000):
        symbols, rank = lm_score.Symbols(key[:n].copy()), {x: i for i, x in enumerate(key[:n].tolist())}
        asked = np.concatenate((key, key - 1, key + 1, [0, (1 << 57) - 1]))
        asked = asked[(asked >= 0) & (asked < 1 << 57)]
        with monkeypatch.context() as m:
            m.setattr(np, "searchsorted", None)
            got = symbols(asked)
        assert got.tolist() == [rank.get(x, n + x % lm_score.CLASSES) for x in asked.tolist()]
