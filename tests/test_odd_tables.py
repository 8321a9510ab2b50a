"""Registered queries against their SQL on small odd tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.operators.commands import Settings
from tessera.plans import catalog, lower
from tessera.plans.session import Session
from tessera.sources import tables
from tessera.sources.corpus import Corpus


def same(spark, folder, name):
    """The query's rows and those of its SQL over the tables in a folder."""
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    result = con.execute(catalog.ORACLES[name])
    names = [c[0] for c in result.description]
    plain = lambda v: round(v, 5) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v
    want = sorted((tuple(map(plain, r)) for r in result.fetchall()), key=repr)
    df = catalog.QUERIES[name](spark, str(folder))
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr) == want
    return want


def write(spark, folder, documents, labels=(), conversations=()):
    for name, rows, kind in (("documents", documents, "doc_id long, text string, lang string, source string"), ("labels", labels, "doc_id long, quality int, toxic int"), ("conversations", conversations, "conv_id long, turn long, role string, text string")):
        spark.createDataFrame(list(rows), kind).coalesce(2).write.parquet(f"{folder}/{name}.parquet")


def test_long_run_of_a_bare_word(spark, tmp_path):
    """More than 100 times the same word is one match of the bare word."""
    write(spark, tmp_path, [(1, "la " * 250 + "fin la", "fr", "src1"), (2, "x " + "la " * 100 + "y", "es", "src2"), (3, "la " * 101, "fr", "src1")])
    assert [r[:2] for r in same(spark, tmp_path, "bare_word")] == [("es", 1), ("fr", 3)]
    s = catalog.session(spark, str(tmp_path))
    assert s.query('[form="la"]+').df.count() == 3 + 1 + 1 + 2 and s.query('"la"{1,50}').df.count() == 5 + 1 + 2 + 3
    s.run("set max_gap 10")
    assert s.query('"la"').df.count() == 25 + 1 + 10 + 11


NAMED = ("tabulate_nested", "show_values_mv", "stats_by", "within_nested", "tabulate", "align_not", "nvals_none", "mv_neq", "rcontains", "within_s", "nvals", "run_unbounded", "coll_measures", "dep_subtree_tcnt", "freq_subcorpus", "fold_c", "eq_or", "fold_d", "anchor_nested", "align")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Texts that end on and beside the borders of sentences and cells, blanks of all kinds, empty and null ones, words of signs only."""
    folder = tmp_path_factory.mktemp("odd")
    words = ["the", "was", "really", "deeply", "a", "la", "is", "--", "THE", "the,", "Élé", "élé", "quickly", "red", "singing", "«é»", "x|y", "_", "Noun", "house", "was", "the", "slowly"]
    text = lambda n, k: " ".join(words[(i * i + k * i) % len(words)] for i in range(n))
    documents = [(i, text(n, i), ("en", "de", "fr", "es")[i % 4], f"src{i % 3}") for i, n in enumerate((1, 5, 19, 20, 21, 63, 64, 65, 130, 500, 64, 320))]
    documents += [(100, "", "en", "src0"), (101, None, "en", "src0"), (102, " \t\r\n ", "en", "src0"), (103, "\n the\t\u000bwas\fthe  slowly quickly\r", "en", "src1"), (104, "-- ... the the !? was", "de", "src1"), (None, "the the", "en", "src0"), (1 << 30, "la la really deeply was the red slowly singing", "es", "src2"), (105, "really\u0085 deeply  th e", "en", "_")]
    write(spark, folder, documents, [(0, 1, 0), (5, 0, 1), (6, None, 1)], [(1, 0, "user", "the end"), (1, 1, "assistant", "and and")])
    return folder


@pytest.mark.parametrize("name", [*NAMED, "seq3", "optional", "within_having", "not_within", "within_value", "coll_on_label", "gov_trans", "containing", "dep_subtree_named", "region_enum", "raw", "kwic", "check", "set_diff", "show_info"])
def test_odd_texts(spark, odd, name):
    same(spark, odd, name)


def joins(df):
    return sum(" Join " in line or line.lstrip(" :+-").startswith("Join ") for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines())


@pytest.mark.parametrize("name, most", [("align", 0), ("align_not", 0), ("within_s", 0), ("tabulate", 0), ("stats_by", 0), ("show_values_mv", 0), ("eq_or", 1), ("fold_c", 1), ("mv_neq", 1), ("nvals_none", 1), ("dep_subtree_tcnt", 1), ("within_nested", 1), ("anchor_nested", 3), ("rcontains", 5)])
def test_tokens_are_not_looked_up(spark, odd, name, most):
    """Values travel with the matches, neighbours come off the same scan, and no derived table is written first. One join is that
    with the total's row."""
    df = catalog.QUERIES[name](spark, str(odd))
    assert joins(df) <= most
    assert {f.split("/")[-2] for f in df.inputFiles()} == {"documents.parquet"}


def test_nested_regions_of_the_matches_only(spark, odd):
    """Nested regions meet matches by cells of 64 positions; they aren't spread over all of their positions."""
    for name in ("tabulate_nested", "nvals", "nested_region_attr", "within_nested"):
        plan = catalog.QUERIES[name](spark, str(odd))._jdf.queryExecution().optimizedPlan().toString()
        assert "_cell" in plan and "sequence(start_pos" not in plan


def test_stored_corpus_agrees(spark, odd, tmp_path):
    """A corpus that was written and read again has no neighbours at hand and looks values up by position."""
    derived = catalog.corpus(spark, str(odd))
    derived.save(str(tmp_path / "c"))
    settings = {"group_limit": 0, "max_items": 0, "limit": 0, "min_freq": 1}
    one, two = (Session(c, Settings(**settings)) for c in (derived, Corpus.open(spark, str(tmp_path / "c"))))
    for program in ('[lemma="the"] []? [upos="ADV"] within s; count by text_lang', 'a:[upos="ADV"] > b:[]; tabulate 0 0 b.form, a.feats/Len, text_domain, node_type', "a:[]{2,3} !> [upos=\"NOUN\"]", '[] << [upos="ADV"]{1,2}', 'h:[upos="ADV"] s:dep_subtree(h); tabulate 0 0 spellout(s, form), tcnt(s)', '[lemma="the"] [] within text_lang="en"', '[lemma="the"] not within s having [upos="ADV"]', 'a:[lemma="the"] b:[]; coll on b by form', "keyness by lemma", '<node type="VP" lang="en"> [] </s>; count by text_source', "[nvals(node_type) > 2 | node_type=\"NP\"]; freq by text_lang", "p:<node> c:<node rcontains(p)> [upos=\"ADV\"] :: rcontains(c, p) = 1 & depth(p) = 0"):
        a, b = (sorted(map(repr, s.run(program).collect())) for s in (one, two))
        assert a == b, program


def test_uneven_tables_are_spread(spark, tmp_path):
    """One large row group doesn't leave all but one core idle."""
    rows = spark.range(40_000).selectExpr("id as doc_id", "sha2(cast(id as string), 512) as text")
    rows.coalesce(1).write.parquet(str(tmp_path / "t"))
    df = tables.spread(spark.read.parquet(str(tmp_path / "t")), "doc_id")
    assert df.rdd.getNumPartitions() >= 4 and df.count() == 40_000
    assert sum(n > 0 for n in df.rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()) >= 4


def test_parallel_pairs_are_made_once(spark, odd, monkeypatch):
    """Pairs share one smallest part of each value, so none has to be removed again; keys with many pairs are split."""
    monkeypatch.setattr(lower, "PAIRS_MOST", 3)
    s = catalog.session(spark, str(odd))
    m = s.query('a:[lemma="the"] with b:[lemma="was"] :: a.text_domain = b.text_domain & a.text_lang = b.text_lang')
    a, b = ({(r.lo, r.d, r.l) for r in s.query(f'[lemma="{w}"]').df.select("lo", F.col("_v0_text@domain").alias("d"), F.col("_v0_text@lang").alias("l")).collect()} for w in ("the", "was"))
    parts = lambda x: {p for p in (x or "").split("|") if p and p != "_"}
    want = sorted((x[0], y[0]) for x in a for y in b if parts(x[1]) & parts(y[1]) and parts(x[2]) & parts(y[2]))
    assert sorted((r.lo, r.t_lo) for r in m.df.collect()) == want and len(want) > 100
    plan = m.df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    first = next(k for k, line in enumerate(plan) if "Join" in line)
    assert not any("Aggregate" in line for line in plan[:first])
