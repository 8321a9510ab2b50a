"""The small inputs of FIXTURES section A as our own fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import commands
from tessera.operators.commands import Settings
from tessera.plans.language import QueryError
from tessera.plans.session import Session
from tessera.sources import readers, tables
from tessera.sources.build import mode_of, tree_numbers, with_parents, with_tree
from tessera.sources.corpus import Corpus

MV6 = [(0, "tok0", "Hunting", "1999-01-01"), (1, "tok1", "Hunting|Fishing", "2001-05-03"), (2, "tok2", "zebra|apple", "not-a-date"), (3, "tok3", "a|a|b", "2020-12-31"), (4, "tok4", "", "1900-12-31"), (5, "tok5", "Fishing", "2000-01-01")]


@pytest.fixture(scope="module")
def mv6(spark):
    t = spark.createDataFrame(MV6, "pos long, form string, domain string, text_date string").withColumns({"text_idx": F.lit(0).cast("long"), "s_idx": F.lit(0).cast("long")})
    return Session(Corpus(t, ["form", "domain", "text_date"], multivalue={"domain"}))


def n(session, text):
    return session.query(text).df.count()


@pytest.mark.parametrize("text, expected", [('[domain="Hunting"]', 2), ('[domain="Fishing"]', 2), ('[domain="zebra"]', 1), ('[domain!="nothing"]', 6), ('a:[form="tok0"] b:[form="tok1"] :: a.domain = b.domain', 1), ('a:[form="tok0"] with b:[form="tok1"] :: a.domain = b.domain', 1), ("[nvals(domain) = 2]", 3), ("[] :: year(text_date) >= 2000", 3), ('a:[form="tok1"] :: year(a.text_date) = 2001', 1), ("[] :: century(text_date) = 20", 2), ("[] :: decade(text_date) = 2000", 2), ('a:[form="tok1"] :: month(a.text_date) = 5 & day(a.text_date) = 3 & week(a.text_date) = 18', 1)])
def test_mv6(mv6, text, expected):
    assert n(mv6, text) == expected


def test_mv6_commands(mv6):
    row = mv6.run('[form="tok1"]; tabulate year(text_date), century(text_date), decade(text_date), month(text_date), week(text_date), day(text_date)').first()
    assert list(row)[2:] == ["2001", "21", "2000", "5", "18", "3"]
    row = mv6.run("[]; freq by strlen(form)").first()
    assert (row.key, row["count"]) == ("4", 6)
    row = mv6.run("a:[]; stats avg(strlen(a.form)), median(strlen(a.form))").first()
    assert tuple(row) == (6, 6, 4.0, 6, 4.0)
    got = {r.value: r["count"] for r in mv6.run("show values domain").collect()}
    assert got == {"Hunting": 2, "Fishing": 2, "zebra": 1, "apple": 1, "a": 1, "b": 1}


DEP3 = "\n".join(json.dumps(x) for x in [{"type": "header", "positional": ["form", "upos", "deprel"]}, {"type": "token", "tok_id": "w-1", "head_tok_id": "w-2", "form": "A", "upos": "DET", "deprel": "det"}, {"type": "token", "v": ["B", "NOUN", "obj"], "tok_id": "w-2", "head_tok_id": "w-3"}, {"type": "token", "tok_id": "w-3", "head": 0, "form": "C", "upos": "VERB", "deprel": "root"}, {"type": "region", "struct": "s", "start_pos": 1, "end_pos": 3, "attrs": {"sent_id": "x"}}])


def test_dep3(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(DEP3)
    s = Session(readers.read(spark, str(tmp_path / "a.jsonl"), "jsonl"))
    r = s.corpus.regions["s"].first()
    assert (r.start_pos, r.end_pos, r.sent_id) == (0, 2, "x")
    assert [n(s, q) for q in ('[form="B" & child[upos="DET"]]', '[form="B" & not child[upos="DET"]]', '[form="B"] > [upos="DET"]', '[form="C"] >> [form="A"]', '[form="A"] << [form="C"]', '[form="A" & ancestor[form="C"]]')] == [1, 0, 1, 1, 1, 1]
    assert s.corpus.check().where("failures > 0").count() == 0
    out = commands.sentences(s.lowering, s.query('[form="B"]'), Settings()).first().conllu
    assert "# match_tokens = 2" in out and "1\tA\t_\tDET" in out and "\t2\tdet" in out


CONLLU = """# newdoc id = d1
# newregion text
# text_lang = en
# sent_id = s1
1-2\tcan't\t_\t_\t_\t_\t_\t_\t_\t_
1\tcan\tcan\tAUX\tMD\tVerbForm=Fin|Mood=Ind\t3\taux\t_\ttuid=t1|SpaceAfter=No
2\tnot\tnot\tPART\tRB\t_\t3\tadvmod\t_\t_
2.1\tx\tx\tX\tX\t_\t_\t_\t_\t_
3\tgo\tgo\tVERB\tVB\t_\t0\troot\t_\t_

# newregion text
# text_lang = fr
# text_en = a translation
1\toui\toui\tINTJ\t_\t_\t0\troot\t_\t_
"""


def test_conllu(spark, tmp_path):
    (tmp_path / "a.conllu").write_text(CONLLU)
    c = readers.read(spark, str(tmp_path / "a.conllu"), "conllu")
    s = Session(c)
    assert c.size() == 4 and {k: r.count() for k, r in c.regions.items()} == {"contr": 1, "doc": 1, "s": 2, "text": 2}
    assert [n(s, q) for q in ('"can\'t"', '[feats/Mood="Ind"]', '[text_lang="fr"]', '[tuid="t1"]', '[upos="VERB" & count(child) = 2]', '[upos="AUX"] [upos="PART"] within contr', '[s_sent_id="s1"]', '[s_text_en=/trans/]', "[] [upos=\"INTJ\"] within text", '<text lang="fr"> []')] == [1, 1, 1, 1, 1, 1, 3, 1, 0, 1]
    path = str(tmp_path / "saved")
    c.save(path)
    assert Session(Corpus.open(spark, path)).run("[]; count by text_lang").count() == 2
    split = readers.read(spark, str(tmp_path / "a.conllu"), "conllu", split_feats=True)
    assert "feats#Mood" in split.attrs


def test_vertical_and_overlay(spark, tmp_path):
    (tmp_path / "a.vrt").write_text('<!-- #vrt positional-attributes: word lemma upos -->\n<text id="1">\n<s>\nThe\tthe\tDET\n<np type="x">\n<np type="y">\ncat\tcat\tNOUN\n</np>\nsat\tsit\tVERB\n</np>\n<pause/>\n</s>\n</text>\n')
    c = readers.read(spark, str(tmp_path / "a.vrt"), "vertical")
    s = Session(c)
    assert c.modes["np"] == "nested" and c.regions["np"].where("par is not null").count() == 1
    assert [n(s, q) for q in ('[np_type="x"]', '[np_type="y"]', '[nvals(np_type) = 2]', "x:<np> []", '[form="cat"] [] within np')] == [2, 1, 1, 2, 1]
    (tmp_path / "b.vrt").write_text("<!-- positional-attributes: word note -->\nThe\ta\ncat\tb\nsat\tc\n")
    both = c.with_overlay("user", "n1", readers.read(spark, str(tmp_path / "b.vrt"), "vertical"))
    assert "overlay-user-n1-form" in both.attrs


def test_groups_and_streaming(spark, tmp_path):
    rows = [{"type": "header", "positional": ["form"], "token_groups": ["err"]}] + [{"type": "token", "form": x} for x in "abcde"] + [{"type": "region", "struct": "s"}, {"type": "region", "struct": "err", "spans": [[0, 1], [3, 3]], "attrs": {"code": "X"}}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(map(json.dumps, rows)))
    s = Session(readers.read(spark, str(tmp_path / "in"), "jsonl"))
    assert n(s, '<err code="X">') == 1 and n(s, '<err type="X">') == 1
    s.query('D = [form="d"]')
    s.query('C = [form="c"]')
    assert n(s, '<err code="X"> where D') == 1 and n(s, "<err> where C") == 0
    from tessera.streaming import ingest

    ingest.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), "jsonl").awaitTermination()
    assert ingest.open_events(spark, str(tmp_path / "out")).size() == 5


def test_brackets(spark, tmp_path):
    (tmp_path / "a.psd").write_text("(S (NP (DT the) (NN cat)) (VP (VB sat)))")
    s = Session(readers.read(spark, str(tmp_path / "a.psd"), "brackets"))
    assert n(s, 'p:<node type="S"> c:<node type="NP"> [] :: contains(p, c) = 1') == 1
    assert n(s, '[xpos="NN" & node_type="NP"]') == 1


def test_cwb(spark, tmp_path):
    import numpy as np

    (tmp_path / "word.lexicon").write_bytes(b"the\0cat\0")
    np.array([0, 1, 0], dtype=">i4").tofile(tmp_path / "word.corpus")
    np.array([[0, 1]], dtype=">i4").tofile(tmp_path / "s.rng")
    c = readers.read_cwb(spark, str(tmp_path), ["word"], ("s",))
    assert [r.form for r in c.tokens.orderBy("pos").collect()] == ["the", "cat", "the"] and c.regions["s"].count() == 1


def test_tree_numbers():
    heads = [1, -1, 1, 2, 0]
    out = tree_numbers(heads)
    assert [r[0] for r in out] == [1, 0, 1, 2, 2] and [r[4] for r in out] == [1, 4, 1, 0, 0] and out[1][5:] == (0, 4)


def test_build(spark):
    t = spark.createDataFrame([(i, 0, i // 3, h) for i, h in enumerate([1, None, 1, None, 3, 4])], "pos long, text_idx long, s_idx long, head_pos long")
    got = {r.pos: (r.depth, r.ndesc) for r in with_tree(t).collect()}
    assert got == {0: (1, 0), 1: (0, 2), 2: (1, 0), 3: (0, 2), 4: (1, 1), 5: (2, 0)}
    r = spark.createDataFrame([(0, 0, 9, 0), (1, 2, 5, 0), (2, 3, 4, 0), (3, 2, 5, 0)], "region_idx long, start_pos long, end_pos long, text_idx long").withColumn("par", F.lit(None).cast("long"))
    assert {x.region_idx: x.par for x in with_parents(r).collect()} == {0: None, 1: 0, 3: 0, 2: None}
    assert mode_of(r).first().nested == 3


def test_session(mv6):
    with pytest.raises(QueryError):
        mv6.run("size Nothing")
    mv6.run('A = [form="tok1"]; B = [domain="Fishing"]')
    assert commands.combine("intersect", mv6.named["A"], mv6.named["B"]).count() == 1
    mv6.run("set limit 1")
    assert mv6.settings.limit == 1 and mv6.run("[]; cat").count() == 1
    mv6.run("drop A")
    assert "A" not in mv6.named
    with pytest.raises(QueryError):
        mv6.run('[nothing="x"]')
    with pytest.raises(QueryError):
        mv6.run('a:[] a:[form="x"]')


def test_long_conversations(spark, tmp_path):
    """Turns of 1,024 and more don't reach into the next conversation."""
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"w{k} one") for k in range(1100)] + [(2, k, "assistant", f"v{k} two three") for k in range(100)] + [(3, 0, "user", "x"), (3, 0, "user", "x"), (None, 1, "user", "y")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    c = tables.conversations_corpus(spark, str(tmp_path))
    texts = c.regions["text"].orderBy("region_idx").collect()
    assert [(int(r.tuid), int(r.turn)) for r in texts] == sorted(r[:2] for r in rows if r[0] is not None)
    assert len({r.text_idx for r in texts}) == len(texts) == 1202
    own = {r.text_idx: r.tuid for r in texts}
    tokens = c.tokens.select("pos", "text_idx", "form").collect()
    assert len({r.pos for r in tokens}) == len(tokens) == 1100 * 2 + 100 * 3 + 2
    assert all(own[r.text_idx] == "1" for r in tokens if r.form == "one") and all(own[r.text_idx] == "2" for r in tokens if r.form == "two")
