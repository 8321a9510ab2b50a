import pytest

from tessera.plans import dialects
from tessera.plans.language import Command, QueryError, Test, parse


@pytest.mark.parametrize("text", ['[form="a"]', "[form=/a/]", '[form="a.*"]', '[feats/Number="Sing"]', 'h:[upos="V"] s:dep_subtree(h)', "[]; stats avg(strlen(form)), median(f(lemma)) by text_lang", '[form="x"]; coll on a by lemma', "dcoll a.children by lemma", '[a="x" %c %d]', "[] within s having [form=\"x\"]"])
def test_accepts(text):
    assert parse(text)


@pytest.mark.parametrize("text", ['[form!="a.*"]', '[a="x" %cd]', "[form=", '[form="a"] garbage', "a:[] :: a.x < b.y", "[child]", "[]{3,1}"])
def test_refuses(text):
    with pytest.raises(QueryError):
        parse(text)


def test_patterns():
    assert parse('[form="ab"]')[0].query.slots[0].cond == Test("form", "=", "ab")
    assert parse('[form="a."]')[0].query.slots[0].cond.regex == "whole"
    assert parse('[form="a."]', strict=True)[0].query.slots[0].cond.regex == ""
    assert len(parse("[] /re/")[0].query.slots) == 2


def test_commands():
    q, c = parse("[]; tabulate Q 2 7 a.form, year(text_date)")
    assert isinstance(c, Command) and c.names == ["Q"] and c.args == {"offset": 2, "limit": 7} and [str(f) for f in c.fields] == ["a.form", "year(text_date)"]
    assert parse("dcoll Q head, nsubj by lemma")[0].args["relations"] == ["head", "nsubj"]


@pytest.mark.parametrize("name, text", [("tiger", "dom NP VP"), ("tiger", "# note\nidom NP VP\ncat S"), ("cwb", '[lemma="a"][lemma="b"]'), ("cwb", "group by match lemma"), ("cwb", '[lemma="the"]; tabulate 0 5 lemma'), ("pmltq", 'a-node [ lemma = "the" and tag = "DT" ]'), ("pmltq", 'a-node $a := [ form ~ "th.*" ] >> distinct $a.form, count(over $a.form)')])
def test_dialects(name, text):
    assert parse(dialects.DIALECTS[name](text))


@pytest.mark.parametrize("name, text", [("tiger", "dom NP"), ("tiger", ""), ("cwb", 'count [lemma="x"]'), ("cwb", '[lemma="a"] | [lemma="b"]'), ("cwb", '![lemma="x"]'), ("cwb", '[lemma="x"] ::'), ("cwb", "count by lemma.sub"), ("cwb", "group by match"), ("pmltq", "[a-node []]")])
def test_dialects_refuse(name, text):
    with pytest.raises(QueryError):
        dialects.DIALECTS[name](text)
