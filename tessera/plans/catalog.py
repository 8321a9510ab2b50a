"""The registered queries of the annotated-text engine with their SQL oracles.

All run over the corpus that ``sources.tables`` derives from the whole ``documents`` (or
``conversations``) table. The derived tables are plans: a query computes what it uses of them from the texts.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import commands
from ..operators.commands import Settings
from ..sources import tables
from ..sources.corpus import Corpus
from .lower import Options
from .session import Session

_built: dict[tuple, Corpus] = {}


def corpus(spark, sf_dir: str, kind: str = "documents") -> Corpus:
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _built:
        _built[key] = getattr(tables, f"{kind}_corpus")(spark, sf_dir)
    return replace(_built[key])


def session(spark, sf_dir: str, kind: str = "documents", **settings) -> Session:
    options = Options(binding=settings.pop("binding", "fanout"))
    within = settings.pop("within", "")
    c = corpus(spark, sf_dir, kind)
    c.default_within = within
    return Session(c, Settings(**({"group_limit": 0, "max_items": 0, "limit": 0} | settings)), options)


QUERIES, ORACLES = {}, {}

_BASE = r"""
d as (
  select doc_id, lang, source, strftime(date '1995-01-01' + ((doc_id * 37 % 9000)::int), '%Y-%m-%d') as date, lang || '|' || source as domain,
         list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents where doc_id is not null and text is not null
), tk as (
  select doc_id as text_idx, doc_id * 16777216 as base, lang, source, date, domain, len(w) as n, unnest(w) as form, generate_subscripts(w, 1) - 1 as i from d where len(w) > 0
), tl as (
  select *, i % 20 as j, i // 20 as block, base + i as pos, text_idx * 1048576 + i // 20 as s_idx, least(20, n - (i // 20) * 20) as sn,
         translate(regexp_replace(form, '[!-/:-@\[-`{-~]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lemma
  from tk
), t as materialized (
  select *, case when j > 0 then pos - j + (j - 1) // 2 end as head_pos, case when j = 0 then 'root' else ['root', 'nsubj', 'obj', 'det'][i % 4 + 1] end as deprel,
         case when lemma = '' then 'PUNCT' when length(lemma) <= 2 then 'DET' when regexp_matches(lemma, '(ed|en|re)$') then 'VERB' when regexp_matches(lemma, '(ly|ing)$') then 'ADV' else 'NOUN' end as upos,
         case when regexp_matches(form[1:1], '^[A-Z]') then 'Yes' else 'No' end as cap, length(lemma) as len,
         floor(log2(j + 1))::bigint as depth, (case when 2 * j + 1 < sn then 1 else 0 end + case when 2 * j + 2 < sn then 1 else 0 end)::bigint as nchildren,
         list_sum([greatest(0, least(sn, (j + 1) * 2 ** k + 2 ** k - 1) - (j + 1) * 2 ** k + 1) for k in [1, 2, 3, 4]])::bigint as ndesc
  from tl
)"""
_NODE = """, node as materialized (
  select s_idx * 8 + code as idx, b0 + a as start_pos, least(b0 + z - 1, b1) as end_pos, case when p >= 0 then s_idx * 8 + p end as par, type, text_idx
  from (select s_idx, text_idx, min(pos) as b0, max(pos) as b1 from t group by s_idx, text_idx),
       (values (0, 0, 20, -1, 'S'), (1, 0, 10, 0, 'NP'), (2, 10, 20, 0, 'NP'), (3, 0, 5, 1, 'VP'), (4, 5, 10, 1, 'VP'), (5, 10, 15, 2, 'VP'), (6, 15, 20, 2, 'VP')) as x(code, a, z, p, type)
  where b0 + a <= b1
)"""
_BELOW = """, below as (
  select a.pos as up, b.pos as down from t b, (values (1), (2), (3), (4)) as x(k), t a
  where (b.j + 1) >> k >= 1 and a.pos = b.pos - b.j + ((b.j + 1) >> k) - 1
)"""


def sql(body: str, *more: str) -> str:
    return "with " + _BASE + "".join(more) + "\n" + body


def rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def add(name: str, program: str, oracle: str, *more: str, extents: bool = False, columns: dict | None = None, base: str = "documents", **settings) -> None:
    """Registers a program's last result (or its matches' extents) and the SQL for it."""

    def run(spark, sf_dir):
        s = session(spark, sf_dir, base, **settings)
        out = s.run(program)
        if extents:
            return out.select("lo", "hi")
        return rounded(out.withColumnsRenamed(columns) if columns else out)

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = oracle if oracle.lstrip().startswith("with ") else sql(oracle, *more)


def _count(where: str, key: str = "lang", source: str = "t") -> str:
    return f"select {key} as key, count(*) as count, round(count(*) * 100.0 / sum(count(*)) over (), 6) as pct from {source} where {where} group by {key}"


def _pos(where: str, source: str = "t") -> str:
    return f"select pos as lo, pos as hi from {source} where {where}"


# ---- token predicates
add("count_by_region", '[form="the"]; count by text_lang', _count("form = 'the'"))
add("match_all", "[]; count by text_source", _count("true", "source"))
add("eq_or", '[lemma="a" | lemma="la"]; count by lemma', _count("lemma in ('a', 'la')", "lemma"))
add("neq", '[upos!="NOUN"]; count by upos', _count("upos <> 'NOUN'", "upos"))
add("string_order", '[lemma >= "x" & lemma < "z"]', _pos("lemma >= 'x' and lemma < 'z'"), extents=True)
add("regex_sub", "[form=/tion[a-m]/]", _pos("regexp_matches(form, 'tion[a-m]')"), extents=True)
add("regex_full", '[form="th.*ing"]', _pos("regexp_full_match(form, 'th.*ing')"), extents=True)
add("fold_c", '[form="THE" %c]; count by form', _count("translate(form, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') = 'the'", "form"))
add("fold_d", '[form="ele" %d]; count by form', _count("translate(form, 'éèêàâçëîïôöùûüñíóúá', 'eeeaaceiioouuunioua') = 'ele'", "form"))
add("fold_cd", '[form="ETRE" %c %d]; count by form', _count("translate(translate(form, 'éèêàâçÉÈÊÀÂÇ', 'eeeaacEEEAAC'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') = 'etre'", "form"))
add("mv_eq", '[text_domain="src3" & lemma="the"]; count by text_lang', _count("lemma = 'the' and list_contains(string_split(domain, '|'), 'src3')"))
add("mv_neq", '[text_domain!="en" & lemma="de"]; count by text_lang', _count("lemma = 'de' and lang <> 'en'"))
add("feats_key", '[feats/Cap="Yes" & feats/Len="3"]; count by text_lang', _count("cap = 'Yes' and len = 3"))
add("region_attr", '[text_lang="de" & form="und"]', _pos("lang = 'de' and form = 'und'"), extents=True)
add("region_attr_regex", '[text_source=/src1/ & form="the"]; count by text_source', _count("form = 'the' and contains(source, 'src1')", "source"))
add("nested_region_attr", '[node_type="VP" & form="the"]', "select distinct pos as lo, pos as hi from t join node on pos between start_pos and end_pos where type = 'VP' and form = 'the'", _NODE, extents=True)
add("nvals", '[nvals(text_domain) = 2 & nvals(node_type) = 3 & lemma="is"]; count by text_lang', _count("lemma = 'is'"))
add("nvals_none", "[nvals(lemma) = 0]; count by text_lang", _count("lemma = ''"))
add("and_or", '[(upos="VERB" | upos="ADV") & text_lang="en"]; count by upos', _count("upos in ('VERB', 'ADV') and lang = 'en'", "upos"))
add("child", '[upos="VERB" & child [upos="ADV"]]', _pos("upos = 'VERB' and exists (select 1 from t b where b.head_pos = t.pos and b.upos = 'ADV')"), extents=True)
add("not_child", '[upos="VERB" & not child [upos="NOUN"]]', _pos("upos = 'VERB' and not exists (select 1 from t b where b.head_pos = t.pos and b.upos = 'NOUN')"), extents=True)
add("parent", '[lemma="the" & parent [upos="VERB"]]', "select a.pos as lo, a.pos as hi from t a join t b on a.head_pos = b.pos where a.lemma = 'the' and b.upos = 'VERB'", extents=True)
add("sibling", '[lemma="the" & sibling [upos="ADV"]]', _pos("lemma = 'the' and exists (select 1 from t b where b.head_pos = t.head_pos and b.pos <> t.pos and b.upos = 'ADV')"), extents=True)
add("descendant", '[deprel="root" & descendant [lemma="was"]]', "select distinct t.pos as lo, t.pos as hi from t join below on up = t.pos join t b on b.pos = down where t.deprel = 'root' and b.lemma = 'was'", _BELOW, extents=True)
add("ancestor", '[lemma="was" & ancestor [upos="ADV"]]', "select distinct t.pos as lo, t.pos as hi from t join below on down = t.pos join t b on b.pos = up where t.lemma = 'was' and b.upos = 'ADV'", _BELOW, extents=True)
add("related_or", '[lemma="was" & (child [upos="ADV"] | parent [upos="ADV"])]', _pos("lemma = 'was' and (exists (select 1 from t b where b.head_pos = t.pos and b.upos = 'ADV') or exists (select 1 from t b where b.pos = t.head_pos and b.upos = 'ADV'))"), extents=True)
add("count_child", '[count(child) = 2 & count(child[upos="DET"]) >= 1]; count by text_lang', _count("nchildren = 2 and (select count(*) from t b where b.head_pos = t.pos and b.upos = 'DET') >= 1"))
add("count_descendants", '[count(descendant[upos="ADV"]) > 2]', "select up as lo, up as hi from below join t b on b.pos = down where b.upos = 'ADV' group by up having count(*) > 2", _BELOW, extents=True)

# ---- sequences and scopes
add("seq2", '[upos="DET"] [upos="ADV"]', "select a.pos as lo, b.pos as hi from t a join t b on b.pos = a.pos + 1 where a.upos = 'DET' and b.upos = 'ADV'", extents=True)
add("seq3", 'a:[upos="ADV"] b:[] c:[upos="ADV"]; count by b.upos', "select b.upos as key, count(*) as count, round(count(*) * 100.0 / sum(count(*)) over (), 6) as pct from t a join t b on b.pos = a.pos + 1 join t c on c.pos = b.pos + 1 where a.upos = 'ADV' and c.upos = 'ADV' group by 1")
_RUNS = ", runs as (select text_idx, min(pos) as first, count(*) as n from (select text_idx, pos, pos - row_number() over (partition by text_idx order by pos) as g from t where {}) group by text_idx, g)"
add("run_max", '[upos="VERB"]{2,4}', "select first + k * 4 as lo, first + k * 4 + least(4, n - k * 4) - 1 as hi from (select *, unnest(range((n - 1) // 4 + 1)) as k from runs) where least(4, n - k * 4) >= 2", _RUNS.format("upos = 'VERB'"), extents=True)
add("bare_word", '"la"; count by text_lang', "select lang as key, count(*) as count, round(count(*) * 100.0 / sum(count(*)) over (), 6) as pct from runs join d on doc_id = text_idx group by lang", _RUNS.format("form = 'la'"))
add("run_unbounded", '[upos="NOUN"]+', "select first + k * 100 as lo, first + k * 100 + least(100, n - k * 100) - 1 as hi from (select *, unnest(range((n - 1) // 100 + 1)) as k from runs)", _RUNS.format("upos = 'NOUN'"), extents=True)
add("chain_rep", '[lemma="the"] [upos="ADV"]{1,3} [upos="VERB"]', "select a.pos as lo, z.pos as hi from t a join t b on b.pos = a.pos + 1 left join t c on c.pos = a.pos + 2 left join t d on d.pos = a.pos + 3 join t z on z.pos in (a.pos + 2, a.pos + 3, a.pos + 4) and z.text_idx = a.text_idx where a.lemma = 'the' and b.upos = 'ADV' and z.upos = 'VERB' and (z.pos < a.pos + 3 or c.upos = 'ADV') and (z.pos < a.pos + 4 or d.upos = 'ADV')", extents=True)
add("optional", '[lemma="the"] [upos="ADV"]? [upos="VERB"]', "select a.pos as lo, b.pos as hi from t a join t b on b.pos = a.pos + 1 where a.lemma = 'the' and b.upos = 'VERB' union all select a.pos, c.pos from t a join t b on b.pos = a.pos + 1 join t c on c.pos = a.pos + 2 where a.lemma = 'the' and b.upos = 'ADV' and c.upos = 'VERB'", extents=True)
add("within_s", '[upos="ADV"] [upos="ADV"] within s', "select a.pos as lo, b.pos as hi from t a join t b on b.pos = a.pos + 1 and a.s_idx = b.s_idx where a.upos = 'ADV' and b.upos = 'ADV'", extents=True)
add("default_within", '[upos="ADV"] [upos="ADV"]; size', "select count(*) as size from t a join t b on b.pos = a.pos + 1 and a.s_idx = b.s_idx where a.upos = 'ADV' and b.upos = 'ADV'", within="s")
add("within_nested", '[upos="ADV"] [upos="ADV"] within node', "select a.pos as lo, b.pos as hi from t a join t b on b.pos = a.pos + 1 where a.upos = 'ADV' and b.upos = 'ADV' and exists (select 1 from node where start_pos <= a.pos and end_pos >= b.pos and node.text_idx = a.text_idx)", _NODE, extents=True)
add("within_value", '[lemma="the"] [upos="ADV"] within text_lang="en"', "select a.pos as lo, b.pos as hi from t a join t b on b.pos = a.pos + 1 where a.lemma = 'the' and b.upos = 'ADV' and a.lang = 'en'", extents=True)
add("within_having", '[lemma="the"] within s having [lemma="worthless"]', _pos("lemma = 'the' and s_idx in (select s_idx from t where lemma = 'worthless')"), extents=True)
add("not_within", '[upos="ADV"] [upos="ADV"] not within s', "select a.pos as lo, b.pos as hi from t a join t b on b.pos = a.pos + 1 and a.s_idx <> b.s_idx where a.upos = 'ADV' and b.upos = 'ADV'", extents=True)
_ADV = ", m as (select first + k * 100 as lo, first + k * 100 + least(100, n - k * 100) - 1 as hi, text_idx from (select *, unnest(range((n - 1) // 100 + 1)) as k from runs))"
add("containing", '[upos="NOUN"]{4,100} containing node', "select lo, hi from (select distinct lo, hi from (select lo, hi, unnest(range(lo, hi + 1)) as p from m where hi - lo >= 3) join node on start_pos = p where end_pos <= hi)", _RUNS.format("upos = 'NOUN'"), _ADV, _NODE, extents=True)
add("not_containing", '[upos="NOUN"]{4,100} not containing node', "select m.lo, m.hi from m left join (select distinct lo, hi from (select lo, hi, unnest(range(lo, hi + 1)) as p from m where hi - lo >= 3) join node on start_pos = p where end_pos <= hi) h on h.lo = m.lo and h.hi = m.hi where m.hi - m.lo >= 3 and h.lo is null", _RUNS.format("upos = 'NOUN'"), _ADV, _NODE, extents=True)
_SUB = ", sub as (select up, min(down) as a, max(down) as z from (select * from below union all select pos, pos from t) group by up)"
add("containing_subtree", '[upos!="DET"]{4,100} containing subtree [nvals(upos) = 1 & count(child) >= 1]', "select distinct lo, hi from m join t on t.text_idx = m.text_idx and t.pos between lo and hi join sub on up = t.pos where hi - lo >= 3 and nchildren >= 1 and a >= lo and z <= hi", _RUNS.format("upos <> 'DET'"), _ADV, _BELOW, _SUB, extents=True)

# ---- relations of the tree
add("gov", 'a:[upos="ADV"] > b:[upos="VERB"]; count by b.deprel', "select b.deprel as key, count(*) as count, round(count(*) * 100.0 / sum(count(*)) over (), 6) as pct from t a join t b on b.head_pos = a.pos where a.upos = 'ADV' and b.upos = 'VERB' group by 1")
add("gov_by", 'a:[upos="ADV"] < b:[upos="VERB"]', "select least(a.pos, b.pos) as lo, greatest(a.pos, b.pos) as hi from t a join t b on a.head_pos = b.pos where a.upos = 'ADV' and b.upos = 'VERB'", extents=True)
add("gov_trans", '[upos="ADV"] >> [upos="ADV"]', "select up as lo, down as hi from below join t a on a.pos = up join t b on b.pos = down where a.upos = 'ADV' and b.upos = 'ADV'", _BELOW, extents=True)
add("gov_trans_by", '[upos="ADV"] << [lemma="the"]', "select up as lo, down as hi from below join t a on a.pos = down join t b on b.pos = up where a.upos = 'ADV' and b.lemma = 'the'", _BELOW, extents=True)
add("not_gov", '[upos="ADV"] !> [upos="NOUN"]', _pos("upos = 'ADV' and not exists (select 1 from t b where b.head_pos = t.pos and b.upos = 'NOUN')"), extents=True)
add("not_gov_by", '[upos="ADV"] !< [upos="NOUN"]', _pos("upos = 'ADV' and not exists (select 1 from t b where t.head_pos = b.pos and b.upos = 'NOUN')"), extents=True)
add("dep_subtree_tcnt", 'h:[upos="ADV"] s:dep_subtree(h); count by tcnt(s)', _count("upos = 'ADV'", "(ndesc + 1)::varchar"))
add("dep_subtree_named", 'Q = [lemma="was"]; s:dep_subtree(Q); tabulate 0 0 spellout(s, form)', "select min(down) as lo, max(down) as hi, string_agg(piece, '' order by down) as field1 from (select up, down, case when lag(down) over w is null then b.form when lag(down) over w = down - 1 then ' ' || b.form else ' ... ' || b.form end as piece from (select up, down from below union all select pos, pos from t) x join t a on a.pos = x.up join t b on b.pos = x.down where a.lemma = 'was' window w as (partition by up order by down)) group by up", _BELOW)

# ---- regions, anchors, groups
add("region_enum", '<node type="VP"> :: match.text_lang = "es"', "select start_pos as lo, end_pos as hi from node join d on d.doc_id = text_idx where type = 'VP' and lang = 'es'", _NODE, extents=True)
add("anchor_start", '<s> [upos="ADV"]', _pos("upos = 'ADV' and j = 0"), extents=True)
add("anchor_end", '[upos="ADV"] </s>', _pos("upos = 'ADV' and j = sn - 1"), extents=True)
add("anchor_nested", 'np:<node> [upos="ADV"]; count by np.type', "select type as key, count(*) as count, round(count(*) * 100.0 / sum(count(*)) over (), 6) as pct from t join node on start_pos = pos where upos = 'ADV' group by 1", _NODE)
add("anchor_innermost", 'np:<node> [upos="ADV"]; count by np.type', "select type as key, count(*) as count, round(count(*) * 100.0 / sum(count(*)) over (), 6) as pct from (select pos, arg_min(type, (end_pos - start_pos, idx)) as type from t join node on start_pos = pos where upos = 'ADV' group by pos) group by 1", _NODE, binding="innermost")
add("anchor_super", '<node type="VP" lang="en"> [upos="ADV"]', "select pos as lo, pos as hi from t join node on start_pos = pos where upos = 'ADV' and type = 'VP' and lang = 'en'", _NODE, extents=True)
add("rchild", 'np:<node type="NP"> vp:<node type="VP" rchild(np)> [upos="ADV"]', "select pos as lo, pos as hi from t join node a on a.start_pos = pos and a.type = 'NP' join node b on b.start_pos = pos and b.type = 'VP' and b.par = a.idx where upos = 'ADV'", _NODE, extents=True)
add("rcontains", 'vp:<node type="VP"> up:<node rcontains(vp)> [upos="ADV"]; count by up.type', "select x.type as key, count(*) as count, round(count(*) * 100.0 / sum(count(*)) over (), 6) as pct from t join node v on v.start_pos = pos and v.type = 'VP' join node x on x.start_pos = pos and (x.idx = v.idx or x.idx = v.par or x.idx = (select par from node y where y.idx = v.par)) where upos = 'ADV' group by 1", _NODE)
add("region_contains", 'vp:<node type="VP"> np:<node type="NP" contains(vp)> [upos="ADV"]', "select pos as lo, pos as hi from t join node v on v.start_pos = pos and v.type = 'VP' join node x on x.start_pos = pos and x.type = 'NP' and x.end_pos >= v.end_pos where upos = 'ADV'", _NODE, extents=True)
_ERR = ", err as (select l.doc_id as gid, base, quality, toxic from labels l join (select distinct text_idx, base, n from t) x on x.text_idx = l.doc_id where n - 1 >= 6 and quality is not null and toxic is not null)"
add("token_group", '<err code="q0" toxic="1">', "select base as lo, base + 6 as hi from err where quality = 0 and toxic = 1", _ERR, extents=True)
add("token_group_where", 'A = [upos="DET"]; B = [upos="ADV"]; <err code="q1"> where A, B', "select base as lo, base + 6 as hi from err where quality = 1 and exists (select 1 from t where pos in (err.base, err.base + 1, err.base + 5, err.base + 6) and upos = 'DET') and exists (select 1 from t where pos in (err.base, err.base + 1, err.base + 5, err.base + 6) and upos = 'ADV')", _ERR, extents=True)

# ---- global filters and functions
add("region_filter", 'a:[lemma="the"] :: a.text_lang != "en" & match.text_source = "src2"', _pos("lemma = 'the' and lang <> 'en' and source = 'src2'"), extents=True)
add("label_filter", 'a:[lemma="the"] b:[] :: b.upos = "ADV" & a.lang = "en"', "select a.pos as lo, b.pos as hi from t a join t b on b.pos = a.pos + 1 where a.lemma = 'the' and b.upos = 'ADV' and a.lang = 'en'", extents=True)
add("align", "a:[] b:[] :: a.lemma = b.lemma", "select a.pos as lo, b.pos as hi from t a join t b on b.pos = a.pos + 1 where a.lemma = b.lemma and a.lemma not in ('', '_')", extents=True)
add("align_not", 'a:[upos="ADV"] b:[upos="ADV"] :: a.lemma != b.lemma', "select a.pos as lo, b.pos as hi from t a join t b on b.pos = a.pos + 1 where a.upos = 'ADV' and b.upos = 'ADV' and a.lemma <> b.lemma", extents=True)
add("pos_order", 'a:[upos="ADV"] > b:[upos="ADV"] :: a < b & distabs(a, b) < 4', "select a.pos as lo, b.pos as hi from t a join t b on b.head_pos = a.pos where a.upos = 'ADV' and b.upos = 'ADV' and b.pos - a.pos < 4", extents=True)
add("strlen_fn", "a:[] :: strlen(a.form) > 18", _pos("length(form) > 18"), extents=True)
add("freq_fn", 'a:[upos="ADV"] :: f(a.lemma) >= 200', _pos("upos = 'ADV' and lemma in (select lemma from t group by lemma having count(*) >= 200)"), extents=True)
add("date_filter", '[lemma="the"] :: century(text_date) = 21 & month(text_date) <= 6 & week(text_date) > 10; count by year(text_date)', _count("lemma = 'the' and date >= '2001-01-01' and month(date::date) <= 6 and weekofyear(date::date) > 10", "date[1:4]"))
add("date_parts", '[lemma="the"]; tabulate 0 0 year(text_date), century(text_date), decade(text_date), month(text_date), week(text_date), day(text_date)', "select pos as lo, pos as hi, year(date::date)::varchar as field1, ((year(date::date) - 1) // 100 + 1)::varchar as field2, (year(date::date) // 10 * 10)::varchar as field3, month(date::date)::varchar as field4, weekofyear(date::date)::varchar as field5, day(date::date)::varchar as field6 from t where lemma = 'the'")
add("tree_functions", 'a:[upos="ADV"] :: depth(a) = 2 & nchildren(a) = 2 & ndescendants(a) >= 4', _pos("upos = 'ADV' and depth = 2 and nchildren = 2 and ndesc >= 4"), extents=True)
add("nvals_fn", 'a:[lemma="the"] :: nvals(a.text_domain) = 2; size', "select count(*) as size from t where lemma = 'the'")
add("region_functions", 'np:<node type="NP"> vp:<node type="VP"> [upos="ADV"] :: rchild(np, vp) = 1 & contains(np, vp) = 1 & rcontains(np, vp) = 1 & tcnt(np) > 5', "select pos as lo, pos as hi from t join node a on a.start_pos = pos and a.type = 'NP' join node b on b.start_pos = pos and b.type = 'VP' and b.par = a.idx where upos = 'ADV' and a.end_pos - a.start_pos + 1 > 5", _NODE, extents=True)

# ---- aggregations
add("count_rollup", '[upos="ADV"]; count by text_lang, deprel', "select key1, key2, (case when key2 is null then 1 else 2 end)::int as level, count, round(count * 100.0 / total, 6) as pct, round(count * 100.0 / case when key2 is null then total else up end, 6) as pct_of_parent from (select lang as key1, deprel as key2, count(*) as count, max(sum(case when true then 1 else 0 end)) over (partition by lang) as up, (select count(*) from t where upos = 'ADV') as total from t where upos = 'ADV' group by rollup(lang, deprel)) where key1 is not null")
add("count_mv", '[lemma="the"]; count by text_domain', "select v as key, count(*) as count, round(count(*) * 100.0 / (select count(*) from t where lemma = 'the'), 6) as pct from (select unnest(string_split(domain, '|')) as v from t where lemma = 'the') group by v")
add("freq_ipm", '[upos="ADV"]; freq by lemma', "select lemma as key, count(*) as count, round(count(*) * 100.0 / sum(count(*)) over (), 6) as pct, round(count(*) * 1e6 / (select count(*) from t), 6) as ipm from t where upos = 'ADV' group by lemma")
add("freq_subcorpus", '[lemma="the"]; freq by text_lang', "select key, count, pct, round(count * 1e6 / n, 6) as ipm, n::bigint as subcorpus_size, round(count * 100.0 / n, 6) as rf_pct from (select lang as key, count(*) filter (lemma = 'the') as count, round(count(*) filter (lemma = 'the') * 100.0 / sum(count(*) filter (lemma = 'the')) over (), 6) as pct, count(*) as n from t group by lang) where count > 0")
add("freq_compare", 'A = [lemma="the"]; B = [lemma="de"]; freq A, B by text_lang', "select lang as key, sum(a)::bigint as count_A, round(sum(a) * 100.0 / sum(sum(a)) over (), 6) as pct_A, round(sum(a) * 1e6 / (select count(*) from t), 6) as ipm_A, sum(b)::bigint as count_B, round(sum(b) * 100.0 / sum(sum(b)) over (), 6) as pct_B, round(sum(b) * 1e6 / (select count(*) from t), 6) as ipm_B from (select lang, (lemma = 'the')::int as a, (lemma = 'de')::int as b from t where lemma in ('the', 'de')) group by lang")
add("size_named", 'A = [lemma="the"]; B = [lemma="de"]; size A', "select count(*) as size from t where lemma = 'the'")
add("stats_by", 'a:[upos="ADV"]; stats avg(strlen(a.form)), median(depth(a)), avg(feats/Len) by text_lang', "select lang as key, count(*) as n_total, count(*) as n_valid1, round(avg(length(form)), 6) as avg1, count(*) as n_valid2, round(median(depth), 6) as median2, count(*) as n_valid3, round(avg(len), 6) as avg3 from t where upos = 'ADV' group by lang")
add("stats_invalid", "a:[lemma=/^(1|2|a)/]; stats avg(a.lemma), median(a.lemma)", r"select count(*) as n_total, count(v) as n_valid1, round(avg(v), 6) as avg1, count(v) as n_valid2, round(median(v), 6) as median2 from (select case when regexp_full_match(lemma, '[0-9]+') then lemma::double end as v from t where regexp_matches(lemma, '^(1|2|a)'))")
_COLL = """select word, obs, freq, {} from (select word, obs, freq, sum(obs) over ()::double as f_n, (select count(*) from t)::double as n from (select b.{a} as word, count(*) as obs from ({nodes}) m join t b on {on} where b.{a} <> '' group by 1) x join (select {a} as w, count(*) as freq from t group by 1) y on w = word) where obs >= 5"""
_FIVE = "((b.pos between m.pos - 5 and m.pos - 1) or (b.pos between m.pos + 1 and m.pos + 5))"
_DICE = "round(14 + log2(2.0 * obs / (f_n + freq)), 3) as logdice"
_ALL = _DICE + ", round(log2(obs / (f_n * freq / n)), 3) as mi, round(log2(obs::double * obs * obs / (f_n * freq / n)), 3) as mi3, round((obs - f_n * freq / n) / sqrt(obs), 3) as t, round(2.0 * obs / (f_n + freq), 3) as dice, round(2 * (obs * ln(obs / (f_n * freq / n)) + case when f_n > obs then (f_n - obs) * ln((f_n - obs) / (f_n * (n - freq) / n)) else 0 end + case when freq > obs then (freq - obs) * ln((freq - obs) / ((n - f_n) * freq / n)) else 0 end + case when n - f_n - freq + obs > 0 then (n - f_n - freq + obs) * ln((n - f_n - freq + obs) / ((n - f_n) * (n - freq) / n)) else 0 end), 3) as ll"
# near positions are joined through explicit offsets, else the join isn't an equi-join
_NEAR = "select pos + k as at from t, (values (-5), (-4), (-3), (-2), (-1), (1), (2), (3), (4), (5)) x(k) where {}"
add("coll_logdice", '[lemma="moron"]; coll by lemma', _COLL.format(_DICE, a="lemma", nodes=_NEAR.format("lemma = 'moron'"), on="b.pos = m.at"))
add("coll_measures", '[lemma="the"]; coll by form', _COLL.format(_ALL, a="form", nodes=_NEAR.format("lemma = 'the'"), on="b.pos = m.at"), measures=["logdice", "mi", "mi3", "t", "dice", "ll"])
add("coll_on_label", 'a:[lemma="the"] b:[upos="ADV"]; coll on b by lemma', _COLL.format(_DICE, a="lemma", nodes="select b.pos + k as at from t a join t b on b.pos = a.pos + 1, (values (-5), (-4), (-3), (-2), (1), (2), (3), (4), (5)) x(k) where a.lemma = 'the' and b.upos = 'ADV'", on="b.pos = m.at"))
add("coll_stoplist", '[upos="ADV"]; coll by lemma', _COLL.format(_DICE, a="lemma", nodes=_NEAR.format("upos = 'ADV'"), on="b.pos = m.at") + " and word not in (select lemma from t group by lemma order by count(*) desc, lemma limit 10)", stoplist=10)
add("dcoll", '[upos="ADV"]; dcoll children by lemma', _COLL.format(_DICE, a="lemma", nodes="select pos from t where upos = 'ADV'", on="b.head_pos = m.pos"))
add("dcoll_head_deprel", '[upos="ADV"]; dcoll head, nsubj by lemma', _COLL.format(_DICE, a="lemma", nodes="select h.pos as at from t join t h on t.head_pos = h.pos where t.upos = 'ADV' union all select c.pos from t join t c on c.head_pos = t.pos where t.upos = 'ADV' and c.deprel = 'nsubj'", on="b.pos = m.at"))
add("dcoll_descendants", '[lemma="was"]; dcoll descendants by lemma', _COLL.format(_DICE, a="lemma", nodes="select down as at from below join t on t.pos = up where lemma = 'was'", on="b.pos = m.at"), _BELOW)
_KEY = """select word, focus_freq, ref_freq, round(g2, 2) + 0.0 as keyness, case when g2 < 0 then '-' else '+' end as effect from (
  select *, (case when a < n1 * (a + b) / (n1 + n2) then -1 else 1 end) * 2 * (case when a > 0 then a * ln(a / (n1 * (a + b) / (n1 + n2))) else 0 end + case when b > 0 then b * ln(b / (n2 * (a + b) / (n1 + n2))) else 0 end) as g2
  from (select word, f as focus_freq, r as ref_freq, f::double as a, r::double as b, (sum(f) over ())::double as n1, {n2} as n2 from ({words}))) where focus_freq + ref_freq >= 5{more}"""
add("keyness_rest", '[text_lang="fr"]; keyness by lemma', _KEY.format(n2="(select count(*) from t where lang <> 'fr')::double", words="select lemma as word, count(*) filter (lang = 'fr') as f, count(*) filter (lang <> 'fr') as r from t group by lemma having count(*) filter (lang = 'fr') > 0", more=""))
add("keyness_vs", 'A = [text_lang="fr"]; B = [text_lang="es"]; keyness A vs B by lemma', _KEY.format(n2="(sum(r) over ())::double", words="select lemma as word, count(*) filter (lang = 'fr') as f, count(*) filter (lang = 'es') as r from t where lang in ('fr', 'es') group by lemma", more=""))

# ---- rows
add("tabulate", 'a:[lemma="the"] b:[upos="ADV"]; tabulate 0 0 a.form, b.lemma, text_domain, b.feats/Len, strlen(b.form)', "select a.pos as lo, b.pos as hi, a.form as field1, b.lemma as field2, '[\"' || a.lang || '\",\"' || a.source || '\"]' as field3, b.len::varchar as field4, length(b.form)::varchar as field5 from t a join t b on b.pos = a.pos + 1 where a.lemma = 'the' and b.upos = 'ADV'")
add("tabulate_page", '[lemma="the"]; tabulate 10 25 form, text_lang', "select pos as lo, pos as hi, form as field1, lang as field2 from t where lemma = 'the' order by pos limit 25 offset 10")
add("tabulate_nested", '[lemma="was"]; tabulate 0 0 node_type', "select pos as lo, pos as hi, string_agg(distinct type, '|' order by type) as field1 from t join node on pos between start_pos and end_pos and node.text_idx = t.text_idx where lemma = 'was' group by pos", _NODE)
add("forms_fn", 'a:[upos="ADV"]{2,3}; tabulate 0 0 forms(a)', "select lo, hi, string_agg(form, ' ' order by pos) as field1 from (select first + k * 3 as lo, first + k * 3 + least(3, n - k * 3) - 1 as hi from (select *, unnest(range((n - 1) // 3 + 1)) as k from runs) where least(3, n - k * 3) >= 2) join t on pos between lo and hi group by lo, hi", _RUNS.format("upos = 'ADV'"))
add("sort_by", '[upos="ADV" & text_lang="es"]; sort by lemma', "select pos as lo, pos as hi, lemma as key from t where upos = 'ADV' and lang = 'es'")
add("raw", '[lemma="the"] [upos="ADV"]; raw', "select a.pos as lo, b.pos as hi, [a.pos, b.pos] as positions, [a.form, b.form] as tokens from t a join t b on b.pos = a.pos + 1 where a.lemma = 'the' and b.upos = 'ADV'")
add("kwic", '[lemma="worthless"]; cat', "select m.text_idx as doc_id, m.pos as match_start, m.pos as match_end, coalesce(string_agg(b.form, ' ' order by b.pos) filter (b.pos < m.pos), '') as \"left\", m.form as match, coalesce(string_agg(b.form, ' ' order by b.pos) filter (b.pos > m.pos), '') as \"right\", ['{\"form\":\"' || m.form || '\",\"lemma\":\"' || m.lemma || '\",\"upos\":\"' || m.upos || '\",\"deprel\":\"' || m.deprel || '\",\"feats\":\"Len=' || m.len || '|Cap=' || m.cap || '\"}'] as tokens from t m join t b on b.pos between m.pos - 5 and m.pos + 5 and b.text_idx = m.text_idx where m.lemma = 'worthless' group by m.text_idx, m.pos, m.form, m.lemma, m.upos, m.deprel, m.len, m.cap")
add("show_values", "show values lemma", "select lemma as value, count(*) as count from t group by lemma")
add("show_values_mv", "show values text_domain", "select v as value, count(*) as count from (select unnest(string_split(domain, '|')) as v from (select distinct text_idx, domain from t)) group by v")
add("show_regions", "show regions node", "select idx as region_idx, start_pos as start, end_pos as \"end\", end_pos - start_pos + 1 as tokens, type from node", _NODE)
add("show_info", "show info", "select count(*) as size, 5 as attributes, 3 as region_types, true as tree, '' as default_within from t")
add("named_filter", 'A = [upos="ADV"]; [lemma="the"] [] :: A.upos = "ADV"', "select a.pos as lo, b.pos as hi from t a join t b on b.pos = a.pos + 1 where a.lemma = 'the' and b.upos = 'ADV'", extents=True)
_CONV = r"""with t as (
  select conv_id, turn, role, (conv_id * 1024 + turn) * 16777216 + generate_subscripts(w, 1) - 1 as pos, unnest(w) as form
  from (select *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from conversations where text is not null)
), l as (
  select *, translate(regexp_replace(form, '[!-/:-@\[-`{-~]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lemma from t
) """
add("parallel", 'a:[lemma="the" & text_role="user"] with b:[lemma="and" & text_role="assistant"] :: a.text_tuid = b.text_tuid', _CONV + "select a.pos as lo, a.pos as hi, b.pos as t_lo, b.pos as t_hi from l a join l b on a.conv_id = b.conv_id where a.lemma = 'the' and a.role = 'user' and b.lemma = 'and' and b.role = 'assistant'", base="conversations")
QUERIES["parallel"] = (lambda run: lambda spark, sf_dir: run(spark, sf_dir).select("lo", "hi", "t_lo", "t_hi"))(QUERIES["parallel"])
add("parallel_mv", 'a:[lemma="moron"] with b:[lemma="clown"] :: a.text_domain = b.text_domain & a.text_lang = b.text_lang', "select a.pos as lo, a.pos as hi, b.pos as t_lo, b.pos as t_hi from t a join t b on a.lang = b.lang where a.lemma = 'moron' and b.lemma = 'clown'")
QUERIES["parallel_mv"] = (lambda run: lambda spark, sf_dir: run(spark, sf_dir).select("lo", "hi", "t_lo", "t_hi"))(QUERIES["parallel_mv"])


def _sets(op: str):
    def run(spark, sf_dir):
        s = session(spark, sf_dir)
        return commands.combine(op, s.query('[upos="ADV"]'), s.query('[text_lang="en"]'))

    return run


for _op, _word in (("union", "union"), ("intersect", "intersect"), ("diff", "except")):
    QUERIES[f"set_{_op}"] = _sets(_op)
    ORACLES[f"set_{_op}"] = sql(f"select pos as lo, pos as hi from t where upos = 'ADV' {_word} select pos, pos from t where lang = 'en'")


def _check(spark, sf_dir):
    return corpus(spark, sf_dir).check()


QUERIES["check"] = _check
ORACLES["check"] = """select c as "check", 0::bigint as failures from (values ('repeated positions'), ('null attribute values'), ('text: end before start'), ('text: start isn''t a position'), ('s: end before start'), ('s: start isn''t a position'), ('node: end before start'), ('node: start isn''t a position'), ('head isn''t a position')) x(c)"""


def flagship(spark, sf_dir: str):
    """Frequencies of a word by language, with the parts' sizes."""
    return QUERIES["freq_subcorpus"](spark, sf_dir)
