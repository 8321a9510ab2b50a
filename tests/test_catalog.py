"""Every registered query of the engine against its SQL, on the smallest tables."""

import os
import re

import duckdb
import pytest

from tessera.plans import catalog

SF = "/root/testdata/sf0.001"
SOME = ("count_by_region", "neq", "fold_cd", "nested_region_attr", "child", "sibling", "descendant", "related_or", "run_max", "chain_rep", "optional", "within_nested", "containing_subtree", "gov_trans", "not_gov", "dep_subtree_named", "rcontains", "token_group_where", "align", "count_rollup", "freq_subcorpus", "coll_measures", "keyness_vs", "tabulate_nested", "kwic", "containing", "not_containing", "rchild", "region_contains", "region_functions", "anchor_super", "nvals_none", "region_attr", "show_values_mv", "mv_eq", "dep_subtree_tcnt")


def test_names():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")
@pytest.mark.parametrize("name", SOME)
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    result = con.execute(catalog.ORACLES[name])
    names = [c[0] for c in result.description]
    want = result.fetchall()
    df = catalog.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    plain = lambda v: round(v, 5) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    assert got == sorted((tuple(map(plain, r)) for r in want), key=repr)


def test_entry_without_llm():
    import __spark_entry__

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(catalog.ORACLES) <= set(__spark_entry__.oracle_sql())


def test_nothing_else_imports_llm():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(os.path.join(root, "tessera")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert not re.search(r"\bllm\b", open(os.path.join(folder, f)).read())
