"""Every query of the library proper against its SQL, on the smallest tables."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from vereda.plans import catalogue


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return None if v != v else v
    return v.isoformat() if isinstance(v, datetime.datetime) else v


def rows(names, found):
    """Each row as its exact values and its doubles, in an order that rounding cannot change much."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = []
    for r in found:
        values = [plain(r[i]) for i in order]
        exact = repr([v if not isinstance(v, float) else "~" for v in values])
        out.append((exact, [v for v in values if isinstance(v, float)]))
    return sorted(out)


def same(a, b):
    assert [x for x, _ in a] == [x for x, _ in b]
    for (_, x), (_, y) in zip(a, b, strict=True):
        assert x == pytest.approx(y, rel=1e-7, abs=2e-6)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_matches_sql(spark, duck, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    got = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(names)
    same(rows(df.columns, df.collect()), rows(names, got.fetchall()))


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_runs(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_lists_all():
    import __spark_entry__ as e

    assert set(catalogue.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_merge_and_sets_reach_all_documents(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    merged = {r.key for r in catalogue.QUERIES["merge_all_fields"](spark, sf_dir).collect()}
    assert {r.doc_id for r in d} <= merged
    both = {r.source for r in d if r.lang == "en"} & {r.source for r in d if r.lang == "fr"}
    got = catalogue.QUERIES["whole_set_operations"](spark, sf_dir).collect()
    short = {(r.text, r.source) for r in d if r.n_chars < 100}
    assert len(got) == len({(r.text, r.source) for r in d if r.source in both} - short) > 0
