"""Every registered query agrees with its SQL on the smallest driver tables."""

import math
import os

import duckdb
import pytest

import catalogue

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    number = float(value)
    return None if math.isnan(number) else float(f"{number:.9g}")


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_agrees_with_sql(spark, db, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in catalogue.ORACLE:
        assert rows
        return
    found = db.execute(catalogue.ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=repr)


def test_telemetry_counts_the_citations_of_all_documents(spark, db):
    rows = catalogue.QUERIES["run_telemetry_all_citations"](spark, SF).collect()
    hand = dict(db.execute("SELECT source, sum(doc_id % 4)::BIGINT FROM documents GROUP BY 1").fetchall())
    assert {r.run_id: r.external_citation_count for r in rows} == hand


def test_hygiene_is_read_from_the_html(spark, monkeypatch):
    """Pages whose markup holds no linked data have none, whatever their ids."""
    from catalogue import pages

    monkeypatch.setattr(pages, "rich_features", pages.features)
    rows = catalogue.QUERIES["html_hygiene_coverage"](spark, SF).collect()
    assert rows and all(r.pages_with_json_ld == r.pages_with_schema == 0 for r in rows)
