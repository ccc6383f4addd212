import itertools
import math

import duckdb
import pytest

import __spark_entry__ as entry
from lexirun import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "-"
    if isinstance(value, float):
        return f"{value:.9g}" if not value.is_integer() else str(int(value))
    return bytes(value).hex() if isinstance(value, bytes | bytearray) else str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in rows)


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_against_sql(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    rows = df.collect()
    if name not in catalog.ORACLES:
        assert rows
        return
    found = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, rows) == rows_of(names, found.fetchall())


def test_document_index_stats(spark, sf_dir):
    """No SQL sorts long texts; here they are sorted by 200 bytes, and by all where these are equal."""
    found = {r.text_id: r for r in catalog.QUERIES["document_index_stats"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text is not null").collect()
    assert len(found) == len(docs)
    for d in docs:
        text = d.text.encode() + b"\0"
        near = sorted((text[k : k + 200], k) for k in range(len(text)))
        order = [k for _, group in itertools.groupby(near, key=lambda x: x[0]) for k in sorted((k for _, k in group), key=lambda k: text[k:])]
        runs = [len(list(g)) for _, g in itertools.groupby(text[k - 1] for k in order)]
        r = found[d.doc_id]
        assert (r.n, r.r, r.sigma, r.max_run) == (len(text), len(runs), len(set(text)), max(runs)) and math.isclose(r.mean_run, len(text) / len(runs))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_contract():
    known = entry.queries()
    assert set(entry.oracle_sql()) <= set(known)
    assert set(catalog.QUERIES) <= set(known)
