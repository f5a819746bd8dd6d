"""Whole tables against SQL in DuckDB, and the model of toxicity on labelled rows that training never saw."""

from __future__ import annotations

import duckdb
import pytest

from tidemark.llm.oracle import ORACLE_SQL
from tidemark.llm.queries import QUERIES, op1_toxicity


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, data, name):
    connection = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{data}/{table}.parquet')")
    wanted = connection.execute(ORACLE_SQL[name])
    columns = [c[0] for c in wanted.description]
    found = QUERIES[name](spark, data)
    assert sorted(found.columns) == sorted(columns)
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(wanted.fetchall())


def test_toxicity_of_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    found = [(labels[r["doc_id"]], r["predicted"]) for r in op1_toxicity(spark, folder).filter("held_out").collect() if labels.get(r["doc_id"]) is not None]
    toxic, clean = ([p for y, p in found if y == k] for k in (1, 0))
    assert len(toxic) > 50 and sum(toxic) / len(toxic) >= 0.85 and sum(clean) / len(clean) <= 0.03
