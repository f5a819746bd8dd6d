"""Every query of the catalogue against its SQL in DuckDB, over the smallest tables."""

from __future__ import annotations

import zlib

import duckdb
import pytest

from tidemark.plans import catalogue, oracle, packaging, packaging_sql

QUERIES, ORACLE = catalogue.QUERIES | packaging.QUERIES, oracle.ORACLE | packaging_sql.ORACLE
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER", "double": "DOUBLE"}


@pytest.fixture(scope="module")
def sql(data: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{data}/{name}.parquet')")
    return connection


def rows(frame) -> list[str]:  # noqa: ANN001
    frame = frame[sorted(frame.columns)]
    return sorted(repr(tuple(None if x != x else x for x in r)) for r in frame.astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sql, data, name):
    found = QUERIES[name](spark, data)
    result = sql.execute(ORACLE[name])
    kinds = {c[0]: str(c[1]) for c in result.description}
    assert {c: TYPES[t] for c, t in found.dtypes} == kinds
    assert rows(found.toPandas()) == rows(result.df())


def test_every_query_has_sql_or_a_test():
    assert set(QUERIES) == set(ORACLE)


def test_all_samples_are_packed_and_parsed(spark, sql, data):
    found = QUERIES["parse_boxes"](spark, data).toPandas()
    want = sql.execute("""WITH v AS (SELECT user_id AS track, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 64 AS fragment, CAST(round(value * 100) AS BIGINT) AS size FROM events)
        SELECT track, fragment, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM v GROUP BY ALL""").df().sort_values(["track", "fragment"])
    for path, size in (("mdat", 8 + want["bytes"]), ("moof/traf/trun", 20 + 16 * want["n"])):
        got = found[found["path"] == path].sort_values(["track", "fragment"])
        assert got[["track", "fragment"]].values.tolist() == want[["track", "fragment"]].values.tolist() and got["size"].tolist() == size.tolist()
    assert want["n"].sum() == sql.execute("SELECT count(*) FROM events").fetchone()[0]


def test_byte_checksums_cover_whole_texts(spark, data):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    found = QUERIES["byte_checksums"](spark, data).collect()
    assert len(found) == len(texts)
    for r in found:
        raw = texts[r["doc_id"]].encode()
        lo, hi = sum(raw) % 65535, sum((len(raw) - k) * b for k, b in enumerate(raw)) % 65535
        assert r["crc32"] == zlib.crc32(raw) and r["fletcher"] == hi << 16 | lo
