"""Prices of zero (infinite returns, labels that start there) and results beyond 2 ** 63: as DuckDB has them."""

import math

import duckdb
import pytest

from barloom.plans import catalog

QUERIES = [
    "meta_labels", "meta_samples", "return_labels", "triple_barrier", "vertical_labels", "vertical_labels_event_grid", "event_frame", "rolling_volatility",
    "bar_return_statistics", "binary_code_counts", "binary_entropy", "sigma_codes", "entropy_correlation", "ewm_volatility", "concurrency_volatility", "concurrency_volatility_all",
    "deflated_sharpe", "deflated_sharpe_compat", "equity_drawdowns", "high_water_drawdowns", "high_water_drawdowns_dollars",
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Three users' trades; from time to time a price falls from 300 or more to 0, and so fires an event there."""
    out = tmp_path_factory.mktemp("zeros")
    value = "CASE WHEN i % 97 = 50 THEN 0 WHEN i % 97 IN (47, 53) THEN 400 ELSE 20 + hash(i)::HUGEINT % 3000 / 100 END"
    duckdb.sql(
        f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_microseconds((i * 2400000123 + hash(i)::HUGEINT % 1000)::BIGINT) AS ts, i % 3 AS user_id, ['click', 'view'][i // 3 % 2 + 1] AS event_type,
        ({value})::DOUBLE AS value, '{{"k": ' || i % 7 || '}}' AS props FROM range(1500) t(i)) TO '{out}/events.parquet'"""
    )
    return str(out)


def rows(cursor, columns, wanted):
    at = [columns.index(c) for c in wanted]
    plain = lambda v: "NaN" if isinstance(v, float) and math.isnan(v) else float(v) if isinstance(v, (int, float)) else v
    return sorted((tuple(plain(r[i]) for i in at) for r in cursor), key=repr)


@pytest.mark.parametrize("name", QUERIES)
def test_zero_prices(spark, folder, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    want, got = con.sql(catalog.SQL[name]), catalog.QUERIES[name](spark, folder)
    wanted = sorted(got.columns)
    found, right = rows(got.collect(), got.columns, wanted), rows(want.fetchall(), want.columns, wanted)
    assert len(found) == len(right)
    for a, b in zip(found, right, strict=True):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-12)) for x, y in zip(a, b, strict=True)), (a, b)
