"""Every trade starts an interval and every close an event, where no SQL says otherwise."""

import pytest
from pyspark.sql import functions as F

from barloom.plans import catalog
from barloom.plans.labels import closes
from barloom.sources import fixtures as X

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["uniqueness_bootstrap", "sequential_bootstrap"])
def test_draws_come_from_all_closes(spark, name):
    drawn = catalog.QUERIES[name](spark, DATA)
    at = closes(spark, DATA).select("symbol", "seq", F.unix_micros("ts").alias("t0_us"))
    rests = {r["r"] for r in drawn.join(at, ["symbol", "t0_us"]).select((F.col("seq") % 4).alias("r")).collect()}
    assert rests == {0, 1, 2, 3}
    assert drawn.join(at, ["symbol", "t0_us"]).count() == drawn.count() == 20 * at.select("symbol").distinct().count()


@pytest.mark.parametrize("name", ["interval_join_all", "average_uniqueness_all"])
def test_one_row_for_each_trade(spark, name):
    trades = X.trades(spark, DATA).count()
    out = catalog.QUERIES[name](spark, DATA)
    assert out.count() == out.select("seq").distinct().count() == trades
