"""Queries: sampling, barriers, labels and sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import q6, us
from ..operators import labels as L
from ..operators import sampling as S
from ..sources import fixtures as X
from ..sources.fixtures import sql_q6 as Q
from .registry import query

#: Prices of each user's trades as a close series.
CLOSES = X.SQL_TRADES + ", c AS (SELECT symbol, ts, seq, price AS close, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS rn FROM trades)"
LONG = CLOSES.replace("user_id::VARCHAR", "event_type")


def closes(spark, sf, symbol="user_id"):
    return X.trades(spark, sf, symbol).select("symbol", "ts", "seq", F.col("price").alias("close"))


H = 200.005

CUSUM = f"""fold AS (
  SELECT symbol, rn, close, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down, 0 AS direction FROM c WHERE rn = 1
  UNION ALL
  SELECT symbol, rn, close, CASE WHEN NOT down < -{H} AND up > {H} THEN 0.0 ELSE up END, CASE WHEN down < -{H} THEN 0.0 ELSE down END,
         CASE WHEN down < -{H} THEN -1 WHEN up > {H} THEN 1 ELSE 0 END
  FROM (SELECT c.symbol, c.rn, c.close, greatest(0.0, f.up + (c.close - f.close)) AS up, least(0.0, f.down + (c.close - f.close)) AS down
        FROM fold f JOIN c ON c.symbol = f.symbol AND c.rn = f.rn + 1)
)"""


def events_of(spark, sf):
    return S.cusum_events(closes(spark, sf).withColumn("h", F.lit(H)))


@query(f"WITH RECURSIVE {CLOSES}, {CUSUM} SELECT f.symbol, c.seq, f.direction FROM fold f JOIN c USING (symbol, rn) WHERE f.direction <> 0")
def cusum_events(spark, sf):
    return events_of(spark, sf).select("symbol", "seq", "direction")


@query(f"WITH {CLOSES}, d AS (SELECT symbol, close - lag(close) OVER (PARTITION BY symbol ORDER BY rn) AS d FROM c) SELECT symbol, {Q('stddev_samp(d)')} AS h FROM d GROUP BY symbol")
def cusum_threshold(spark, sf):
    return S.cusum_threshold(closes(spark, sf)).select("symbol", q6("h").alias("h"))


VOL = """r AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY rn) - 1 AS ret FROM c),
vol AS (SELECT symbol, ts, seq, close, ret, stddev_samp(ret) OVER (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL '2 days 23:59:59.999999' PRECEDING AND CURRENT ROW) AS v FROM r)"""
SPAN = 3 * 86_400_000_000
HORIZON = "INTERVAL 2 DAYS"


def volatility(spark, sf):
    return S.rolling_volatility(closes(spark, sf), span_us=SPAN)


@query(f"WITH {CLOSES}, {VOL} SELECT symbol, seq, {Q('v')} AS trgt FROM vol")
def rolling_volatility(spark, sf):
    return volatility(spark, sf).select("symbol", "seq", q6("trgt").alias("trgt"))


EVENTS = f"""{VOL}, e0 AS (SELECT c.symbol, c.ts AS t0, c.seq FROM fold f JOIN c USING (symbol, rn) WHERE f.direction <> 0),
e1 AS (SELECT e0.symbol, e0.t0, c.ts AS t1 FROM e0 ASOF LEFT JOIN c ON e0.symbol = c.symbol AND e0.t0 + {HORIZON} <= c.ts),
ev AS (SELECT e1.symbol, e1.t0, e1.t1, vol.v AS trgt, CASE WHEN epoch_us(e1.t0) % 2 = 0 THEN 1 ELSE -1 END AS side FROM e1 ASOF LEFT JOIN vol ON e1.symbol = vol.symbol AND e1.t0 >= vol.ts)"""


def make_events(spark, sf):
    e = events_of(spark, sf).select("symbol", F.col("ts").alias("t0"))
    e = S.vertical_barrier(e, closes(spark, sf), "2 days")
    e = e.withColumn("_side", F.when(us("t0") % 2 == 0, 1).otherwise(-1))
    return S.make_events(e, volatility(spark, sf)).drop("side").withColumn("side", F.when(us("t0") % 2 == 0, 1).otherwise(-1))


def _times(df, *names):
    return [us(n).alias(f"{n}_us") for n in names]


@query(f"WITH RECURSIVE {CLOSES}, {CUSUM}, {EVENTS} SELECT symbol, {X.sql_us('t0')} AS t0_us, {X.sql_us('t1')} AS t1_us, {Q('trgt')} AS trgt, side FROM ev")
def event_frame(spark, sf):
    e = make_events(spark, sf)
    return e.select("symbol", *_times(e, "t0", "t1"), q6("trgt").alias("trgt"), "side")


PATH = """lastbar AS (SELECT symbol, max(ts) AS z FROM c GROUP BY symbol),
path AS (SELECT ev.symbol, ev.t0, ev.t1, ev.trgt, ev.side, p.ts, p.close / s.close - 1 AS raw, (p.close / s.close - 1) * ev.side AS r
         FROM ev JOIN lastbar USING (symbol) JOIN c s ON s.symbol = ev.symbol AND s.ts = ev.t0 JOIN c p ON p.symbol = ev.symbol AND p.ts BETWEEN ev.t0 AND coalesce(ev.t1, z))"""
TOUCH = f"""{PATH},
touch AS (SELECT symbol, t0, min(ts) FILTER (r < -trgt) AS sl, min(ts) FILTER (r > trgt) AS pt FROM path GROUP BY symbol, t0),
barrier AS (SELECT ev.symbol, ev.t0, ev.t1, sl, pt, least(ev.t1, sl, pt) AS first_touch, ev.side FROM ev LEFT JOIN touch USING (symbol, t0))"""


@query(f"WITH RECURSIVE {CLOSES}, {CUSUM}, {EVENTS}, {TOUCH} SELECT symbol, {X.sql_us('t0')} AS t0_us, {X.sql_us('t1')} AS t1_us, {X.sql_us('sl')} AS sl_us, {X.sql_us('pt')} AS pt_us, {X.sql_us('first_touch')} AS first_touch_us FROM barrier")
def triple_barrier(spark, sf):
    out = L.triple_barrier(closes(spark, sf), make_events(spark, sf))
    return out.select("symbol", *_times(out, "t0", "t1", "sl", "pt", "first_touch"))


def _labels_sql(end: str, table: str, ret: str, label: str) -> str:
    return f"""a AS (SELECT b.symbol, b.t0, b.{end} AS t1, b.side, p.close AS p0 FROM {table} b ASOF LEFT JOIN c p ON b.symbol = p.symbol AND b.t0 <= p.ts WHERE b.{end} IS NOT NULL),
    b AS (SELECT a.*, p.close AS p1 FROM a ASOF LEFT JOIN c p ON a.symbol = p.symbol AND a.t1 <= p.ts),
    r AS (SELECT symbol, t0, t1, {ret} AS ret FROM b)
    SELECT symbol, {X.sql_us("t0")} AS t0_us, {X.sql_us("t1")} AS t1_us, {Q("ret")} AS ret, ({label})::INTEGER AS bin FROM r"""


def _labels(out):
    return out.select("symbol", *_times(out, "t0", "t1"), q6("ret").alias("ret"), "bin")


@query(f"WITH RECURSIVE {CLOSES}, {CUSUM}, {EVENTS.replace('r AS (', 'r0 AS (').replace('FROM r)', 'FROM r0)')}, {_labels_sql('t1', 'ev', 'p1 / p0 - 1', 'sign(ret)')}")
def return_labels(spark, sf):
    return _labels(L.return_labels(closes(spark, sf), make_events(spark, sf)))


@query(f"WITH RECURSIVE {CLOSES}, {CUSUM}, {EVENTS.replace('r AS (', 'r0 AS (').replace('FROM r)', 'FROM r0)')}, {TOUCH}, {_labels_sql('first_touch', 'barrier', '(p1 / p0 - 1) * side', 'ret > 0')}")
def meta_labels(spark, sf):
    e = make_events(spark, sf)
    t = L.triple_barrier(closes(spark, sf), e).join(e.select("symbol", "t0", "side"), ["symbol", "t0"])
    return _labels(L.return_labels(closes(spark, sf), t, end="first_touch", apply_side=True))


VERTICAL = f"""{PATH},
v AS (SELECT symbol, t0, t1, arg_min(raw, ts) FILTER (abs(raw) >= trgt) AS hr, min(ts) FILTER (abs(raw) >= trgt) AS ht, arg_max(raw, ts) AS lr FROM path WHERE t1 IS NOT NULL GROUP BY symbol, t0, t1)
SELECT symbol, {X.sql_us("t0")} AS t0_us, {X.sql_us("coalesce(ht, t1)")} AS t1_us, {Q("coalesce(hr, lr)")} AS ret, CASE WHEN ht IS NOT NULL THEN sign(hr) ELSE 0 END::INTEGER AS bin FROM v"""


@query(f"WITH RECURSIVE {CLOSES}, {CUSUM}, {EVENTS}, {VERTICAL}")
def vertical_labels(spark, sf):
    return _labels(L.vertical_labels(closes(spark, sf), make_events(spark, sf)))


@query(f"WITH RECURSIVE {CLOSES}, {CUSUM}, {EVENTS}, g AS (SELECT symbol, t0 AS ts FROM ev WHERE t1 IS NOT NULL UNION SELECT symbol, t1 FROM ev WHERE t1 IS NOT NULL), {VERTICAL.replace('JOIN c p ON p.symbol = ev.symbol', 'JOIN (SELECT c.* FROM c SEMI JOIN g USING (symbol, ts)) p ON p.symbol = ev.symbol')}")
def vertical_labels_event_grid(spark, sf):
    return _labels(L.vertical_labels(closes(spark, sf), make_events(spark, sf), event_grid=True))


@query(f"WITH {CLOSES}, l AS (SELECT symbol, seq, CASE WHEN seq % 40 = 0 THEN 0 WHEN seq % 3 = 0 THEN -1 ELSE 1 END AS bin FROM c) SELECT symbol, seq, bin FROM l WHERE bin <> 0")
def rare_labels_dropped(spark, sf):
    bin_ = F.when(F.col("seq") % 40 == 0, 0).when(F.col("seq") % 3 == 0, -1).otherwise(1)
    return L.drop_rare_labels(closes(spark, sf).select("symbol", "seq", bin_.alias("bin")))


def _mean(n: int, x: str = "close", f: str = "avg") -> str:
    w = f"OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} >= {n} THEN {f}({x}) {w} END"


@query(f"WITH {LONG}, m AS (SELECT symbol, rn, seq, sign(floor(({_mean(5)} - {_mean(20)}) * 1e6 + 0.5)) AS s FROM c) SELECT symbol, seq, lag(s) OVER (PARTITION BY symbol ORDER BY rn)::INTEGER AS side FROM m")
def ma_cross_side(spark, sf):
    return L.ma_cross_side(closes(spark, sf, "event_type")).select("symbol", "seq", "side")


@query(
    f"""WITH {LONG}, m AS (SELECT *, {_mean(20)} AS m, {_mean(20, f="stddev_samp")} AS sd FROM c),
    x AS (SELECT *, CASE WHEN close > m + 1.8 * sd THEN -1 WHEN close < m - 1.8 * sd THEN 1 END AS x FROM m),
    f AS (SELECT *, last_value(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY rn ROWS UNBOUNDED PRECEDING) AS p FROM x)
    SELECT symbol, seq, lag(p) OVER (PARTITION BY symbol ORDER BY rn)::INTEGER AS side FROM f"""
)
def bollinger_side(spark, sf):
    return L.bollinger_side(closes(spark, sf, "event_type"), deviations=1.8).select("symbol", "seq", "side")


@query(
    f"""WITH {LONG}, r AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY rn) - 1 AS ret FROM c),
    m AS (SELECT *, {_mean(5)} AS f, {_mean(20)} AS s, {_mean(10, "ret", "stddev_samp")} AS v FROM r), w AS (SELECT *, f - s AS d FROM m)
    SELECT symbol, seq, {Q("lag(f) OVER o")} AS fast_ma, {Q("lag(s) OVER o")} AS slow_ma, {Q("lag(d) OVER o")} AS ma_diff, {Q("lag(v) OVER o")} AS volatility FROM w WINDOW o AS (PARTITION BY symbol ORDER BY rn)"""
)
def meta_features(spark, sf):
    names = ("fast_ma", "slow_ma", "ma_diff", "volatility")
    return L.meta_features(closes(spark, sf, "event_type")).select("symbol", "seq", *(q6(c).alias(c) for c in names))


@query(
    f"""WITH {LONG}, r AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY rn) - 1 AS a FROM c), l AS (SELECT *, lag(a) OVER (PARTITION BY symbol ORDER BY rn) AS b FROM r),
    s AS (SELECT symbol, seq, count(b) OVER o AS n, covar_samp(a, b) OVER o AS cv, stddev_samp(CASE WHEN b IS NOT NULL THEN a END) OVER o AS sa, stddev_samp(b) OVER o AS sb FROM l WINDOW o AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
    SELECT symbol, seq, {Q("CASE WHEN n = 4 THEN cv / nullif(sa * sb, 0) END")} AS serial_corr FROM s"""
)
def rolling_autocorr(spark, sf):
    return L.rolling_autocorr(closes(spark, sf, "event_type")).select("symbol", "seq", q6("serial_corr").alias("serial_corr"))


@query(
    f"""WITH RECURSIVE {CLOSES}, {CUSUM}, {EVENTS.replace("r AS (", "r0 AS (").replace("FROM r)", "FROM r0)")},
    r2 AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY rn) - 1 AS ret FROM c), m AS (SELECT *, {_mean(5)} AS f, {_mean(20)} AS s, {_mean(10, "ret", "stddev_samp")} AS v FROM r2),
    feat AS (SELECT symbol, ts, seq, lag(f) OVER o AS fast_ma, lag(s) OVER o AS slow_ma, lag(v) OVER o AS volatility FROM m WINDOW o AS (PARTITION BY symbol ORDER BY rn)),
    lab AS ({_labels_sql("t1", "ev", "p1 / p0 - 1", "sign(ret)").replace("a AS (SELECT b.symbol", "WITH a AS (SELECT b.symbol", 1)})
    SELECT feat.symbol, seq, {Q("fast_ma")} AS fast_ma, {Q("slow_ma")} AS slow_ma, {Q("volatility")} AS volatility, (bin = 1)::INTEGER AS bin
    FROM feat JOIN lab ON lab.symbol = feat.symbol AND lab.t0_us = epoch_us(feat.ts) WHERE slow_ma IS NOT NULL AND volatility IS NOT NULL AND bin IS NOT NULL"""
)
def meta_samples(spark, sf):
    c = closes(spark, sf)
    feats = L.meta_features(c).select("symbol", "ts", "seq", "fast_ma", "slow_ma", "volatility")
    out = L.meta_target(L.return_labels(c, make_events(spark, sf)), feats)
    return out.select("symbol", "seq", q6("fast_ma").alias("fast_ma"), q6("slow_ma").alias("slow_ma"), q6("volatility").alias("volatility"), "bin")


@query(f"WITH RECURSIVE {CLOSES}, {CUSUM}, {EVENTS} SELECT symbol, {X.sql_us('t0')} AS t0_us, 1 AS pred FROM ev")
def primary_predictions(spark, sf):
    return L.primary_predictions(make_events(spark, sf)).select("symbol", us("t0").alias("t0_us"), "pred")
