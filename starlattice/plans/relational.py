"""Relational, sky-join and streaming queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import calendar
from ..functions import healpix as hp
from ..functions.layers import render
from ..operators import own, skyjoin
from ..streaming import windows
from .elementwise import ANGLES
from .tables import query, sky, table


def _sky(spark, sf_dir, source, key):
    return table(spark, sf_dir, source).selectExpr(*[f"{e} AS {n}" for n, e in sky(key).items()])


def _sky_sql(source: str, key: str) -> str:
    return f"SELECT {', '.join(f'{e} AS {n}' for n, e in sky(key).items())} FROM {source}"


DENSITY = [ANGLES, *hp.ang2pix_layers("theta", "phi", 8, "pix", True)]


@query("sky_density_map", f"SELECT pix, count(*) AS n FROM ({render(DENSITY, _sky_sql('orders', 'o_orderkey'), ['pix'])}) AS d GROUP BY pix")
def density(spark, sf_dir):
    return skyjoin.density(_sky(spark, sf_dir, "orders", "o_orderkey"), 8)


def distance_sql(a: str, b: str) -> str:
    """Angle between two points in degrees, by the half-angle formula."""
    d1, d2 = f"radians({a}.lat)", f"radians({b}.lat)"
    return f"degrees(2e0 * asin(least(1e0, sqrt(pow(sin(({d1} - {d2}) / 2e0), 2) + cos({d1}) * cos({d2}) * pow(sin(radians({a}.lon - {b}.lon) / 2e0), 2)))))"


@query("cone_search", f"SELECT a.id, round({distance_sql('a', 'b')}, 7) AS dist FROM ({_sky_sql('customer', 'c_custkey')}) a, (SELECT 120e0 AS lon, 20e0 AS lat) b WHERE {distance_sql('a', 'b')} <= 15e0")
def cone(spark, sf_dir):
    return skyjoin.cone_search(_sky(spark, sf_dir, "customer", "c_custkey"), 120.0, 20.0, 15.0).select("id", F.round("dist", 7).alias("dist"))


@query("cross_match", f"SELECT a.id AS id_a, b.id AS id_b, round({distance_sql('a', 'b')}, 7) AS dist FROM ({_sky_sql('customer', 'c_custkey')}) a, ({_sky_sql('supplier', 's_suppkey + 7')}) b WHERE {distance_sql('a', 'b')} <= 2e0")
def match(spark, sf_dir):
    out = skyjoin.cross_match(_sky(spark, sf_dir, "customer", "c_custkey"), _sky(spark, sf_dir, "supplier", "s_suppkey + 7"), 2.0)
    return out.select("id_a", "id_b", F.round("dist", 7).alias("dist"))


SEMI = "SELECT c_custkey, c_mktsegment FROM customer WHERE {} EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')"


@query("join_semi", SEMI.format(""))
def semi(spark, sf_dir):
    done = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    c = table(spark, sf_dir, "customer")
    return c.join(done, c.c_custkey == done.o_custkey, "left_semi").select("c_custkey", "c_mktsegment")


@query("join_anti", SEMI.format("NOT"))
def anti(spark, sf_dir):
    done = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    c = table(spark, sf_dir, "customer")
    return c.join(done, c.c_custkey == done.o_custkey, "left_anti").select("c_custkey", "c_mktsegment")


ASOF_SQL = """
SELECT e.event_id, p.event_id AS prev_id FROM (SELECT * FROM events WHERE event_type = 'purchase') e
LEFT JOIN LATERAL (SELECT event_id FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'click' AND x.ts <= e.ts ORDER BY x.ts DESC, x.event_id DESC LIMIT 1) p ON true"""


@query("join_asof", ASOF_SQL)
def asof(spark, sf_dir):
    """For each purchase the user's last click at or before it."""
    events = table(spark, sf_dir, "events")
    return skyjoin.as_of(events.filter("event_type = 'purchase'"), events.filter("event_type = 'click'"), ["user_id"], "ts", "event_id").select("event_id", F.col("match_id").alias("prev_id"))


@query("join_range", "SELECT p_partkey, s_suppkey FROM part, supplier WHERE abs(p_retailprice - s_acctbal) < 2.0")
def band(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("a"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("b"))
    return skyjoin.band_join(p, s, "a", "b", 2.0).select("p_partkey", "s_suppkey")


for _kind, _group in (("cube", "CUBE (l_returnflag, l_linestatus)"), ("rollup", "ROLLUP (l_returnflag, l_linestatus)"), ("grouping_sets", "GROUPING SETS ((l_returnflag), (l_linestatus), ())")):
    _sql = f"SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY {_group}"

    def _grouped(spark, sf_dir, sql=_sql):
        return spark.sql(sql.replace("FROM lineitem", "FROM {lines}"), lines=table(spark, sf_dir, "lineitem"))

    query(f"agg_{_kind}", _sql)(_grouped)


@query("agg_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag")
def distinct(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"))


for _name, _op, _method in (("union", "UNION", lambda a, b: a.union(b).distinct()), ("intersect", "INTERSECT", lambda a, b: a.intersect(b)), ("except", "EXCEPT", lambda a, b: a.subtract(b))):

    def _sets(spark, sf_dir, method=_method):
        a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), (F.col("c_custkey") % 5).alias("m"))
        b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), (F.col("s_suppkey") % 5).alias("m"))
        return method(a, b)

    query(f"setop_{_name}", f"SELECT c_nationkey AS k, c_custkey % 5 AS m FROM customer {_op} SELECT s_nationkey, s_suppkey % 5 FROM supplier")(_sets)


@query("win_rank", "SELECT o_orderkey, rank() OVER w AS rk, dense_rank() OVER w AS drk, ntile(4) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS nt FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderstatus)")
def rank(spark, sf_dir):
    w = Window.partitionBy("o_orderpriority").orderBy("o_orderstatus")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.rank().over(w).cast("long").alias("rk"), F.dense_rank().over(w).cast("long").alias("drk"), F.ntile(4).over(Window.partitionBy("o_orderpriority").orderBy("o_totalprice", "o_orderkey")).cast("long").alias("nt"))


@query("win_lag", "SELECT event_id, lag(value) OVER w AS prev, lead(value, 2) OVER w AS next2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def lag(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", F.lag("value").over(w).alias("prev"), F.lead("value", 2).over(w).alias("next2"))


@query("win_frame", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS moving FROM events")
def frame(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-3, 0)
    return table(spark, sf_dir, "events").select("event_id", F.round(F.avg("value").over(w), 6).alias("moving"))


@query("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


# -- streams: the events table comes in three batches, the last one late ---------------------------------------------
_ARRIVED = """
ends AS (SELECT min(ts) AS lo, max(ts) AS hi FROM events),
seen AS (SELECT *, event_id % 7 = 0 AND ts < lo + (hi - lo) / 2 AS late, hi - INTERVAL 1 HOUR AS mark FROM events, ends)"""


def _streamed(build):
    def run(spark, sf_dir):
        return windows.replay(windows.arrivals(table(spark, sf_dir, "events"), F.col("event_id") % 7 == 0), build)

    return run


@query("stream_tumbling", f"WITH {_ARRIVED} SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM seen WHERE NOT (late AND time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= mark) GROUP BY ALL")
def tumbling(spark, sf_dir):
    out = _streamed(lambda events: windows.tumbling(events, "1 hour"))(spark, sf_dir)
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_sliding", f"WITH {_ARRIVED} SELECT s + INTERVAL (k) MINUTE AS start, count(*) AS n FROM (SELECT *, date_trunc('hour', ts) AS s, unnest([0, -30, 30]) AS k FROM seen) WHERE ts >= s + INTERVAL (k) MINUTE AND ts < s + INTERVAL (k + 60) MINUTE AND NOT (late AND s + INTERVAL (k + 60) MINUTE <= mark) GROUP BY 1")
def sliding(spark, sf_dir):
    return _streamed(lambda events: windows.sliding(events, "1 hour", "30 minutes"))(spark, sf_dir).select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


SESSION_SQL = f"""
WITH {_ARRIVED},
g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM seen WHERE NOT (late AND ts + INTERVAL 30 MINUTE <= mark) WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k"""


@query("stream_session", SESSION_SQL)
def session(spark, sf_dir):
    return _streamed(lambda events: windows.sessions(events, "30 minutes"))(spark, sf_dir).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("stream_late", f"WITH {_ARRIVED} SELECT event_type, count(*) AS n FROM seen WHERE NOT (late AND time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= mark) GROUP BY event_type")
def late(spark, sf_dir):
    """What is left of each type when rows that come after their day was closed are dropped."""
    days = _streamed(lambda events: windows.tumbling(events, "1 day"))(spark, sf_dir)
    return days.groupBy("event_type").agg(F.sum("n").cast("long").alias("n"))


# -- dates, JSON, frames by value, aggregates and table functions in Python, join hints ------------------------------
@query("julian_dates", "SELECT o_orderkey, o_orderdate::DATE - DATE '1858-11-17' AS mjd, (o_orderdate::DATE - DATE '1858-11-17') + 2400000.5 AS jd, round(2000 + ((o_orderdate::DATE - DATE '2000-01-01') - 0.5) / 365.25, 8) AS epoch FROM orders")
def julian(spark, sf_dir):
    mjd = calendar.mjd(F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(mjd).cast("long").alias("mjd"), calendar.jd(F.col("o_orderdate")).alias("jd"), F.round(calendar.julian_epoch(F.col("o_orderdate")), 8).alias("epoch"))


@query("win_range", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY epoch(ts) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW), 4) AS hour_sum FROM events")
def window_range(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return rows.select("event_id", F.round(F.sum("value").over(Window.partitionBy("user_id").orderBy("s").rangeBetween(-3600, 0)), 4).alias("hour_sum"))


@query("setop_all", "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY k")
def union_all(spark, sf_dir):
    both = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).unionAll(table(spark, sf_dir, "supplier").select("s_nationkey"))
    return both.groupBy("k").agg(F.count(F.lit(1)).alias("n"))


for _hint in ("broadcast", "merge", "shuffle_hash", "shuffle_replicate_nl"):

    def _hinted(spark, sf_dir, hint=_hint):
        """Suppliers by nation's name, under each join strategy."""
        nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
        return supplier.join(nation.hint(hint), supplier.s_nationkey == nation.n_nationkey).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))

    query(f"join_{_hint}", "SELECT n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")(_hinted)


@query("udaf_harmonic", "SELECT l_returnflag, round(count(*) / sum(1 / l_quantity), 6) AS harmonic FROM lineitem GROUP BY l_returnflag")
def udaf(spark, sf_dir):
    """An aggregate of one's own, in two levels so that no group has to fit one worker."""
    return own.harmonic_mean(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity").select("l_returnflag", F.round("harmonic", 6).alias("harmonic"))


@query("udtf_tiles", "SELECT n_nationkey AS id, t AS tile, (t % 3) * 10 AS x0, (t // 3) * 10 AS y0 FROM nation, range(6) AS r(t) WHERE t < CASE WHEN n_nationkey % 2 = 0 THEN 6 ELSE 3 END")
def udtf(spark, sf_dir):
    """Tiles of images of 30 by 20 or 10 pixels, by a table function."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.lit(30).alias("w"), F.when(F.col("n_nationkey") % 2 == 0, 20).otherwise(10).alias("h"))
    return own.tiles_of(rows, "id", "w", "h", 10)


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, len(json_keys(props)) AS keys FROM events WHERE json_valid(props)")
def json_props(spark, sf_dir):
    """A field of a JSON text, and the text as a map."""
    rows = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint").alias("s"), F.from_json("props", "map<string,string>").alias("m"))
    return rows.filter("m IS NOT NULL").select("event_id", "s.k", F.size(F.map_keys("m")).cast("long").alias("keys"))
