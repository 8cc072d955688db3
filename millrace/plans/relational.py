"""Queries of joins on order and intervals, event time, sketches, groupings, frames and multisets, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import sketches, tables
from millrace.operators import ranges
from millrace.operators.joins import asof_join, interval_join
from millrace.operators.layout import kept_path
from millrace.plans.registry import query, table
from millrace.sources.csv import csv_line
from millrace.sources.datasource import register
from millrace.streaming.keyed import rebatch_by_key, sessions, windows

#: Orders moved into the month of the events.
START, EVENTS_START = 788918400000000, 1704067200000000
MOVED = f"(SELECT o_orderkey, o_custkey, o_totalprice, make_timestamp((epoch_us(o_orderdate) - {START}) // 80 + {EVENTS_START}) AS o_time FROM orders)"


def moved_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.timestamp_micros(F.expr(f"(unix_micros(cast(o_orderdate as timestamp)) - {START}) div 80 + {EVENTS_START}"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", at.alias("o_time"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def micros(name: str) -> F.Column:
    return F.unix_micros(name).alias(name)


@query(f"""
SELECT e.event_id, e.user_id, epoch_us(e.ts) AS ts, o.o_orderkey, o.o_totalprice, epoch_us(o.o_time) AS o_time FROM events e
LEFT JOIN LATERAL (SELECT * FROM {MOVED} o WHERE o.o_custkey = e.user_id AND o.o_time <= e.ts ORDER BY o_time DESC, o_orderkey DESC LIMIT 1) o ON true
""")
def asof_events_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the last order of its user."""
    left = events(spark, sf_dir).select("event_id", "user_id", "ts")
    out = asof_join(left, moved_orders(spark, sf_dir), ["user_id"], "ts", "o_time", tie="o_orderkey", right_by=["o_custkey"])
    return out.select("event_id", "user_id", micros("ts"), "o_orderkey", "o_totalprice", micros("o_time"))


@query(f"""
SELECT e.event_id, o.o_orderkey, (epoch_us(o.o_time) - epoch_us(e.ts))::BIGINT AS wait FROM events e
LEFT JOIN LATERAL (SELECT * FROM {MOVED} o WHERE o.o_time > e.ts ORDER BY o_time, o_orderkey DESC LIMIT 1) o ON epoch_us(o.o_time) - epoch_us(e.ts) <= 3600000000
""")
def asof_one_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the first order after it, of any customer and within an hour: one key has all rows."""
    left, right = events(spark, sf_dir).select("event_id", "ts"), moved_orders(spark, sf_dir)
    near = lambda a, b: F.unix_micros(b) - F.unix_micros(a) <= 3_600_000_000
    out = asof_join(left.withColumn("k", F.lit(1)), right.withColumn("k", F.lit(1)), ["k"], "ts", "o_time", tie="o_orderkey", direction="forward", allow_equal=False, within=near, prefix="r_")
    return out.select("event_id", F.col("r_o_orderkey").alias("o_orderkey"), (F.unix_micros("r_o_time") - F.unix_micros("ts")).alias("wait"))


OPEN = "(SELECT o_orderkey AS k, o_custkey AS c, epoch_us(o_orderdate) AS a, max(epoch_us(l_shipdate)) AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3 HAVING b >= a)"


@query(f"SELECT x.c, x.k AS k1, y.k AS k2 FROM {OPEN} x JOIN {OPEN} y ON x.c = y.c AND x.a <= y.b AND y.a <= x.b AND x.k < y.k")
def interval_open_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of one customer that were open at the same time."""
    o, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    spans = o.join(line.groupBy("l_orderkey").agg(F.max(at("l_shipdate")).alias("b")), F.col("l_orderkey") == F.col("o_orderkey"))
    spans = spans.select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("k"), at("o_orderdate").alias("a"), "b")
    out = interval_join(spans, spans, ("a", "b"), ("a", "b"), on=["c"], prefix="r_")
    return out.where("k < r_k").select("c", F.col("k").alias("k1"), F.col("r_k").alias("k2"))


@query("""
SELECT w.event_id AS error_id, count(*)::BIGINT AS n, sum(e.event_id)::BIGINT AS ids FROM events w JOIN events e ON epoch_us(e.ts) >= epoch_us(w.ts) AND epoch_us(e.ts) < epoch_us(w.ts) + 3600000000
WHERE w.event_type = 'error' GROUP BY 1
""")
def range_events_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of the hour after each error, without a key to join on."""
    e = events(spark, sf_dir)
    windows = e.where("event_type = 'error'").select(F.col("event_id").alias("error_id"), F.unix_micros("ts").alias("a"), (F.unix_micros("ts") + 3_600_000_000).alias("b"))
    points = e.select("event_id", F.unix_micros("ts").alias("at"))
    return ranges.interval_sums(windows, points, "error_id", ("a", "b"), "at", {"ids": "event_id"})


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(kinds).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def drained(plan: DataFrame, label: str) -> DataFrame:
    """What a streaming plan gives from all that its source has now."""
    spark = plan.sparkSession
    out = kept_path(spark, label)
    plan.writeStream.format("parquet").option("path", out).option("checkpointLocation", kept_path(spark, f"{label}-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(plan.schema).parquet(out)


@query("""
SELECT user_id, ((r - 1) // 20)::BIGINT AS batch, ((r - 1) % 20)::BIGINT AS place, event_id
FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE r <= n // 20 * 20
""")
def stream_rebatch_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 20 events of each user from a stream, with the rest in its state."""
    return drained(rebatch_by_key(event_stream(spark, sf_dir).select("user_id", "event_id"), "user_id", "event_id", 20), "by-user")


@query("""
WITH e AS (SELECT user_id, epoch_us(ts) AS t, value FROM events),
g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= 7200000000 THEN 0 ELSE 1 END AS new FROM e),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k, max(t) OVER (PARTITION BY user_id) AS latest FROM g)
SELECT user_id, min(t)::BIGINT AS first, max(t)::BIGINT AS last, count(*)::BIGINT AS n, round(100 * sum(value))::BIGINT AS cents FROM s GROUP BY user_id, k, latest HAVING max(t) + 7200000000 < latest - 3600000000
""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user with gaps of up to two hours, those that are over an hour after."""
    out = drained(sessions(event_stream(spark, sf_dir), "user_id", "ts", "value", 7_200_000_000, 3_600_000_000), "sessions")
    return out.where("kind = 'session'").select("user_id", "first", "last", "n", F.round(100 * F.col("total")).cast("long").alias("cents"))


WINDOWS = """
SELECT event_type, ((epoch_us(ts) // 1800000000 - k.i) * 1800000000)::BIGINT AS start, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS users FROM events, (SELECT unnest([0, 1]) AS i) k GROUP BY 1, 2
"""


def shown_windows(df: DataFrame) -> DataFrame:
    return df.select("event_type", micros("start"), "n", *(c for c in ("users",) if c in df.columns))


@query(WINDOWS)
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of an hour that begin every half an hour."""
    return shown_windows(windows(events(spark, sf_dir), "ts", "1 hour", ["event_type"], [F.count("*").alias("n"), F.count_distinct("user_id").alias("users")], "30 minutes"))


@query(f"SELECT event_type, start, n FROM ({WINDOWS}) WHERE start + 3600000000 <= (SELECT max(epoch_us(ts)) FROM events)")
def stream_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream: the windows that are over by the watermark."""
    return shown_windows(drained(windows(event_stream(spark, sf_dir), "ts", "1 hour", ["event_type"], [F.count("*").alias("n")], "30 minutes"), "windows"))


@query("""
WITH v AS (SELECT event_type, user_id || ':' || props AS v FROM events), h AS (SELECT event_type, md5(v) AS d FROM v),
b AS (SELECT event_type, ('0x' || substr(d, 1, 4))::BIGINT >> 4 AS slot, ('0x' || substr(d, 5, 8))::BIGINT AS t FROM h),
r AS (SELECT event_type, slot, max(CASE WHEN t = 0 THEN 33 ELSE 33 - length(bin(t)) END) AS rank FROM b GROUP BY 1, 2),
z AS (SELECT event_type, 4096 - count(*) AS z, 4096 - count(*) + sum(power(2.0, -rank)) AS s FROM r GROUP BY 1),
e AS (SELECT event_type, z, (0.7213 / (1 + 1.079 / 4096)) * 4096 * 4096 / s AS raw FROM z)
SELECT event_type, (SELECT count(DISTINCT v) FROM v WHERE v.event_type = e.event_type)::BIGINT AS users, floor(CASE WHEN raw <= 2.5 * 4096 AND z > 0 THEN 4096 * ln(4096 / z) ELSE raw END + 0.5)::BIGINT AS estimate FROM e
""")
def approx_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with their properties by event type: the exact number, and that of the merged sketches of all days."""
    e = events(spark, sf_dir).select("event_type", F.to_date("ts").alias("day"), F.concat_ws(":", F.col("user_id").cast("string"), "props").alias("v"))
    days = sketches.distinct_sketch(e, ["event_type", "day"], "v")
    whole = sketches.merged(days, ["event_type"], "sketch", "max").select("event_type", sketches.distinct_estimate("sketch").alias("estimate"))
    return e.groupBy("event_type").agg(F.count_distinct("v").alias("users")).join(whole, "event_type").select("event_type", "users", "estimate")


@query("""
WITH p AS (SELECT o_orderpriority AS p, o_totalprice AS x, ceil(ln(o_totalprice) / ln(1.01 / 0.99)) AS k, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) - 1 AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
q AS (SELECT unnest([0.0, 0.5, 0.99]) AS q)
SELECT p, q::DOUBLE AS q, round(2 * power(1.01 / 0.99, k) / (1.01 / 0.99 + 1), 3) AS estimate, x AS exact, abs(2 * power(1.01 / 0.99, k) / (1.01 / 0.99 + 1) - x) <= 0.0100001 * x AS near FROM p, q WHERE r = floor(q * (n - 1))
""")
def approx_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of prices by priority from merged sketches, with the exact ones by running row numbers."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("p"), F.year("o_orderdate").alias("y"), F.col("o_totalprice").alias("x"), "o_orderkey")
    whole = sketches.merged(sketches.quantile_sketch(o, ["p", "y"], "x"), ["p"], "sketch", "sum")
    told = whole.select("p", F.explode(F.array(*(F.struct(F.lit(q).alias("q"), sketches.quantile("sketch", q).alias("e")) for q in (0.0, 0.5, 0.99)))).alias("s")).select("p", "s.q", "s.e")
    ranked = ranges.running(o, ["p"], ["x", "o_orderkey"], {}, "r")
    sizes = o.groupBy("p").agg(F.count("*").alias("n"))
    out = told.join(sizes, "p").join(ranked.withColumnRenamed("p", "p2"), F.expr("p2 = p and r - 1 = floor(q * (n - 1))"))
    return out.select("p", "q", F.round("e", 3).alias("estimate"), F.col("x").alias("exact"), (F.abs(F.col("e") - F.col("x")) <= 0.0100001 * F.col("x")).alias("near"))


PARTLY = "(SELECT o_orderstatus AS s, CASE WHEN o_orderpriority <> '3-MEDIUM' THEN o_orderpriority END AS p, o_custkey, o_orderdate, o_orderkey FROM orders)"


def partly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, some of whose priorities are null."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("s"), F.when(F.col("o_orderpriority") != "3-MEDIUM", F.col("o_orderpriority")).alias("p"), "o_custkey", "o_orderdate", "o_orderkey")


COUNTED = "count(*)::BIGINT AS n, count(DISTINCT o_custkey)::BIGINT AS customers, count(DISTINCT o_orderdate)::BIGINT AS days, max(o_orderkey) AS last"


def counted() -> list[F.Column]:
    return [F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"), F.count_distinct("o_orderdate").alias("days"), F.max("o_orderkey").alias("last")]


@query(f"SELECT s, p, (2 * grouping(s) + grouping(p))::BIGINT AS level, {COUNTED} FROM {PARTLY} GROUP BY CUBE (s, p)")
def cube_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.grouping_sets(partly(spark, sf_dir), ranges.cube_sets(["s", "p"]), counted())


@query(f"SELECT s, p, (2 * grouping(s) + grouping(p))::BIGINT AS level, {COUNTED} FROM {PARTLY} GROUP BY ROLLUP (s, p)")
def rollup_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.grouping_sets(partly(spark, sf_dir), ranges.rollup_sets(["s", "p"]), counted())


@query(f"SELECT p, s, (2 * grouping(p) + grouping(s))::BIGINT AS level, {COUNTED} FROM {PARTLY} GROUP BY GROUPING SETS ((p), (s), ())")
def grouping_sets_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.grouping_sets(partly(spark, sf_dir), [["p"], ["s"], []], counted())


@query("""
SELECT event_id, sum(user_id) OVER (ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND 3 FOLLOWING)::BIGINT AS near, min(user_id) OVER (ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND 3 FOLLOWING) AS least FROM events
""")
def frame_one_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of rows over all events as one key, which is cut."""
    out = ranges.rows_frame(events(spark, sf_dir).select("event_id", "user_id"), [], ["event_id"], 5, 3, {"near": F.sum("user_id"), "least": F.min("user_id")}, piece=1000)
    return out.select("event_id", "near", "least")


@query("SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND 60000000 FOLLOWING)::BIGINT AS n FROM events")
def frame_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a type from an hour before each one to a minute after."""
    out = ranges.range_frame(events(spark, sf_dir).select("event_id", "event_type", micros("ts")), ["event_type"], "ts", 3_600_000_000, 60_000_000, {"n": F.count("*")})
    return out.select("event_id", "n")


@query("""
SELECT event_id, row_number() OVER (ORDER BY event_id)::BIGINT AS place, sum(user_id) OVER (ORDER BY event_id)::BIGINT AS total,
sum(user_id) OVER (PARTITION BY event_type ORDER BY event_id)::BIGINT AS of_type FROM events
""")
def running_one_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums that run on over all events, and over those of a type."""
    e = ranges.running(events(spark, sf_dir).select("event_id", "event_type", "user_id"), [], ["event_id"], {"total": F.col("user_id")}, "place")
    return ranges.running(e, ["event_type"], ["event_id"], {"of_type": F.col("user_id")}).select("event_id", "place", "total", "of_type")


@query("SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id)::BIGINT AS rank FROM events QUALIFY rank <= 3")
def top_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three dearest events of each user; of equal ones the earlier."""
    return ranges.top_k(events(spark, sf_dir).select("user_id", "event_id", "value"), ["user_id"], [("value", "descending"), ("event_id", "ascending")], 3)


BAGS = ("SELECT o_custkey % 50 AS a, CASE WHEN o_custkey % 7 > 0 THEN o_orderstatus END AS b FROM orders WHERE o_orderkey % 2 = 0", "SELECT o_custkey % 60 AS a, CASE WHEN o_custkey % 5 > 0 THEN o_orderstatus END AS b FROM orders WHERE o_orderkey % 3 = 0")


def bags(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    return tuple(o.where(f"o_orderkey % {k} = 0").selectExpr(f"o_custkey % {m} AS a", f"CASE WHEN o_custkey % {d} > 0 THEN o_orderstatus END AS b") for k, m, d in ((2, 50, 7), (3, 60, 5)))


@query(f"({BAGS[0]}) INTERSECT ALL ({BAGS[1]})")
def intersect_all_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.intersect_all(*bags(spark, sf_dir))


@query(f"({BAGS[0]}) EXCEPT ALL ({BAGS[1]})")
def except_all_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.except_all(*bags(spark, sf_dir))


@query("""
WITH t AS (SELECT c_nationkey AS nation, c_custkey, c_name, c_nationkey + 1 AS age, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS r FROM customer)
SELECT nation, (r // 2)::BIGINT AS batch, (r % 2)::BIGINT AS place, array_to_string(list_transform(string_split(c_name, ''), lambda x: chr(ascii(x) + 1)), '') AS login, (age + length(c_name))::BIGINT AS age
FROM t WHERE age + length(c_name) > 30
""")
def sql_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline of the README as SQL, a stream for each nation."""
    tables.register(spark)
    table(spark, sf_dir, "customer").createOrReplaceTempView("sql_customers")
    return spark.sql("""
    WITH people AS (SELECT c_nationkey AS nation, c_custkey, c_name AS login, CAST(c_nationkey + 1 AS BIGINT) AS age FROM sql_customers),
    stream AS (SELECT * FROM create_batches(TABLE(people) PARTITION BY nation ORDER BY (c_custkey), 2)),
    changed AS (SELECT nation, batch, place, array_join(transform(split(login, ''), x -> char(ascii(x) + 1)), '') AS login, age + char_length(login) AS age FROM stream)
    SELECT * FROM changed WHERE age > 30
    """)


@query("""
WITH w AS (SELECT conv_id, turn, string_split(role || ' ' || coalesce(text[:20], ''), ' ') AS words FROM conversations),
m AS (SELECT *, max(len(words)) OVER (PARTITION BY conv_id) AS m FROM w)
SELECT conv_id, turn, t.i::INT AS i, words[t.i + 1] AS element, t.i < len(words) AS there FROM m, LATERAL unnest(range(m)) t(i)
""")
def sql_pad_and_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each turn, padded to the longest turn of the conversation and taken apart."""
    tables.register(spark)
    table(spark, sf_dir, "conversations").createOrReplaceTempView("sql_turns")
    return spark.sql("""
    WITH words AS (SELECT conv_id, turn, split(concat(role, ' ', coalesce(substring(text, 1, 20), '')), ' ') AS words FROM sql_turns),
    padded AS (SELECT * FROM pad_batches(TABLE(words) PARTITION BY conv_id ORDER BY (turn), 'words'))
    SELECT conv_id, turn, i, element, mask[i] AS there FROM unpack_elements(TABLE(padded), 'words')
    """)


@query("SELECT o_orderkey::VARCHAR AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 5 <> 3")
def csv_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as CSV in several files and read by the strict data source from SQL."""
    register(spark)
    path = kept_path(spark, "strict")
    o = table(spark, sf_dir, "orders").where("o_orderkey % 5 <> 3")
    o.repartition(3, "o_orderkey").select(csv_line([F.col("o_orderkey").cast("string"), F.col("o_orderstatus")]).alias("value")).write.text(path)
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW strict_orders (k STRING, s STRING) USING strict_csv OPTIONS (path '{path}', header 'false')")
    return spark.sql("SELECT k, s FROM strict_orders")
