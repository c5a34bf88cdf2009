"""The star-schema tables: long facts from orders, aggregates, as-of and range joins, sessions and windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import growth, ratio
from ledgerloom.tables import table


def _money(c):
    return c.cast("decimal(18,4)")


def order_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines with year and nation of their order; the two large tables are joined once, on the order."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("company"))
    return lines.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))


def star_wide(spark: SparkSession, d: str) -> DataFrame:
    gross = F.col("l_extendedprice")
    g = order_lines(spark, d).groupBy("company", "year").agg(
        F.sum(_money(gross)).cast("double").alias("revenue_gross"), F.sum(_money(gross * F.col("l_discount"))).cast("double").alias("revenue_cut"),
        F.sum(_money(gross * (1 - F.col("l_discount")) * F.col("l_tax"))).cast("double").alias("tax_current"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"),
    )
    return g.withColumn("revenue_net", F.col("revenue_gross") - F.col("revenue_cut"))


def star_facts(spark: SparkSession, d: str) -> DataFrame:
    """Long facts of nations and years, unpivoted."""
    w = star_wide(spark, d)
    return w.unpivot(["company", "year"], ["revenue_gross", "revenue_cut", "tax_current"], "concept", "value").withColumn("value", F.round("value", 1))


def star_ratios(spark: SparkSession, d: str) -> DataFrame:
    w = star_wide(spark, d)
    return w.select("company", "year", ratio(F.col("revenue_net"), F.col("revenue_gross")).alias("net_share"), ratio(F.col("tax_current"), F.col("revenue_net")).alias("tax_share"))


def star_growth(spark: SparkSession, d: str) -> DataFrame:
    """Change of gross revenue on the year before, by a window within each nation."""
    w = W.partitionBy("company").orderBy("year")
    p = star_wide(spark, d).withColumn("_before", F.lag("revenue_gross").over(w)).withColumn("_y", F.lag("year").over(w))
    return p.where("_y = year - 1").select("company", "year", F.round(growth(F.col("revenue_gross"), F.col("_before")), 1).alias("growth"))


def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").where("l_shipdate <= timestamp '1998-09-02'")
    disc = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("sum_qty"), F.round(F.sum(_money(disc)).cast("double"), 0).alias("sum_disc_price"), F.count("*").alias("count_order"))


def priority_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Orders by year and status, priorities as columns."""
    o = table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), "o_orderstatus", F.substring("o_orderpriority", 1, 1).alias("p"))
    return o.groupBy("year", "o_orderstatus").pivot("p", ["1", "2", "3", "4", "5"]).count().toDF("year", "o_orderstatus", "p1", "p2", "p3", "p4", "p5")


def top_customers(spark: SparkSession, d: str) -> DataFrame:
    """The three customers of each nation with the highest orders in all."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(_money(F.col("o_totalprice"))).alias("total"))
    c = o.join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    w = W.partitionBy("c_nationkey").orderBy(F.desc("total"), "c_custkey")
    return c.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("c_nationkey", "rank", "c_custkey", F.col("total").cast("double").alias("total"))


def running_before(df: DataFrame, key: str, order: list, value, how: str, out: str) -> DataFrame:
    """df with `out`: of `value` over the rows of a key before each row, the maximum, the sum, or the last that is not null.

    Rows are split by key and day: a small table of days carries what came before each day, and windows
    only reach over a day's rows, so a key that holds a third of all rows is spread over many tasks.
    """
    df = df.withColumn("_day", F.to_date(F.col(order[0]))).withColumn("_v", value)
    place = F.struct(*order)
    of_day = {"max": F.max("_v"), "sum": F.sum("_v"), "last": F.max_by("_v", F.when(F.col("_v").isNotNull(), place))}[how]
    days = df.groupBy(key, "_day").agg(of_day.alias("_d"))
    earlier = W.partitionBy(key).orderBy("_day").rowsBetween(W.unboundedPreceding, -1)
    fold = {"max": F.max, "sum": F.sum, "last": lambda c: F.last(c, ignorenulls=True)}[how]
    carried = days.select(key, "_day", fold("_d").over(earlier).alias("_carry"))
    within = W.partitionBy(key, "_day").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    joined = df.join(carried, [key, "_day"]).withColumn("_w", fold("_v").over(within))
    both = {"max": F.greatest("_carry", "_w"), "sum": F.coalesce("_carry", F.lit(0)) + F.coalesce("_w", F.lit(0)), "last": F.coalesce("_w", "_carry")}[how]
    return joined.withColumn(out, both).drop("_day", "_v", "_carry", "_w")


def last_event_before(spark: SparkSession, d: str) -> DataFrame:
    """As-of join: each event of the second most frequent type with the last one of the most frequent type of its user up to that time."""
    e = table(spark, d, "events").where("user_id is not null and ts is not null").select("event_id", "user_id", "ts", "event_type")
    two = [r["event_type"] for r in e.groupBy("event_type").count().orderBy(F.desc("count"), "event_type").limit(2).collect()]
    e = running_before(e, "user_id", ["ts", "event_id"], F.when(F.col("event_type") == two[0], F.col("event_id")), "last", "last_id")
    return e.where(F.col("event_type") == two[1]).select("event_id", "last_id")


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of users: a gap of over 30 minutes starts the next; their number and the longest, in events."""
    e = table(spark, d, "events").where("user_id is not null and ts is not null").select("event_id", "user_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    e = running_before(e, "user_id", ["ts", "event_id"], F.col("us"), "max", "_before")
    e = e.withColumn("_new", F.when(F.coalesce(F.col("us") - F.col("_before") > 30 * 60 * 1_000_000, F.lit(True)), 1).otherwise(0))
    e = running_before(e, "user_id", ["ts", "event_id"], F.col("_new"), "sum", "_starts").withColumn("session", F.col("_starts") + F.col("_new"))
    s = e.groupBy("user_id", "session").agg(F.count("*").alias("events"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("events").alias("longest"))


def event_hours(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling hours: events by type."""
    e = table(spark, d, "events")
    return e.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").agg(F.count("*").alias("events")).select(F.unix_timestamp("w.start").alias("hour"), "event_type", "events")


def running_guard(spark: SparkSession, d: str) -> DataFrame:
    """Events of each user whose value is no less than every one before it: a monotonic guard by a running maximum."""
    e = table(spark, d, "events").where("value is not null and user_id is not null and ts is not null").select("event_id", "user_id", "ts", "value")
    e = running_before(e, "user_id", ["ts", "event_id"], F.col("value"), "max", "_m")
    return e.where(F.col("_m").isNull() | (F.col("value") >= F.col("_m"))).groupBy("user_id").agg(F.count("*").alias("accepted"))


QUERIES = {f.__name__: f for f in (star_facts, star_ratios, star_growth, pricing_summary, priority_pivot, top_customers, last_event_before, event_sessions, event_hours, running_guard)}
_W = """w AS (SELECT n_name AS company, year(o_orderdate)::int AS year, sum(l_extendedprice::DECIMAL(18,4))::DOUBLE AS revenue_gross, sum((l_extendedprice * l_discount)::DECIMAL(18,4))::DOUBLE AS revenue_cut,
  sum((l_extendedprice * (1 - l_discount) * l_tax)::DECIMAL(18,4))::DOUBLE AS tax_current FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""
_TWO = "k AS (SELECT event_type, row_number() OVER (ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY event_type)"
ORACLES = {
    "star_facts": f"WITH {_W} SELECT company, year, 'revenue_gross' AS concept, round(revenue_gross, 1) AS value FROM w UNION ALL SELECT company, year, 'revenue_cut', round(revenue_cut, 1) FROM w UNION ALL SELECT company, year, 'tax_current', round(tax_current, 1) FROM w",
    "star_ratios": f"WITH {_W} SELECT company, year, round((revenue_gross - revenue_cut) / revenue_gross, 4) AS net_share, round(tax_current / (revenue_gross - revenue_cut), 4) AS tax_share FROM w",
    "star_growth": f"WITH {_W} SELECT a.company, a.year, round(round((a.revenue_gross - b.revenue_gross) * 100 / abs(b.revenue_gross), 2), 1) AS growth FROM w a JOIN w b ON a.company = b.company AND b.year = a.year - 1",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS sum_qty, round(sum((l_extendedprice * (1 - l_discount))::DECIMAL(18,4))::DOUBLE, 0) AS sum_disc_price, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
    "priority_pivot": "SELECT year(o_orderdate)::int AS year, o_orderstatus, " + ", ".join(f"nullif(count(*) FILTER (WHERE o_orderpriority[1] = '{k}'), 0) AS p{k}" for k in range(1, 6)) + " FROM orders GROUP BY ALL",
    "top_customers": "WITH o AS (SELECT o_custkey AS c_custkey, sum(o_totalprice::DECIMAL(18,4)) AS total FROM orders GROUP BY 1) SELECT c_nationkey, rank, c_custkey, total::DOUBLE AS total FROM (SELECT c_nationkey, c_custkey, total, row_number() OVER (PARTITION BY c_nationkey ORDER BY total DESC, c_custkey) AS rank FROM o JOIN customer USING (c_custkey)) WHERE rank <= 3",
    "last_event_before": f"WITH {_TWO} SELECT event_id, last_id FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = (SELECT event_type FROM k WHERE r = 1) THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_id FROM events) WHERE event_type = (SELECT event_type FROM k WHERE r = 2)",
    "event_sessions": "WITH e AS (SELECT user_id, ts, event_id, CASE WHEN coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w > 1800000000, true) THEN 1 ELSE 0 END AS n FROM events WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM e), g AS (SELECT user_id, session, count(*) AS events FROM s GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(events) AS longest FROM g GROUP BY user_id",
    "event_hours": "SELECT epoch(time_bucket(INTERVAL '1 hour', ts))::BIGINT AS hour, event_type, count(*) AS events FROM events GROUP BY ALL",
    "running_guard": "SELECT user_id, count(*) AS accepted FROM (SELECT user_id, value, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM events WHERE value IS NOT NULL) WHERE m IS NULL OR value >= m GROUP BY user_id",
}
