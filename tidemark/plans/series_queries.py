"""Registered queries over series: sources, quality, slices, aggregates, resampling, windows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.units import SERIES_CONVERSIONS, convert_result
from ..operators import aggregates as A
from ..operators import ordered as O
from ..operators import quality as Q
from ..operators import resample as R
from ..operators import slices as S
from ..sources import series as src
from .catalogue import BY_ID, QUESTIONS, published_truths, truths
from .registry import query
from .views import Tables, r, stamp

FIRST, LAST = "1995-01-01", "2001-08-01"

# ------------------------------------------------------------------------------- sources
EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


@query(
    "read_series",
    "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS time, user_id, event_type, value FROM events",
)
def read_series(t: Tables):
    rows = src.read_series(t.spark, f"{t.folder}/events.parquet", EVENTS)
    return rows.select("event_id", stamp("ts").alias("time"), "user_id", "event_type", "value")


def day_payloads(t: Tables):
    """One landed document per day: a day of an hourly series holds at most 24 records."""
    point = F.struct("time", "v", "s")
    days = t.series_h.groupBy(F.date_trunc("day", "time").alias("day")).agg(F.array_sort(F.collect_list(point)).alias("p"))
    return days.select(
        F.lit(48.5).alias("latitude"),
        F.lit(9.0).alias("longitude"),
        F.lit(341.0).alias("elevation"),
        F.when(F.dayofmonth("day") % 5 == 0, F.lit("Europe/Berlin")).otherwise(F.lit("GMT")).alias("timezone"),
        F.struct(F.lit("iso8601").alias("time"), F.lit("u").alias("v"), F.lit("u").alias("s")).alias("hourly_units"),
        F.struct(
            F.transform("p", lambda p: F.date_format(p["time"], "yyyy-MM-dd'T'HH:mm")).alias("time"),
            F.transform("p", lambda p: p["v"]).alias("v"),
            F.transform("p", lambda p: p["s"]).alias("s"),
        ).alias("hourly"),
    )


def landed(t: Tables):
    path = t.fresh("payloads")
    day_payloads(t).write.json(path)
    return src.parse_payloads(src.read_payloads(t.spark, path, ("v", "s")), ("v", "s"))


@query(
    "parse_payload",
    """SELECT strftime(time, '%Y-%m-%d %H:%M') AS time, round(v, 4) AS v, round(s, 4) AS s
       FROM series_h WHERE day(time) % 5 <> 0""",
)
def parse_payload(t: Tables):
    records, _ = landed(t)
    return records.select(stamp("time").alias("time"), r("v").alias("v"), r("s").alias("s"))


@query(
    "parse_payload_rejects",
    """SELECT 'expected timestamps in GMT/UTC, got timezone=Europe/Berlin' AS problem,
         CAST(count(DISTINCT date_trunc('day', time)) AS BIGINT) AS payloads
       FROM series_h WHERE day(time) % 5 = 0 GROUP BY 1""",
)
def parse_payload_rejects(t: Tables):
    _, rejects = landed(t)
    return rejects.groupBy("problem").agg(F.count(F.lit(1)).alias("payloads"))


SERIES_D = T.StructType(
    [
        T.StructField("time", T.TimestampType()),
        T.StructField("v", T.DoubleType()),
        T.StructField("s", T.DoubleType()),
        T.StructField("n", T.LongType()),
    ]
)


def complete_days(t: Tables):
    """The daily series with its empty days filled, so that it validates; ``pos`` is the place in the input."""
    filled = R.fill_bins(t.series_d, "day", zero=["n"], column="time")
    place = F.datediff("time", F.lit(FIRST))
    return filled.select("time", "v", "s", F.col("n").cast("long").alias("n"), place.alias("pos"))


def store(t: Tables, rows, path: str) -> None:
    src.write_series_validated(rows, path, {"v": "EUR", "s": "EUR"}, FIRST, LAST, "day", position="pos", request={"place": "shop"})


def stored_series(t: Tables) -> str:
    """Two published versions of a series, the second one complete and in order."""
    path = t.fresh("series")
    store(t, complete_days(t).withColumn("v", F.col("v") + 1), path)
    store(t, complete_days(t), path)
    return path


DAYS = """SELECT CAST(range AS TIMESTAMP) AS day
          FROM range(TIMESTAMP '1995-01-01', TIMESTAMP '2001-08-02', INTERVAL 1 DAY)"""


@query(
    "write_series_validated",
    f"""SELECT strftime(day, '%Y-%m-%d') AS day, round(v, 6) AS v, round(s, 2) AS s, coalesce(n, 0) AS n
        FROM ({DAYS}) LEFT JOIN series_d ON time = day""",
)
def write_series_validated(t: Tables):
    back = src.read_published(t.spark, stored_series(t), SERIES_D)
    return back.select(F.date_format("time", "yyyy-MM-dd").alias("day"), r("v", 6).alias("v"), r("s", 2).alias("s"), "n")


@query(
    "build_manifest",
    f"""SELECT 'UTC' AS timezone, 'EUR' AS unit_v, '1995-01-01 00:00' AS first, '2001-08-01 00:00' AS last,
          CAST(count(*) AS BIGINT) AS rows, CAST(count(*) AS BIGINT) AS expected_rows,
          CAST(count(*) - count(v) AS BIGINT) AS missing_v, CAST(1 AS BIGINT) AS version, 'shop' AS place
        FROM ({DAYS}) LEFT JOIN series_d ON time = day""",
)
def build_manifest(t: Tables):
    m = src.read_manifest(t.spark, stored_series(t))
    return m.select(
        "timezone",
        m["variables"]["v"].alias("unit_v"),
        stamp(m["time_range"][0]).alias("first"),
        stamp(m["time_range"][1]).alias("last"),
        "rows",
        "expected_rows",
        m["nan_counts"]["v"].alias("missing_v"),
        "version",
        m["request"]["place"].alias("place"),
    )


@query(
    "write_gate",
    """SELECT unnest(['in order', 'swapped', 'a day short', 'a day twice', 'a day late']) AS kind,
         unnest([NULL, 'timestamps are not sorted', '1 missing hours, first: 1996-05-05 00:00', '1 duplicated timestamps',
                 '1 missing hours, first: 1995-01-01 00:00; 1 unexpected timestamps, first: 2001-08-02 00:00']) AS refused,
         2 AS readable""",
)
def write_gate(t: Tables):
    """What the gate says of payloads with one fault each, and the version readers see afterwards."""
    path, good = t.fresh("gate"), complete_days(t)
    day = lambda text: F.col("time") == F.lit(text).cast("timestamp")
    tries = {
        "in order": good,
        "swapped": good.withColumn("pos", F.when(F.col("pos").isin(40, 41), 81 - F.col("pos")).otherwise(F.col("pos"))),
        "a day short": good.where(~day("1996-05-05")),
        "a day twice": good.unionByName(good.where(day("1996-05-05"))),
        "a day late": good.withColumn("time", F.col("time") + F.expr("INTERVAL 1 DAY")),
    }
    store(t, good.withColumn("v", F.lit(1.0)), path)
    out = []
    for kind, rows in tries.items():
        try:
            store(t, rows, path)
            refused = None
        except ValueError as e:
            refused = str(e).removeprefix("dataset failed validation: ")
        out.append((kind, refused, src.read_manifest(t.spark, path).first()["version"] + 1))
    return t.spark.createDataFrame(out, "kind string, refused string, readable int")


@query(
    "check_manifest",
    f"SELECT true AS ok, CAST(count(*) AS BIGINT) AS rows FROM ({DAYS})",
)
def check_manifest(t: Tables):
    checked = src.check_manifest(t.spark, stored_series(t), SERIES_D)
    return checked.select("ok", F.regexp_extract("message", r"^ok: (\d+) rows", 1).try_cast("long").alias("rows"))


# ------------------------------------------------------------------------------- quality
@query(
    "missing_hours",
    f"""SELECT CAST(count(*) AS BIGINT) AS missing, strftime(min(day), '%Y-%m-%d %H:%M') AS first
        FROM ({DAYS}) WHERE day NOT IN (SELECT time FROM series_d)""",
)
def missing_hours(t: Tables):
    return Q.missing_hours(t.orders_t, FIRST, LAST, "day")


@query(
    "missing_hours_hourly",
    """SELECT CAST(count(*) AS BIGINT) AS missing, strftime(min(h), '%Y-%m-%d %H:%M') AS first
       FROM (SELECT CAST(range AS TIMESTAMP) AS h
             FROM range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-01', INTERVAL 1 HOUR))
       WHERE h NOT IN (SELECT time FROM series_h)""",
)
def missing_hours_hourly(t: Tables):
    return Q.missing_hours(t.series_h, "2024-01-01", "2024-01-31")


@query(
    "unexpected_timestamps",
    """SELECT CAST(count(*) AS BIGINT) AS unexpected, strftime(min(time), '%Y-%m-%d %H:%M') AS first
       FROM series_d WHERE time > TIMESTAMP '2001-07-01'""",
)
def unexpected_timestamps(t: Tables):
    return Q.unexpected_timestamps(t.orders_t, FIRST, "2001-07-01", "day")


@query("duplicate_timestamps", "SELECT CAST(count(*) - count(DISTINCT o_orderdate) AS BIGINT) AS duplicates FROM orders")
def duplicate_timestamps(t: Tables):
    return Q.duplicate_timestamps(t.orders_t)


@query(
    "unsorted_check",
    """SELECT CAST(count(*) FILTER (WHERE o_orderdate < before) AS BIGINT) AS out_of_order,
         count(*) FILTER (WHERE o_orderdate < before) = 0 AS is_sorted
       FROM (SELECT o_orderdate, lag(o_orderdate) OVER (ORDER BY o_orderkey) AS before FROM orders)""",
)
def unsorted_check(t: Tables):
    return O.unsorted_check(t.orders_t, "o_orderkey")


@query(
    "unsorted_check_events",
    """SELECT CAST(count(*) FILTER (WHERE ts < before) AS BIGINT) AS out_of_order,
         count(*) FILTER (WHERE ts < before) = 0 AS is_sorted
       FROM (SELECT ts, lag(ts) OVER (ORDER BY event_id) AS before FROM events)""",
)
def unsorted_check_events(t: Tables):
    return O.unsorted_check(t.ticks, "event_id")


NULLABLE = ["question_id", "answer_key", "got_number", "stop_reason", "plan_status", "total_s"]


@query(
    "null_counts",
    """SELECT unnest(['question_id', 'answer_key', 'got_number', 'stop_reason', 'plan_status', 'total_s']) AS "column",
         unnest([n, n, n, n, n, n]) AS rows,
         unnest([0, n - a, n - g, z, n - p, 0]) AS missing
       FROM (SELECT count(*) AS n, count(answer_key) AS a, count(got_number) AS g,
               count(*) FILTER (WHERE stop_reason = 'none') AS z, count(plan_status) AS p FROM runs_t)""",
)
def null_counts(t: Tables):
    return Q.null_counts(t.runs, NULLABLE)


@query("all_null_columns", """SELECT 'nothing' AS "column", CAST(count(*) AS BIGINT) AS rows FROM lineitem""")
def all_null_columns(t: Tables):
    widened = t.runs.withColumn("nothing", F.when(F.col("correct"), float("nan")).cast("double"))
    return Q.all_null_columns(widened, [*NULLABLE, "nothing"])


@query(
    "validate_series",
    f"""SELECT CAST((SELECT count(*) FROM orders) AS BIGINT) AS rows, CAST((SELECT count(*) FROM ({DAYS})) - 31 AS BIGINT) AS expected_rows,
          CAST(0 AS BIGINT) AS missing_price,
          concat(dup, ' duplicated timestamps; timestamps are not sorted; ',
                 CASE WHEN lacking > 0 THEN concat(lacking, ' missing hours, first: ', lack1, '; ') ELSE '' END,
                 extra, ' unexpected timestamps, first: ', extra1) AS problems
        FROM (SELECT count(*) - count(DISTINCT o_orderdate) AS dup,
                count(DISTINCT CASE WHEN o_orderdate > TIMESTAMP '2001-07-01' THEN o_orderdate END) AS extra,
                strftime(min(CASE WHEN o_orderdate > TIMESTAMP '2001-07-01' THEN o_orderdate END), '%Y-%m-%d %H:%M') AS extra1
              FROM orders),
             (SELECT count(*) AS lacking, strftime(min(day), '%Y-%m-%d %H:%M') AS lack1 FROM ({DAYS})
              WHERE day <= TIMESTAMP '2001-07-01' AND day NOT IN (SELECT time FROM series_d))""",
)
def validate_series(t: Tables):
    rows = t.orders_t.select("time", "o_totalprice", "o_orderkey")
    out = Q.validate_series(rows, FIRST, "2001-07-01", "day", position="o_orderkey")
    return out.select("rows", "expected_rows", F.col("nan_counts")["o_totalprice"].alias("missing_price"), "problems")


WORDS = ", ".join(f"CAST(sum(CAST(concat('0x', substr(h, {8 * i + 1}, 8)) AS BIGINT)) AS VARCHAR)" for i in range(8))


@query(
    "content_hash",
    f"""SELECT rows, sha256(concat_ws(',', CAST(rows AS VARCHAR), w)) AS content_sha256 FROM (
          SELECT CAST(count(*) AS BIGINT) AS rows, concat_ws(',', {WORDS}) AS w FROM (
            SELECT sha256(concat_ws(',', strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), printf('%.6f', value),
                     printf('%.6f', CAST(user_id AS DOUBLE)))) AS h FROM events))""",
)
def content_hash(t: Tables):
    rows = t.ticks.select("time", "value", F.col("user_id").cast("double").alias("user_id"))
    return Q.content_hash(rows, ["value", "user_id"])


@query(
    "profile_columns",
    """SELECT unnest(['value', 'user_id']) AS "column", unnest(['mm', NULL]) AS unit,
         unnest([min(value), min(user_id)]) AS min, unnest([round(avg(value), 3), round(avg(user_id), 3)]) AS mean,
         unnest([max(value), max(user_id)]) AS max, CAST(0 AS BIGINT) AS missing, CAST(count(*) AS BIGINT) AS rows,
         strftime(min(ts), '%Y-%m-%d %H:%M') AS time_from, strftime(max(ts), '%Y-%m-%d %H:%M') AS time_to
       FROM events""",
)
def profile_columns(t: Tables):
    rows = t.ticks.select("time", "value", F.col("user_id").cast("double").alias("user_id"))
    return Q.profile_columns(rows, {"value": "mm"}, ["value", "user_id"])


@query(
    "describe_result_column",
    """SELECT n_rows, n_columns, n_missing, (SELECT string_agg(line, chr(10) ORDER BY event_id) FROM (
           SELECT event_id, concat('{"event_id":', event_id, ',"user_id":', user_id,
             CASE WHEN event_id % 3 > 0 THEN concat(',"kind":"', event_type, '"') ELSE '' END, '}') AS line
           FROM events ORDER BY event_id LIMIT 20)) AS head
       FROM (SELECT CAST(count(*) AS BIGINT) AS n_rows, 3 AS n_columns,
               CAST(count(*) FILTER (WHERE event_id % 3 = 0) AS BIGINT) AS n_missing FROM events)""",
)
def describe_result_column(t: Tables):
    rows = t.events.select("event_id", "user_id", F.when(F.col("event_id") % 3 > 0, F.col("event_type")).alias("kind"))
    return Q.describe_result(rows, ["event_id"])


# ------------------------------------------------------------------------------- slices
@query(
    "period_slice",
    """SELECT strftime(time, '%Y-%m-%d') AS day, round(v, 6) AS v, n FROM series_d
       WHERE time >= TIMESTAMP '1996-02-01' AND time < TIMESTAMP '1996-03-01'""",
)
def period_slice(t: Tables):
    rows = S.period_slice(t.series_d, "1996-02")
    return rows.select(F.date_format("time", "yyyy-MM-dd").alias("day"), r("v", 6).alias("v"), "n")


@query(
    "date_range_inclusive",
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS time FROM events
       WHERE ts >= TIMESTAMP '2024-01-06' AND ts < TIMESTAMP '2024-01-09'""",
)
def date_range_inclusive(t: Tables):
    return S.date_range_inclusive(t.events, "2024-01-06", "2024-01-08", "ts").select("event_id", stamp("ts").alias("time"))


@query(
    "hour_of_day_filter",
    """SELECT strftime(time, '%Y-%m-%d %H:%M') AS time, round(v, 4) AS v FROM series_h
       WHERE hour(time) IN (22, 23, 0, 1, 2, 3, 4)""",
)
def hour_of_day_filter(t: Tables):
    rows = S.hour_of_day_filter(t.series_h, 22, 23, 0, 1, 2, 3, 4)
    return rows.select(stamp("time").alias("time"), r("v").alias("v"))


@query("threshold_filter", "SELECT strftime(time, '%Y-%m-%d %H:%M') AS time, round(v, 4) AS v FROM series_h WHERE v > 50")
def threshold_filter(t: Tables):
    return S.threshold_filter(t.series_h, "v", ">", 50.0).select(stamp("time").alias("time"), r("v").alias("v"))


@query("column_projection", "SELECT event_id, value FROM events")
def column_projection(t: Tables):
    return S.column_projection(t.events, "event_id", "value")


# ------------------------------------------------------------------------------- aggregates
@query("agg_mean", "SELECT round(avg(v), 4) AS mean FROM series_h")
def agg_mean(t: Tables):
    return t.series_h.agg(r(A.stat("mean", "v")).alias("mean"))


@query("agg_min_max", "SELECT max(value) AS max, min(value) AS min FROM events")
def agg_min_max(t: Tables):
    return t.events.agg(A.stat("max", "value").alias("max"), A.stat("min", "value").alias("min"))


@query(
    "agg_sum",
    """SELECT round(sum(o_totalprice), 2) AS total, 0.0 AS nothing FROM orders
       WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'""",
)
def agg_sum(t: Tables):
    return t.orders_t.agg(
        r(A.stat("sum", "o_totalprice", S.in_period("1998")), 2).alias("total"),
        A.stat("sum", "o_totalprice", S.in_period("2050")).alias("nothing"),
    )


@query("agg_median", "SELECT round(median(v), 4) AS median FROM series_h")
def agg_median(t: Tables):
    # An hourly series of one month: at most 744 values.
    return t.series_h.agg(r(A.stat("median", "v")).alias("median"))


@query("agg_stddev", "SELECT round(stddev_samp(v), 4) AS std FROM series_h")
def agg_stddev(t: Tables):
    return t.series_h.agg(r(A.stat("std", "v")).alias("std"))


@query(
    "agg_quantile_linear",
    """SELECT event_type, round(quantile_cont(value, 0.1), 4) AS p10, round(quantile_cont(value, 0.95), 4) AS p95
       FROM events GROUP BY event_type""",
)
def agg_quantile_linear(t: Tables):
    # Raw records have no calendar bound.
    out = A.exact_quantiles(t.events, ["event_type"], "value", [0.1, 0.95])
    return out.select("event_type", r("`q0.1`").alias("p10"), r("`q0.95`").alias("p95"))


@query(
    "agg_quantile_unkeyed",
    "SELECT round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.999), 4) AS p999 FROM events",
)
def agg_quantile_unkeyed(t: Tables):
    out = A.exact_quantiles(t.events, [], "value", [0.5, 0.999])
    return out.select(r("`q0.5`").alias("p50"), r("`q0.999`").alias("p999"))


@query("agg_count_rows", "SELECT CAST(count(*) AS BIGINT) AS n FROM orders WHERE year(o_orderdate) = 1997")
def agg_count_rows(t: Tables):
    return S.period_slice(t.orders_t, "1997").agg(A.count_rows().alias("n"))


@query(
    "agg_count_if",
    """SELECT CAST(count(*) FILTER (WHERE v < 50) AS BIGINT) AS below, CAST(count(*) FILTER (WHERE v > 50) AS BIGINT) AS above
       FROM series_h""",
)
def agg_count_if(t: Tables):
    return t.series_h.agg(A.count_if("v", "<", 50.0).alias("below"), A.count_if("v", ">", 50.0).alias("above"))


@query(
    "agg_share_percent",
    "SELECT round(100.0 * count(*) FILTER (WHERE got_number > 25) / count(*), 4) AS share FROM runs_t",
)
def agg_share_percent(t: Tables):
    return t.runs.agg(r(A.share_percent("got_number", ">", 25.0)).alias("share"))


@query("agg_corr_pearson", "SELECT round(corr(got_number, total_s), 4) AS corr FROM runs_t")
def agg_corr_pearson(t: Tables):
    return t.runs.agg(r(A.corr_pearson("got_number", "total_s")).alias("corr"))


@query("group_by_hour_of_day", "SELECT CAST(hour(time) AS INT) AS hour, round(avg(v), 4) AS mean FROM series_h GROUP BY 1")
def group_by_hour_of_day(t: Tables):
    return R.group_by_hour_of_day(t.series_h, "v").select("hour", r("mean").alias("mean"))


@query(
    "arg_extreme_time",
    """SELECT event_type, strftime((arg_min(ts, (-value, ts))), '%Y-%m-%d %H:%M') AS largest_at,
         strftime((arg_min(ts, (value, ts))), '%Y-%m-%d %H:%M') AS smallest_at
       FROM events GROUP BY event_type""",
)
def arg_extreme_time(t: Tables):
    time, value = F.col("time"), A.masked("value")
    return t.ticks.groupBy("event_type").agg(
        A.arg_extreme(stamp("time"), value, time).alias("largest_at"),
        A.arg_extreme(stamp("time"), value, time, largest=False).alias("smallest_at"),
    )


@query(
    "period_difference",
    """SELECT round(avg(CASE WHEN year(o_orderdate) = 1999 THEN o_totalprice END)
         - avg(CASE WHEN year(o_orderdate) = 1997 THEN o_totalprice END), 3) AS difference FROM orders""",
)
def period_difference(t: Tables):
    return t.orders_t.agg(
        r(A.mean_difference("o_totalprice", S.in_period("1999"), S.in_period("1997")), 3).alias("difference")
    )


@query(
    "hour_difference",
    """SELECT round(avg(CASE WHEN hour(time) = 15 THEN v END) - avg(CASE WHEN hour(time) = 3 THEN v END), 4) AS difference
       FROM series_h""",
)
def hour_difference(t: Tables):
    return t.series_h.agg(r(A.mean_difference("v", S.at_hours(15), S.at_hours(3))).alias("difference"))


# ------------------------------------------------------------------------------- resampling
def day_spine(unit: str, last: str) -> str:
    return f"""SELECT CAST(range AS TIMESTAMP) AS bin FROM range(
      (SELECT min(date_trunc('{unit}', {last})) FROM orders), (SELECT max(date_trunc('{unit}', {last})) FROM orders) + INTERVAL 1 {unit},
      INTERVAL 1 {unit})"""


def resampled(unit: str, fmt: str, digits: int) -> str:
    return f"""SELECT strftime(bin, '{fmt}') AS bin, round(mean, {digits}) AS mean, round(coalesce(total, 0), 2) AS total,
          round(hi, 2) AS hi, round(lo, 2) AS lo
        FROM ({day_spine(unit, 'o_orderdate')}) LEFT JOIN (
          SELECT date_trunc('{unit}', o_orderdate) AS b, avg(o_totalprice) AS mean, sum(o_totalprice) AS total,
            max(o_totalprice) AS hi, min(o_totalprice) AS lo FROM orders GROUP BY 1) ON b = bin"""


FOUR = {
    "mean": ("o_totalprice", "mean"),
    "total": ("o_totalprice", "sum"),
    "hi": ("o_totalprice", "max"),
    "lo": ("o_totalprice", "min"),
}


def resample_orders(t: Tables, freq: str):
    out = R.resample(t.orders_t, freq, FOUR)
    return out.select(
        R.bin_id(F.col("bin"), freq).alias("bin"), r("mean", 6).alias("mean"), r("total", 2).alias("total"),
        r("hi", 2).alias("hi"), r("lo", 2).alias("lo"),
    )


@query("resample_daily", resampled("day", "%Y-%m-%d", 6))
def resample_daily(t: Tables):
    return resample_orders(t, "day")


@query("resample_monthly", resampled("month", "%Y-%m", 6))
def resample_monthly(t: Tables):
    return resample_orders(t, "month")


@query("resample_yearly", resampled("year", "%Y", 6))
def resample_yearly(t: Tables):
    return resample_orders(t, "year")


@query(
    "resample_fill_empty",
    """WITH d AS (SELECT o_custkey % 20 AS part, CAST(o_orderdate AS DATE) AS day, count(*) AS n, avg(o_totalprice) AS mean FROM orders GROUP BY 1, 2),
            s AS (SELECT part, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS bin FROM d GROUP BY 1)
       SELECT CAST(s.part AS BIGINT) AS part, strftime(bin, '%Y-%m-%d') AS bin, CAST(coalesce(n, 0) AS DOUBLE) AS total, mean IS NULL AS mean_missing
       FROM s LEFT JOIN d ON d.part = s.part AND d.day = CAST(s.bin AS DATE)""",
)
def resample_fill_empty(t: Tables):
    """All orders, as the daily series of twenty groups of customers: many of their days are empty."""
    rows = t.orders_t.withColumns({"one": F.lit(1.0), "part": (F.col("o_custkey") % 20).cast("long")})
    bins = R.resample(rows, "day", {"total": ("one", "sum"), "mean": ("o_totalprice", "mean")}, keys=["part"])
    return bins.select(
        "part", R.bin_id(F.col("bin"), "day").alias("bin"), "total", F.col("mean").isNull().alias("mean_missing")
    )


@query(
    "count_days_where",
    f"""SELECT CAST(count(*) FILTER (WHERE hi >= 400000) AS BIGINT) AS high_days,
          CAST(count(*) FILTER (WHERE lo < 20000) AS BIGINT) AS low_days,
          CAST(count(*) FILTER (WHERE coalesce(total, 0) < 500000) AS BIGINT) AS dry_days,
          CAST(count(*) FILTER (WHERE mean > 250000) AS BIGINT) AS mild_days
        FROM ({resampled('day', '%Y-%m-%d', 6)})""",
)
def count_days_where(t: Tables):
    days = R.resample(t.orders_t, "day", FOUR)
    test = lambda c, op, x: F.count_if(S.passes(c, op, x))
    return days.agg(
        test("hi", ">=", 400000.0).alias("high_days"),
        test("lo", "<", 20000.0).alias("low_days"),
        test("total", "<", 500000.0).alias("dry_days"),
        test("mean", ">", 250000.0).alias("mild_days"),
    )


@query(
    "mean_daily_range",
    """SELECT round(avg(hi - lo), 3) AS mean_range FROM (
         SELECT max(o_totalprice) AS hi, min(o_totalprice) AS lo FROM orders GROUP BY o_orderdate)""",
)
def mean_daily_range(t: Tables):
    return R.mean_daily_range(t.orders_t, "o_totalprice").select(r("mean_range", 3).alias("mean_range"))


def extreme(unit: str, fmt: str, value: str, desc: str) -> str:
    return f"""(SELECT strftime(b, '{fmt}') FROM (SELECT date_trunc('{unit}', time) AS b, {value} AS x FROM series_d GROUP BY 1)
               ORDER BY x {desc}, b LIMIT 1)"""


@query(
    "extreme_bin",
    f"""SELECT unnest(['day', 'month', 'month', 'year']) AS freq, unnest(['max mean', 'min sum', 'max sum', 'max mean']) AS what,
          unnest([{extreme('day', '%Y-%m-%d', 'avg(v)', 'DESC')}, {extreme('month', '%Y-%m', 'sum(s)', 'ASC')},
                  {extreme('month', '%Y-%m', 'sum(s)', 'DESC')}, {extreme('year', '%Y', 'avg(v)', 'DESC')}]) AS bin""",
)
def extreme_bin(t: Tables):
    wanted = (("day", "v", "mean", True), ("month", "s", "sum", False), ("month", "s", "sum", True), ("year", "v", "mean", True))
    parts = [
        R.extreme_bin(t.series_d, f, c, how, big).select(
            F.lit(f).alias("freq"), F.lit(f"{'max' if big else 'min'} {how}").alias("what"), "bin"
        )
        for f, c, how, big in wanted
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    "two_step_extreme_then_agg",
    """SELECT strftime(b, '%Y-%m') AS bin, round(m, 3) AS mean FROM (
         SELECT date_trunc('month', time) AS b, sum(s) AS total, avg(v) AS m FROM series_d WHERE year(time) = 2000 GROUP BY 1)
       ORDER BY total DESC, b LIMIT 1""",
)
def two_step_extreme_then_agg(t: Tables):
    rows = S.period_slice(t.series_d, "2000")
    return R.two_step_extreme_then_agg(rows, "month", "s", "v").select("bin", r("mean", 3).alias("mean"))


# ------------------------------------------------------------------------------- windows
@query(
    "rolling_sum_max",
    """SELECT round(max(x), 4) AS max_sum FROM (
         SELECT sum(v) OVER w AS x, count(v) OVER w AS n FROM series_h
         WINDOW w AS (ORDER BY time ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)) WHERE n = 24""",
)
def rolling_sum_max(t: Tables):
    return O.rolling_sum_max(t.series_h, "v", 24).select(r("max_sum").alias("max_sum"))


@query(
    "rolling_sum",
    """SELECT strftime(time, '%Y-%m-%d') AS day, CASE WHEN n = 24 THEN round(x, 2) END AS rolling_sum FROM (
         SELECT time, sum(s) OVER w AS x, count(s) OVER w AS n FROM series_d
         WINDOW w AS (ORDER BY time ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))""",
)
def rolling_sum(t: Tables):
    out = O.rolling_sum(t.series_d, "s", 24, block="year")
    return out.select(F.date_format("time", "yyyy-MM-dd").alias("day"), r("rolling_sum", 2).alias("rolling_sum"))


def runs_sql(table: str, test: str) -> str:
    return f"""SELECT CAST(coalesce(max(n), 0) AS BIGINT) AS longest_run FROM (
      SELECT island, count(*) FILTER (WHERE hit) AS n FROM (
        SELECT {test} AS hit, count(*) FILTER (WHERE NOT ({test})) OVER (ORDER BY time ROWS UNBOUNDED PRECEDING) AS island
        FROM {table}) GROUP BY island)"""


@query("longest_run", runs_sql("series_h", "v > 50"))
def longest_run(t: Tables):
    return O.longest_run(t.series_h, S.passes("v", ">", 50.0), block="day")


@query("longest_run_daily", runs_sql("series_d", "v > 200000"))
def longest_run_daily(t: Tables):
    return O.longest_run(t.series_d, S.passes("v", ">", 200000.0))


@query(
    "expected_vs_actual_times",
    f"""SELECT 'missing' AS side, strftime(day, '%Y-%m-%d') AS day FROM ({DAYS})
        WHERE day <= TIMESTAMP '2001-07-01' AND day NOT IN (SELECT time FROM series_d)
        UNION ALL SELECT 'unexpected', strftime(time, '%Y-%m-%d') FROM series_d WHERE time > TIMESTAMP '2001-07-01'""",
)
def expected_vs_actual_times(t: Tables):
    out = Q.expected_vs_actual(t.orders_t, FIRST, "2001-07-01", "day")
    return out.select("side", F.date_format("time", "yyyy-MM-dd").alias("day"))


# ------------------------------------------------------------------------------- conversions, ids
@query(
    "series_unit_conversions",
    """SELECT round(avg(wind_speed_10m) / 3.6, 4) AS wind_ms, round(avg(temperature_2m) + 273.15, 4) AS temp_k,
         round(max(temperature_2m) * 9 / 5 + 32, 4) AS temp_f, round(avg(surface_pressure) * 100, 2) AS press_pa,
         round(sum(precipitation) / 10, 4) AS precip_cm FROM weather""",
)
def series_unit_conversions(t: Tables):
    means = t.weather.agg(
        A.stat("mean", "wind_speed_10m").alias("wind_ms"),
        A.stat("mean", "temperature_2m").alias("temp_k"),
        A.stat("max", "temperature_2m").alias("temp_f"),
        A.stat("mean", "surface_pressure").alias("press_pa"),
        A.stat("sum", "precipitation").alias("precip_cm"),
    )
    names = dict(zip(("wind_ms", "temp_k", "temp_f", "press_pa", "precip_cm"), SERIES_CONVERSIONS))
    return means.select(
        *[r(convert_result(F.col(n), *pair), 2 if n == "press_pa" else 4).alias(n) for n, pair in names.items()]
    )


@query(
    "month_day_ids",
    """SELECT event_id, strftime(ts, '%Y-%m') AS month_id, strftime(ts, '%Y-%m-%d') AS day_id,
         strftime(ts, '%Y-%m-%d %H:%M') AS hour_id FROM events""",
)
def month_day_ids(t: Tables):
    return t.ticks.select(
        "event_id", *[R.bin_id(F.col("time"), f).alias(f"{f}_id") for f in ("month", "day", "hour")]
    )


# ------------------------------------------------------------------------------- the catalogue
def weather_where(lo: str, hi: str) -> str:
    return f"time >= TIMESTAMP '{lo}' AND time < TIMESTAMP '{hi}'"


def year(y: int) -> str:
    return weather_where(f"{y}-01-01", f"{y + 1}-01-01")


TE, HU, PR, WI, PS = "temperature_2m", "relative_humidity_2m", "precipitation", "wind_speed_10m", "surface_pressure"


def scalar(expr: str, where: str = "true", table: str = "weather") -> tuple[str, bool]:
    return f"SELECT CAST({expr} AS DOUBLE) FROM {table} WHERE {where}", False


def binned(unit: str, fmt: str, value: str, desc: str, where: str = "true") -> tuple[str, bool]:
    return (
        f"SELECT strftime(b, '{fmt}') FROM (SELECT date_trunc('{unit}', time) AS b, {value} AS x FROM weather "
        f"WHERE {where} GROUP BY 1) ORDER BY x {desc}, b LIMIT 1",
        True,
    )


def filled(unit: str, value: str, where: str) -> str:
    """Bins of a slice with the empty ones between its first and last bin as zero."""
    return (
        f"SELECT CAST(r.range AS TIMESTAMP) AS b, coalesce(x, 0) AS x FROM range("
        f"(SELECT min(date_trunc('{unit}', time)) FROM weather WHERE {where}), "
        f"(SELECT max(date_trunc('{unit}', time)) FROM weather WHERE {where}) + INTERVAL 1 {unit}, INTERVAL 1 {unit}) r "
        f"LEFT JOIN (SELECT date_trunc('{unit}', time) AS d, {value} AS x FROM weather WHERE {where} GROUP BY 1) ON d = r.range"
    )


def days(value: str, test: str, where: str) -> tuple[str, bool]:
    return scalar(f"count(*) FILTER (WHERE {test})", table=f"({filled('day', value, where)})")[0], False


TRUTH_SQL: dict[str, tuple[str, bool]] = {
    "mean_temp_2023": scalar(f"avg({TE})", year(2023)),
    "max_temp_all": scalar(f"max({TE})"),
    "min_temp_all": scalar(f"min({TE})"),
    "median_temp_2023": scalar(f"median({TE})", year(2023)),
    "std_temp_2023": scalar(f"stddev_samp({TE})", year(2023)),
    "p95_temp_2023": scalar(f"quantile_cont({TE}, 0.95)", year(2023)),
    "p10_temp_2022": scalar(f"quantile_cont({TE}, 0.1)", year(2022)),
    "mean_humidity_2024": scalar(f"avg({HU})", year(2024)),
    "mean_pressure_2023": scalar(f"avg({PS})", year(2023)),
    "total_precip_2022": scalar(f"sum({PR})", year(2022)),
    "total_precip_all": scalar(f"sum({PR})"),
    "mean_wind_2021": scalar(f"avg({WI})", year(2021)),
    "mean_wind_2023_ms": scalar(f"avg({WI}) / 3.6", year(2023)),
    "mean_temp_2023_kelvin": scalar(f"avg({TE}) + 273.15", year(2023)),
    "max_temp_2020_fahrenheit": scalar(f"max({TE}) * 9 / 5 + 32", year(2020)),
    "mean_pressure_2022_pa": scalar(f"avg({PS}) * 100", year(2022)),
    "total_precip_2023_cm": scalar(f"sum({PR}) / 10", year(2023)),
    "mean_temp_summer_2023": scalar(f"avg({TE})", weather_where("2023-06-01", "2023-09-01")),
    "mean_temp_winter_2022_23": scalar(f"avg({TE})", weather_where("2022-12-01", "2023-03-01")),
    "mean_temp_first_week_2023": scalar(f"avg({TE})", weather_where("2023-01-01", "2023-01-08")),
    "mean_temp_leap_day_2024": scalar(f"avg({TE})", weather_where("2024-02-29", "2024-03-01")),
    "hours_in_2023": scalar("count(*)", year(2023)),
    "mean_temp_july_nights_2023": scalar(
        f"avg({TE})", weather_where("2023-07-01", "2023-08-01") + " AND (hour(time) >= 22 OR hour(time) <= 4)"
    ),
    "mean_temp_hour3_2023": scalar(f"avg({TE})", year(2023) + " AND hour(time) = 3"),
    "diurnal_range_2023": scalar(
        f"avg(CASE WHEN hour(time) = 15 THEN {TE} END) - avg(CASE WHEN hour(time) = 3 THEN {TE} END)", year(2023)
    ),
    "warmest_month_2023": binned("month", "%Y-%m", f"avg({TE})", "DESC", year(2023)),
    "coldest_month_all": binned("month", "%Y-%m", f"avg({TE})", "ASC"),
    "driest_month_2023": binned("month", "%Y-%m", f"sum({PR})", "ASC", year(2023)),
    "wettest_month_all": binned("month", "%Y-%m", f"sum({PR})", "DESC"),
    "most_humid_month_2023": binned("month", "%Y-%m", f"avg({HU})", "DESC", year(2023)),
    "warmest_year": binned("year", "%Y", f"avg({TE})", "DESC"),
    "warmest_day_2023": binned("day", "%Y-%m-%d", f"avg({TE})", "DESC", year(2023)),
    "coldest_day_2021": binned("day", "%Y-%m-%d", f"avg({TE})", "ASC", year(2021)),
    "windiest_day_2023": binned("day", "%Y-%m-%d", f"avg({WI})", "DESC", year(2023)),
    "hottest_hour_timestamp_2022": (
        f"SELECT strftime(time, '%Y-%m-%d %H:%M') FROM weather WHERE {year(2022)} ORDER BY {TE} DESC, time LIMIT 1", True,
    ),
    "july_2023_precip": scalar(f"sum({PR})", weather_where("2023-07-01", "2023-08-01")),
    "mean_daily_range_2023": scalar(
        "avg(x)", table=f"(SELECT max({TE}) - min({TE}) AS x FROM weather WHERE {year(2023)} GROUP BY date_trunc('day', time))"
    ),
    "max_24h_precip_2023": scalar(
        "max(x)", "n = 24",
        f"(SELECT sum({PR}) OVER w AS x, count(*) OVER w AS n FROM weather WHERE {year(2023)} "
        "WINDOW w AS (ORDER BY time ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))",
    ),
    "warmest_hour_of_day_2023": (
        f"SELECT CAST(h AS VARCHAR) FROM (SELECT hour(time) AS h, avg({TE}) AS x FROM weather WHERE {year(2023)} GROUP BY 1) "
        "ORDER BY x DESC, h LIMIT 1", True,
    ),
    "frost_hours_2023": scalar(f"count(*) FILTER (WHERE {TE} < 0)", year(2023)),
    "summer_days_2023": days(f"max({TE})", "x >= 25", year(2023)),
    "frost_days_2021": days(f"min({TE})", "x < 0", year(2021)),
    "wet_hours_2022": scalar(f"count(*) FILTER (WHERE {PR} > 0)", year(2022)),
    "dry_days_2023": days(f"sum({PR})", "x < 0.1", year(2023)),
    "mild_days_2023": days(f"avg({TE})", "x > 20", year(2023)),
    "humid_hours_share_2023": scalar(f"100.0 * count(*) FILTER (WHERE {HU} > 90) / count(*)", year(2023)),
    "longest_hot_streak_2023": (
        f"SELECT CAST(longest_run AS DOUBLE) FROM ({runs_sql(f'(SELECT * FROM weather WHERE {year(2023)})', f'{TE} > 25')})", False,
    ),
    "temp_change_2021_2023": scalar(
        f"avg(CASE WHEN year(time) = 2023 THEN {TE} END) - avg(CASE WHEN year(time) = 2021 THEN {TE} END)"
    ),
    "pressure_diff_jan_jul_2023": scalar(
        f"avg(CASE WHEN month(time) = 1 THEN {PS} END) - avg(CASE WHEN month(time) = 7 THEN {PS} END)", year(2023)
    ),
    "temp_humidity_correlation_2023": scalar(f"corr({TE}, {HU})", year(2023)),
    "mean_temp_wettest_month_2023": (
        f"SELECT m FROM (SELECT date_trunc('month', time) AS b, sum({PR}) AS x, avg({TE}) AS m FROM weather "
        f"WHERE {year(2023)} GROUP BY 1) ORDER BY x DESC, b LIMIT 1", False,
    ),
}


def catalogue_sql() -> str:
    parts = []
    for q in QUESTIONS:
        sql, is_text = TRUTH_SQL.get(q.id, ("SELECT 'not answerable'", True))
        reaches = getattr(q.truth, "unless", None) and not q.truth.place  # answered where the series reaches that far
        if reaches:
            mean = scalar(f"avg({TE})", year(2026))[0]
            sql = f"CASE WHEN ({mean}) IS NULL THEN 'not answerable' END"
        num, text = ("CAST(NULL AS DOUBLE)", f"({sql})") if is_text else (f"round(({sql}), 4) + 0.0", "CAST(NULL AS VARCHAR)")
        if reaches:
            num = f"round(({mean}), 4) + 0.0"
        parts.append(f"SELECT '{q.id}' AS question_id, {num} AS value_num, {text} AS value_text, 'ok' AS status")
    return "\nUNION ALL ".join(parts)


@query("batch_scalar_truths", catalogue_sql())
def batch_scalar_truths(t: Tables):
    """All 56 questions of the catalogue over the derived hourly series."""
    out = truths(t.weather)
    return out.select("question_id", r("value_num").alias("value_num"), "value_text", "status")


@query(
    "truths_of_published",
    f"""SELECT place, question_id, CASE WHEN place = 'Berlin' OR question_id = 'mean_temp_2023' THEN round(m, 4) + 0.0 END AS value_num,
          CASE WHEN place <> 'Berlin' AND question_id = 'berlin_temperature' THEN 'not answerable' END AS value_text
        FROM (SELECT avg({TE}) AS m FROM weather WHERE {year(2023)}),
          (SELECT unnest(['Berlin', 'Oslo']) AS place), (SELECT unnest(['berlin_temperature', 'mean_temp_2023']) AS question_id)""",
)
def truths_of_published(t: Tables):
    """Whether the series is of the place a question asks about is told by its manifest."""
    hours = R.fill_bins(t.weather, "hour", column="time").where(F.year("time") == 2023)
    asked = [BY_ID["berlin_temperature"], BY_ID["mean_temp_2023"]]
    found = None
    for place in ("Berlin", "Oslo"):
        path = t.fresh("weather")
        src.write_series_validated(hours, path, {}, "2023-01-01", "2023-12-31", request={"place": place})
        told = published_truths(t.spark, path, questions=asked).withColumn("place", F.lit(place))
        found = told if found is None else found.unionByName(told)
    return found.select("place", "question_id", r("value_num").alias("value_num"), "value_text")
