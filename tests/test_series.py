"""Catalogue truths, bins, order-dependent operators and quantiles against plain pandas."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregates as A
from tidemark.operators import ordered as O
from tidemark.operators import resample as R
from tidemark.operators import slices as S
from tidemark.plans import catalogue as C
from tidemark.schemas import HUM, MEASURES, PRECIP, PRESS, TEMP, WIND


def hourly_frame() -> pd.DataFrame:
    """Five years of hours with season, daily cycle, wet hours, one gap and missing values."""
    index = pd.date_range("2020-01-01", "2024-12-31 23:00", freq="h", name="time")
    n = np.arange(len(index))
    rng = np.random.default_rng(11)
    frame = pd.DataFrame(
        {
            TEMP: 9 - 12 * np.cos(n / 8766 * 2 * np.pi) - 4 * np.cos((n % 24 - 3) / 24 * 2 * np.pi) + rng.normal(0, 3, len(n)),
            HUM: rng.uniform(30, 100, len(n)),
            PRECIP: np.where(rng.random(len(n)) < 0.1, rng.integers(1, 40, len(n)) / 8, 0.0),
            WIND: rng.gamma(2, 5, len(n)),
            PRESS: rng.normal(960, 8, len(n)),
        },
        index=index,
    )
    frame.iloc[rng.integers(0, len(n), 50), 0] = np.nan
    gap = (index >= "2023-02-10") & (index < "2023-02-13")
    return frame[~gap]


def window(frame: pd.DataFrame, where: C.Slice) -> pd.DataFrame:
    if where.bounds():
        lo, hi = where.bounds()
        frame = frame[(frame.index >= lo) & (frame.index < hi)]
    return frame[frame.index.hour.isin(where.hours)] if where.hours else frame


def expected(frame: pd.DataFrame, q: C.Question):
    """The truth of a question, read off its definition."""
    t = q.truth
    if isinstance(t, C.Unanswerable):
        return "not answerable"
    rows = window(frame, t.where)
    column = rows[t.column] if t.column else None
    if isinstance(t, C.Direct):
        tests = {"<": lambda x: x < t.bound, ">": lambda x: x > t.bound}
        how = {
            "rows": lambda: len(rows),
            "count": lambda: tests[t.op](column).sum(),
            "share": lambda: tests[t.op](column).mean() * 100,
            "argmax": lambda: column.idxmax().strftime("%Y-%m-%d %H:%M"),
            "corr": lambda: column.corr(rows[t.other]),
        }.get(t.how) or (lambda: column.quantile(float(t.how[1:])) if t.how[0] == "q" else getattr(column, t.how)())
        value = how()
        if t.minus:
            value -= window(frame, t.minus)[t.column].mean()
        scale = {"m/s": lambda x: x / 3.6, "K": lambda x: x + 273.15, "°F": lambda x: x * 1.8 + 32, "Pa": lambda x: x * 100, "cm": lambda x: x / 10}
        return scale.get(q.unit, lambda x: x)(value)
    if isinstance(t, C.Rolling):
        return column.rolling(t.size).sum().max()
    if isinstance(t, C.Run):
        best = current = 0
        for hit in column > t.bound:
            current = current + 1 if hit else 0
            best = max(best, current)
        return best
    if isinstance(t, C.HourOfDay):
        return str(column.groupby(column.index.hour).mean().idxmax())
    freq = {"day": "D", "month": "MS", "year": "YS"}[t.freq]
    bins = column.resample(freq)
    values = bins.max() - bins.min() if t.how == "range" else getattr(bins, t.how)()
    if t.pick == "count":
        return {">=": values >= t.bound, "<": values < t.bound, ">": values > t.bound}[t.op].sum()
    if t.pick == "mean":
        return values.mean()
    best = values.idxmin() if t.pick == "min" else values.idxmax()
    if t.pick == "then":
        return rows[rows.index.to_period("M") == best.to_period("M")][t.then_mean_of].mean()
    return best.strftime({"day": "%Y-%m-%d", "month": "%Y-%m", "year": "%Y"}[t.freq])


@pytest.fixture(scope="module")
def frame():
    return hourly_frame()


@pytest.fixture(scope="module")
def series(spark, frame):
    return spark.createDataFrame(frame.reset_index())


def test_every_question_of_the_catalogue(series, frame):
    got = {r["question_id"]: r for r in C.truths(series).collect()}
    assert len(C.QUESTIONS) == 56 and set(got) == {q.id for q in C.QUESTIONS}
    for q in C.QUESTIONS:
        want, row = expected(frame, q), got[q.id]
        if isinstance(want, str):
            assert row["value_text"] == want, q.id
        else:
            assert row["value_num"] == pytest.approx(want, abs=1e-6), q.id


def test_a_missing_column_does_not_hide_other_questions(series):
    got = {r["question_id"]: r for r in C.truths(series.drop(HUM), [C.BY_ID["mean_humidity_2024"], C.BY_ID["mean_temp_2023"]]).collect()}
    assert got["mean_humidity_2024"]["status"].startswith("missing column") and got["mean_temp_2023"]["value_num"] is not None


def test_many_series_at_once_equal_each_alone(spark, series):
    two = series.withColumn("station", F.lit("a")).unionByName(
        series.withColumn(TEMP, F.col(TEMP) + 1).withColumn("station", F.lit("b"))
    )
    ids = [C.BY_ID[i] for i in ("mean_temp_2023", "warmest_month_2023", "dry_days_2023", "longest_hot_streak_2023", "max_24h_precip_2023")]
    rows = C.truths(two, ids, keys=["station"]).collect()
    alone = {r["question_id"]: r for r in C.truths(series, ids).collect()}
    for r in rows:
        if r["station"] == "a":
            assert r["value_text"] == alone[r["question_id"]]["value_text"]
            if r["value_num"] is not None:
                assert r["value_num"] == pytest.approx(alone[r["question_id"]]["value_num"])
    assert len(rows) == 10


def test_periods_are_half_open_and_pushed_down(spark, series, tmp_path):
    assert S.period_bounds("2024-02") == ("2024-02-01 00:00:00", "2024-03-01 00:00:00")
    assert S.period_bounds("2023-12") == ("2023-12-01 00:00:00", "2024-01-01 00:00:00")
    path = str(tmp_path / "s")
    series.write.parquet(path)
    plan = S.period_slice(spark.read.parquet(path), "2023").select(TEMP)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(time" in plan and "LessThan(time" in plan
    assert HUM not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize("block,records", [("day", 24), ("month", 100), ("year", 7), ("day", 100_000)])
def test_blocked_windows_equal_one_window(spark, frame, block, records):
    part = frame[:3000].copy()
    part = part[np.random.default_rng(5).random(len(part)) < 0.3]
    df = spark.createDataFrame(part.reset_index())
    want = part[TEMP].rolling(24).sum()
    got = O.rolling_sum(df, TEMP, 24, block=block, records=records).toPandas().set_index("time")["rolling_sum"].sort_index()
    np.testing.assert_allclose(got.to_numpy(dtype=float), want.to_numpy(), rtol=1e-9)
    best = current = 0
    for hit in part[TEMP] > 0:
        current = current + 1 if hit else 0
        best = max(best, current)
    run = O.longest_run(df, S.passes(TEMP, ">", 0.0), block=block).first()["longest_run"]
    assert run == best


@pytest.mark.parametrize("bits", ["", "0", "1", "1111111", "0110111011110", "1110011111", "0000", "11111000001111111"])
def test_longest_run_across_blocks(spark, bits):
    rows = [((pd.Timestamp("2024-01-01") + pd.Timedelta(hours=13 * i)).to_pydatetime(), float(b)) for i, b in enumerate(bits)]
    df = spark.createDataFrame(rows, "time timestamp, x double")
    got = O.longest_run(df, F.col("x") > 0, block="day").first()
    assert (got["longest_run"] if got else 0) == max((len(x) for x in bits.split("0")), default=0)


@pytest.mark.parametrize("records", [2, 3, 1000])
def test_unsorted_check_and_running_count(spark, records):
    times = [1, 2, 2, 5, 4, 6, 6, 3, 7, 8, 0]
    df = spark.createDataFrame([(i * 2, t, "k") for i, t in enumerate(times)], "p long, time long, k string")
    row = O.unsorted_check(df, "p", records=records).first()
    assert row["out_of_order"] == 3 and not row["is_sorted"]
    rows = O.running_count(df, F.col("time") > 4, "p", ["k"], records=records).orderBy("p").collect()
    assert [r["running"] for r in rows] == list(np.cumsum([t > 4 for t in times]))


def test_exact_quantiles_equal_linear_interpolation(spark):
    rng = np.random.default_rng(3)
    groups = {
        "hot": rng.normal(0, 1, 4000),
        "ties": rng.integers(0, 4, 900).astype(float),
        "one": np.array([7.0]),
        "two": np.array([1.0, 2.0]),
        "wide": np.concatenate([-(10.0 ** rng.uniform(-300, 300, 300)), [0.0, 0.0], 10.0 ** rng.uniform(-300, 300, 300)]),
        "close": 1e6 + np.arange(3000) * 2.0**-33,
        None: np.array([3.0, 4.0]),
    }
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("hot", None), ("hot", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    qs = [0.0, 0.1, 0.5, 0.95, 1.0]
    out = {r["k"]: r for r in A.exact_quantiles(df, ["k"], "v", qs).collect()}
    assert set(out) == set(groups)
    for k, vs in groups.items():
        for q in qs:
            assert out[k][f"q{q:g}"] == pytest.approx(np.quantile(vs, q)), (k, q)
    whole = A.exact_quantiles(df, [], "v", [0.5])
    assert whole.first()[0] == pytest.approx(np.quantile(np.concatenate(list(groups.values())), 0.5))
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert A.exact_quantiles(df.where("false"), [], "v", [0.5]).count() == 0


def test_empty_bins_and_empty_sum(spark):
    day = dt.datetime
    rows = [(day(2024, 1, 30), 1.0), (day(2024, 2, 2, 5), 2.0), (day(2024, 2, 2, 6), None)]
    df = spark.createDataFrame(rows, "time timestamp, x double")
    out = R.resample(df, "day", {"s": ("x", "sum"), "m": ("x", "mean")}).orderBy("bin").collect()
    assert [(r["s"], r["m"]) for r in out] == [(1.0, 1.0), (0.0, None), (0.0, None), (2.0, 2.0)]
    assert df.where("false").agg(A.stat("sum", "x").alias("s")).first()["s"] == 0.0
    driest = R.extreme_bin(df, "day", "x", "sum", largest=False).first()["bin"]
    assert driest == "2024-01-31"
    with pytest.raises(ValueError):
        R.resample(df, "day", {"s": ("x", "mode")})


def test_rank_limit_runs_before_the_shuffle(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 3)
    plan = O.first_per_group(df, ["k"], [F.col("id")], 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


