"""Explicit schemas.  Readers never infer."""

from __future__ import annotations

from pyspark.sql import types as T

TEMP = "temperature_2m"
HUM = "relative_humidity_2m"
PRECIP = "precipitation"
WIND = "wind_speed_10m"
PRESS = "surface_pressure"

# The measures of the hourly series and the units they are recorded in.
MEASURES = (TEMP, HUM, PRECIP, WIND, PRESS)
MEASURE_UNITS = {TEMP: "°C", HUM: "%", PRECIP: "mm", WIND: "km/h", PRESS: "hPa"}

SERIES = T.StructType(
    [T.StructField("time", T.TimestampType())] + [T.StructField(m, T.DoubleType()) for m in MEASURES]
)


def payload_schema(variables: tuple[str, ...] = MEASURES) -> T.StructType:
    """One landed document: parallel arrays under ``hourly`` plus units and the grid cell."""
    arrays = [T.StructField("time", T.ArrayType(T.StringType()))]
    arrays += [T.StructField(v, T.ArrayType(T.DoubleType())) for v in variables]
    units = [T.StructField(v, T.StringType()) for v in ("time", *variables)]
    return T.StructType(
        [
            T.StructField("latitude", T.DoubleType()),
            T.StructField("longitude", T.DoubleType()),
            T.StructField("elevation", T.DoubleType()),
            T.StructField("timezone", T.StringType()),
            T.StructField("hourly_units", T.StructType(units)),
            T.StructField("hourly", T.StructType(arrays)),
        ]
    )


MANIFEST = T.StructType(
    [
        T.StructField("timezone", T.StringType()),
        T.StructField("variables", T.MapType(T.StringType(), T.StringType())),
        T.StructField("time_range", T.ArrayType(T.TimestampType())),
        T.StructField("rows", T.LongType()),
        T.StructField("expected_rows", T.LongType()),
        T.StructField("nan_counts", T.MapType(T.StringType(), T.LongType())),
        T.StructField("content_sha256", T.StringType()),
        T.StructField("version", T.LongType()),
        T.StructField("folder", T.StringType()),
        T.StructField("request", T.MapType(T.StringType(), T.StringType())),
    ]
)

COUNTER = T.MapType(T.StringType(), T.LongType())

REJECTED = T.ArrayType(
    T.StructType(
        [
            T.StructField("value", T.StringType()),
            T.StructField("unit", T.StringType()),
            T.StructField("was_correct", T.BooleanType()),
            T.StructField("failed_checks", T.ArrayType(T.StringType())),
        ]
    )
)

_RUN_FIELDS: list[tuple[str, T.DataType]] = [
    ("config", T.StringType()),
    ("question_id", T.StringType()),
    ("run_index", T.LongType()),
    ("category", T.StringType()),
    ("difficulty", T.StringType()),
    ("correct", T.BooleanType()),
    ("reason", T.StringType()),
    ("expected", T.VariantType()),
    ("got", T.VariantType()),
    ("raw_value", T.VariantType()),
    ("got_number", T.DoubleType()),
    ("answer_key", T.StringType()),
    ("unit_converted", T.BooleanType()),
    ("answer_unit", T.StringType()),
    ("stop_reason", T.StringType()),
    ("plan_status", T.StringType()),
    ("turns", T.IntegerType()),
    ("tool_status_counts", COUNTER),
    ("sandbox_violations", COUNTER),
    ("sandbox_limits", COUNTER),
    ("rejected_answers", REJECTED),
    ("input_tokens", T.LongType()),
    ("output_tokens", T.LongType()),
    ("total_s", T.DoubleType()),
    ("model", T.StringType()),
    ("error", T.StringType()),
]

# As stored: expected, got and raw_value are a number or a text, so they are read as VARIANT.
RUNS_STORED = T.StructType([T.StructField(n, t) for n, t in _RUN_FIELDS])
RUN_KEY = ["config", "question_id", "run_index"]

_ANSWER = T.StructType(
    [
        T.StructField("value", T.VariantType()),
        T.StructField("unit", T.StringType()),
        T.StructField("method_summary", T.StringType()),
    ]
)

_CHECK = T.StructType([T.StructField(n, T.StringType()) for n in ("name", "status", "detail")])

_EXECUTION = T.StructType(
    [
        T.StructField("status", T.StringType()),
        T.StructField("violations", T.ArrayType(T.StructType([T.StructField("kind", T.StringType())]))),
        T.StructField("limits_hit", T.ArrayType(T.StringType())),
    ]
)

# The stored document of one run, reduced to the parts the operators read.
TRACE = T.StructType(
    [
        T.StructField("question", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("plan_status", T.StringType()),
        T.StructField("stop_reason", T.StringType()),
        T.StructField("turns", T.IntegerType()),
        T.StructField("total_s", T.DoubleType()),
        T.StructField("error", T.StringType()),
        T.StructField("answer", _ANSWER),
        T.StructField("plan", T.StructType([T.StructField("interpretation", T.StringType())])),
        T.StructField(
            "tool_calls",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("tool", T.StringType()),
                        T.StructField("status", T.StringType()),
                        T.StructField("raw_arguments", T.StringType()),
                        T.StructField("sandbox", _EXECUTION),
                    ]
                )
            ),
        ),
        T.StructField(
            "llm_calls",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("purpose", T.StringType()),
                        T.StructField("input_tokens", T.LongType()),
                        T.StructField("output_tokens", T.LongType()),
                    ]
                )
            ),
        ),
        T.StructField(
            "verifications",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("ok", T.BooleanType()),
                        T.StructField("answer", _ANSWER),
                        T.StructField(
                            "verdict", T.StructType([T.StructField("checks", T.ArrayType(_CHECK))])
                        ),
                    ]
                )
            ),
        ),
    ]
)

# The states the stored records may hold.
TOOL_STATES = ("ok", "unknown_tool", "invalid_json", "schema_violation", "rule_violation", "execution_error")
PLAN_STATES = ("ok", "invalid_json", "schema_violation", "rule_violation", "llm_error", "setup_error")
CHECK_STATES = ("pass", "fail", "warn", "skip")
