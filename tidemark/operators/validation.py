"""Validation of recorded JSON: tool calls, plans, execution outcomes, code policy.

A record ends in exactly one state.  Wrong fields or JSON types are schema violations and outrank
rule violations (blank code, non-finite values, length limits).  Records are parsed to VARIANT once;
every rule is a column expression.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, strip
from .slices import computed_once

# Limits and texts of the record rules.
MAX_CODE = 20_000
MAX_SUMMARY = 500
MAX_TEXT_VALUE = 100
TOOLS = ("describe_dataset", "run_python", "submit_answer")
REQUIRED = "Field required"
FORBIDDEN = "Extra inputs are not permitted"
NOT_STRING = "Input should be a valid string"
NOT_NUMBER = "Input should be a valid number"
NOT_LIST = "Input should be a valid list"
NOT_BOOL = "Input should be a valid boolean"
NOT_OBJECT = "Input should be a valid dictionary or object"
NOT_STEP = "Input should be a valid dictionary or instance of PlanStep"
NOT_TOOL = "Input should be " + " or ".join([", ".join(f"'{t}'" for t in TOOLS[:-1]), f"'{TOOLS[-1]}'"])
TRUE_FALSE_WORDS = ("0", "off", "f", "false", "n", "no", "1", "on", "t", "true", "y", "yes")
NUMERIC = r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$"


def parse_lenient(raw: Column) -> Column:
    """JSON text to VARIANT, NULL if it is not JSON.

    NaN and Infinity tokens are accepted: where strict parsing fails they are rewritten to a
    numeral that overflows to infinity, which the finite-value rule then rejects.
    """
    token = r"([:\[,]\s*|^\s*)(-?)(?:NaN|Infinity)(?=\s*[,}\]]|\s*\z)"
    rewritten = F.regexp_replace(raw, token, "$1$2" + "1e999")
    has_token = raw.rlike("NaN|Infinity")
    return F.coalesce(F.try_parse_json(raw), F.when(has_token, F.try_parse_json(rewritten)))


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(_kind(v).startswith(kind) if kind in ("OBJECT", "ARRAY") else _kind(v) == kind, F.lit(False))


def _null(v: Column) -> Column:
    return v.isNull() | _is(v, "VOID")


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _error(level: str, path: Column | str, message: str) -> Column:
    where = F.lit(path) if isinstance(path, str) else path
    return F.struct(F.lit(level).alias("level"), where.alias("path"), F.lit(message).alias("message"))


def _when(condition: Column, level: str, path: Column | str, message: str) -> Column:
    error = _error(level, path, message)
    return F.when(F.coalesce(condition, F.lit(False)), error)


def _fields(root: str) -> Column:
    return F.try_variant_get(F.col(root), "$", "map<string,variant>")


def _has(fields: Column, name: str) -> Column:
    return F.coalesce(F.map_contains_key(fields, name), F.lit(False))


def _get(fields: Column, name: str) -> Column:
    return F.try_element_at(fields, F.lit(name))


def _shape(fields: Column, names: Sequence[str], prefix: str = "") -> list[Column]:
    """Missing required fields, as errors."""
    return [_when(~_has(fields, n), "schema", prefix + n, REQUIRED) for n in names]


def _extras(fields: Column, names: Sequence[str]) -> Column:
    """One error per field that is not allowed (empty names mean any field is too much)."""
    keys = F.coalesce(F.map_keys(fields), F.array().cast("array<string>"))
    bad = F.filter(keys, lambda k: ~k.isin(*names)) if names else keys
    return F.transform(
        bad, lambda k: F.struct(F.lit("schema").alias("level"), k.alias("path"), F.lit(FORBIDDEN).alias("message"))
    )


def _length(fields: Column, name: str, least: int, most: int) -> list[Column]:
    """A required string with a length between two limits."""
    v = _get(fields, name)
    s = _text(v)
    ok = _is(v, "STRING")
    many = "" if least == 1 else "s"
    return [
        _when(_has(fields, name) & ~ok, "schema", name, NOT_STRING),
        _when(ok & (F.length(s) < least), "rule", name, f"String should have at least {least} character{many}"),
        _when(ok & (F.length(s) > most), "rule", name, f"String should have at most {most} characters"),
    ]


def _run_python(f: Column) -> list[Column]:
    code = _get(f, "code")
    blank = _is(code, "STRING") & (F.length(_text(code)).between(1, MAX_CODE)) & is_blank(_text(code))
    return [
        *_shape(f, ("code",)),
        *_length(f, "code", 1, MAX_CODE),
        _when(blank, "rule", "code", "Value error, code is empty or whitespace only"),
    ]


def _submit_answer(f: Column) -> list[Column]:
    value, unit = _get(f, "value"), _get(f, "unit")
    kind = _kind(value)
    number = kind.rlike(NUMERIC) | (kind == "BOOLEAN")
    has = _has(f, "value")
    text = strip(_text(value))
    as_double = F.try_variant_get(value, "$", "double")
    infinite = kind.rlike(NUMERIC) & (as_double.isNull() | F.isnan(as_double) | (F.abs(as_double) == float("inf")))
    bad_type = has & ~F.coalesce(number | (kind == "STRING"), F.lit(False))
    is_text = kind == "STRING"
    unit_text = _is(unit, "STRING")
    return [
        *_shape(f, ("value", "unit", "method_summary")),
        _when(bad_type, "schema", "value.float", NOT_NUMBER),
        _when(bad_type, "schema", "value.str", NOT_STRING),
        _when(infinite, "rule", "value", "Value error, value must be a finite number, not NaN or infinity"),
        _when(is_text & (text == ""), "rule", "value", "Value error, value is an empty string"),
        _when(
            is_text & (F.length(text) > MAX_TEXT_VALUE), "rule", "value",
            f"Value error, text value is longer than {MAX_TEXT_VALUE} characters; give a short answer",
        ),
        _when(_has(f, "unit") & ~_null(unit) & ~unit_text, "schema", "unit", NOT_STRING),
        _when(
            unit_text & is_blank(_text(unit)), "rule", "unit",
            "Value error, unit is an empty string; use null for values without a unit",
        ),
        *_length(f, "method_summary", 1, MAX_SUMMARY),
    ]


def _collect(errors: list[Column], extras: Column) -> Column:
    found = F.array_compact(F.array(*errors)) if errors else F.array().cast("array<struct<level:string,path:string,message:string>>")
    return F.concat(found, extras)


def _with_errors(df: DataFrame, errors: Column, known: Column) -> DataFrame:
    not_object = F.array(
        F.struct(F.lit("schema").alias("level"), F.lit("(arguments)").alias("path"), F.lit(NOT_OBJECT).alias("message"))
    )
    none = F.expr("array()").cast("array<struct<level:string,path:string,message:string>>")
    decided = (
        F.when(~known | F.col("_doc").isNull(), none).when(~_is(F.col("_doc"), "OBJECT"), not_object).otherwise(errors)
    )
    return computed_once(df, "errors", decided)


def _status(known: Column) -> Column:
    return (
        F.when(~known, F.lit("unknown_tool"))
        .when(F.col("_doc").isNull(), F.lit("invalid_json"))
        .when(F.exists("errors", lambda e: e["level"] == "schema"), F.lit("schema_violation"))
        .when(F.size("errors") > 0, F.lit("rule_violation"))
        .otherwise(F.lit("ok"))
    )


def validate_tool_calls(calls: DataFrame, tool: str = "tool", raw: str = "raw_arguments") -> DataFrame:
    """Add ``status`` and ``errors`` to recorded calls."""
    text = F.when(F.coalesce(F.length(F.col(raw)), F.lit(0)) == 0, F.lit("{}")).otherwise(F.col(raw))
    known = F.coalesce(F.col(tool).isin(*TOOLS), F.lit(False))
    parsed = calls.withColumn("_doc", F.when(known, parse_lenient(text))).withColumn("_f", _fields("_doc"))
    f = F.col("_f")
    errors = (
        F.when(F.col(tool) == "run_python", _collect(_run_python(f), _extras(f, ("code",))))
        .when(
            F.col(tool) == "submit_answer",
            _collect(_submit_answer(f), _extras(f, ("value", "unit", "method_summary"))),
        )
        .otherwise(_collect([], _extras(f, ())))
    )
    return _with_errors(parsed, errors, known).withColumn("status", _status(known)).drop("_doc", "_f")


PLAN_FIELDS = ("interpretation", "assumptions", "answerable", "expected_unit", "steps")


def _plan_step(s: Column, i: Column) -> Column:
    """A step reduced to its tool and its errors."""
    fields = F.try_variant_get(s, "$", "map<string,variant>")
    at = lambda name: F.concat(F.lit("steps."), i.cast("string"), F.lit("." + name))
    tool, description = _get(fields, "tool"), _get(fields, "description")
    known = F.coalesce(_is(tool, "STRING") & _text(tool).isin(*TOOLS), F.lit(False))
    said, size = _is(description, "STRING"), F.length(_text(description))
    found = F.array_compact(
        F.array(
            _when(~_has(fields, "tool"), "schema", at("tool"), REQUIRED),
            _when(_has(fields, "tool") & ~known, "schema", at("tool"), NOT_TOOL),
            _when(~_has(fields, "description"), "schema", at("description"), REQUIRED),
            _when(_has(fields, "description") & ~said, "schema", at("description"), NOT_STRING),
            _when(said & (size < 1), "rule", at("description"), "String should have at least 1 character"),
            _when(said & (size > 300), "rule", at("description"), "String should have at most 300 characters"),
        )
    )
    keys = F.coalesce(F.map_keys(fields), F.array().cast("array<string>"))
    extra = F.transform(
        F.filter(keys, lambda k: ~k.isin("tool", "description")),
        lambda k: _error("schema", F.concat(F.lit("steps."), i.cast("string"), F.lit("."), k), FORBIDDEN),
    )
    none = F.array(_error("schema", F.concat(F.lit("steps."), i.cast("string")), NOT_STEP))
    return F.struct(
        F.when(known, _text(tool)).alias("tool"),
        F.when(_is(s, "OBJECT"), F.concat(found, extra)).otherwise(none).alias("errors"),
    )


def _plan_note(a: Column, i: Column) -> Column:
    text = _text(a)
    shaped = _is(a, "STRING")
    wrong = _when(~shaped, "schema", F.concat(F.lit("assumptions."), i.cast("string")), NOT_STRING)
    return F.struct(shaped.alias("shaped"), _fits(text, 200).alias("fits"), wrong.alias("error"))


# The type of a document whose fields and items have the right names and types, as ``schema_of_variant`` writes it.
PLAN_SHAPE = (
    r"^OBJECT<answerable: BOOLEAN, assumptions: ARRAY<(STRING|VOID)>, expected_unit: (STRING|VOID), interpretation: STRING, "
    r"steps: ARRAY<(OBJECT<description: STRING, tool: STRING>|VOID)>>$"
)
PLAN_TYPE = "struct<interpretation: string, assumptions: array<string>, steps: array<struct<tool: string, description: string>>>"
MANY_NOTES = "List should have at most 5 items"
LONG_NOTE = "Value error, each assumption must be 1 to 200 characters"
FEW_STEPS = "List should have at least 1 item"
MANY_STEPS = "List should have at most 8 items"
ENDS_ONCE = "Value error, the plan must contain exactly one submit_answer step, and it must be last"


def _fits(text: Column, most: int) -> Column:
    # A text that starts with a letter or digit is not blank: no search for white space is needed.
    visible = text.rlike("^[0-9A-Za-z]") | ~is_blank(text)
    return F.coalesce((F.length(text) <= most) & visible, F.lit(False))


def validate_plans(plans: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``status`` and ``errors`` to recorded plan documents.

    One test of the type of the whole document, and one typed read of it, tell the documents whose fields and
    items are right; only limits are left to check there, on plain columns.  All other documents are
    taken apart item by item to name every fault.
    """
    typed = F.when(_kind(F.col("_doc")).rlike(PLAN_SHAPE), F.try_variant_get("_doc", "$", PLAN_TYPE))
    parsed = plans.withColumn("_doc", parse_lenient(F.col(raw))).withColumn("_plan", typed)
    steps, notes = F.col("_plan.steps"), F.col("_plan.assumptions")
    # A field that only some items have does not show in the type of the list, nor does a NULL item.
    fine = F.forall(steps, lambda s: s["tool"].isNotNull() & s["description"].isNotNull()) & (F.size(F.array_compact(notes)) == F.size(notes))
    parsed = parsed.withColumn("_fine", F.coalesce(fine, F.lit(False)))
    errors = F.when(F.col("_fine"), _limits(F.col("_plan.interpretation"), notes, steps)).otherwise(_faults(F.col("_doc")))
    out = _with_errors(parsed, errors, F.lit(True)).withColumn("status", _status(F.lit(True)))
    return out.select(*plans.columns, "errors", "status")


def _limits(interpretation: Column, notes: Column, steps: Column) -> Column:
    """Errors of a plan whose fields and items have the right types."""
    size, n_notes, n_steps = F.length(interpretation), F.size(notes), F.size(steps)
    # Arrays of one field are cheaper than functions of each item; errors of items are made where there are any.
    tools, sizes = steps["tool"], F.transform(steps["description"], F.length)
    submits = F.size(tools) - F.size(F.array_remove(tools, "submit_answer"))
    ends_once = (submits == 1) & (F.try_element_at(tools, F.lit(-1)) == "submit_answer")
    known = F.size(F.array_except(tools, F.array(*[F.lit(t) for t in TOOLS]))) == 0
    steps_fine = known & (F.array_min(sizes) >= 1) & (F.array_max(sizes) <= 300)

    def item(s: Column, i: Column) -> Column:
        at = lambda name: F.concat(F.lit("steps."), i.cast("string"), F.lit("." + name))
        return F.array_compact(
            F.array(
                _when(~s["tool"].isin(*TOOLS), "schema", at("tool"), NOT_TOOL),
                _when(F.length(s["description"]) < 1, "rule", at("description"), "String should have at least 1 character"),
                _when(F.length(s["description"]) > 300, "rule", at("description"), "String should have at most 300 characters"),
            )
        )

    found = [
        _when(size < 1, "rule", "interpretation", "String should have at least 1 character"),
        _when(size > 500, "rule", "interpretation", "String should have at most 500 characters"),
        _when(n_notes > 5, "rule", "assumptions", MANY_NOTES),
        _when((n_notes <= 5) & F.exists(notes, lambda a: ~_fits(a, 200)), "rule", "assumptions", LONG_NOTE),
        _when(n_steps < 1, "rule", "steps", FEW_STEPS),
        _when(n_steps > 8, "rule", "steps", MANY_STEPS),
        _when(n_steps.between(1, 8) & steps_fine & ~ends_once, "rule", "steps", ENDS_ONCE),
    ]
    none = F.expr("array()").cast("array<struct<level:string,path:string,message:string>>")
    of_items = F.when(n_steps.between(1, 8) & ~steps_fine, F.flatten(F.transform(steps, item))).otherwise(none)
    return F.concat(F.array_compact(F.array(*found)), of_items)


def _faults(doc: Column) -> Column:
    """Errors of any plan document, from its fields and items one by one."""

    def taken_apart(f: Column) -> Column:
        flag, unit = _get(f, "answerable"), _get(f, "expected_unit")
        kind = _kind(flag)
        flag_ok = (
            (kind == "BOOLEAN")
            | (kind.rlike(NUMERIC) & F.try_variant_get(flag, "$", "double").isin(0.0, 1.0))
            | ((kind == "STRING") & F.lower(_text(flag)).isin(*TRUE_FALSE_WORDS))
        )
        listed = lambda name: F.when(_is(_get(f, name), "ARRAY"), F.try_variant_get(_get(f, name), "$", "array<variant>"))
        lists = F.struct(F.transform(listed("assumptions"), _plan_note).alias("notes"), F.transform(listed("steps"), _plan_step).alias("steps"))
        first = [*_shape(f, PLAN_FIELDS), *_length(f, "interpretation", 1, 500)]
        last = [
            _when(_has(f, "answerable") & ~F.coalesce(flag_ok, F.lit(False)), "schema", "answerable", NOT_BOOL),
            _when(_has(f, "expected_unit") & ~_null(unit) & ~_is(unit, "STRING"), "schema", "expected_unit", NOT_STRING),
        ]

        def of_lists(x: Column) -> Column:
            notes, steps = x["notes"], x["steps"]
            n_notes, n_steps = F.size(notes), F.size(steps)
            few_notes, some_steps = notes.isNotNull() & (n_notes <= 5), steps.isNotNull() & n_steps.between(1, 8)
            submits = F.size(F.filter(steps, lambda s: s["tool"] == "submit_answer"))
            ends_once = (submits == 1) & (F.try_element_at(steps, F.lit(-1))["tool"] == "submit_answer")
            steps_fine = F.forall(steps, lambda s: F.size(s["errors"]) == 0)
            shaped = F.forall(notes, lambda a: a["shaped"])
            found = [
                *first,
                _when(_has(f, "assumptions") & notes.isNull(), "schema", "assumptions", NOT_LIST),
                _when(notes.isNotNull() & (n_notes > 5), "rule", "assumptions", MANY_NOTES),
                _when(few_notes & shaped & F.exists(notes, lambda a: ~a["fits"]), "rule", "assumptions", LONG_NOTE),
                *last,
                _when(_has(f, "steps") & steps.isNull(), "schema", "steps", NOT_LIST),
                _when(steps.isNotNull() & (n_steps < 1), "rule", "steps", FEW_STEPS),
                _when(steps.isNotNull() & (n_steps > 8), "rule", "steps", MANY_STEPS),
                _when(some_steps & steps_fine & ~ends_once, "rule", "steps", ENDS_ONCE),
            ]
            # An error for each faulty item of the two lists, unless a list is too long to be looked at.
            none = F.expr("array()").cast("array<struct<level:string,path:string,message:string>>")
            of_notes = F.when(few_notes, F.array_compact(F.transform(notes, lambda a: a["error"])))
            of_steps = F.when(some_steps, F.flatten(F.transform(steps, lambda s: s["errors"])))
            return _collect(found, F.concat(F.coalesce(of_notes, none), F.coalesce(of_steps, none), _extras(f, PLAN_FIELDS)))

        return _let(lists, of_lists)

    return _let(F.try_variant_get(doc, "$", "map<string,variant>"), taken_apart)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, and only where the expression is reached."""
    return F.element_at(F.transform(F.array(value), body), 1)


def validation_errors_long(validated: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per error: (keys.., level, path, message)."""
    return validated.select(*keys, F.inline("errors"))


# ------------------------------------------------------------------------------- executions
OUTCOME = (
    "status string, result variant, result_missing boolean, stdout string, error string, "
    "violations array<struct<kind:string,detail:string>>, stdout_truncated boolean, exec_s double"
)


def classify_results(executions: DataFrame) -> DataFrame:
    """Add ``status``, ``limits_hit`` and ``payload`` to raw execution facts.

    Needs hard_killed, oom_killed, raw_truncated, exit_code, stdout and marker (per execution, so
    output of the executed code cannot imitate it).  A hard kill outranks running out of memory,
    which outranks a missing payload; otherwise the payload states the outcome.
    """
    # The marker varies per row, so its last position is found by splitting on it literally.
    parts = F.split(F.col("stdout"), F.concat(F.lit("\\Q"), F.col("marker"), F.lit("\\E")))
    body = F.when(F.size(parts) > 1, F.substring_index(F.element_at(parts, -1), "\n", 1))
    doc = F.try_parse_json(body)
    payload = F.when(_is(doc, "OBJECT"), F.from_json(body, OUTCOME))
    out = executions.withColumn("payload", payload)
    killed, oom = F.col("hard_killed"), F.col("oom_killed")
    none = F.col("payload").isNull()
    status = (
        F.when(killed, F.lit("timeout"))
        .when(oom, F.lit("oom_killed"))
        .when(none & F.col("exit_code").isin(125, 126, 127), F.lit("docker_error"))
        .when(none, F.lit("runner_crash"))
        .otherwise(F.col("payload.status"))
    )
    stated = ~killed & ~oom & ~none
    limits = F.array_compact(
        F.array(
            F.when(F.col("raw_truncated"), F.lit("output_truncated")),
            F.when(killed, F.lit("hard_kill")),
            F.when(oom & ~killed, F.lit("oom")),
            F.when(stated & (F.col("payload.status") == "timeout"), F.lit("soft_timeout")),
            F.when(
                stated & F.coalesce("payload.stdout_truncated", F.lit(False)) & ~F.col("raw_truncated"),
                F.lit("output_truncated"),
            ),
        )
    )
    return out.withColumn("status", status).withColumn("limits_hit", limits)


# ------------------------------------------------------------------------------- code policy
# What analysis code may import and must not touch.
ALLOWED_MODULES = ["pandas", "numpy", "math", "statistics", "datetime"]
FORBIDDEN_NAMES = [
    "eval",
    "exec",
    "compile",
    "__import__",
    "globals",
    "vars",
    "locals",
    "getattr",
    "setattr",
    "delattr",
    "breakpoint",
    "input",
    "open",
]
FORBIDDEN_ATTRIBUTES = [
    "__subclasses__",
    "__globals__",
    "__builtins__",
    "__code__",
    "__closure__",
    "__base__",
    "__bases__",
    "__mro__",
    "__loader__",
    "__spec__",
    "__import__",
    "__getattribute__",
    "__reduce__",
    "__reduce_ex__",
]

# Which field of a syntax node names what it refers to.
_NAMED_BY = {"alias": "name", "ImportFrom": "module", "Name": "id", "Attribute": "attr"}
FACT = "array<struct<node:string,name:string,level:int,line:int>>"


def syntax_facts(code: Column) -> Column:
    """What a Python text refers to, as an array of facts (node, name, level, line); no judgement.

    Names brought in by ``import`` are ``alias`` facts, the modules of ``from`` imports ``ImportFrom`` facts.  A
    text that does not parse is one ``error`` fact.  Parsing Python needs Python, so this runs on Arrow batches.
    """

    @F.pandas_udf(FACT)
    def facts(texts: pd.Series) -> pd.Series:
        def of(text: str | None) -> list[dict]:
            try:
                nodes = list(ast.walk(ast.parse(text or "")))
            except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
                return [{"node": "error", "name": str(getattr(e, "msg", e)), "level": 0, "line": getattr(e, "lineno", None)}]
            partial = {id(a) for n in nodes if isinstance(n, ast.ImportFrom) for a in n.names}
            return [
                {"node": kind, "name": getattr(n, _NAMED_BY[kind]) or "", "level": getattr(n, "level", 0), "line": n.lineno}
                for n in nodes
                if (kind := type(n).__name__) in _NAMED_BY and id(n) not in partial
            ]

        return texts.map(of)

    return facts(code)


def scan_code_policy(
    df: DataFrame, code: str = "code", keys: Sequence[str] = (), allowed: Sequence[str] = ALLOWED_MODULES
) -> DataFrame:
    """(keys.., kind, detail, line): one row per finding; clean code gives no row.

    The policy is a set of column conditions on the facts of the parsed text.
    """
    facts = df.select(*keys, F.inline(syntax_facts(F.col(code))))
    node, name = F.col("node"), F.col("name")
    outside = ~F.split_part(name, F.lit("."), F.lit(1)).isin(*allowed)
    dots = F.repeat(F.lit("."), F.col("level"))
    rules = (
        (node == "error", "syntax_error", name),
        ((node == "alias") & outside, "static_import", F.concat(F.lit("import "), name)),
        ((node == "ImportFrom") & (outside | (F.col("level") > 0)), "static_import", F.concat(F.lit("from "), dots, name, F.lit(" import ..."))),
        ((node == "Name") & name.isin(*FORBIDDEN_NAMES), "static_forbidden_name", name),
        ((node == "Attribute") & name.isin(*FORBIDDEN_ATTRIBUTES), "static_forbidden_attr", name),
    )
    finding = F.coalesce(*[F.when(test, F.struct(F.lit(kind).alias("kind"), detail.alias("detail"))) for test, kind, detail in rules])
    found = facts.withColumn("_f", finding).where(F.col("_f").isNotNull())
    return found.select(*keys, "_f.kind", "_f.detail", "line")
