"""Declarative rules compiled to columns, and formulas with exact decimals.

A rule is a nested dict: all, any, not, exists, compare or calculation. Each node
compiles to a condition and to an error flag; Spark promises no short circuit, so
errors are columns of their own and count only where evaluation would reach them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridock.functions.canonical import canonical_json, content_id
from veridock.functions.numbers import decimal_text

#: Input types and what they are in Spark.
TYPES = {"string": "string", "decimal": "decimal(18,6)", "integer": "long", "boolean": "boolean"}


@dataclass(frozen=True)
class Rule:
    """An id, typed inputs (name: (type, required)) and an expression over them."""

    rule_id: str
    version: str
    inputs: dict[str, tuple[str, bool]]
    expression: dict
    calculations: tuple[str, ...] = field(default=())

    def names(self) -> list[str]:
        """Inputs that must be supplied: required ones and all that the expression mentions."""
        found = {n for n, (_, required) in self.inputs.items() if required}

        def walk(node: dict) -> None:
            kind, body = next(iter(node.items()))
            if kind in ("all", "any"):
                for child in body:
                    walk(child)
            elif kind == "not":
                walk(body)
            elif kind == "exists":
                found.add(body["input"])
            elif kind == "compare":
                found.update(side["input"] for side in (body["left"], body["right"]) if "input" in side)

        walk(self.expression)
        return sorted(found)


def validate_rule(rule: Rule) -> list[str]:
    """Problems of a rule document; empty if it can be compiled."""
    problems = [f"unknown type {t} of {n}" for n, (t, _) in rule.inputs.items() if t not in TYPES]
    return problems + [f"undeclared input {n}" for n in rule.names() if n not in rule.inputs]


def apply_operator(operator: str, left: Column, right: Column, same_type: bool, array: bool = False) -> tuple[Column, Column]:
    """(condition, error): eq and ne of different types are false and true; ordered comparison of them is an error."""
    no, yes = F.lit(False), F.lit(True)
    if operator == "eq":
        return (F.coalesce(left.eqNullSafe(right), no) if same_type else no), no
    if operator == "ne":
        return (~left.eqNullSafe(right) if same_type else yes), no
    if operator in ("gt", "gte", "lt", "lte"):
        if not same_type:
            return no, yes
        ops = {"gt": left > right, "gte": left >= right, "lt": left < right, "lte": left <= right}
        return F.coalesce(ops[operator], no), left.isNull() | right.isNull()
    if operator == "in":
        return F.coalesce(F.array_contains(right, left) if array else right.contains(left), no), right.isNull()
    return F.coalesce(F.array_contains(left, right) if array else left.contains(right), no), left.isNull()


def compile_node(rule: Rule, node: dict, inputs: dict[str, Column], calculations: dict[str, dict[str, Column]]) -> tuple[Column, Column]:
    """(condition, error) of a node; an error counts only if no earlier sibling decides."""
    kind, body = next(iter(node.items()))
    if kind in ("all", "any"):
        value, error = F.lit(kind == "all"), F.lit(False)
        for child in body:
            v, e = compile_node(rule, child, inputs, calculations)
            reached = (value if kind == "all" else ~value) & ~error
            error = error | (reached & e)
            value = (value & v) if kind == "all" else (value | v)
        return value, error
    if kind == "not":
        v, e = compile_node(rule, body, inputs, calculations)
        return ~v, e
    if kind == "exists":
        return inputs[body["input"]].isNotNull(), F.lit(False)
    if kind == "calculation":
        actual = calculations[body["calculation"]][body["field"]]
        return apply_operator(body["operator"], actual, F.lit(body["value"]), True)

    def side(operand: dict, other: dict) -> tuple[Column, str, bool]:
        if "input" in operand:
            kind = rule.inputs[operand["input"]][0]
            return inputs[operand["input"]], kind, False
        value = operand["value"]
        if isinstance(value, list):
            return F.array(*[F.lit(v) for v in value]), "array", True
        kind = rule.inputs[other["input"]][0] if "input" in other else "string"
        return F.lit(value).try_cast(TYPES[kind]), kind, False

    left, lt, la = side(body["left"], body["right"])
    right, rt, ra = side(body["right"], body["left"])
    return apply_operator(body["operator"], left, right, lt == rt, la or ra)


def evaluate(rule: Rule, inputs: dict[str, Column], present: dict[str, Column] | None = None, sources_ok: Column | None = None, calculations: dict[str, dict[str, Column]] | None = None) -> dict[str, Column]:
    """status, reason and missing of one rule over columns.

    ``present`` says whether an input was supplied at all; a supplied null counts
    as present. Unresolved sources come first, then missing inputs, then broken
    calculations, then the expression.
    """
    present = present or {n: c.isNotNull() for n, c in inputs.items()}
    calculations = calculations or {}
    gone = F.filter(F.array(*[F.when(~present.get(n, F.lit(False)), F.lit(n)) for n in rule.names()] or [F.lit(None).cast("string")]), lambda x: x.isNotNull())
    broken = F.lit(False)
    for c in calculations.values():
        broken = broken | F.coalesce(c["status"] != "SUCCESS", F.lit(True))
    value, error = compile_node(rule, rule.expression, inputs, calculations)
    unresolved = ~sources_ok if sources_ok is not None else F.lit(False)
    status = (
        F.when(unresolved, "ENGINE_ERROR").when(F.size(gone) > 0, "INDETERMINATE").when(broken, "ENGINE_ERROR").when(error, "ENGINE_ERROR")
        .when(value, "SATISFIED").otherwise("NOT_SATISFIED")
    )
    reason = (
        F.when(unresolved, "UNRESOLVED_RULE_SOURCE").when(F.size(gone) > 0, "MISSING_REQUIRED_INPUT").when(broken, "INVALID_CALCULATION_REFERENCE")
        .when(error, "INVALID_RULE_INPUT").when(value, "EVALUATED_TRUE").otherwise("EVALUATED_FALSE")
    )
    return {"status": status, "reason": reason, "missing": F.when(unresolved, F.array().cast("array<string>")).otherwise(gone)}


def frontage_ratio(frontage: Column, perimeter: Column, threshold: Column) -> Column:
    """Struct status, error, raw, display, comparison of text inputs; the ratio has twenty places."""
    f, p, t = (c.try_cast("decimal(18,9)") for c in (frontage, perimeter, threshold))
    ratio = F.try_divide(f, F.nullif(p, F.lit(0).cast("decimal(18,9)")))
    error = (
        F.when(frontage.isNull() | perimeter.isNull() | threshold.isNull(), "MISSING_INPUT").when(f.isNull() | p.isNull() | t.isNull(), "INVALID_DECIMAL")
        .when(p == 0, "DIVISION_BY_ZERO").when((f < 0) | (p < 0) | (t < 0), "NEGATIVE_VALUE")
    )
    status = F.when(error.isNull(), "SUCCESS").when(error == "DIVISION_BY_ZERO", "DIVISION_BY_ZERO").otherwise("INVALID_INPUT")
    ok = error.isNull()
    return F.struct(
        status.alias("status"), error.alias("error"), F.when(ok, decimal_text(ratio)).alias("raw"),
        F.when(ok, F.concat(decimal_text(F.round(ratio * 100, 3)), F.lit("%"))).alias("display"),
        F.when(ok, F.when(ratio < t, "BELOW_THRESHOLD").when(ratio > t, "ABOVE_THRESHOLD").otherwise("AT_THRESHOLD")).alias("comparison"),
    )


def scale_formula(left: Column, right: Column, multiply: bool) -> Column:
    """Struct status, error, raw: real length by pixels, or pixels by scale; both must be positive numbers."""
    a, b = left.try_cast("decimal(18,9)"), right.try_cast("decimal(18,9)")
    error = (
        F.when(left.isNull() | right.isNull(), "MISSING_INPUT").when(a.isNull() | b.isNull(), "INVALID_DECIMAL")
        .when((b == 0) & F.lit(not multiply), "DIVISION_BY_ZERO").when((a <= 0) | (b <= 0), "NON_POSITIVE_VALUE")
    )
    value = a * b if multiply else F.try_divide(a, F.nullif(b, F.lit(0).cast("decimal(18,9)")))
    return F.struct(F.when(error.isNull(), "SUCCESS").when(error == "DIVISION_BY_ZERO", error).otherwise("INVALID_INPUT").alias("status"), error.alias("error"), F.when(error.isNull(), decimal_text(value)).alias("raw"))


#: Registry of formulas by (id, version): a user adds functions of columns that return a struct with status.
FORMULAS = {
    ("FRONTAGE_RATIO", "1"): frontage_ratio,
    ("DRAWING_SCALE", "1"): lambda real, pixel: scale_formula(real, pixel, False),
    ("DRAWING_LENGTH", "1"): lambda pixel, scale: scale_formula(pixel, scale, True),
}


def register_formula(formula_id: str, version: str, function) -> None:
    if (formula_id, version) in FORMULAS:
        raise ValueError(f"formula {formula_id} {version} is registered")
    FORMULAS[formula_id, version] = function


def run_formula(df: DataFrame, formula_id: str, version: str, inputs: dict[str, str], output: str = "calculation") -> DataFrame:
    """Adds the formula's struct and its content id over formula, version and inputs."""
    made = FORMULAS[formula_id, version](*[F.col(c).cast("string") for c in inputs.values()])
    payload = canonical_json(formula=F.lit(formula_id), version=F.lit(version), inputs=F.struct(*[F.col(inputs[n]).cast("string").alias(n) for n in sorted(inputs)]))
    return df.withColumns({output: made, f"{output}_id": content_id("CALC-", payload)})


#: Rules that are broadcast.
BROADCAST_RULES = 100_000


def select_rules(rules: DataFrame, contexts: DataFrame, scopes: list[str]) -> DataFrame:
    """context, rule_id, code: null code for rules whose scope fits, else the first scope that doesn't; scopes are null for any."""
    r, c = rules.alias("r"), contexts.alias("c")
    code = F.coalesce(*[F.when(F.col(f"r.{s}").isNotNull() & ~F.col(f"r.{s}").eqNullSafe(F.col(f"c.{s}")), F.lit(f"{s.upper()}_MISMATCH")) for s in scopes])
    # Every context meets every rule, as the result has a row for each; a list of the usual length is broadcast.
    small = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    return c.crossJoin(F.broadcast(r) if small else r).select(F.col("c.context").alias("context"), F.col("r.rule_id").alias("rule_id"), code.alias("code"))
