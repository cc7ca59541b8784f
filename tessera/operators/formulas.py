"""A registry of financial formulas and their evaluation over facts.

An expression is compiled once to a column; nothing is evaluated row by row in Python.
Facts are matched with the inputs of all formulas in one join on the line item, and one
grouped aggregation gives every formula of a filing and year.

Defined cases: a fact that is absent makes the status ``missing_inputs`` and is named in
``missing``; a nil fact (present, without a value) is missing too unless the input is
optional, when it counts as 0; a divisor of 0 gives the status ``error``; of several
facts of one key the first by ``chunk_id`` counts.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Input:
    """One input: a normalised line item, or "{metric}"; ``back`` years before the year of the result."""

    item: str
    back: int = 0
    optional: bool = False


@dataclass(frozen=True)
class Formula:
    kind: str  # ratio, amount or pct
    digits: int
    inputs: Mapping[str, Input]
    expression: str
    cues: tuple[str, ...] = ()
    statement: str = "balance_sheet"

    @property
    def generic(self) -> bool:
        return any(i.item == METRIC for i in self.inputs.values())


METRIC = "{metric}"
_ASSETS, _LIABILITIES, _EQUITY = Input("total current assets"), Input("total current liabilities"), Input("total shareholders' equity")
_CASH, _SECURITIES = Input("cash and cash equivalents"), Input("marketable securities")
_YEARS = {"current": Input(METRIC), "prior": Input(METRIC, back=1)}

# --- fixed values: formulas, the line items they take and the words that ask for them --------------------
FORMULAS: dict[str, Formula] = {
    "current_ratio": Formula("ratio", 2, {"current_assets": _ASSETS, "current_liabilities": _LIABILITIES}, "current_assets / current_liabilities", ("current ratio", "liquidity ratio")),
    "quick_ratio": Formula(
        "ratio", 2, {"cash": _CASH, "securities": _SECURITIES, "receivables": Input("accounts receivable net"), "current_liabilities": _LIABILITIES},
        "(cash + securities + receivables) / current_liabilities", ("quick ratio", "acid test", "acid-test"),
    ),
    "working_capital": Formula("amount", 0, {"current_assets": _ASSETS, "current_liabilities": _LIABILITIES}, "current_assets - current_liabilities", ("working capital", "net working capital")),
    "debt_to_equity": Formula(
        "ratio", 3, {"short_term_debt": Input("short term debt", optional=True), "long_term_debt": Input("long term debt"), "equity": _EQUITY},
        "(short_term_debt + long_term_debt) / equity", ("debt to equity", "debt-to-equity", "debt/equity", "leverage ratio", "total debt to equity"),
    ),
    "liabilities_to_equity": Formula("ratio", 3, {"liabilities": Input("total liabilities"), "equity": _EQUITY}, "liabilities / equity", ("liabilities to equity", "liabilities-to-equity")),
    "equity_ratio": Formula("ratio", 3, {"equity": _EQUITY, "assets": Input("total assets")}, "equity / assets", ("equity ratio", "equity to assets")),
    "cash_and_investments": Formula("amount", 0, {"cash": _CASH, "securities": _SECURITIES}, "cash + securities", ("cash and investments", "cash and marketable securities", "cash pile", "total cash", "liquidity position")),
    "yoy_change_pct": Formula("pct", 1, _YEARS, "(current - prior) / abs(prior) * 100", ("year-over-year", "year over year", "yoy", "percent change", "percentage change", "grow", "growth", "increase", "decrease", "change in")),
    "yoy_change_abs": Formula("amount", 0, _YEARS, "current - prior", ("absolute change", "dollar change", "how much did", "by how much")),
}

_ARITHMETIC: dict[type, Callable[[Column, Column], Column]] = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: F.try_divide(a, b)}
_CALLS: dict[str, Callable[..., Column]] = {"abs": F.abs, "min": F.least, "max": F.greatest}


def compile_expression(expression: str, variables: Iterable[str], column: Callable[[str], Column] = F.col) -> Column:
    """The column of an expression of + - * /, signs, brackets, abs, min and max over named variables.

    Anything else (powers, attributes, other calls, keywords, unknown names) raises ValueError
    before any data is read.  Division by zero gives null.
    """
    known = set(variables)
    try:
        root = ast.parse(expression, mode="eval").body
    except SyntaxError as e:
        raise ValueError(f"not an expression: {expression!r}") from e

    def build(node: ast.AST) -> Column:
        match node:
            case ast.Constant(value=bool()):
                pass
            case ast.Constant(value=int() | float() as number):
                return F.lit(float(number))
            case ast.Name(id=name) if name in known:
                return column(name).cast("double")
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -build(x)
            case ast.UnaryOp(op=ast.UAdd(), operand=x):
                return build(x)
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _ARITHMETIC:
                return _ARITHMETIC[type(op)](build(a), build(b))
            case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in _CALLS and (len(args) == 1) == (name == "abs") and args:
                return _CALLS[name](*[build(x) for x in args])
        raise ValueError(f"not allowed in an expression: {ast.unparse(node)}")

    return build(root)


def formatted(kind: Column, rounded: Column, digits: Column) -> Column:
    """A result as text: "$1,234 million", "+85.3%", "3.91"; "n/a" without a result."""
    sign = F.when(rounded < 0, "-").otherwise("")
    amount = F.concat(sign, F.lit("$"), F.format_number(F.abs(rounded), 0), F.lit(" million"))
    fixed = F.when(digits == 0, F.format_string("%.0f", rounded)).when(digits == 1, F.format_string("%.1f", rounded)).when(digits == 2, F.format_string("%.2f", rounded)).otherwise(F.format_string("%.3f", rounded))
    signed = F.concat(F.when(rounded >= 0, "+").otherwise(""), fixed, F.lit("%"))
    return F.coalesce(F.when(kind == "amount", amount).when(kind == "pct", signed).otherwise(fixed), F.lit("n/a"))


def compute(facts: DataFrame, keys: list[str], formulas: Mapping[str, Formula] = FORMULAS) -> DataFrame:
    """Every formula over ``facts(*keys, statement, item, fy, value, chunk_id)``, whose nil values are null.

    One row for each key, year, formula and, for generic ones, each line item of the facts
    of a statement as ``metric``: ``status, missing, result, rounded, unit, inputs`` (name, chunk_id, value, nil).
    A named formula is tried for each key and year of which any of its inputs' items is known.
    """
    spark = facts.sparkSession
    named, generic = {n: f for n, f in formulas.items() if not f.generic}, {n: f for n, f in formulas.items() if f.generic}
    once = facts.where(F.col("item").isNotNull()).groupBy(*keys, "statement", "item", "fy").agg(F.min_by("value", "chunk_id").alias("value"), F.min("chunk_id").alias("chunk_id"))
    wanted = spark.createDataFrame([(n, f.statement, k, i.item, i.back, i.optional) for n, f in named.items() for k, i in f.inputs.items()], "formula string, statement string, input string, item string, back int, optional boolean")
    hit = once.join(F.broadcast(wanted), ["statement", "item"]).withColumn("metric", F.lit(None).cast("string"))  # a row an input of a formula
    each = spark.createDataFrame([(n, k, i.back, i.optional) for n, f in generic.items() for k, i in f.inputs.items()], "formula string, input string, back int, optional boolean")
    bound = once.crossJoin(F.broadcast(each)).withColumn("metric", F.col("item"))  # rows of the registry
    columns = [*keys, "formula", "statement", "metric", (F.col("fy") + F.col("back")).alias("fy"), "input", "optional", "value", "chunk_id"]
    found = hit.select(*columns).unionByName(bound.select(*columns))

    def of(name: str, what: Column) -> Column:
        return F.max(F.when(F.col("input") == name, what))

    names = sorted({k for f in formulas.values() for k in f.inputs})
    present = [of(n, F.lit(1)).alias(f"_has_{n}") for n in names]
    values = [of(n, F.coalesce("value", F.when(F.col("optional"), 0.0))).alias(f"_v_{n}") for n in names]
    used = F.array_sort(F.collect_list(F.struct(F.col("input").alias("name"), "chunk_id", F.coalesce("value", F.lit(0.0)).alias("value"), F.col("value").isNull().alias("nil")))).alias("inputs")
    wide = found.groupBy(*keys, "formula", "statement", "metric", "fy").agg(*present, *values, used)
    # A year is asked about if the facts have it, so that next year's formulas do not arise from prior inputs alone.
    years = once.select(*keys, "fy").distinct()
    wide = wide.join(years.hint("merge"), [*keys, "fy"])

    result = missing = kind = digits = None
    for n, f in formulas.items():
        this = F.col("formula") == n
        x = compile_expression(f.expression, f.inputs, lambda v: F.col(f"_v_{v}"))
        gaps = [_gap(k, i) for k, i in sorted(f.inputs.items())]
        gone = F.filter(F.array(*gaps), lambda g: g.isNotNull())
        result = F.when(this, x) if result is None else result.when(this, x)
        missing = F.when(this, gone) if missing is None else missing.when(this, gone)
        kind = F.when(this, f.kind) if kind is None else kind.when(this, f.kind)
        digits = F.when(this, f.digits) if digits is None else digits.when(this, f.digits)
    out = wide.withColumns({"missing": missing, "kind": kind, "digits": digits, "result": result})
    whole = F.size("missing") == 0
    status = F.when(~whole, "missing_inputs").when(F.col("result").isNull(), "error").otherwise("ok")
    rounded = F.when(F.col("digits") == 0, F.bround("result", 0)).when(F.col("digits") == 1, F.bround("result", 1)).when(F.col("digits") == 2, F.bround("result", 2)).otherwise(F.bround("result", 3))
    out = out.withColumn("status", status).withColumn("result", F.when(whole, F.col("result"))).withColumn("rounded", F.when(whole, rounded))
    return out.select(*keys, "fy", "formula", "statement", "metric", "kind", "digits", "status", "missing", "result", "rounded", "inputs")


def _gap(name: str, wanted: Input) -> Column:
    """What to report of an input that cannot be used, or null."""
    item = F.coalesce("metric", F.lit(wanted.item)) if wanted.item == METRIC else F.lit(wanted.item)
    year = (F.col("fy") - wanted.back).cast("string")
    absent = F.concat(item, F.lit(" (FY"), year, F.lit(")"))
    nil = F.concat(item, F.lit(" (FY"), year, F.lit(" is nil)"))
    return F.when(F.col(f"_has_{name}").isNull(), absent).when(F.col(f"_v_{name}").isNull(), nil)


def working(results: DataFrame) -> DataFrame:
    """Adds ``shown``: the formatted result, and ``lines``: the working, one line an input and its source."""
    inputs = F.transform(
        "inputs",
        lambda i: F.concat(F.lit("  "), i["name"], F.lit(" = "), F.when(i["nil"], F.lit("nil, counted as 0")).otherwise(F.format_number(i["value"], 0)), F.lit(" [source "), F.coalesce(i["chunk_id"], F.lit("?")), F.lit("]")),
    )
    shown = formatted(F.col("kind"), F.col("rounded"), F.col("digits"))
    head = F.concat(F.col("formula"), F.lit(", FY"), F.col("fy").cast("string"), F.coalesce(F.concat(F.lit(", "), F.col("metric")), F.lit("")))
    body = F.when(F.col("status") == "ok", F.concat(inputs, F.array(F.concat(F.lit("  result: "), shown)))).otherwise(F.array(F.concat(F.lit("  "), F.col("status"), F.lit(": "), F.array_join("missing", "; "))))
    return results.withColumns({"shown": shown, "lines": F.concat(F.array(head), body)})


def select_formulas(questions: DataFrame, formulas: Mapping[str, Formula] = FORMULAS) -> DataFrame:
    """The formulas a question asks for by cue: ``id, formula``; named ones win over generic ones.

    ``questions(id, question)``; the cues are literals of the plan, so this is a map.
    """
    text = F.lower("question")

    def asked(chosen: Mapping[str, Formula]) -> Column:
        hits = [F.when(F.lit(False), F.lit(n)) if not f.cues else F.when(text.rlike("|".join(_quoted(c) for c in f.cues)), F.lit(n)) for n, f in chosen.items()]
        return F.filter(F.array(*hits), lambda h: h.isNotNull())

    named = asked({n: f for n, f in formulas.items() if not f.generic})
    generic = asked({n: f for n, f in formulas.items() if f.generic})
    picked = F.when(F.size(named) > 0, named).otherwise(generic)
    return questions.where(F.col("question").isNotNull()).select("id", F.explode(picked).alias("formula"))


def _quoted(cue: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c != " " else c for c in cue)
