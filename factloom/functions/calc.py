"""Deterministic arithmetic as Column expressions.

Every operation comes in two readings: ``strict`` raises on an undefined case (division by zero, a growth
rate over nothing), the default gives NULL, which is what a query over many rows wants.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _guard(ok: Column, value: Column, strict: bool, message: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)).cast("double") if strict else F.lit(None).cast("double"))


def _double(x: Column) -> Column:
    return x.cast("double")


def add(a: Column, b: Column) -> Column:
    return _double(a) + _double(b)


def subtract(a: Column, b: Column) -> Column:
    return _double(a) - _double(b)


def multiply(a: Column, b: Column) -> Column:
    return _double(a) * _double(b)


def ratio(a: Column, b: Column, strict: bool = False) -> Column:
    """a / b; also plain division."""
    return _guard(_double(b) != 0, F.try_divide(_double(a), _double(b)), strict, "division by zero")


def margin(a: Column, b: Column, strict: bool = False) -> Column:
    """a as a percentage of b; also percent_of."""
    return ratio(a, b, strict) * 100


def yoy_growth(current: Column, previous: Column, strict: bool = False) -> Column:
    """Percentage change. The sign follows the quotient, so a negative base turns it around."""
    return ratio(_double(current) - _double(previous), previous, strict) * 100


def cagr(start: Column, end: Column, years: Column, strict: bool = False) -> Column:
    """Compound annual growth in percent; undefined unless start, end and years are above zero."""
    s, e, y = _double(start), _double(end), _double(years)
    return _guard((s > 0) & (e > 0) & (y > 0), (F.pow(F.try_divide(e, s), F.try_divide(F.lit(1.0), y)) - 1) * 100, strict, "cagr needs positive start, end and years")


def list_operation(name: str, values: Column) -> Column:
    """sum, mean, median, min or max over an array of doubles; NULL for an empty one."""
    n, ordered = F.size(values), F.array_sort(values)
    middle = (F.element_at(ordered, F.floor((n + 1) / 2).cast("int")) + F.element_at(ordered, F.floor((n + 2) / 2).cast("int"))) / 2
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    out = {"sum": total, "mean": F.try_divide(total, n.cast("double")), "median": middle, "min": F.array_min(values), "max": F.array_max(values)}[name]
    return F.when(n > 0, out)


def shown(name: str, value: Column) -> Column:
    """A result as text: percentages with four places, ratios with six."""
    if name in {"yoy_growth", "margin", "percent_of", "cagr"}:
        return F.format_string("%.4f%%", value)
    return F.format_string("%.6f", value) if name in {"ratio", "divide"} else value.cast("string")


# How the formula of an operation is written; {0}, {1}, {2} are its operands in order.
FORMULAS = {
    "add": "{0} + {1}",
    "subtract": "{0} - {1}",
    "multiply": "{0} * {1}",
    "divide": "{0} / {1}",
    "yoy_growth": "({0} - {1}) / {1} * 100",
    "percent_of": "{0} / {1} * 100",
    "ratio": "{0} / {1}",
    "margin": "{0} / {1} * 100",
    "cagr": "((({1} / {0}) ^ (1 / {2})) - 1) * 100",
}


def formula(name: str, operands: Sequence[Column], value: Column) -> Column:
    """``left side = result`` of an operation as text; an aggregate's operand is one array. NULL where a part is NULL.

    Operands are written as Spark writes numbers, the result as :func:`shown`.
    """
    if name not in FORMULAS:
        listed = F.concat(F.lit(f"{name}(["), F.array_join(F.transform(operands[0], lambda x: x.cast("string")), ", "), F.lit("])"))
        return F.concat(listed, F.lit(" = "), shown(name, value))
    parts = re.split(r"\{(\d)\}", FORMULAS[name])
    text = [F.lit(part) if i % 2 == 0 else operands[int(part)].cast("string") for i, part in enumerate(parts)]
    return F.concat(*text, F.lit(" = "), shown(name, value))


def _floor_div(a: Column, b: Column) -> Column:
    return F.floor(F.try_divide(a, b)).cast("double")


_BINARY = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: lambda a, b: F.when(b != 0, F.try_divide(a, b)),
    ast.FloorDiv: lambda a, b: F.when(b != 0, _floor_div(a, b)),
    ast.Mod: lambda a, b: F.when(b != 0, a - b * _floor_div(a, b)),
    ast.Pow: lambda a, b: F.nanvl(F.pow(a, b), F.lit(None).cast("double")),
}


def expression(text: str, **names: Column) -> Column:
    """An arithmetic expression over numbers and the given columns as a Column.

    ``+ - * / // % **`` and unary signs are allowed, nothing else: anything but numbers and known
    names raises ValueError when the plan is built. // and % round towards minus infinity; division
    by zero and undefined powers are NULL.
    """

    def build(node: ast.AST) -> Column:
        if isinstance(node, ast.Expression):
            return build(node.body)
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name) and node.id in names:
            return _double(names[node.id])
        if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
            return _BINARY[type(node.op)](build(node.left), build(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.UAdd, ast.USub)):
            return build(node.operand) if isinstance(node.op, ast.UAdd) else -build(node.operand)
        raise ValueError(f"not allowed in an expression: {ast.dump(node)[:60]}")

    try:
        return build(ast.parse(text.strip(), mode="eval"))
    except SyntaxError as x:
        raise ValueError(f"no expression: {text!r}") from x


def all_of(conditions: list[Column]) -> Column:
    """Conjunction of the active conditions; true for none."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
