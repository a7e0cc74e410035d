"""Candidate score expressions as Columns.

An expression is arithmetic text such as ``min(torque, 4.5) + rpm / 3``. Python's own ``ast``
module reads it and only the listed operations become Column calls; text is never evaluated.
"""

from __future__ import annotations

import ast
import operator
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

_ARITHMETIC = {
    ast.Add: operator.add,
    ast.Sub: operator.sub,
    ast.Mult: operator.mul,
    ast.Div: F.try_divide,
}
#: Functions that expressions may call: the number of arguments and what makes the Column. Pass
#: a mapping of your own, for example ``FUNCTIONS | {"square": (1, lambda a: a * a)}``.
FUNCTIONS: dict[str, tuple[int, Callable[..., Column]]] = {
    "max": (2, F.greatest),
    "min": (2, F.least),
    "greater": (2, lambda a, b: (a > b).cast("double")),
    "less": (2, lambda a, b: (a < b).cast("double")),
    "logical_or": (2, F.greatest),
    "logical_and": (2, F.least),
}


def compile_expression(
    text: str,
    variables: Mapping[str, Column],
    functions: Mapping[str, tuple[int, Callable[..., Column]]] = FUNCTIONS,
) -> Column:
    """Column of an expression, NULL where a used variable is missing or a divisor is zero.

    ``greatest`` and ``least`` skip NULL, so validity is settled by one test in front rather
    than left to propagate. Numbers are doubles, never decimals.
    """
    required: list[Column] = []
    seen: set[str] = set()

    def build(node: ast.AST) -> Column:
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name) and node.id in variables:
            value = variables[node.id]
            if node.id not in seen:
                seen.add(node.id)
                required.append(value.isNotNull() & ~F.isnan(value))
            return value
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -build(node.operand)
        if isinstance(node, ast.BinOp) and type(node.op) in _ARITHMETIC:
            left, right = build(node.left), build(node.right)
            if isinstance(node.op, ast.Div):
                required.append(right != 0)
            return _ARITHMETIC[type(node.op)](left, right)
        if (
            isinstance(node, ast.Call)
            and isinstance(node.func, ast.Name)
            and node.func.id in functions
            and len(node.args) == functions[node.func.id][0]
            and not node.keywords
        ):
            return functions[node.func.id][1](*[build(a) for a in node.args])
        raise ValueError(f"not allowed in an expression: {ast.unparse(node)!r} in {text!r}")

    try:
        tree = ast.parse(text.strip(), mode="eval")
    except SyntaxError as error:
        raise ValueError(f"not an expression: {text!r}") from error
    value = build(tree.body)
    for condition in required:
        value = F.when(condition, value)
    return value


def logistic_loss(prediction: Column, label: Column) -> Column:
    """Log loss of the squashed prediction, with the guard 1e-9 inside both logarithms."""
    squashed = 1.0 / (1.0 + F.exp(-prediction))
    return -(
        label * F.ln(squashed + 1e-9) + (1.0 - label) * F.ln(1.0 - squashed + 1e-9)
    )


def squared_loss(prediction: Column, label: Column) -> Column:
    """Squared error."""
    return F.pow(prediction - label, 2)
