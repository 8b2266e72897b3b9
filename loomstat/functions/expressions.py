"""Filter and derive expressions: a whitelisted Python expression becomes a Spark column."""

from __future__ import annotations

import ast

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ExpressionError(ValueError):
    pass


def _numeric(c: Column) -> Column:
    return c.cast("double")


def _log(f):
    """A logarithm with the floating-point limits: -inf at zero, null below."""
    return lambda x: F.when(x == 0, F.lit(float("-inf"))).when(x > 0, f(x))


def _extreme(f):
    """The larger or smaller of two; null if either is."""
    return lambda a, b: F.when(a.isNotNull() & b.isNotNull(), f(a, b))


FUNCTIONS = {
    "log": (1, _log(F.log)),
    "log10": (1, _log(F.log10)),
    "log1p": (1, lambda x: F.when(x == -1, F.lit(float("-inf"))).when(x > -1, F.log1p(x))),
    "exp": (1, F.exp),
    "sqrt": (1, lambda x: F.when(x >= 0, F.sqrt(x))),
    "abs": (1, F.abs),
    "minimum": (2, _extreme(F.least)),
    "maximum": (2, _extreme(F.greatest)),
}
_ARITHMETIC = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: lambda a, b: F.try_divide(_numeric(a), _numeric(b)),
    ast.Mod: lambda a, b: F.try_mod(a, b),
    ast.Pow: lambda a, b: F.pow(a, b),
    ast.FloorDiv: lambda a, b: F.floor(F.try_divide(_numeric(a), _numeric(b))),
}
#: A missing value is unequal to everything and in no order with anything.
_COMPARE = {
    ast.Eq: lambda a, b: F.coalesce(a == b, F.lit(False)),
    ast.NotEq: lambda a, b: F.coalesce(a != b, F.lit(True)),
    ast.Lt: lambda a, b: F.coalesce(a < b, F.lit(False)),
    ast.LtE: lambda a, b: F.coalesce(a <= b, F.lit(False)),
    ast.Gt: lambda a, b: F.coalesce(a > b, F.lit(False)),
    ast.GtE: lambda a, b: F.coalesce(a >= b, F.lit(False)),
}


class _Translator(ast.NodeVisitor):
    def __init__(self, columns: set[str]):
        self.columns = columns

    def generic_visit(self, node):
        raise ExpressionError(f"not allowed in an expression: {type(node).__name__}")

    def visit_Expression(self, node):
        return self.visit(node.body)

    def visit_Name(self, node):
        if node.id not in self.columns:
            raise ExpressionError(f"no column {node.id}")
        return F.col(f"`{node.id}`")

    def visit_Constant(self, node):
        if isinstance(node.value, (bool, int, float, str)) or node.value is None:
            return F.lit(node.value)
        raise ExpressionError(f"not allowed as a constant: {node.value!r}")

    def visit_UnaryOp(self, node):
        x = self.visit(node.operand)
        if isinstance(node.op, (ast.Not, ast.Invert)):
            return ~F.coalesce(x, F.lit(False))
        return -x if isinstance(node.op, ast.USub) else x

    def visit_BinOp(self, node):
        a, b = self.visit(node.left), self.visit(node.right)
        if isinstance(node.op, ast.BitAnd):
            return a & b
        if isinstance(node.op, ast.BitOr):
            return a | b
        if type(node.op) not in _ARITHMETIC:
            return self.generic_visit(node.op)
        return _ARITHMETIC[type(node.op)](a, b)

    def visit_BoolOp(self, node):
        out, *rest = map(self.visit, node.values)
        for x in rest:
            out = out & x if isinstance(node.op, ast.And) else out | x
        return out

    def visit_Compare(self, node):
        out, left = None, node.left
        for op, right in zip(node.ops, node.comparators, strict=True):
            if isinstance(op, (ast.In, ast.NotIn)) and isinstance(right, (ast.List, ast.Tuple, ast.Set)):
                got = F.coalesce(self.visit(left).isin([e.value for e in right.elts if isinstance(e, ast.Constant)]), F.lit(False))
                one = ~got if isinstance(op, ast.NotIn) else got
            elif type(op) in _COMPARE:
                one = _COMPARE[type(op)](self.visit(left), self.visit(right))
            else:
                self.generic_visit(op)
            out, left = one if out is None else out & one, right
        return out

    def visit_Call(self, node):
        if isinstance(node.func, ast.Attribute) and node.func.attr in ("isnull", "isna", "notnull", "notna") and not node.args:
            x = self.visit(node.func.value).isNull()
            return x if node.func.attr in ("isnull", "isna") else ~x
        if not isinstance(node.func, ast.Name) or node.func.id not in FUNCTIONS or node.keywords:
            raise ExpressionError("unknown function")
        arity, f = FUNCTIONS[node.func.id]
        if len(node.args) != arity:
            raise ExpressionError(f"{node.func.id} takes {arity} arguments")
        return f(*(_numeric(self.visit(a)) for a in node.args))


def column(expression: str, df: DataFrame) -> Column:
    """The column of ``expression`` over ``df``. Names must be columns; nothing is evaluated as Python.

    Comparisons with a missing value are false, but ``!=`` is true. Division by zero gives null.
    """
    try:
        tree = ast.parse(expression.strip(), mode="eval")
    except SyntaxError as e:
        raise ExpressionError(f"can't read {expression!r}: {e.msg}") from e
    return _Translator(set(df.columns)).visit(tree)
