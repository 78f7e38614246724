"""Expressions written as text: a checked subset of Python over columns."""

from __future__ import annotations

import ast
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BINARY = {
    ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.Pow: operator.pow,
    ast.BitAnd: operator.and_, ast.BitOr: operator.or_, ast.BitXor: operator.xor,
}
_COMPARE = {ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge}


class ExpressionError(ValueError):
    pass


class _Table:
    """``t`` of an expression: attributes and subscripts are columns."""

    def __init__(self, df: DataFrame):
        self._df = df

    def __getattr__(self, name: str) -> Column:
        if name not in self._df.columns:
            raise ExpressionError(f"no column {name}")
        return F.col(f"`{name}`")

    __getitem__ = __getattr__


class _Evaluator:
    """Walks the tree; whatever isn't named here is refused."""

    def __init__(self, names: dict[str, object]):
        self.names = names

    def run(self, text: str):
        try:
            tree = ast.parse(text.strip(), mode="eval").body
        except SyntaxError as e:
            raise ExpressionError(f"{text!r}: {e.msg}") from e
        return self.visit(tree)

    def visit(self, node: ast.AST):
        f = getattr(self, f"on_{type(node).__name__}", None)
        if f is None:
            raise ExpressionError(f"{type(node).__name__} is not allowed in an expression")
        return f(node)

    def on_Constant(self, n):
        return n.value

    def on_Name(self, n):
        if n.id not in self.names:
            raise ExpressionError(f"unknown name {n.id}")
        return self.names[n.id]

    def on_List(self, n):
        return [self.visit(x) for x in n.elts]

    def on_Tuple(self, n):
        return tuple(self.visit(x) for x in n.elts)

    def on_Dict(self, n):
        if None in n.keys:
            raise ExpressionError("** is not allowed in an expression")
        return {self.visit(k): self.visit(v) for k, v in zip(n.keys, n.values)}

    def on_Attribute(self, n):
        if n.attr.startswith("_"):
            raise ExpressionError(f"{n.attr} is not allowed in an expression")
        return getattr(self.visit(n.value), n.attr)

    def on_Subscript(self, n):
        return self.visit(n.value)[self.visit(n.slice)]

    def on_Slice(self, n):
        return slice(*(x and self.visit(x) for x in (n.lower, n.upper, n.step)))

    def on_Call(self, n):
        if any(isinstance(a, ast.Starred) for a in n.args) or any(k.arg is None for k in n.keywords):
            raise ExpressionError("* is not allowed in an expression")
        return self.visit(n.func)(*map(self.visit, n.args), **{k.arg: self.visit(k.value) for k in n.keywords})

    def on_UnaryOp(self, n):
        x = self.visit(n.operand)
        if isinstance(n.op, ast.Not):
            return ~x if isinstance(x, Column) else not x
        return {ast.Invert: operator.invert, ast.USub: operator.neg, ast.UAdd: operator.pos}[type(n.op)](x)

    def on_BinOp(self, n):
        if type(n.op) not in _BINARY:
            raise ExpressionError(f"{type(n.op).__name__} is not allowed in an expression")
        a, b = self.visit(n.left), self.visit(n.right)
        if isinstance(n.op, ast.FloorDiv) and (isinstance(a, Column) or isinstance(b, Column)):
            return F.floor(a / b)
        return _BINARY[type(n.op)](a, b)

    def on_BoolOp(self, n):
        out = self.visit(n.values[0])
        for x in n.values[1:]:
            if not isinstance(out, Column):
                if bool(out) == isinstance(n.op, ast.Or):
                    return out
                out = self.visit(x)
            else:
                out = out & self.visit(x) if isinstance(n.op, ast.And) else out | self.visit(x)
        return out

    def on_Compare(self, n):
        out, left = None, self.visit(n.left)
        for op, right in zip(n.ops, map(self.visit, n.comparators)):
            one = self.compare(op, left, right)
            out, left = one if out is None else out & one, right
        return out

    def compare(self, op, a, b):
        if isinstance(op, ast.Is | ast.IsNot):
            same = a.isNull() if b is None and isinstance(a, Column) else a is b
            return same if isinstance(op, ast.Is) else ~same if isinstance(same, Column) else not same
        if isinstance(op, ast.In | ast.NotIn):
            found = a.isin(list(b)) if isinstance(a, Column) else a in b
            return found if isinstance(op, ast.In) else ~found if isinstance(found, Column) else not found
        return _COMPARE[type(op)](a, b)

    def on_IfExp(self, n):
        test = self.visit(n.test)
        if isinstance(test, Column):
            return F.when(test, self.visit(n.body)).otherwise(self.visit(n.orelse))
        return self.visit(n.body if test else n.orelse)


def evaluate_expression(text: str, df: DataFrame, **more: object):
    """A column from text over ``t`` (the table) and ``F``: SQL's three-valued logic."""
    return _Evaluator({"t": _Table(df), "F": F, **more}).run(text)


class _Row(_Evaluator):
    """Python's meaning for each row: None equals None, empty values are false, ``or`` gives an operand."""

    def on_Name(self, n):
        if n.id in ("str", "int", "float", "len", "bool"):
            return {"str": lambda x: _lit(x).cast("string"), "int": lambda x: _lit(x).cast("bigint"), "float": lambda x: _lit(x).cast("double"), "len": lambda x: F.length(_lit(x)), "bool": self.truth}[n.id]
        return super().on_Name(n)

    @staticmethod
    def truth(x) -> Column:
        c = _lit(x)
        text = c.cast("string")
        return F.coalesce(~text.isin("", "0", "0.0", "false"), F.lit(False))

    def on_UnaryOp(self, n):
        return ~self.truth(self.visit(n.operand)) if isinstance(n.op, ast.Not) else super().on_UnaryOp(n)

    def on_BoolOp(self, n):
        values = [_lit(self.visit(x)) for x in n.values]
        out = values[-1]
        for x in reversed(values[:-1]):
            out = F.when(self.truth(x), out if isinstance(n.op, ast.And) else x).otherwise(x if isinstance(n.op, ast.And) else out)
        return out

    def on_IfExp(self, n):
        return F.when(self.truth(self.visit(n.test)), _lit(self.visit(n.body))).otherwise(_lit(self.visit(n.orelse)))

    def compare(self, op, a, b):
        if isinstance(op, ast.Eq):
            return _lit(a).eqNullSafe(_lit(b))
        if isinstance(op, ast.NotEq):
            return ~_lit(a).eqNullSafe(_lit(b))
        if isinstance(op, ast.In | ast.NotIn):
            if isinstance(b, Column):
                found = F.coalesce(b.contains(_lit(a)), F.lit(False))
            else:
                found = F.coalesce(_lit(a).isin([x for x in b if x is not None]), F.lit(None in b))
            return found if isinstance(op, ast.In) else ~found
        return super().compare(op, a, b)

    def on_Call(self, n):
        if isinstance(n.func, ast.Attribute) and not n.func.attr.startswith("_"):
            x, args = _lit(self.visit(n.func.value)), [self.visit(a) for a in n.args]
            methods = {
                "lower": lambda: F.lower(x), "upper": lambda: F.upper(x), "strip": lambda: F.trim(x), "split": lambda: F.split(x, _quote(args[0])), "startswith": lambda: x.startswith(args[0]),
                "endswith": lambda: x.endswith(args[0]), "replace": lambda: F.replace(x, _lit(args[0]), _lit(args[1])),
            }
            if n.func.attr in methods:
                return methods[n.func.attr]()
            raise ExpressionError(f"{n.func.attr} is not allowed in a computed field")
        return super().on_Call(n)

    def on_Subscript(self, n):
        i = self.visit(n.slice)
        x = self.visit(n.value)
        if isinstance(x, Column) and isinstance(i, int):
            return F.get(x, i) if i >= 0 else F.try_element_at(x, F.lit(i))
        return x[i]


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _quote(text: str) -> str:
    import re

    return re.escape(text)


def row_expression(text: str, columns: list[str]) -> Column:
    """A computed field over the columns ``name`` or ``t.name``, with Python's meaning for each row."""

    class Row:
        def __getattr__(self, name: str) -> Column:
            if name not in columns:
                raise ExpressionError(f"no column {name}")
            return F.col(f"`{name}`")

        __getitem__ = __getattr__

    return _lit(_Row({"t": Row(), **{c: F.col(f"`{c}`") for c in columns}}).run(text))
