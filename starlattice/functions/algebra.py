"""One way to write a formula, two ways to run it: numpy arrays and layered SQL expressions.

A formula takes a namespace ``m`` for functions and uses Python's operators for the rest. ``NP`` computes at once; a
:class:`Sql` namespace records text, and names what grows long as columns of lower layers, so that shared parts are
computed once and no expression tree explodes (see :mod:`layers`). Arguments out of a function's domain are clamped, so
no engine raises; formulas mark what is invalid as missing.
"""

from __future__ import annotations

import numpy as np

from .layers import Layer, num


class _Numpy:
    pi = float(np.pi)
    missing = np.nan
    sin, cos, tan, atan, exp, floor, absolute = (staticmethod(f) for f in (np.sin, np.cos, np.tan, np.arctan, np.exp, np.floor, np.abs))
    log = staticmethod(lambda x: np.log(np.maximum(x, 1e-300)))
    asin = staticmethod(lambda x: np.arcsin(np.clip(x, -1, 1)))
    acos = staticmethod(lambda x: np.arccos(np.clip(x, -1, 1)))
    sqrt = staticmethod(lambda x: np.sqrt(np.maximum(x, 0)))
    power = staticmethod(lambda x, p: np.power(np.maximum(x, 0), p))
    atan2, where, larger, smaller = (staticmethod(f) for f in (np.arctan2, np.where, np.maximum, np.minimum))

    @staticmethod
    def div(a, b):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(b == 0, np.nan, a / np.where(b == 0, 1.0, b))


NP = _Numpy()

#: Expressions longer than this become columns of their own.
LONGEST = 160


class Text:
    """A SQL expression: its text, the layer it can stand in, and the namespace that names its parts."""

    __slots__ = ("level", "m", "sql")
    __hash__ = None

    def __init__(self, m: Sql, sql: str, level: int = 0):
        self.m, self.sql, self.level = m, sql, level

    def _pair(self, op: str, other, swap: bool = False) -> Text:
        a, b = self.m.of(self), self.m.of(other)
        if swap:
            a, b = b, a
        return self.m.made(f"({a[0]} {op} {b[0]})", max(a[1], b[1]))

    def __neg__(self):
        return self.m.made(f"(-{self.sql})", self.level)

    def __invert__(self):
        return self.m.made(f"(NOT {self.sql})", self.level)


def _operator(op: str, swap: bool):
    return lambda self, other: self._pair(op, other, swap)


for _name, _op in (("add", "+"), ("sub", "-"), ("mul", "*"), ("truediv", "/"), ("and", "AND"), ("or", "OR")):
    setattr(Text, f"__{_name}__", _operator(_op, False))
    setattr(Text, f"__r{_name}__", _operator(_op, True))
for _name, _op in (("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">="), ("eq", "="), ("ne", "<>")):
    setattr(Text, f"__{_name}__", _operator(_op, False))


class Sql:
    """Records a formula; ``layers()`` are the columns that its parts were given."""

    pi = float(np.pi)

    def __init__(self, prefix: str = "t"):
        self.prefix, self.named, self.rows = prefix, {}, []

    def column(self, name: str) -> Text:
        return Text(self, name)

    def of(self, x) -> tuple[str, int]:
        return (x.sql, x.level) if isinstance(x, Text) else (num(x), 0)

    def made(self, sql: str, level: int) -> Text:
        if len(sql) <= LONGEST:
            return Text(self, sql, level)
        if sql not in self.named:
            name = f"{self.prefix}{len(self.named)}"
            self.named[sql] = (name, level + 1)
            self.rows.append((level, name, sql))
        name, above = self.named[sql]
        return Text(self, name, above)

    def layers(self) -> list[Layer]:
        out: dict[int, Layer] = {}
        for level, name, sql in self.rows:
            out.setdefault(level, {})[name] = sql
        return [out[k] for k in sorted(out)]

    def _call(self, form: str, *args) -> Text:
        parts = [self.of(a) for a in args]
        return self.made(form.format(*[p[0] for p in parts]), max(p[1] for p in parts))

    @property
    def missing(self) -> Text:
        return Text(self, "CAST(NULL AS DOUBLE)")

    def sin(self, x):
        return self._call("sin({})", x)

    def cos(self, x):
        return self._call("cos({})", x)

    def tan(self, x):
        return self._call("tan({})", x)

    def atan(self, x):
        return self._call("atan({})", x)

    def exp(self, x):
        return self._call("exp({})", x)

    def floor(self, x):
        return self._call("CAST(floor({}) AS DOUBLE)", x)

    def absolute(self, x):
        return self._call("abs({})", x)

    def larger(self, a, b):
        return self._call("greatest({}, {})", a, b)

    def smaller(self, a, b):
        return self._call("least({}, {})", a, b)

    def atan2(self, a, b):
        return self._call("atan2({}, {})", a, b)

    def asin(self, x):
        return self._call("asin(least(greatest({}, -1e0), 1e0))", x)

    def acos(self, x):
        return self._call("acos(least(greatest({}, -1e0), 1e0))", x)

    def sqrt(self, x):
        return self._call("sqrt(greatest({}, 0e0))", x)

    def log(self, x):
        return self._call("ln(greatest({}, 1e-300))", x)

    def power(self, x, p):
        return self._call("pow(greatest({}, 0e0), {})", x, p)

    def where(self, c, a, b):
        if not isinstance(c, Text):
            return a if c else b
        return self._call("CASE WHEN {} THEN {} ELSE {} END", c, a, b)

    def div(self, a, b):
        return self._call("({} / nullif({}, 0e0))", a, b)


def layered(formula, names: list[str], outputs: list[str], prefix: str) -> list[Layer]:
    """The layers that compute ``outputs`` from columns ``names`` by ``formula(m, *columns)``."""
    m = Sql(prefix)
    results = formula(m, *[m.column(n) for n in names])
    level = max(m.of(r)[1] for r in results)
    return [*m.layers(), {o: m.of(r)[0] for o, r in zip(outputs, results)}] if level >= 0 else []
