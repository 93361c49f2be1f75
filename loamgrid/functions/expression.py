"""A safe arithmetic language, compiled to Column expressions.

The text is parsed by Python's own parser and only whitelisted nodes are
translated; names are the constants or columns.
"""

from __future__ import annotations

import ast
import difflib
import functools
import itertools
import math
import operator
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamgrid.errors import DataError

CONSTANTS = {"pi": math.pi, "e": math.e, "tau": math.tau, "inf": math.inf, "nan": math.nan}


def _floor_div(a: Column, b: Column) -> Column:
    return F.floor(a / b)


def _mod(a: Column, b: Column) -> Column:
    """The remainder with the divisor's sign."""
    return a - b * F.floor(a / b)


#: n! as doubles, multiplied upwards; those up to EXACT are whole numbers that doubles hold, and so are their quotients.
_FACTORIALS = list(itertools.accumulate(range(1, 171), operator.mul, initial=1.0))
_EXACT = 18
_LOG_PHI = math.log((1 + math.sqrt(5)) / 2)


def _gcd(a: Column, b: Column) -> Column:
    """Euclid by a fold of two divisions a step; by Lame's theorem the smaller number, at most log_phi(it) + 2 divisions, bounds the steps."""
    x, y = F.abs(a.cast("long")), F.abs(b.cast("long"))
    pair = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    rest = lambda s: s["x"] % s["y"]
    step = lambda s, _: F.when(s["y"] == 0, s).when(rest(s) == 0, pair(s["y"], F.lit(0).cast("long"))).otherwise(pair(rest(s), s["y"] % rest(s)))
    steps = F.coalesce((F.ln(F.least(x, y) + 1.0) / (2 * _LOG_PHI)).cast("int"), F.lit(0)) + 2
    return F.aggregate(F.sequence(F.lit(1), steps), pair(x, y), step)["x"]


def _lcm(a: Column, b: Column) -> Column:
    """Divided before it is multiplied, in whole numbers: no step exceeds the result."""
    x, y = F.abs(a.cast("long")), F.abs(b.cast("long"))
    return F.when((x == 0) | (y == 0), F.lit(0).cast("long")).otherwise(F.call_function("div", x, F.greatest(_gcd(a, b), F.lit(1).cast("long"))) * y)


def _factorial_of(n: Column, most: int) -> Column:
    """n! from the table, for whole n from 0 to ``most``."""
    return F.element_at(F.array(*map(F.lit, _FACTORIALS[: most + 1])), n.cast("int") + 1)


def _exact(*numbers: Column) -> Column:
    """Whether all are whole and so small that quotients of their factorials are exact."""
    return functools.reduce(operator.and_, (n.between(0, _EXACT) & (n == F.floor(n)) for n in numbers))


def _product(low: Column, high: Column) -> Column:
    """low * (low + 1) * ... * high, one if empty."""
    folded = F.aggregate(F.sequence(low.cast("long"), F.greatest(low, high).cast("long")), F.lit(1.0), lambda acc, k: acc * k)
    return F.when(high < low, F.lit(1.0)).when(high >= low, folded)


def _factorial(n: Column) -> Column:
    return F.when(n.between(0, len(_FACTORIALS) - 1), _factorial_of(n, len(_FACTORIALS) - 1)).otherwise(_product(F.lit(1), n))


def _comb(n: Column, k: Column) -> Column:
    few = F.least(k, n - k)
    value = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(few, F.lit(1)).cast("long")), F.lit(1.0), lambda acc, i: acc * (n - few + i) / i)
    table = _factorial_of(n, _EXACT) / (_factorial_of(k, _EXACT) * _factorial_of(n - k, _EXACT))
    return F.when((k < 0) | (k > n), 0.0).when(_exact(n, k, n - k), table).when(few == 0, 1.0).otherwise(F.round(value))


def _perm(n: Column, k: Column | None = None) -> Column:
    if k is None:
        return _factorial(n)
    return F.when(k > n, 0.0).when(_exact(n, k, n - k), _factorial_of(n, _EXACT) / _factorial_of(n - k, _EXACT)).otherwise(_product(n - k + 1, n))


FUNCTIONS: dict[str, tuple[int, int, Callable[..., Column]]] = {
    "abs": (1, 1, F.abs), "round": (1, 2, lambda x, n=None: F.bround(x) if n is None else F.bround(x, n)), "int": (1, 1, lambda x: x.cast("long")), "float": (1, 1, lambda x: x.cast("double")),
    "min": (2, 99, F.least), "max": (2, 99, F.greatest), "sqrt": (1, 1, F.sqrt), "cbrt": (1, 1, F.cbrt), "exp": (1, 1, F.exp), "log": (1, 2, lambda x, b=None: F.ln(x) if b is None else F.ln(x) / F.ln(b)),
    "ln": (1, 1, F.ln), "log2": (1, 1, F.log2), "log10": (1, 1, F.log10), "pow": (2, 2, F.pow), "floor": (1, 1, F.floor), "ceil": (1, 1, F.ceil), "trunc": (1, 1, lambda x: x.cast("long")), "fabs": (1, 1, lambda x: F.abs(x).cast("double")),
    "copysign": (2, 2, lambda a, b: F.abs(a).cast("double") * F.when((b < 0) | (b.cast("string") == "-0.0"), -1).otherwise(1)), "hypot": (2, 2, F.hypot), "gcd": (2, 2, _gcd), "lcm": (2, 2, _lcm),
    "factorial": (1, 1, _factorial), "comb": (2, 2, _comb), "perm": (1, 2, _perm),
    "degrees": (1, 1, F.degrees), "radians": (1, 1, F.radians), "sin": (1, 1, F.sin), "cos": (1, 1, F.cos), "tan": (1, 1, F.tan), "asin": (1, 1, F.asin), "acos": (1, 1, F.acos), "atan": (1, 1, F.atan), "atan2": (2, 2, F.atan2),
    "sinh": (1, 1, F.sinh), "cosh": (1, 1, F.cosh), "tanh": (1, 1, F.tanh), "xor": (2, 2, lambda a, b: a.bitwiseXOR(b)),
}

_BINARY: dict[type, Callable[[Column, Column], Column]] = {
    ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: a / b, ast.FloorDiv: _floor_div, ast.Mod: _mod, ast.Pow: F.pow,
    ast.BitAnd: lambda a, b: a.bitwiseAND(b), ast.BitOr: lambda a, b: a.bitwiseOR(b), ast.BitXor: lambda a, b: a.bitwiseXOR(b),
    ast.LShift: lambda a, b: F.call_function("shiftleft", a.cast("long"), b.cast("int")), ast.RShift: lambda a, b: F.call_function("shiftright", a.cast("long"), b.cast("int")),
}
_UNARY: dict[type, Callable[[Column], Column]] = {ast.UAdd: lambda a: a, ast.USub: lambda a: -a, ast.Invert: lambda a: F.bitwise_not(a)}
_COMPARE: dict[type, Callable[[Column, Column], Column]] = {ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b}
#: The largest argument of factorial, comb and perm that may be written out.
MOST_FACTORIAL = 10_000


def compile_expression(text: str, columns: Mapping[str, Column] | None = None, caret: str = "power", null_on_zero: bool = False) -> Column:
    """Translate an arithmetic expression over ``columns``.

    ``^`` is a power, or exclusive or with ``caret="xor"``.  Dividing by zero
    raises at run time under ANSI mode; with ``null_on_zero`` it gives null.
    """
    names = dict(columns or {})
    source = text.replace("^", "**") if caret == "power" else text
    try:
        tree = ast.parse(source.strip(), mode="eval")
    except SyntaxError as error:
        raise DataError(f"Cannot read {text!r}: {error.msg}.") from error

    def unknown(kind: str, name: str, known: list[str]) -> DataError:
        near = difflib.get_close_matches(name, known, 3, 0.4)
        return DataError(f"Unknown {kind} {name!r}." + (f" Did you mean: {', '.join(near)}?" if near else ""))

    def build(node: ast.AST) -> Column:
        if isinstance(node, ast.Expression):
            return build(node.body)
        if isinstance(node, ast.Constant) and isinstance(node.value, int | float) and not isinstance(node.value, bool):
            return F.lit(node.value)
        if isinstance(node, ast.Name):
            if node.id in names:
                return names[node.id]
            if node.id in CONSTANTS:
                return F.lit(CONSTANTS[node.id])
            raise unknown("name", node.id, sorted([*names, *CONSTANTS]))
        if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
            right = build(node.right)
            if null_on_zero and isinstance(node.op, ast.Div | ast.FloorDiv | ast.Mod):
                right = F.nullif(right, F.lit(0))
            return _BINARY[type(node.op)](build(node.left), right)
        if isinstance(node, ast.UnaryOp) and type(node.op) in _UNARY:
            return _UNARY[type(node.op)](build(node.operand))
        if isinstance(node, ast.Compare) and all(type(op) in _COMPARE for op in node.ops):
            sides = [build(x) for x in (node.left, *node.comparators)]
            out = None
            for op, a, b in zip(node.ops, sides, sides[1:], strict=False):
                one = _COMPARE[type(op)](a, b)
                out = one if out is None else out & one
            return out
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and not node.keywords:
            found = FUNCTIONS.get(node.func.id)
            if found is None:
                raise unknown("function", node.func.id, sorted(FUNCTIONS))
            least, most, make = found
            if not least <= len(node.args) <= most:
                raise DataError(f"{node.func.id}() takes {least} to {most} arguments.")
            if node.func.id in ("factorial", "comb", "perm") and any(isinstance(a, ast.Constant) and isinstance(a.value, int) and a.value > MOST_FACTORIAL for a in node.args):
                raise DataError(f"{node.func.id}() is limited to arguments up to {MOST_FACTORIAL:,}.")
            return make(*map(build, node.args))
        raise DataError(f"Not allowed in an expression: {type(node).__name__}")

    return build(tree)


def format_result(value: Column, base: str = "dec", precision: int = 12) -> Column:
    """A number as text: ``precision`` significant digits, or a whole one in hex, bin or oct."""
    if base == "hex":
        return F.concat(F.lit("0x"), F.lower(F.hex(value.cast("long"))))
    if base == "bin":
        return F.concat(F.lit("0b"), F.bin(value.cast("long")))
    if base == "oct":
        return F.concat(F.lit("0o"), F.conv(value.cast("string"), 10, 8))
    if base != "dec":
        raise DataError(f"Unknown base {base!r}.")
    whole = F.when((F.abs(value) < 1e15) & (value == F.floor(value)), F.floor(value).cast("string"))
    digits = F.greatest(F.lit(0), F.lit(precision - 1) - F.floor(F.log10(F.abs(value.cast("double"))))).cast("int")
    return F.coalesce(whole, F.regexp_replace(F.regexp_replace(F.round(value.cast("double"), digits).cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", ""))
