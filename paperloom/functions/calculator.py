"""Numeric functions as columns: sampled, exponential, stitching, and calculator programs compiled to expressions.

Inputs are clamped to the domain and outputs to the range.  A program's stack exists only while it is
compiled, so the result is one expression that the engine generates code for.
"""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

Number = Column | float | int


def _c(x: Number) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def clamp(x: Number, bounds: tuple[float, float] | None) -> Column:
    return _c(x) if bounds is None else F.greatest(F.least(_c(x).cast("double"), F.lit(float(bounds[1]))), F.lit(float(bounds[0])))


def divide(a: Column, b: Column) -> Column:
    """Division of doubles; by zero it gives an infinity, or NaN for 0/0."""
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    a, b = a.cast("double"), b.cast("double")
    at_zero = F.when(a == 0, nan).when(a > 0, inf).otherwise(-inf)
    return F.when(b == 0, at_zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


class Truth:
    """A boolean on the stack of a program: logical operators treat it otherwise than a number."""

    def __init__(self, column: Column) -> None:
        self.column = column


def _whole(x: Column) -> Column:
    """The integer part, of infinities and NaN themselves."""
    return F.when(F.abs(x) < 2.0**62, x.cast("bigint").cast("double")).otherwise(x)


def _logical(op: str):
    def work(a, b):
        if isinstance(a, Truth) and isinstance(b, Truth):
            return Truth({"and": a.column & b.column, "or": a.column | b.column, "xor": a.column != b.column}[op])
        x, y = _number(a).cast("int"), _number(b).cast("int")
        return {"and": x.bitwiseAND(y), "or": x.bitwiseOR(y), "xor": x.bitwiseXOR(y)}[op].cast("double")

    return work


def _shift(a, b) -> Column:
    x, n = _number(a).cast("int"), _number(b).cast("int")
    left, right = F.call_function("shiftleft", x, F.greatest(n, F.lit(0))), F.call_function("shiftright", x, F.greatest(-n, F.lit(0)))
    return F.when(n >= 0, left).otherwise(right).cast("double")


def _not(a):
    return Truth(~a.column) if isinstance(a, Truth) else F.bitwise_not(_number(a).cast("int")).cast("double")


def _number(x) -> Column:
    if isinstance(x, Truth):
        return F.when(x.column, 1.0).otherwise(0.0)
    return _c(float(x)) if isinstance(x, (int, float)) else x


def _test(x) -> Column:
    return x.column if isinstance(x, Truth) else _number(x) != 0


def _numeric(f):
    return lambda *values: f(*map(_number, values))


def _relation(f):
    return lambda a, b: Truth(f(_number(a), _number(b)))


_TWO = {
    "add": _numeric(lambda a, b: a + b),
    "sub": _numeric(lambda a, b: a - b),
    "mul": _numeric(lambda a, b: a * b),
    "div": _numeric(divide),
    "idiv": _numeric(lambda a, b: _whole(divide(a, b))),
    "mod": _numeric(lambda a, b: a - _whole(divide(a, b)) * b),
    "exp": _numeric(lambda a, b: F.pow(a, b)),
    "atan": _numeric(lambda a, b: F.degrees(F.atan2(a, b))),
    "eq": _relation(lambda a, b: a == b),
    "ne": _relation(lambda a, b: a != b),
    "gt": _relation(lambda a, b: a > b),
    "ge": _relation(lambda a, b: a >= b),
    "lt": _relation(lambda a, b: a < b),
    "le": _relation(lambda a, b: a <= b),
    "and": _logical("and"),
    "or": _logical("or"),
    "xor": _logical("xor"),
    "bitshift": _shift,
}
_ONE = {
    "abs": _numeric(F.abs),
    "neg": _numeric(lambda a: -a),
    "ceiling": _numeric(lambda a: F.ceil(a).cast("double")),
    "floor": _numeric(lambda a: F.floor(a).cast("double")),
    "round": _numeric(lambda a: F.floor(a + 0.5).cast("double")),
    "truncate": _numeric(_whole),
    "cvi": _numeric(_whole),
    "cvr": _numeric(lambda a: a.cast("double")),
    "sqrt": _numeric(F.sqrt),
    "ln": _numeric(F.ln),
    "log": _numeric(F.log10),
    "sin": _numeric(lambda a: F.sin(F.radians(a))),
    "cos": _numeric(lambda a: F.cos(F.radians(a))),
    "not": _not,
}


def _blocks(tokens: list[str]) -> tuple[list, int]:
    out, i = [], 0
    while i < len(tokens):
        if tokens[i] == "{":
            inner, used = _blocks(tokens[i + 1 :])
            out.append(inner)
            i += used + 2
        elif tokens[i] == "}":
            return out, i
        else:
            out.append(tokens[i])
            i += 1
    return out, i


def _constant(x) -> int:
    if not isinstance(x, (int, float)):
        raise ValueError("a stack operator needs a literal count")
    return int(x)


def program(source: str, *inputs: Number) -> list[Column]:
    """The columns that a program ``{ … }`` leaves for its inputs (booleans as 1 and 0); numbers that only the stack uses must be literals."""
    body, _ = _blocks(re.findall(r"[{}]|[^\s{}]+", source))
    return [_number(x) for x in _run(body[0] if body and isinstance(body[0], list) else body, [x if isinstance(x, (int, float)) else x.cast("double") for x in inputs])]


def _run(body: list, stack: list) -> list:
    stack = list(stack)
    pop = stack.pop
    for t in body:
        if isinstance(t, list):
            stack.append(t)
        elif t in _TWO:
            b, a = pop(), pop()
            stack.append(_TWO[t](a, b))
        elif t in _ONE:
            stack.append(_ONE[t](pop()))
        elif t in ("true", "false"):
            stack.append(Truth(F.lit(t == "true")))
        elif t == "pop":
            pop()
        elif t == "exch":
            stack[-2:] = stack[:-3:-1]
        elif t == "dup":
            stack.append(stack[-1])
        elif t == "copy":
            n = _constant(pop())
            stack += stack[len(stack) - n :]
        elif t == "index":
            stack.append(stack[-1 - _constant(pop())])
        elif t == "roll":
            j, n = _constant(pop()), _constant(pop())
            if n:
                part = stack[-n:]
                stack[-n:] = part[-(j % n) :] + part[: -(j % n)] if j % n else part
        elif t in ("if", "ifelse"):
            other = pop() if t == "ifelse" else []
            first, test = pop(), _test(pop())
            yes, no = _run(first, stack), _run(other, stack)
            if len(yes) != len(no):
                raise ValueError("both branches must leave as many values")
            stack[:] = [_either(test, a, b) for a, b in zip(yes, no)]
        else:
            stack.append(float(t))
    return stack


def _either(test: Column, a, b):
    if a is b:
        return a
    if isinstance(a, Truth) and isinstance(b, Truth):
        return Truth(F.when(test, a.column).otherwise(b.column))
    return F.when(test, _number(a)).otherwise(_number(b))


def exponential(x: Number, c0: list[float] | None = None, c1: list[float] | None = None, n: float = 1.0, domain: tuple[float, float] = (0.0, 1.0)) -> list[Column]:
    """c0 + x**n * (c1 - c0)."""
    c0, c1, x = c0 or [0.0], c1 or [1.0], clamp(x, domain)
    return [F.lit(float(a)) + F.pow(x, F.lit(float(n))) * (float(b) - float(a)) for a, b in zip(c0, c1)]


def stitching(x: Number, parts: list, bounds: list[float], encode: list[tuple[float, float]], domain: tuple[float, float] = (0.0, 1.0)) -> list[Column]:
    """Functions over neighbouring intervals; each part takes a column and gives a list of columns."""
    x = clamp(x, domain)
    edges = [domain[0], *bounds, domain[1]]
    outs = []
    for (lo, hi), (a, b), part in zip(itertools.pairwise(edges), encode, parts):
        outs.append(part(F.lit(float(a)) + (x - lo) * ((b - a) / (hi - lo)) if hi > lo else F.lit(float(a))))
    result = list(outs[-1])
    for bound, out in zip(reversed(bounds), reversed(outs[:-1])):
        result = [F.when(x < bound, o).otherwise(r) for o, r in zip(out, result)]
    return result


def sampled(inputs: list[Number], samples: list[float], size: list[int], outputs: int = 1, domain: list[tuple[float, float]] | None = None, encode: list[tuple[float, float]] | None = None, decode: list[tuple[float, float]] | None = None, most: float = 1.0) -> list[Column]:
    """Multilinear interpolation in a table of samples, the first input varying fastest."""
    domain = domain or [(0.0, 1.0)] * len(size)
    encode = encode or [(0.0, s - 1.0) for s in size]
    decode = decode or [(0.0, most)] * outputs
    table = F.array(*[F.lit(float(s)) for s in samples])
    corners = []
    for x, (lo, hi), (a, b), s in zip(inputs, domain, encode, size):
        e = clamp(F.lit(float(a)) + (clamp(x, (lo, hi)) - lo) * ((b - a) / (hi - lo)), (0.0, s - 1.0))
        i = F.least(F.floor(e), F.lit(max(s - 2, 0))).cast("int")
        corners.append((i, e - i, s))
    result = []
    for o in range(outputs):
        total = F.lit(0.0)
        for pick in itertools.product((0, 1), repeat=len(size)):
            at, weight, step = F.lit(0), F.lit(1.0), 1
            for bit, (i, f, s) in zip(pick, corners):
                at = at + F.least(i + bit, F.lit(s - 1)) * step
                weight = weight * (f if bit else 1 - f)
                step *= s
            total = total + weight * F.element_at(table, at * outputs + o + 1)
        lo, hi = decode[o]
        result.append(F.lit(float(lo)) + total * ((hi - lo) / most))
    return result
