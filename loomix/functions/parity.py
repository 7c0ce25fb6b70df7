"""One-line functions, one for each construct of the lowering rules."""

from __future__ import annotations

from ..serve import native_udf


@native_udf()
def add_mul(x: int, y: int) -> int:
    return x * y + 1


@native_udf()
def sub_neg(x: int) -> int:
    return 1 - -x


# Of bigints beyond 2**53 Python's quotient is rounded once, Spark's after both sides are.
@native_udf(inputs=["int", "int"])
def truediv(x: int, y: int) -> float:
    return x / y


@native_udf()
def eq_zero(x: int) -> bool:
    return x == 0


@native_udf()
def ne_zero(x: int) -> bool:
    return x != 0


@native_udf()
def less_five(x: int) -> bool:
    return x < 5


@native_udf()
def py_and(a: bool, b: bool) -> bool:
    return a and b


@native_udf()
def py_or(a: bool, b: bool) -> bool:
    return a or b


@native_udf()
def not_x(a: bool) -> bool:
    return not a


@native_udf()
def ternary(x: int) -> int:
    return 1 if x else 2


@native_udf()
def nested_if(x: int, y: int) -> int:
    if x <= 0:
        return 3
    return 1 if y > 0 else 2


@native_udf()
def chained(x: int) -> bool:
    return 0 < x < 10


@native_udf()
def str_lt(a: str, b: str) -> bool:
    return a < b


@native_udf()
def str_eq(a: str, b: str) -> bool:
    return a == b


@native_udf()
def str_or(s: str, t: str) -> str:
    return s or t


@native_udf()
def square(x: int) -> int:
    return x**2


@native_udf()
def shifted(x: int) -> int:
    return (x << 3) + (x >> 2)


@native_udf(inputs=["int", "int"])
def ratio_or_zero(x: int, y: int) -> float:
    try:
        return x / y
    except ZeroDivisionError:
        return 0.0


@native_udf()
def circle(r: float) -> float:
    import math

    return math.pi * r * r
