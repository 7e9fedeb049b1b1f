"""How values look where they are compared as text: numbers in their shortest general form."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "<nil>"


def render(value: Any) -> str:
    """On the driver: 100000, 1e+06, 0.5, 1e-05, true, <nil>."""
    if value is None:
        return MISSING
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return _number(float(value))
    if isinstance(value, (list, tuple)):
        return "[" + " ".join(map(render, value)) + "]"
    return str(value)


def _number(x: float) -> str:
    if x != x:
        return "NaN"
    if x in (float("inf"), float("-inf")):
        return "+Inf" if x > 0 else "-Inf"
    if x == 0:
        return "-0" if str(x)[0] == "-" else "0"
    digits, exponent = "", 0
    for n in range(18):  # the fewest digits that give the number back
        digits, e = f"{x:.{n}e}".split("e")
        if float(f"{digits}e{e}") == x:
            exponent = int(e)
            break
    if exponent < -4 or exponent >= 6:
        return f"{digits}e{'-' if exponent < 0 else '+'}{abs(exponent):02d}"
    return f"{x:.{max(0, len(digits.lstrip('-').replace('.', '')) - 1 - exponent)}f}"


def render_number(x: Column) -> Column:
    """The same for a double column; null stays null."""
    s = x.cast("string")
    mantissa = F.regexp_replace(F.split_part(s, F.lit("E"), F.lit(1)), r"\.0$", "")
    exponent = F.split_part(s, F.lit("E"), F.lit(2)).try_cast("int")
    scientific = F.concat(mantissa, F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    tiny = F.concat(sign, F.lit("0.000"), F.regexp_replace(mantissa, r"[-.]", ""))  # exponent -4
    plain = F.regexp_replace(s, r"\.0$", "")
    million = F.concat(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"^(-?\d)(\d{6})\.", "$1.$2"), r"0+$", ""), r"\.$", ""), F.lit("e+06"))
    middle = (F.abs(x) >= 1e-3) & (F.abs(x) < 1e6)  # most numbers: whole ones as integers, others as they are
    return (
        F.when(middle, F.when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(s))
        .when(F.isnan(x), F.lit("NaN")).when(x == float("inf"), F.lit("+Inf")).when(x == float("-inf"), F.lit("-Inf"))
        .when(exponent.isNotNull() & (exponent == -4), tiny).when(exponent.isNotNull(), scientific)
        .when(F.abs(x) >= 1e6, million).otherwise(plain)
    )
