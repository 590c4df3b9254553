"""Text forms of numbers in rule names and messages."""

from __future__ import annotations

import math
from decimal import Decimal


def double_text(value: float | None) -> str:
    """Write a double the way the JVM does: ``5000.0``, ``1.0E-4``, ``1.2E7``, ``NaN``."""
    if value is None:
        return "null"
    value = float(value)
    if math.isnan(value):
        return "NaN"
    if math.isinf(value):
        return "Infinity" if value > 0 else "-Infinity"
    if value == 0 or 1e-3 <= abs(value) < 1e7:
        return format(Decimal(repr(value)), "f") if "e" in repr(value) else repr(value)
    sign, digits, exponent = Decimal(repr(value)).normalize().as_tuple()
    mantissa = "".join(map(str, digits))
    power = exponent + len(digits) - 1
    return f"{'-' if sign else ''}{mantissa[0]}.{mantissa[1:] or '0'}E{power}"
