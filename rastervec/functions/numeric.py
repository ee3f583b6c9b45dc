"""Rounding and defaults as in ECMAScript."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def js_round(c: Column) -> Column:
    return F.floor(c + 0.5)


def truthy_or(c: Column, default) -> Column:
    """The default also stands in for zero."""
    return F.when(c.isNull() | (c == 0) | F.isnan(c.cast("double")), F.lit(default)).otherwise(c)


def fixed_text(value: float, digits: int) -> str:
    """The exact binary value at so many digits, ties away from zero."""
    text = str(Decimal(value).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return text[1:] if text[0] == "-" and not any(d in text for d in "123456789") and value == 0 else text


def fixed_texts(values: np.ndarray, digits: int) -> list[str]:
    """fixed_text() of many: printing rounds the exact value and differs in ties only."""
    form = f"%.{digits}f"
    out = [form % v for v in (values + 0.0).tolist()]
    for i in np.flatnonzero(np.abs(values) * 10.0**digits % 1 == 0.5):
        out[i] = fixed_text(float(values[i]), digits)
    return out


def to_fixed(c: Column, digits: int) -> Column:
    """Text of doubles, a batch at a time."""

    @F.arrow_udf("string")
    def fixed(v: pa.Array) -> pa.Array:
        own = v.fill_null(0.0).to_numpy(zero_copy_only=False)
        return pa.array(fixed_texts(own, digits), pa.string(), mask=v.is_null().to_numpy(zero_copy_only=False))

    return fixed(c.cast("double"))


def points_fixed(points: Column, digits: int) -> Column:
    """An array of points to an array of (x, y) as text, all points of a batch in one go."""

    @F.arrow_udf("array<struct<x:string,y:string>>")
    def fixed(v: pa.Array) -> pa.Array:
        flat, n = v.flatten(), pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False)
        texts = [pa.array(fixed_texts(flat.field(c).to_numpy(zero_copy_only=False), digits), pa.string()) for c in ("x", "y")]
        at = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
        return pa.ListArray.from_arrays(at, pa.StructArray.from_arrays(texts, ["x", "y"]), mask=v.is_null())

    return fixed(points)
