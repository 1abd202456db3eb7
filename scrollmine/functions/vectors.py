"""Vector functions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def l2_distance(a: Column | str, b: Column | str) -> Column:
    """Euclidean distance of two arrays of one length, summed in double precision."""
    square = lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(F.zip_with(a, b, square), F.lit(0.0), lambda s, x: s + x))


def normalized(v: Column | str) -> Column:
    """The vector at length one, as floats; a zero vector stays."""
    v = F.col(v) if isinstance(v, str) else v
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x).cast("float"))


def to_bytes(vector) -> bytes:
    """Little-endian 32-bit floats."""
    return np.asarray(vector, "<f4").tobytes()


def from_bytes(blob: bytes) -> list[float]:
    if len(blob) % 4:
        raise ValueError(f"a vector of 32-bit floats can't have {len(blob)} bytes")
    return np.frombuffer(blob, "<f4").tolist()


def decoded(blob: Column | str, dimensions: int) -> Column:
    """The array<float> in a binary column of `dimensions` little-endian 32-bit floats; null for any other length.

    Sign, exponent and fraction are taken from the bits, so no Python runs.
    """
    blob = F.col(blob) if isinstance(blob, str) else blob
    text = F.hex(blob)

    def value(i: Column) -> Column:
        pair = lambda k: F.substring(text, i * 8 + 2 * k + 1, F.lit(2))
        bits = F.conv(F.concat(pair(3), pair(2), pair(1), pair(0)), 16, 10).cast("long")
        sign = F.when(bits.bitwiseAND(F.lit(1 << 31)) != 0, -1.0).otherwise(1.0)
        exponent, fraction = F.shiftright(bits, 23).bitwiseAND(F.lit(255)), bits.bitwiseAND(F.lit((1 << 23) - 1))
        normal = (1 + fraction / float(1 << 23)) * F.pow(F.lit(2.0), (exponent - 127).cast("double"))
        small = fraction / float(1 << 23) * F.pow(F.lit(2.0), F.lit(-126.0))
        odd = F.when(fraction == 0, float("inf")).otherwise(float("nan"))
        return (sign * F.when(exponent == 255, odd).when(exponent == 0, small).otherwise(normal)).cast("float")

    return F.when(F.octet_length(blob) == 4 * dimensions, F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), value))
