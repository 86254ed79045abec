"""Order-preserving integer codes of doubles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MANTISSA = 10
#: Sign, exponent and the upper MANTISSA bits of the fraction.
BITS = 12 + MANTISSA


def encode(value: str | Column) -> Column:
    """The code of a double, by its order, in built-in functions: powers of two divide exactly, so nothing is rounded."""
    v = F.col(value) if isinstance(value, str) else value
    a = F.abs(v)
    guess = F.floor(F.log2(a))
    ratio = a / F.pow(F.lit(2.0), guess)
    exponent = guess + F.when(ratio >= 2, 1).when(ratio < 1, -1).otherwise(0)
    normal = (exponent + 1023) * 2**MANTISSA + F.floor((a / F.pow(F.lit(2.0), exponent) - 1) * 2**MANTISSA)
    tiny = F.floor(a * 2.0**1022 * 2**MANTISSA)
    top = F.when(a == 0, 0).when(a == float("inf"), 0x7FF << MANTISSA).when(a < 2.0**-1022, tiny).otherwise(normal)
    half = 2 ** (BITS - 1)
    return F.when(v < 0, half - 1 - top).otherwise(half + top).cast("int")


def encode_array(values: np.ndarray) -> np.ndarray:
    """Codes of an array of doubles."""
    bits = np.abs(values.astype(np.float64)).view(np.uint64)
    top = (bits >> np.uint64(52 - MANTISSA)).astype(np.int64)
    half = 2 ** (BITS - 1)
    return np.where(values < 0, half - 1 - top, half + top)


def decode_array(codes: np.ndarray) -> np.ndarray:
    """The middle of the values of each code; 0 and the infinities as they are."""
    half = 2 ** (BITS - 1)
    codes = np.asarray(codes, np.int64)
    top = np.where(codes < half, half - 1 - codes, codes - half).astype(np.uint64)
    bits = top << np.uint64(52 - MANTISSA)
    inner = (top > 0) & (top < np.uint64(0x7FF << MANTISSA))
    out = (bits | np.where(inner, np.uint64(1) << np.uint64(51 - MANTISSA), np.uint64(0))).view(np.float64)
    return np.where(codes < half, -out, out)
