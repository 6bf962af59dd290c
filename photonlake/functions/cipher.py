"""The type-2 calibration keystream: a linear congruence with one period, so a table and a join can apply it."""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# Fixed values of the format.
MULTIPLIER, INCREMENT, MODULUS = 1597, 51749, 244944


@cache
def keystream(size: int, seed: int = 0) -> np.ndarray:
    """The first `size` key bytes; states repeat with the modulus's full period, so at most one period is stepped through."""
    out = np.empty(min(size, MODULUS), np.uint8)
    state = seed
    for i in range(len(out)):
        state = ((MULTIPLIER * state) % (1 << 32) + INCREMENT) % (1 << 32) % MODULUS
        out[i] = state * 256 // MODULUS
    return np.resize(out, size)


def decrypt(payload: bytes, seed: int) -> bytes:
    return (np.frombuffer(payload, np.uint8) ^ keystream(len(payload), seed)).tobytes()


def keystream_table(spark: SparkSession, size: int, seed: int = 0) -> DataFrame:
    """(k, key): the key byte at each phase, `size` rows, at most one period of them."""
    return spark.createDataFrame(pd.DataFrame({"k": np.arange(size), "key": keystream(size, seed).astype(np.int64)}))
