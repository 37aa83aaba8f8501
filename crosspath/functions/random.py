"""Counter-based random numbers from built-in functions.

Each number is a function of (seed, draw, stream) only, so draws do not change with
partitioning, retries or cluster size, as they would with rand()/randn().
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, draw: Column, stream: str) -> Column:
    """Uniform in (0, 1) on a grid of 2^32 values."""
    key = F.concat_ws(":", F.lit(str(seed)), draw.cast("string"), F.lit(stream))
    word = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double")
    return (word + 0.5) / 4294967296.0


def normal(seed: int, draw: Column, stream: str) -> Column:
    """Standard normal by the Box-Muller transform of two uniforms."""
    radius = F.sqrt(F.ln(uniform(seed, draw, stream + "a")) * -2.0)
    return radius * F.cos(uniform(seed, draw, stream + "b") * (2 * pi))


def uniform_index(seed: int, draw: Column, n: Column) -> Column:
    """Uniform integer in 0..n-1."""
    return F.floor(uniform(seed, draw, "0") * n)
