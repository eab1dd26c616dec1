"""Counter-based uniforms that any SQL engine can replay.

u(salt, id) = (first 32 bits of md5("salt|id") + 0.5) / 2**32

For tests and replayable queries only: the stream is predictable and its tail is
cut, so it gives no privacy. Releases draw from `operators.noise.SecureNoise`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 4294967296.0


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def key(salt: str, *ids) -> Column:
    """The md5 text behind a uniform; also a sort key for exact-size samples."""
    return F.md5(F.concat_ws("|", F.lit(salt), *[_col(i).cast("string") for i in ids]))


def uniform(salt: str, *ids) -> Column:
    return (F.conv(F.substring(key(salt, *ids), 1, 8), 16, 10).cast("bigint") + 0.5) / SCALE


def discrete_laplace(scale: float, salt: str, *ids) -> Column:
    """Difference of two geometric draws with parameter 1 - exp(-1 / scale)."""
    a, b = uniform(salt + "+", *ids), uniform(salt + "-", *ids)
    return (F.floor(-scale * F.log(1 - a)) - F.floor(-scale * F.log(1 - b))).cast("bigint")


def gaussian(salt: str, *ids) -> Column:
    """Standard normal by Box and Muller."""
    return F.sqrt(-2 * F.log(uniform(salt + "r", *ids))) * F.cos(2 * math.pi * uniform(salt + "a", *ids))


def sql_key(salt: str, *ids: str) -> str:
    return f"md5(concat_ws('|', '{salt}', {', '.join(f'CAST({i} AS VARCHAR)' for i in ids)}))"


def sql_uniform(salt: str, *ids: str) -> str:
    return f"((CAST('0x' || substr({sql_key(salt, *ids)}, 1, 8) AS BIGINT) + 0.5) / {SCALE})"


def sql_discrete_laplace(scale: float, salt: str, *ids: str) -> str:
    a, b = sql_uniform(salt + "+", *ids), sql_uniform(salt + "-", *ids)
    return f"CAST(floor(-{scale!r} * ln(1 - {a})) - floor(-{scale!r} * ln(1 - {b})) AS BIGINT)"
