"""Counter-based normal numbers (H6, H7): a pure function of (seed, segment, step).

The digest of the three gives two uniform numbers, and Box–Muller a normal one.  So the noise
of a segment's week is the same under any partitioning, order or number of cores, and
different steps and segments are independent.  The column, the numpy caller's scalar and
the DuckDB expression give the same numbers.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGITS = 13  # hexadecimal digits of a uniform number: 52 bits
_SIZE = float(1 << 4 * _DIGITS)


def normal(seed: int, segment: Column, step: Column) -> Column:
    """Standard normal number of each (segment, step); a null segment counts as an empty name."""
    name = F.coalesce(segment.cast("string"), F.lit(""))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), name, step.cast("int").cast("string")).cast("binary"))

    def uniform(at: int) -> Column:
        return (F.conv(F.substring(digest, at, _DIGITS), 16, 10).cast("double") + 0.5) / _SIZE

    return F.sqrt(-2 * F.log(uniform(1))) * F.cos(2 * math.pi * uniform(1 + _DIGITS))


def normal_value(seed: int, segment: str | None, step: int) -> float:
    """The same number for one (segment, step)."""
    digest = hashlib.md5(f"{seed}:{segment if segment is not None else ''}:{step}".encode()).hexdigest()
    u, v = ((int(digest[at:at + _DIGITS], 16) + 0.5) / _SIZE for at in (0, _DIGITS))
    return math.sqrt(-2 * math.log(u)) * math.cos(2 * math.pi * v)


def normal_sql(seed: int, segment: str, step: str) -> str:
    """The same number as a DuckDB expression."""
    digest = f"md5('{seed}:' || coalesce({segment}, '') || ':' || ({step})::int::varchar)"

    def uniform(at: int) -> str:
        return f"((('0x' || substr({digest}, {at}, {_DIGITS}))::bigint::double + 0.5) / {_SIZE!r})"

    return f"(sqrt(-2 * ln({uniform(1)})) * cos(2 * pi() * {uniform(1 + _DIGITS)}))"
