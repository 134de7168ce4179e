"""Band arithmetic and 8-bit encodings of index values in [-1, 1]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Target ranges of the narrow integer types.
NARROW = {"uint8": 256, "uint16": 65536}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def water_index(green: Column | str, nir: Column | str, empty: float | None = None) -> Column:
    """(green - nir) / (green + nir); a pixel without signal is NULL, or `empty` if given."""
    g, n = col(green).cast("double"), col(nir).cast("double")
    index = F.try_divide(g - n, g + n)
    return index if empty is None else F.coalesce(index, F.lit(empty))


def encode_floor(x: Column | str) -> Column:
    """Index to 0..255, one step is 1/128, the top value clamps. NULL and NaN give NULL."""
    x = col(x)
    valid = x.isNotNull() & ~F.isnan(x.cast("double"))
    return F.when(valid, F.least(F.floor((x + 1) * 128), F.lit(255)).cast("int"))


def encode_trunc(x: Column | str) -> Column:
    """Index to 1..255, one step is 1/127, zero sits at 128. NULL and NaN give NULL."""
    x = col(x)
    valid = x.isNotNull() & ~F.isnan(x.cast("double"))
    return F.when(valid, (x * 127 + 128).cast("int"))


def decode_floor(t: Column | str) -> Column:
    """Inverse of encode_floor for thresholds."""
    return col(t) / 128.0 - 1


def decode_trunc(t: Column | str) -> Column:
    """Inverse of encode_trunc for thresholds."""
    return (col(t) - 128) / 127.0


def decode_yen(t: Column | str) -> Column:
    """Scale of the Yen threshold, which pairs neither encoding."""
    return (col(t) - 127) / 128.0


def at_least(x: Column | str, threshold: Column | float) -> Column:
    """1 where x >= threshold, else 0. No value and NaN give 0 (Spark itself sorts NaN above all numbers)."""
    x = col(x)
    return F.when(F.isnan(x.cast("double")), 0).otherwise(F.coalesce((x >= threshold).cast("int"), F.lit(0)))


def narrow(x: Column | str, dtype: str) -> Column:
    """Cast as array libraries do: drop the fraction, wrap around the integer range."""
    if dtype in NARROW:
        return F.pmod(col(x).try_cast("bigint"), F.lit(NARROW[dtype])).cast("int")
    return col(x).try_cast({"float32": "float", "float64": "double"}[dtype])


def midpoint_scale(x: Column | str, low: float, middle: float, high: float) -> Column:
    """Two linear pieces: low -> 0, middle -> 0.5, high -> 1, flat outside; NULL and NaN become NULL."""
    x = col(x).cast("double")
    piece = F.when(x <= middle, (x - low) / (middle - low) * 0.5).otherwise(0.5 + (x - middle) / (high - middle) * 0.5)
    return F.when(x.isNotNull() & ~F.isnan(x), F.least(F.greatest(piece, F.lit(0.0)), F.lit(1.0)))


def masked_label(label: Column | str, band: Column | str) -> Column:
    """Labels are void where the image has no data."""
    return F.when(col(band) == 0, F.lit(0)).otherwise(col(label))
