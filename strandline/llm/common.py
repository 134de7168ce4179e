"""Helpers the operators share: row identities, skew-proof attaching of group values, Arrow batches.

Internal columns start with an underscore and two letters of their own, and every operator first
selects what it needs, so extra columns of the input never meet them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.session import settled

ROW = "_row"
#: Rows in an Arrow batch: whole texts travel in it, so it is kept small.
BATCH_ROWS = 256
#: Parts into which a key is split before its rows meet.
SALTS = 32


def keyed(df: DataFrame, *columns: str | Column, label: str = "rows") -> DataFrame:
    """Columns of df with a unique _row, written once so that every later read sees the same identities.

    Without columns, all columns of df come packed as _doc, so none of them can meet an internal name.
    """
    columns = columns or (F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_doc"),)
    return settled(df.select(*columns, F.monotonically_increasing_id().alias(ROW)), label)


def among(df: DataFrame, rows: DataFrame, inside: bool = True) -> DataFrame:
    """Rows of df whose _row is one of rows (inside False: is none of them); numbers as keyed gives them.

    The numbers travel as bitmaps, one bit a row of df, so they are broadcast up to a very large table
    and the texts of df stay where they are.
    """
    maps = settled(rows.groupBy(F.bitmap_bucket_number(ROW).alias("_bn")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(ROW)).alias("_bits")), "bitmaps")
    byte = F.conv(F.hex(F.substring("_bits", (F.col("_bp") / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    found = F.coalesce(F.getbit(byte, (F.col("_bp") % 8).cast("int")) == 1, F.lit(False))
    placed = df.select("*", F.bitmap_bucket_number(ROW).alias("_bn"), F.bitmap_bit_position(ROW).alias("_bp"))
    return placed.join(maps, "_bn", "inner" if inside else "left").where(found if inside else ~found).select(*[F.col(f"`{c}`") for c in df.columns])


def training_row(doc_id: Column, parts: int) -> Column:
    """crc32 of doc_id as text modulo parts; a null doc_id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches small enough for whole texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(fn, schema)


def attach(df: DataFrame, keys: list[str], salt: Column, aggs: dict[str, tuple[Callable, Column]], salts: int = SALTS, having: str = "true") -> DataFrame:
    """df with an aggregate of its group (null keys form a group): name -> (aggregate that may be applied twice, column).

    Rows of groups for which having (over the aggregates, prefixed _ag_) does not hold are left out.

    A group value is formed per (key, salt), then per key, and travels back the same way: no join
    meets more than one row per salt on the small side, and the rows of a hot key spread over all salts.
    """
    names = [f"_ky{i}" for i in range(len(keys))]
    salted = df.select("*", *[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.pmod(F.xxhash64(salt), F.lit(salts)).alias("_salt"))
    part = salted.groupBy(*names, "_salt").agg(*[fn(col).alias(f"_ag_{n}") for n, (fn, col) in aggs.items()])
    whole = part.groupBy(*names).agg(*[fn(F.col(f"_ag_{n}")).alias(f"_ag_{n}") for n, (fn, _) in aggs.items()]).where(having)
    back = _join(part.select(*names, "_salt"), whole, names)
    out = _join(salted, back, [*names, "_salt"])
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"_ag_{n}").alias(n) for n in aggs])


def _join(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    """Equi-join in which nulls are equal."""
    renamed = right.select(*[F.col(n).alias(f"{n}_r") if n in names else F.col(n) for n in right.columns])
    on = None
    for n in names:
        same = F.col(n).eqNullSafe(F.col(f"{n}_r"))
        on = same if on is None else on & same
    return left.join(renamed, on).drop(*[f"{n}_r" for n in names])
