"""Exact deduplication: a tree merge of digest runs, in DataFrame operations only.

Every input partition is a run of digests. In round r the runs that differ only in digit r of their
number (base FAN_IN) are merged: equal digests become one entry with the best row and the sum of the
counts. After the last round one logical run is left, which stays spread over all tasks by digest.
Then the winners go back down the same tree, so that an entry only ever meets the entries of the
runs that were merged into it. A text with a third of all copies is one entry per run at the first
level and at most FAN_IN entries per key in all others.

A run is ordered by the 64-bit hash of the text; entries with equal hashes are verified by SHA-256
and byte length before they count as equal, at every level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import ROW
from strandline.session import settled

FAN_IN = 16
KEY = ["_hash", "_sha", "_len"]


def digests(df: DataFrame, text: Column, ident: Column, row: Column | None = None) -> DataFrame:
    """Settled (_row, _id, _run, _hash, _sha, _len): one row for each row of df; a null text counts as empty."""
    whole = F.coalesce(text, F.lit(""))
    return settled(
        df.select(
            (F.monotonically_increasing_id() if row is None else row).alias(ROW), ident.alias("_id"),
            F.spark_partition_id().alias("_run"), F.xxhash64(whole).alias("_hash"),
            F.sha2(whole, 256).alias("_sha"), F.octet_length(whole).alias("_len"),
        ),
        "digests",
    )


def classes(rows: DataFrame, largest: bool = False, fan_in: int = FAN_IN) -> DataFrame:
    """rows (of digests, written) with keep_row, keep_id, group_size and kept. Ids may be of any type that has an order.

    The row with the smallest _id stays (largest: the largest); null ids come last; of equal ids the
    row with the smallest _row stays, so exactly one row of every group is kept even among repeated rows.
    """
    best = F.struct((F.col("_id").isNotNull() if largest else F.col("_id").isNull()).alias("null"), F.col("_id").alias("id"), (-F.col(ROW) if largest else F.col(ROW)).alias("row"))
    pick = F.max if largest else F.min
    runs = (rows.agg(F.max("_run")).first()[0] or 0) + 1
    level = rows.groupBy("_run", *KEY).agg(pick(best).alias("_best"), F.count("*").alias("_n"))
    levels = [level]
    while runs > 1:
        runs = -(-runs // fan_in)
        merged = levels[-1].withColumn("_run", F.floor(F.col("_run") / fan_in).cast("int"))
        levels.append(merged.groupBy("_run", *KEY).agg(pick("_best").alias("_best"), F.sum("_n").alias("_n")))
    # Only groups of two and more travel down again.
    down = levels.pop().where("_n > 1")
    for level in reversed(levels):
        child = level.select(F.col("_run").alias("_child"), F.floor(F.col("_run") / fan_in).cast("int").alias("_run"), *KEY)
        down = child.join(down, ["_run", *KEY]).select(F.col("_child").alias("_run"), *KEY, "_best", "_n")
    found = rows.join(down, ["_run", *KEY], "left")
    keep_row = F.coalesce(-F.col("_best.row") if largest else F.col("_best.row"), ROW)
    keep_id = F.when(F.col("_best").isNull(), F.col("_id")).otherwise(F.col("_best.id"))
    return found.select(*rows.columns, keep_row.alias("keep_row"), keep_id.alias("keep_id"), F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"), (keep_row == F.col(ROW)).alias("kept"))


def exact_duplicates(docs: DataFrame, text: str = "text", ident: str = "doc_id", largest: bool = False) -> DataFrame:
    """One row per row of docs: ident, keep_id, group_size, kept, text_sha256.

    Nulls: a null text equals an empty one; a null id stays only if all ids of its group are null.
    Repeated rows: one of them is kept. Empty table: no rows. Other columns are never read.
    """
    rows = digests(docs, F.col(text), F.col(ident))
    found = classes(rows, largest)
    return found.select(F.col("_id").alias(ident), "keep_id", "group_size", "kept", F.col("_sha").alias("text_sha256"))


def without_duplicates(docs: DataFrame, text: str = "text", ident: str = "doc_id", largest: bool = False) -> DataFrame:
    """The rows of docs that stay, with all their columns unchanged, whatever their names; nulls and repeated rows as above."""
    from strandline.llm.common import among, keyed

    whole = keyed(docs)
    rows = digests(whole, F.col(f"_doc.`{text}`"), F.col(f"_doc.`{ident}`"), F.col(ROW))
    gone = classes(rows, largest).where("not kept").select(ROW)
    return among(whole, gone, inside=False).select("_doc.*")
