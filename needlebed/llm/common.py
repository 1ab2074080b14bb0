"""What the operators share: names that clash with nothing, the shared folder, checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from needlebed.shared import shared_dir, work_path  # noqa: F401

#: A side is broadcast only when it is known to be smaller than this.
BROADCAST_BYTES = 32 << 20


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that no column of ``df`` has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, where the loss of an executor can't reach it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_enough(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` hinted for broadcast if its measured ``rows`` of ``row_bytes`` are few, else as it is (a shuffled join)."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def id_key(c: Column) -> Column:
    """An id as a string that is never null, so that null ids compare equal without a null-safe join."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))


def need(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing; there are {df.columns}")
