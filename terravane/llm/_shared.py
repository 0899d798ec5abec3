"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.session import cleanup, new_path, remove, shared_dir, ship_package, staged  # noqa: F401

SPACE = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MAX_LONG = (1 << 63) - 1


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """The wanted column names, with underscores after them where a column of that name is taken (in any case)."""
    used = {t.lower() for t in taken}
    out = []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release_memory() -> None:
    """Give freed memory of this Python worker back; workers of several stages live side by side."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, UPPER.lower())


def row_key(id_col: Column) -> Column:
    """Ids as a never-null key; a null id counts as larger than every other."""
    return F.coalesce(id_col.cast("long"), F.lit(MAX_LONG))


def slices(spark: SparkSession, least: int = 1) -> int:
    """Partitions for a shuffle of this session."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
