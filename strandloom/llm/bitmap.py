"""A bitmap of fixed size over ids, to keep rows that cannot match out of a shuffle.

It lets through every id that was put in and a few others, so results do not depend on it; it
holds BITS bits whatever the data, and where more ids than that are put in it only filters less.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 25


def slot(col: str) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(BITS))


def bitmap(df: DataFrame, col: str) -> np.ndarray:
    """The bitmap of a column's values: BITS / 64 words at most come to the driver."""
    at = slot(col)
    words = (
        df.select(F.shiftright(at, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int")).alias("b"))
        .groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    )
    out = np.zeros(BITS // 64, dtype=np.int64)
    out[words["w"].to_numpy(dtype=np.int64)] = words["b"].to_numpy(dtype=np.int64)
    return out.view(np.uint64)


def inside(slots: pa.Array, words: np.ndarray) -> np.ndarray:
    """Which slots the bitmap has; a null id has the slot of any other value."""
    at = slots.to_numpy(zero_copy_only=False).astype(np.int64)
    return (words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def only(df: DataFrame, col: str, bits: np.ndarray, there: bool = True) -> DataFrame:
    """The rows whose id may be in the bitmap, or those whose id is not."""
    shared = df.sparkSession.sparkContext.broadcast(bits)

    def kernel(batches):
        for batch in batches:
            last = batch.num_columns - 1
            rest = pa.RecordBatch.from_arrays(batch.columns[:last], names=batch.schema.names[:last])
            yield rest.filter(pa.array(inside(batch.column(last), shared.value) == there))

    return df.withColumn("__slot", slot(col)).mapInArrow(kernel, df.schema)


def split_by(df: DataFrame, col: str, bits: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """(rows whose id may be in the bitmap, rows whose id is not)."""
    return only(df, col, bits), only(df, col, bits, False)
