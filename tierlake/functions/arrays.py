"""Array functions that Spark lacks, over whole Arrow batches, and their compositions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType


@F.arrow_udf(ArrayType(IntegerType()))
def running_sum(values: pa.Array) -> pa.Array:
    """The running sums of each array of numbers; null stays null, nulls within count as 0."""
    flat = np.cumsum(np.nan_to_num(values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64))
    sizes = np.asarray(values.value_lengths().fill_null(0)).astype(np.int64)
    ends = np.cumsum(sizes)
    before = np.append(0, flat)[ends - sizes] if len(flat) else np.zeros(len(sizes), np.int64)
    sums = (flat - np.repeat(before, sizes)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(sums), mask=values.is_null())


def ascending(a: Column) -> Column:
    """Whether an array of numbers rises strictly."""
    return F.coalesce(F.forall(F.zip_with(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), lambda x, y: x < y), lambda x: x), F.lit(True))


def deltas(a: Column) -> Column:
    """The first item and the differences that follow."""
    return F.zip_with(a, F.concat(F.array(F.lit(0).cast("int")), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))), lambda x, y: x - y)
