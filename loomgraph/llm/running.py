"""Running totals inside groups of any size, without a group in one task.

Rows are dealt by range of (group, order), so a hot group spans many partitions.  Each
partition is read once, in order; what earlier partitions hold of its first group is added
afterwards, from a table of at most one row for each partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stash, tidy


def _walk(group: int, values: list[int], how: np.ufunc, undo: np.ufunc, names: list[str]):
    """For mapInArrow over rows sorted by column `group`: the running totals of `values` behind all columns."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry = None, [np.int64(0)] * len(values)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key = batch.column(group)
            changes = pc.not_equal(key.slice(1), key.slice(0, n - 1)).to_numpy(zero_copy_only=False).astype(bool)
            start = np.flatnonzero(np.concatenate([[key[0].as_py() != last], changes]))
            part = np.searchsorted(start, np.arange(n), side="right")  # 0 goes on with the group of the batch before
            totals = []
            for k, i in enumerate(values):
                sums = how.accumulate(batch.column(i).to_numpy())
                before = np.concatenate([[undo(np.int64(0), carry[k])], np.where(start > 0, sums[start - 1], 0)])
                totals.append(undo(sums, before[part]))
                carry[k] = totals[-1][-1]
            last = key[n - 1].as_py()
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(t, pa.int64()) for t in totals)], names=names)

    return walk


def running(rows: DataFrame, group: str, order: list[str], values: list[str], how: str = "add") -> DataFrame:
    """`rows` with a column run_<v> for each of `values` (long, no nulls): the total of its group up to the row, itself included.

    `how` is "add" or "xor"; `group` has no nulls; nulls come first in `order`.  Rows equal
    in group and order are taken one by one, in an order that may differ between runs.  The
    result is stored in the shared folder.
    """
    ufunc, undo, total, join = (np.add, np.subtract, F.sum, lambda a, b: a + b) if how == "add" else (np.bitwise_xor, np.bitwise_xor, F.bit_xor, lambda a, b: a.bitwiseXOR(b))
    names = [*rows.columns, *(f"run_{v}" for v in values)]
    walk = _walk(rows.columns.index(group), [rows.columns.index(v) for v in values], ufunc, undo, names)
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), *(f"`run_{v}` long" for v in values)])
    # where a row was read tells equal ones apart, so that they spread too
    dealt = rows.withColumn("__in", F.monotonically_increasing_id()).repartitionByRange(group, *order, "__in").sortWithinPartitions(group, *order, "__in")
    local = stash(dealt.drop("__in").mapInArrow(tidy(walk), kinds).withColumn("__part", F.spark_partition_id()))
    parts = local.groupBy(group, "__part").agg(*[total(v).alias(f"__{v}") for v in values])
    earlier = W.partitionBy(group).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    # a partition goes on with one group at most, so there are no more rows than partitions
    spans = parts.select(group, "__part", *[total(f"__{v}").over(earlier).alias(f"__{v}") for v in values]).where(F.col(f"__{values[0]}").isNotNull())
    joined = local.join(F.broadcast(spans), [group, "__part"], "left")
    return joined.select(*rows.columns, *[join(F.col(f"run_{v}"), F.coalesce(f"__{v}", F.lit(0))).alias(f"run_{v}") for v in values])


def numbered(rows: DataFrame, group: str, order: list[str], name: str = "rank") -> DataFrame:
    """`rows` with `name`: their place from 0 in `group` by `order`, as `running` orders them."""
    counted = running(rows.withColumn("__one", F.lit(1).cast("long")), group, order, ["__one"])
    return counted.select(*rows.columns, (F.col("run___one") - 1).alias(name))
