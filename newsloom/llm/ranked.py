"""Places and running totals of rows within their groups, however large one group is.

A window by group would take a group with a third of all rows through one task. Here the
rows are range-sorted by group and order, each task numbers the rows of its range, and what
earlier ranges hold of a group that goes on is added afterwards: one row per range at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from newsloom.session import materialise


def _starts(batch, group, last):
    """Where a new group begins in a batch, ``last`` being the group of the row before it."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    new = np.zeros(batch.num_rows, dtype=bool)
    for i, name in enumerate(group):
        values = batch.column(name)
        new[0] |= last is None or values[0].as_py() != last[i]
        a, b = values.slice(1), values.slice(0, len(values) - 1)
        differs = pc.fill_null(pc.not_equal(a, b), pa.scalar(False))
        one_null = pc.xor(pc.is_null(a), pc.is_null(b))
        new[1:] |= pc.or_(differs, one_null).to_numpy(zero_copy_only=False)
    return new


def _running(values, new, carried, xor: bool):
    """Totals within groups up to each row; ``carried`` goes on into the first rows."""
    import numpy as np

    total = np.bitwise_xor.accumulate(values) if xor else np.cumsum(values)
    first = np.maximum.accumulate(np.where(new, np.arange(len(values)), -1))
    before = np.where(first > 0, total[first - 1], 0)
    before[first < 0] = carried if xor else -carried
    return total ^ before if xor else total - before


def _number(group: list[str], sums: list[str], xors: list[str]):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last, carried = None, {name: 0 for name in ("place", *sums, *xors)}
        for batch in batches:
            if not batch.num_rows:
                continue
            new = _starts(batch, group, last)
            last = [batch.column(name)[-1].as_py() for name in group]
            columns = {"place": _running(np.ones(len(new), np.int64), new, carried["place"], False)}
            for name in (*sums, *xors):
                values = batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)
                columns[name] = _running(values, new, carried[name], name in xors)
            carried = {name: int(values[-1]) for name, values in columns.items()}
            columns["place"] = columns["place"] - 1
            out = {f"run_{n}" if n != "place" else n: v for n, v in columns.items()}
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([part] * len(new), pa.int32()), *map(pa.array, out.values())],
                names=[*batch.schema.names, "part", *out])
    return run


def placed(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], keep: Sequence[str],
    sums: Sequence[str] = (), xors: Sequence[str] = (),
) -> DataFrame:
    """Columns ``keep`` with ``place`` from 0 in the group and, per column in ``sums`` and
    ``xors``, ``run_<name>``: its total up to and with the row.

    ``keep`` has the columns of ``group`` and those summed, whole numbers without nulls. A null
    is a group like others. Rows equal in all of ``order`` are placed as they come.
    """
    group, sums, xors = list(group), list(sums), list(xors)
    # Rows that are equal in all would share a range, whatever their number.
    by = [*[F.col(g).asc_nulls_first() for g in group], *order, F.col("_come")]
    rows = df.withColumn("_come", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by).select(*keep)
    added = ["place", *[f"run_{name}" for name in (*sums, *xors)]]
    schema = T.StructType([
        *rows.schema.fields, T.StructField("part", T.IntegerType()),
        *[T.StructField(name, T.LongType()) for name in added],
    ])
    local = materialise(rows.mapInArrow(_number(group, sums, xors), schema))

    last = [F.max_by(f"run_{name}", "place").alias(f"run_{name}") for name in (*sums, *xors)]
    ends = local.groupBy(*group, "part").agg((F.max("place") + 1).alias("place"), *last)
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = materialise(ends.select(
        *[F.col(g).alias(f"_{g}") for g in group], F.col("part").alias("_part"),
        *[(F.bit_xor if name[4:] in xors else F.sum)(name).over(earlier).alias(f"_{name}") for name in added],
    ).filter("_place is not null"))
    same = F.col("part") == F.col("_part")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))

    def whole(name: str) -> Column:
        before = F.coalesce(f"_{name}", F.lit(0))
        return F.col(name).bitwiseXOR(before) if name[4:] in xors else F.col(name) + before
    return local.join(carried, same, "left").select(*keep, *[whole(name).alias(name) for name in added])
