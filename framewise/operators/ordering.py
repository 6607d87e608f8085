"""Positions, predecessors and running sums in one order of a whole table.

A window without a partition would send every row to one task.  Here the table
is sorted by ranges of the order and written once, so that every later step
sees the same ranges; windows then run within a range, and one row for each
range carries what the next ones need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from framewise.storage import stored

PART, AT = "_part", "_at"
#: ``AT`` holds the place within a range in its lower bits, as monotonically_increasing_id does.
_PLACE = (1 << 33) - 1


def _running(value: Column) -> Column:
    """The sum of ``value`` up to each row of a range, in the order in which its task writes them."""

    def sums(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        total = 0
        for batch in batches:
            upto = np.cumsum(batch.fill_null(0).to_numpy(zero_copy_only=False)) + total
            total = int(upto[-1]) if len(upto) else total
            yield pa.array(upto, pa.int64())

    return F.arrow_udf(sums, "long").asNondeterministic()(value.cast("long"))


class Ordered:
    """``df`` in the order of ``keys`` (columns or expressions, unique together).

    There are as many ranges as shuffle partitions, so what is broadcast below
    has one row for each of them.  ``sums`` are values whose running sums within a
    range are written with its rows, for :meth:`placed`; so rows do not move again.
    ``more`` are settings of that write.
    """

    def __init__(self, df: DataFrame, *keys: Column | str, name: str = "ordered", sums: dict[str, Column] | None = None, more: dict[str, str] | None = None) -> None:
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        at = F.monotonically_increasing_id()
        sorted_ = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn(PART, F.spark_partition_id()).withColumn(AT, at)
        self.sums = tuple(sums or {})
        self.rows = stored(sorted_.withColumns({k: _running(v) for k, v in sums.items()}) if sums else sorted_, name, more)

    def placed(self, name: str | None = None) -> DataFrame:
        """The rows with the ``sums`` over the whole table, up to and with each row, and with their number ``name``.  No row moves."""
        inner = {k: F.col(k) for k in self.sums} | ({} if name is None else {name: F.col(AT).bitwiseAND(F.lit(_PLACE)) + F.lit(1)})
        before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # of one row a range
        ends = self.rows.groupBy(PART).agg(*(F.max_by(v, AT).alias(f"_sum_{k}") for k, v in inner.items()))
        ends = ends.select(PART, *(F.coalesce(F.sum(f"_sum_{k}").over(before), F.lit(0)).alias(f"_before_{k}") for k in inner))
        return self._joined(self.rows, ends).withColumns({k: (v + F.col(f"_before_{k}")).cast("long") for k, v in inner.items()}).drop(*(f"_before_{k}" for k in inner))

    @property
    def within(self) -> WindowSpec:
        return Window.partitionBy(PART).orderBy(AT)

    def _joined(self, rows: DataFrame, summary: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(summary), PART)

    def running_sums(self, values: dict[str, Column], rows: DataFrame | None = None) -> DataFrame:
        """The rows with the sum of each value, by name, up to and with each row."""
        rows = self.rows if rows is None else rows
        before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # of one row a range
        sums = rows.groupBy(PART).agg(*(F.sum(v).alias(f"_sum_{k}") for k, v in values.items()))
        sums = sums.select(PART, *(F.coalesce(F.sum(f"_sum_{k}").over(before), F.lit(0)).alias(f"_before_{k}") for k in values))
        up_to = self.within.rowsBetween(Window.unboundedPreceding, 0)
        joined = self._joined(rows.withColumns({k: F.sum(v).over(up_to) for k, v in values.items()}), sums)
        return joined.withColumns({k: (F.col(k) + F.col(f"_before_{k}")).cast("long") for k in values}).drop(*(f"_before_{k}" for k in values))

    def running_sum(self, value: Column, name: str, rows: DataFrame | None = None) -> DataFrame:
        return self.running_sums({name: value}, rows)

    def row_number(self, name: str) -> DataFrame:
        return self.placed(name).drop(PART, AT)

    def lag(self, columns: dict[str, str], keep: tuple[str, ...] | None = None) -> DataFrame:
        """The rows (or their columns ``keep``) with the values of the row before: ``columns`` maps new names to old ones; null at the first row."""
        keep = tuple(c for c in self.rows.columns if c not in (PART, AT)) if keep is None else keep
        one = F.struct(*(F.col(c).alias(new) for new, c in columns.items()))
        ends = self.rows.groupBy(PART).agg(F.max(AT).alias(AT))
        last = self.rows.join(F.broadcast(ends.select(AT)), AT).select(PART, one.alias("_last"))
        last = last.select(PART, F.lag("_last").over(Window.orderBy(PART)).alias("_last"))  # of one row a range
        rows = self.rows.withColumn("_prev", F.lag(one).over(self.within))
        prev = F.coalesce("_prev", "_last")
        return self._joined(rows, last).select(PART, AT, *keep, *(prev[new].alias(new) for new in columns))


def value_ranks(df: DataFrame, *values: Column) -> list[DataFrame]:
    """For each of ``values`` a table ``value, below, upto, total`` of its distinct values: rows with a lesser one, with at most it, and all rows.

    All are counted and ordered together.  The values are doubles and not null.
    """
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("of"), v.alias("value")) for i, v in enumerate(values))))
    counts = df.select(each.alias("_one")).groupBy("_one.of", "_one.value").agg(F.count("*").alias("n"))
    ordered = Ordered(counts, "of", "value", name="ranks", sums={"upto": F.col("n")})
    total = ordered.rows.where("of = 0").agg(F.sum("n")).first()[0] or 0
    upto = F.col("upto") - F.col("of") * F.lit(total)  # the values before this one had all rows each
    summed = ordered.placed().select("of", "value", "n", upto.alias("upto"))
    return [summed.where(F.col("of") == i).select("value", (F.col("upto") - F.col("n")).alias("below"), "upto", F.lit(total).alias("total")) for i in range(len(values))]
