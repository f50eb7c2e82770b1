"""Running sums and maxima of lanes of any length: blocks are folded alone, then the folds of the blocks before are added."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Values of the ordering column that make a block. A task sorts one block's rows, not a lane's.
BLOCK = 1 << 17


def running_sum(rows: DataFrame, keys: Sequence[str], order: str, value: str, block: int = BLOCK) -> DataFrame:
    """Adds ``running``: the sum of ``value`` up to the row, in the order of an integer column whose values differ within ``keys``.

    Neither ``keys`` nor that column may be null, as in the coordinates of records; a null value adds nothing.
    """
    return _running(rows, keys, order, value, block, F.sum, lambda a, b: F.coalesce(a + b, a, b))


def running_max(rows: DataFrame, keys: Sequence[str], order: str, value: str, block: int = BLOCK) -> DataFrame:
    """Adds ``running``: the maximum of ``value`` up to the row, likewise."""
    return _running(rows, keys, order, value, block, F.max, F.greatest)


def running_last(rows: DataFrame, keys: Sequence[str], order: str, value: str, block: int = BLOCK) -> DataFrame:
    """Adds ``running``: the last ``value`` that isn't null up to the row, and ``before``: the same up to the row before it."""
    cut, inside, bases = _blocks(rows, keys, order, block, F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))), lambda fold, before: F.last(fold, ignorenulls=True).over(before))
    here = F.last(value, ignorenulls=True)
    line = Window.partitionBy(*keys, "_block").orderBy(order)
    joined = cut.join(bases, [*keys, "_block"])
    return joined.withColumns({"running": F.coalesce(here.over(inside), "_base"), "before": F.coalesce(here.over(line.rowsBetween(Window.unboundedPreceding, -1)), "_base")}).drop("_block", "_base")


def previous(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, block: int = BLOCK) -> DataFrame:
    """Adds ``before``: ``value`` (not null) of the row before in the order of ``order``, of which the first is an integer that makes the blocks."""
    rank = F.struct(*order)
    cut, _, bases = _blocks(rows, keys, order[0], block, F.max_by(value, rank), lambda fold, before: F.last(fold, ignorenulls=True).over(before))
    line = Window.partitionBy(*keys, "_block").orderBy(*order)
    return cut.join(bases, [*keys, "_block"]).withColumn("before", F.coalesce(F.lag(value).over(line), "_base")).drop("_block", "_base")


def _blocks(rows: DataFrame, keys: Sequence[str], order: str, block: int, fold, carry):
    """(rows with their block, the window of a block up to a row, what the blocks before carry into each)."""
    cut = rows.withColumn("_block", F.col(order) - F.pmod(order, F.lit(block)))
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return cut, inside, cut.groupBy(*keys, "_block").agg(fold.alias("_fold")).select(*keys, "_block", carry(F.col("_fold"), before).alias("_base"))


def _running(rows: DataFrame, keys: Sequence[str], order: str, value: str, block: int, fold, both) -> DataFrame:
    cut, inside, bases = _blocks(rows, keys, order, block, fold(value), lambda x, before: fold(x).over(before))
    joined = cut.join(bases, [*keys, "_block"])
    return joined.withColumn("running", both(F.col("_base"), fold(value).over(inside))).drop("_block", "_base")
