"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Every document of a source expects ``target / source size`` copies (times its own weight, if it has one). The whole part is certain.
For the rest, documents are ranked by their random odds u/(1-u) over the odds of their fractional part, and
taken in that order as long as they fit in the words still missing from the target. What the first that doesn't fit leaves open
is filled, in the same order, from shorter documents behind it, and at last by the one document whose length is nearest to the room left, if it brings the words closer.

Ranks are cut into intervals whose word sums are small tables, so a source that holds a third
of all rows is never sorted as one group: only the one interval in which the target falls is ordered row by row. There are
more intervals when there are more rows; how many never changes what is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerflow.llm.common import Workspace

#: Source weights by order of the source's name, repeating (fixed by the contract).
WEIGHTS = (5, 2, 1)
#: A source's words are taken at most so many times.
MOST_COPIES = 3
#: Least number of intervals of the Pareto rank, and intervals for the square root of the rows beyond it: with n rows, both the
#: intervals of a source and the rows of one interval stay in the order of the square root of n.
INTERVALS, PER_ROOT = 4096, 16
#: Times that a source's documents are gone through: what a round leaves open is filled from shorter documents in the next.
ROUNDS = 2
#: Most sources whose targets and edges are broadcast (some 100 bytes each); beyond it they are joined by a shuffle.
BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def uniform(key: Column, seed: str) -> Column:
    """In [0, 1), from the key alone: 52 bits of an MD5, so that reruns and other engines agree."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), key.cast("string"))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target): shares of all words by weight, capped at ``most`` times a source's size.

    Sources in code-point order, null last, get ``weights`` in turn. The excess over a cap goes to the others by weight until none is above.
    In the order of cap / weight the capped sources come first, so prefix sums find them without iterating.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long")
    s = by_source.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    s = s.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / F.sum("weight").over(after).cast("double"))
    s = s.withColumn("capped", F.col("weight") * F.col("level") > F.col("cap"))
    level = F.min(F.when(~F.col("capped"), F.struct((F.col("cap") / F.col("weight")).alias("k"), F.col("source").isNull().alias("last"), "source", F.col("level").alias("level")))).over(everything)["level"]
    return s.withColumn("open", level).select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("open")).alias("target"))


def _edges(rows: DataFrame, rest: str) -> DataFrame:
    """(of, at, done, room) per source: the interval in which the words of ``rows`` (source, cell, size, ``rest``) exceed ``rest`` (null: none does), and the words before it."""
    cells = rows.groupBy("source", "cell").agg(F.sum("size").alias("words"), F.first(rest).alias("rest"))
    upto = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    over = F.when(F.col("through") > F.col("rest"), F.struct("cell", (F.col("through") - F.col("words")).alias("done")))
    edge = cells.withColumn("through", F.sum("words").over(upto)).groupBy("source").agg(F.min(over).alias("e"), F.sum("words").alias("whole"), F.first("rest").alias("room"))
    return edge.select(F.col("source").alias("of"), F.col("e.cell").alias("at"), F.coalesce("e.done", "whole").alias("done"), "room")


def _running() -> Column:
    """Words up to a row in the Pareto order of one interval; rows that repeat an id and a size have one rank, so they are taken together or not at all."""
    return F.sum("size").over(Window.partitionBy("source").orderBy("odds", "id", "size").rangeBetween(Window.unboundedPreceding, Window.currentRow))


def _open(k: int) -> Column:
    """Rows that round ``k`` may take: all with a fractional part first, then those that fit in what is left open."""
    some = F.col("cell").isNotNull() & F.col(f"gap{k}").isNotNull()
    #: Behind the rounds, a document of less than twice the room brings the words closer.
    fits = F.col("size") < F.col(f"gap{k}") * 2 if k == ROUNDS else F.col("size") <= F.col(f"gap{k}")
    return some & (F.col("size") > 0) & fits if k else some


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: str = "mix", keep_row: bool = False
) -> DataFrame:
    """One row per document: id, source, size (words), source_size, target, copies, taken (size * copies), and row (all columns of ``docs``) if ``keep_row``.

    ``weight_col`` (0 or more; null: 0) makes documents of a source unequally likely; without it all are equal.
    No document is taken more than ``most`` times. A null text has size 0, a null source is a source of its own. Equal ranks go by id, then size; rows that repeat
    an id and a size share a rank and are taken together or not at all, other rows that repeat an id are sampled one by one. Documents with no words are taken with the certain copies only, or not at all; that changes no sum.
    Other columns are ignored; an empty table gives an empty result.
    """
    work = Workspace(docs.sparkSession, "mix-sources")
    own = F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)) if weight_col else F.lit(1.0)
    whole = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] * keep_row
    sized = docs.select(*whole, F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), own.alias("own"))
    sized = work.save(sized, "sizes")
    n = sized.count()
    intervals = max(INTERVALS, 1 << (int(PER_ROOT * n**0.5)).bit_length())
    targets = source_targets(sized, weights, most)

    def by_source(rows: DataFrame, small: DataFrame) -> DataFrame:
        """``rows`` with the columns of their source's row in ``small``; whole rows aren't shuffled unless there are too many sources to broadcast."""
        return rows.join(F.broadcast(small) if few else small, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")

    if weight_col:
        scale = sized.groupBy("source").agg((F.sum(F.col("own") * F.col("size"))).alias("mass"))
        rate = targets.join(scale.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))).select("source", "source_size", "target", (F.col("target") / F.nullif(F.col("mass"), F.lit(0.0))).alias("rate"))
    else:
        rate = targets.withColumn("rate", F.col("target") / F.nullif(F.col("source_size"), F.lit(0)))
    rate = work.save(rate.withColumnRenamed("source", "of"), "rates")
    few = rate.count() <= BROADCAST_SOURCES

    def ranked(rows: DataFrame) -> DataFrame:
        rows = by_source(rows, rate)
        expect = F.least(F.lit(float(most)), F.coalesce(F.col("rate"), F.lit(0.0)) * F.col("own"))
        rows = rows.withColumn("expect", expect).withColumn("base", F.floor("expect")).withColumn("p", F.col("expect") - F.col("base"))
        rows = rows.withColumn("u", uniform(F.coalesce(F.col("id").cast("string"), F.lit("null")), seed))
        rows = rows.withColumn("odds", F.when(F.col("p") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))))
        return rows.withColumn("cell", F.floor(F.col("odds") / (1 + F.col("odds")) * intervals).cast("int")).drop("own", "u", "expect", "p", "rate")

    #: What the ranking itself needs of a row; whole rows are ranked once, at the end.
    slim = work.save(ranked(sized.select("id", "source", "size", "own")), "ranks")
    ends = slim.groupBy("source").agg((F.first("target") - F.sum(F.col("base") * F.col("size"))).alias("gap0"))
    ends = work.save(ends.withColumnRenamed("source", "of"), "ends")
    rank = F.struct("odds", "id", "size")

    def taken(rounds: int) -> Column:
        """Whether one of the first ``rounds`` rounds takes a row, given its source's row of ``ends``."""
        out = F.lit(False)
        for k in range(rounds):
            ahead = F.col(f"at{k}").isNull() | (F.col("cell") < F.col(f"at{k}")) | ((F.col("cell") == F.col(f"at{k}")) & (rank <= F.col(f"last{k}")))
            out = out | F.coalesce(_open(k) & ahead, F.lit(False))
        return out

    for k in range(ROUNDS):
        rows = by_source(slim, ends).where(_open(k) & ~taken(k)).select("id", "source", "size", "odds", "cell", f"gap{k}")
        edge = _edges(rows, f"gap{k}")
        last = by_source(rows, edge).where("cell = at").withColumn("sum", F.col("done") + _running()).where("sum <= room")
        last = last.groupBy("source").agg(F.max(rank).alias(f"last{k}"), F.max("sum").alias("full"))
        edge = edge.join(last, F.col("of").eqNullSafe(F.col("source")), "left").select(F.col("of").alias("of2"), F.col("at").alias(f"at{k}"), f"last{k}", (F.col("room") - F.coalesce("full", "done")).alias(f"gap{k + 1}"))
        ends = ends.join(edge, F.col("of").eqNullSafe(F.col("of2")), "left").drop("of2")
        ends = work.save(ends.withColumn(f"gap{k + 1}", F.coalesce(f"gap{k + 1}", f"gap{k}")), "ends")
    off = F.abs(F.col("size") - F.col(f"gap{ROUNDS}"))
    left = by_source(slim, ends).where(_open(ROUNDS) & ~taken(ROUNDS)).groupBy("source").agg(F.min_by(rank, F.struct(off.alias("off"), "odds", "id", "size")).alias("one"))
    ends = work.save(ends.join(left, F.col("of").eqNullSafe(F.col("source")), "left").drop("source"), "ends")
    picked = taken(ROUNDS) | F.coalesce(rank == F.col("one"), F.lit(False))
    rows = by_source(ranked(sized) if keep_row else slim, ends).withColumn("copies", F.col("base") + picked.cast("long"))
    return rows.select("id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), *["row"] * keep_row)
