"""Latency windows, the adaptive barrier and forced releases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerflow.config import BarrierConfig


def latest(samples: DataFrame, keys: Sequence[str], window: int = 1024, order: str = "offset") -> DataFrame:
    """The last ``window`` samples of each key; a rank limit lets every task drop the rest before the shuffle."""
    line = Window.partitionBy(*keys).orderBy(F.desc(order))
    return samples.withColumn("_n", F.row_number().over(line)).where(F.col("_n") <= window).drop("_n")


def percentiles(samples: DataFrame, keys: Sequence[str], at: Sequence[float], value: str = "duration_ms") -> DataFrame:
    """Nearest-rank percentiles p50, p99, ..."""
    return samples.groupBy(*keys).agg(F.count("*").alias("samples"), *(F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})").cast("bigint").alias(f"p{round(q * 100)}") for q in at))


def adaptive_barrier(samples: DataFrame, keys: Sequence[str], config: BarrierConfig, value: str = "duration_ms") -> DataFrame:
    """(keys, samples, barrier_ms): flat until warmed up, then percentile times multiplier, floored, the ceiling last."""
    seen = latest(samples, keys, config.window).groupBy(*keys).agg(F.count("*").alias("samples"), F.expr(f"percentile_disc({config.percentile}) WITHIN GROUP (ORDER BY {value})").alias("p"))
    ceiling = F.lit(config.ceiling_ms).cast("bigint")
    wide = F.ceil(F.col("p") * config.multiplier).cast("bigint")
    fitted = F.least(ceiling, F.greatest(F.lit(config.floor_ms).cast("bigint"), wide))
    flat = F.lit(not config.enabled) | (F.col("samples") < config.warm_up)
    return seen.select(*keys, "samples", F.when(flat, ceiling).otherwise(fitted).alias("barrier_ms"))


def lock_alignment(lock_ms: Column, broker_ms: Column) -> tuple[Column, Column]:
    """(ceiling_ms, unsafe): an unset lock takes 80 % of the broker's, a set one is used as it is, and is unsafe if it isn't below the broker's."""
    ceiling = F.coalesce(lock_ms, F.floor(broker_ms * 80 / 100)).cast("bigint")
    return ceiling.alias("ceiling_ms"), F.coalesce(lock_ms >= broker_ms, F.lit(False)).alias("unsafe")


def drain(records: DataFrame, batch: str, barrier_ms: int) -> DataFrame:
    """Per batch: cost until all are done or the barrier ends, and how many are released as slow."""
    return records.groupBy("topic", batch).agg(F.max(F.least(F.col("duration_ms"), F.lit(barrier_ms).cast("bigint"))).alias("cost_ms"), F.count_if(F.col("duration_ms") > barrier_ms).alias("released"))
