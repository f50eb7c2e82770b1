"""User handlers: column expressions first, Arrow batches where code is opaque, and a registry of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow.config import DeliveryConfig

#: A handler over a batch: returns outcome (null: accept) and error (null: none) for every row.
BatchHandler = Callable[[pd.DataFrame], pd.DataFrame]


def apply_columns(records: DataFrame, outcome: Column, error: Column) -> DataFrame:
    """A handler as expressions; stays inside generated code."""
    return records.withColumn("outcome", outcome).withColumn("error", error)


def apply_batches(records: DataFrame, handler: BatchHandler) -> DataFrame:
    """A Python handler over Arrow batches. If a batch raises, its halves are tried, and so on, so that one bad row fails alone.

    One failing row in n costs some 2 log n further calls. Rows beside it are handled again: handlers must be repeatable, as in any redelivery.
    """
    schema = T.StructType([*records.schema.fields, T.StructField("outcome", T.StringType()), T.StructField("error", T.StringType())])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            got = handler(pdf)
            return pdf.assign(outcome=got["outcome"].to_numpy(), error=got["error"].to_numpy())
        except Exception as e:
            if len(pdf) == 1:
                return pdf.assign(outcome=None, error=f"{type(e).__name__}: {e}")
            half = len(pdf) // 2
            return pd.concat([one(pdf.iloc[:half]), one(pdf.iloc[half:])])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield one(pdf)

    return records.mapInPandas(run, schema)


def manual_outcome(ack: Column, error: Column) -> Column:
    """What a handler that acknowledges by hand decides: its acknowledgement stands, even if it throws afterwards.

    Without one an error goes to retry, and a plain return releases the record.
    """
    return F.when(ack.isNotNull(), F.lower(ack)).when(error.isNotNull(), "retry").otherwise("release")


def apply_manual_columns(records: DataFrame, ack: Column, error: Column) -> DataFrame:
    """A handler with explicit acknowledgements (null: none) as expressions."""
    return apply_columns(records, manual_outcome(ack, error), F.when(ack.isNull(), error))


def apply_manual_batches(records: DataFrame, handler: BatchHandler) -> DataFrame:
    """A Python handler whose ``outcome`` is its acknowledgement (null: none given)."""
    done = apply_batches(records, handler)
    return done.withColumn("outcome", manual_outcome(F.col("outcome"), F.col("error")))


@dataclass(frozen=True)
class Registered:
    name: str
    config: DeliveryConfig
    handler: BatchHandler


class Registry:
    """Handlers by name: ``@registry.handler(config)``. One handler per name."""

    def __init__(self) -> None:
        self.known: dict[str, Registered] = {}

    def handler(self, config: DeliveryConfig, name: str | None = None) -> Callable[[BatchHandler], BatchHandler]:
        def add(f: BatchHandler) -> BatchHandler:
            key = name or f.__name__
            if key in self.known:
                raise ValueError(f"{key} is registered already")
            self.known[key] = Registered(key, config, f)
            return f

        return add

    def start_all(self, start: Callable[[Registered], object]) -> list:
        """Start a query for each handler; if one fails, those started are stopped again."""
        running: list = []
        try:
            for r in self.known.values():
                running.append(start(r))
        except Exception:
            for q in reversed(running):
                q.stop()
            raise
        return running
