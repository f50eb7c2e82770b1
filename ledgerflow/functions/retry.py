"""Retry decisions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerflow.config import INLINE_LIMIT_MS, RetryPolicy


def backoff_ms(policy: RetryPolicy, attempt: Column) -> Column:
    """Whole milliseconds before the next try, at least 1; attempts count from 0."""
    return F.greatest(F.lit(1).cast("bigint"), (F.lit(float(policy.initial_ms)) * F.pow(F.lit(policy.multiplier), attempt)).cast("bigint"))


def jittered_ms(delay: Column, jitter: float, seed: int | None = None) -> Column:
    """Times a factor uniform in [1 - jitter, 1 + jitter), at least 1; no jitter leaves the delay alone."""
    if not jitter:
        return delay
    return F.greatest(F.lit(1).cast("bigint"), (delay * (1 - jitter + 2 * jitter * F.rand(seed))).cast("bigint"))


def effective_attempt(attempt: Column, delivery_count: Column, slowness: Column) -> Column:
    """The larger of the in-process count and the redeliveries not caused by slowness; never their sum."""
    return F.greatest(attempt, F.greatest(F.lit(0), F.coalesce(delivery_count, F.lit(1)) - 1 - slowness))


def is_retriable(policy: RetryPolicy, error_class: Column, classifier: Column | None = None) -> Column:
    """A classifier overrides the class list; an empty list retries nothing."""
    if classifier is not None:
        return classifier
    if policy.retriable is None:
        return F.lit(True)
    return error_class.isin(*policy.matching()) if policy.retriable else F.lit(False)


def decision(policy: RetryPolicy, attempt: Column, retriable: Column, delay: Column | None = None) -> Column:
    """reject, exhausted, inline or delayed; the inline limit includes its bound and holds after jitter."""
    wait = backoff_ms(policy, attempt) if delay is None else delay
    return F.when(~retriable, "reject").when(attempt >= policy.max_attempts, "exhausted").when(wait <= INLINE_LIMIT_MS, "inline").otherwise("delayed")


def publish_backoff_ms(tries: Column, base_ms: int = 1000, cap_ms: int = 30_000) -> Column:
    """Wait before try ``tries`` (from 0) of a failed dead-letter publish: doubling up to a cap."""
    return F.least(F.lit(cap_ms).cast("bigint"), (F.lit(base_ms) * F.pow(F.lit(2.0), F.least(tries, F.lit(30)))).cast("bigint"))
