"""Settings and their rules; a plan with an illegal combination is refused before any DataFrame is built."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from enum import Enum
from types import MappingProxyType

#: Source properties that each engine refuses.
REFUSED_SHARE = (
    "enable.auto.commit",
    "auto.commit.interval.ms",
    "group.instance.id",
    "isolation.level",
    "partition.assignment.strategy",
    "auto.offset.reset",
    "interceptor.classes",
    "session.timeout.ms",
    "heartbeat.interval.ms",
    "group.protocol",
    "group.remote.assignor",
)
REFUSED_CLASSIC = ("enable.auto.commit", "auto.commit.interval.ms", "share.acknowledgement.mode", "share.acquire.mode", "interceptor.classes", "group.remote.assignor")
#: Properties that a broker's source can't do without.
REQUIRED = ("bootstrap.servers", "group.id")
#: Delays up to this many milliseconds are slept by the worker that failed.
INLINE_LIMIT_MS = 1000


class Engine(str, Enum):
    SHARE = "share"
    CLASSIC = "classic"


class Ordering(str, Enum):
    UNORDERED = "unordered"
    KEY = "key"
    PARTITION = "partition"


class Guarantee(str, Enum):
    LOCAL = "local"
    STRICT = "strict"


class Outcome(str, Enum):
    ACCEPT = "accept"
    RELEASE = "release"
    REJECT = "reject"


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@dataclass(frozen=True)
class RetryPolicy:
    """Back-off and what counts as retriable. ``retriable`` lists error classes; None: all. ``parents`` maps a class to its superclass."""

    max_attempts: int = 3
    initial_ms: int = 100
    multiplier: float = 2.0
    jitter: float = 0.2
    retriable: tuple[str, ...] | None = None
    parents: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        _need(self.max_attempts >= 0, "max_attempts must not be negative")
        _need(self.initial_ms > 0, "initial_ms must be positive")
        _need(math.isfinite(self.multiplier) and self.multiplier >= 1, "multiplier must be finite and at least 1")
        _need(0 <= self.jitter <= 1, "jitter must be between 0 and 1")
        object.__setattr__(self, "parents", MappingProxyType(dict(self.parents)))

    @classmethod
    def none(cls) -> RetryPolicy:
        """Nothing is retried: every failure is a reject."""
        return cls(max_attempts=0, initial_ms=1, multiplier=1.0, jitter=0.0, retriable=())

    def matching(self) -> tuple[str, ...]:
        """The retriable classes with all their known subclasses."""
        found = set(self.retriable or ())
        while more := {c for c, p in self.parents.items() if p in found} - found:
            found |= more
        return tuple(sorted(found))


@dataclass(frozen=True)
class DeadLetterConfig:
    suffix: str = ".DLT"
    prefix: str = "ledger-dlt-"
    stack_trace: bool = False
    stack_trace_bytes: int = 4096
    producer: Mapping[str, str] = field(default_factory=lambda: {"acks": "all"})

    def __post_init__(self) -> None:
        _need(bool(self.producer), "producer properties are required")
        object.__setattr__(self, "producer", MappingProxyType(dict(self.producer)))


@dataclass(frozen=True)
class BarrierConfig:
    """How long a batch waits for its slowest record."""

    enabled: bool = False
    percentile: float = 0.99
    multiplier: float = 3.0
    window: int = 1024
    warm_up: int = 100
    poll_timeout_ms: int = 1000
    least_ms: int = 1000
    lock_ms: int | None = None
    broker_lock_ms: int = 30_000

    def __post_init__(self) -> None:
        _need(0 < self.percentile < 1, "percentile must lie between 0 and 1")
        _need(math.isfinite(self.multiplier) and self.multiplier >= 1, "multiplier must be finite and at least 1")

    @property
    def ceiling_ms(self) -> int:
        """Unset: 80 % of the broker's lock; set: as it is."""
        return self.lock_ms if self.lock_ms is not None else self.broker_lock_ms * 80 // 100

    @property
    def lock_is_unsafe(self) -> bool:
        return self.lock_ms is not None and self.lock_ms >= self.broker_lock_ms

    @property
    def floor_ms(self) -> int:
        return max(self.least_ms, self.poll_timeout_ms)


def _parsed(key: str, value: str, kind: str):
    """A text setting as the number, truth value or list of names that its field holds."""
    text = value.strip()
    try:
        if kind.startswith("bool"):
            return {"true": True, "false": False}[text.lower()]
        if kind.startswith("tuple"):
            return tuple(x.strip() for x in text.split(",") if x.strip())
        return float(text) if kind.startswith("float") else int(text)
    except (KeyError, ValueError):
        raise ValueError(f"setting {key}: {value!r} isn't of kind {kind}") from None


@dataclass(frozen=True)
class DeliveryConfig:
    """One consumer's settings. A topic is required."""

    topic: str
    engine: Engine = Engine.SHARE
    ordering: Ordering = Ordering.UNORDERED
    guarantee: Guarantee | None = None
    concurrency: int = 50
    shards: int | None = None
    poll_timeout_ms: int = 1000
    lock_ms: int = 30_000
    drain_ms: int = 30_000
    handler_timeout_ms: int | None = None
    max_poll_records: int | None = None
    properties: Mapping[str, str] = field(default_factory=dict)
    retry: RetryPolicy = field(default_factory=RetryPolicy.none)
    dead_letters: DeadLetterConfig | None = None
    barrier: BarrierConfig = field(default_factory=BarrierConfig)

    def __post_init__(self) -> None:
        _need(bool(self.topic.strip()), "topic must not be blank")
        for name in ("concurrency", "poll_timeout_ms", "lock_ms", "drain_ms"):
            _need(getattr(self, name) > 0, f"{name} must be positive")
        _need(self.shards is None or self.shards > 0, "shards must be positive")
        _need(self.handler_timeout_ms is None or self.handler_timeout_ms > 0, "handler_timeout_ms must be positive")
        share = self.engine == Engine.SHARE
        _need(not share or self.ordering == Ordering.UNORDERED, "the share engine is unordered")
        _need(self.guarantee != Guarantee.STRICT or self.ordering != Ordering.UNORDERED, "unordered delivery has no strict guarantee")
        _need(share or self.handler_timeout_ms is None, "handler_timeout_ms is for the share engine")
        _need(share or not self.barrier.enabled, "the adaptive barrier is for the share engine")
        _need(not share or self.max_poll_records is None or self.max_poll_records <= self.concurrency, "a poll must not exceed the concurrency")
        for key in REFUSED_SHARE if share else REFUSED_CLASSIC:
            _need(key not in self.properties, f"property {key} is not supported by the {self.engine.value} engine")
        object.__setattr__(self, "properties", MappingProxyType(dict(self.properties)))

    def for_broker(self) -> DeliveryConfig:
        """This configuration, if it has what a broker needs: its servers and a consumer group."""
        for key in REQUIRED:
            _need(bool(self.properties.get(key, "").strip()), f"property {key} is required")
        return self

    @classmethod
    def from_settings(cls, settings: Mapping[str, str], prefix: str = "ledger.") -> DeliveryConfig:
        """From flat text settings (``ledger.topic``, ``ledger.concurrency``, ``ledger.retry.max-attempts``, ``ledger.properties.group.id``).

        Names are in kebab case; a name that stands for nothing, or a value that doesn't parse, is refused.
        """
        own, retry, barrier, properties = {}, {}, {}, {}
        parse = {"engine": lambda v: Engine(v.lower()), "ordering": lambda v: Ordering(v.lower()), "guarantee": lambda v: Guarantee(v.lower()), "topic": str}
        for key, value in settings.items():
            if not key.startswith(prefix):
                continue
            name = key[len(prefix) :]
            part, _, rest = name.partition(".")
            if part == "properties" and rest:
                properties[rest] = value
            elif part in ("retry", "barrier") and rest:
                field_name = rest.replace("-", "_")
                known = {f.name: f.type for f in fields(RetryPolicy if part == "retry" else BarrierConfig)}
                _need(field_name in known and field_name != "parents", f"unknown setting {key}")
                (retry if part == "retry" else barrier)[field_name] = _parsed(key, value, known[field_name])
            else:
                field_name = name.replace("-", "_")
                known = {f.name: f.type for f in fields(cls) if f.name not in ("properties", "retry", "dead_letters", "barrier")}
                _need(field_name in known, f"unknown setting {key}")
                try:
                    own[field_name] = parse[field_name](value) if field_name in parse else _parsed(key, value, known[field_name])
                except ValueError as e:
                    raise ValueError(f"setting {key}: {e}") from None
        if retry:
            own["retry"] = RetryPolicy(**retry)
        if barrier:
            own["barrier"] = BarrierConfig(**barrier)
        _need("topic" in own, f"setting {prefix}topic is required")
        return cls(**own, properties=properties)

    @property
    def shard_count(self) -> int:
        return self.shards or self.concurrency * 4

    @property
    def poll_size(self) -> int:
        return self.max_poll_records or self.concurrency

    @property
    def effective_guarantee(self) -> Guarantee:
        return self.guarantee or (Guarantee.LOCAL if self.ordering == Ordering.UNORDERED else Guarantee.STRICT)
