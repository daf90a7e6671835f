"""Validated options of subscriptions, producers, partitions and supervisors."""

from __future__ import annotations

from dataclasses import dataclass, field


class OptionError(ValueError):
    """An option outside its bounds."""


def _integer(name: str, value, low: int, high: int | None = None) -> int:
    if isinstance(value, bool) or not isinstance(value, int):
        raise OptionError(f"{name} must be an integer, got {value!r}")
    if value < low or high is not None and value > high:
        raise OptionError(f"{name} must be at least {low}" + (f" and at most {high}" if high is not None else "") + f", got {value}")
    return value


def _one_of(name: str, value, allowed: tuple) -> None:
    if value not in allowed:
        raise OptionError(f"{name} must be one of {', '.join(map(str, allowed))}, got {value!r}")


@dataclass(frozen=True)
class SubscriptionOptions:
    """Demand of one subscription: `max_demand` events at most are outstanding; at `min_demand` or fewer, more are asked."""

    to: str = ""
    max_demand: int = 1000
    min_demand: int | None = None
    cancel: str = "permanent"
    partition: str | None = None
    selector: str | None = None

    def __post_init__(self):
        _integer("max_demand", self.max_demand, 1)
        if self.min_demand is None:
            object.__setattr__(self, "min_demand", self.max_demand // 2)
        _integer("min_demand", self.min_demand, 0, self.max_demand - 1)
        _one_of("cancel", self.cancel, ("permanent", "transient", "temporary"))

    @property
    def chunk(self) -> int:
        return self.max_demand - self.min_demand


@dataclass(frozen=True)
class ProducerOptions:
    """`buffer_size` None keeps everything; 0 is rejected, since a buffer of no events cannot be made."""

    demand: str = "forward"
    buffer_size: int | None = 10_000
    buffer_keep: str = "last"
    dispatcher: str = "demand"

    def __post_init__(self):
        _one_of("demand", self.demand, ("forward", "accumulate"))
        _one_of("buffer_keep", self.buffer_keep, ("first", "last"))
        _one_of("dispatcher", self.dispatcher, ("demand", "broadcast", "partition"))
        if self.buffer_size is not None:
            _integer("buffer_size", self.buffer_size, 1)


@dataclass(frozen=True)
class PartitionOptions:
    """Partitions by number (0 to n - 1) or by name; names need a hash expression of their own."""

    partitions: int | tuple = ()
    hash: str | None = None

    def __post_init__(self):
        if isinstance(self.partitions, int):
            _integer("partitions", self.partitions, 1)
        elif not self.partitions:
            raise OptionError("partitions are required")
        elif self.hash is None:
            raise OptionError("a hash is required where partitions are named")

    @property
    def names(self) -> list[str]:
        return [str(p) for p in (range(self.partitions) if isinstance(self.partitions, int) else self.partitions)]


@dataclass(frozen=True)
class SupervisorOptions:
    """Limits of per-event work: more than `max_restarts` restarts in `max_seconds` stop the supervisor."""

    strategy: str = "one_for_one"
    restart: str = "temporary"
    max_restarts: int = 3
    max_seconds: int = 5
    subscribe_to: list = field(default_factory=list)

    def __post_init__(self):
        _one_of("strategy", self.strategy, ("one_for_one",))
        _one_of("restart", self.restart, ("temporary", "transient"))  # permanent children cannot be supervised here
        _integer("max_restarts", self.max_restarts, 0)
        _integer("max_seconds", self.max_seconds, 1)
        if not isinstance(self.subscribe_to, list):
            raise OptionError("subscribe_to must be a list")
