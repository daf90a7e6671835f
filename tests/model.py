"""A brute-force model of the rules that depend on the interleaving of asks, dispatches and cancels: one step for each row of a log.

The DataFrame forms are compared with it.  One log order is one legal interleaving.
"""

from __future__ import annotations

from bisect import insort
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

from sluice.operators.batching import split_message
from sluice.options import SubscriptionOptions

class Buffer:
    """Events that wait for demand, and messages (infos) that wait behind them."""

    def __init__(self, size: int | None, keep: str = "last"):
        if size is not None and size < 1:
            raise ValueError("a buffer holds one event at least")
        self.size, self.keep, self.events, self.behind, self.next = size, keep, deque(), {}, 0

    def __len__(self) -> int:
        return len(self.events)

    def store(self, events: list) -> tuple[int, list]:
        """(events discarded, infos that lost the event they waited for)."""
        lost, freed = 0, []
        for e in events:
            if self.size is not None and len(self.events) >= self.size:
                lost += 1
                if self.keep == "first":
                    continue
                freed += self.behind.pop(self.events.popleft()[0], [])
            self.events.append((self.next, e))
            self.next += 1
        return lost, freed

    def info(self, message) -> bool:
        """Wait behind the last event, or behind a message that was put back to the front; False where there is neither."""
        if self.events:
            self.behind.setdefault(self.events[-1][0], []).append(message)
        elif getattr(self, "front", None):
            self.front.append(message)
        else:
            return False
        return True

    def take(self, n: int) -> tuple[int, list, list]:
        """(demand left, events, infos): up to n events, no further than one that infos wait for."""
        out = []
        while n and self.events:
            at, e = self.events.popleft()
            out.append(e)
            n -= 1
            if at in self.behind:
                if self.size is None and not n:  # an unbounded buffer keeps infos as entries: met only with demand left
                    self.held = self.behind.pop(at)
                    self._refile()
                    return n, out, []
                return n, out, self.behind.pop(at)
        return n, out, []

    def _refile(self) -> None:
        """Infos that are now at the front: they stand before the next event."""
        self.front = [*getattr(self, "front", []), *self.held]

    def pop_front(self) -> list:
        front, self.front = getattr(self, "front", []), []
        return front


class DemandState:
    """Greedy to the largest demand; credit for demand that was asked upstream and lost its consumer."""

    def __init__(self):
        self.demands: list[tuple[int, str]] = []
        self.pending = 0

    def _put(self, n: int, sub: str) -> None:
        insort(self.demands, (n, sub), key=lambda x: -x[0])

    def _pull(self, sub: str) -> int:
        at = next(i for i, (_, s) in enumerate(self.demands) if s == sub)
        return self.demands.pop(at)[0]

    def subscribe(self, sub: str, **_) -> int:
        self.demands.append((0, sub))
        return 0

    def ask(self, n: int, sub: str) -> tuple[int, list]:
        self._put(self._pull(sub) + n, sub)
        paid = min(self.pending, n)
        self.pending -= paid
        return n - paid, []

    def cancel(self, sub: str) -> tuple[int, list]:
        self.pending += self._pull(sub)
        return 0, []

    def dispatch(self, events: list) -> tuple[list, list]:
        out = []
        while events and self.demands and self.demands[0][0] > 0:
            n, sub = self.demands.pop(0)
            now, events = events[:n], events[n:]
            out.append(("deliver", sub, now))
            self._put(n - len(now), sub)
        self.pending = max(0, self.pending - len(events))
        return events, out

    def info(self, message) -> list:
        return [("info", None, [message])]

    def state(self):
        return [[n, s] for n, s in self.demands], self.pending


class BroadcastState:
    """All events to all subscribers, as far as the slowest has asked."""

    def __init__(self):
        self.extra: list[list] = []  # [demand above the common one, sub, predicate]
        self.waiting = self.requested = 0

    def _sync(self) -> int:
        common = max(0, min(x[0] for x in self.extra)) if self.extra else 0
        for x in self.extra:
            x[0] -= common
        self.waiting += common
        more = max(0, self.waiting - self.requested)
        self.requested += more
        return more

    def subscribe(self, sub: str, selector=None, consumer: str | None = None, **_) -> int:
        who = consumer or sub
        if any(x[3] == who for x in self.extra):
            raise ValueError("already_subscribed")
        for x in self.extra:
            x[0] += self.waiting
        self.waiting = 0
        self.extra.insert(0, [0, sub, selector, who])
        return 0

    def ask(self, n: int, sub: str) -> tuple[int, list]:
        at = next(i for i, x in enumerate(self.extra) if x[1] == sub)
        entry = self.extra.pop(at)
        entry[0] += n
        self.extra.insert(0, entry)
        return self._sync(), []

    def cancel(self, sub: str) -> tuple[int, list]:
        self.extra = [x for x in self.extra if x[1] != sub]
        if self.extra:
            return self._sync(), []
        self.waiting = 0
        return 0, []

    def dispatch(self, events: list) -> tuple[list, list]:
        k = min(self.waiting, len(events))
        now, left, out = events[:k], events[k:], []
        for _, sub, test, _ in self.extra if k else []:
            mine = [e for e in now if test is None or test(e)]
            if mine:
                out.append(("deliver", sub, mine))
            if len(mine) < k:
                out.append(("reask", sub, k - len(mine)))
        self.waiting -= k
        self.requested -= k
        return left, out

    def info(self, message) -> list:
        return [("info", None, [message])]

    def state(self):
        return [[x[0], x[1]] for x in self.extra], self.waiting, self.requested


class PartitionState:
    """One consumer for each partition; a partition that is behind has a queue in place of a demand."""

    def __init__(self, names: list[str], where):
        """where: event -> (event, partition name or None)."""
        self.where, self.subs, self.waiting, self.pending = where, {}, 0, 0
        self.partitions = {str(p): [None, 0] for p in names}  # [sub, demand or queue]
        self.infos: dict[int, list] = {}
        self.count = 0

    def subscribe(self, sub: str, partition: str | None = None, **_) -> int:
        if partition is None:
            raise ValueError("a partition is required")
        if str(partition) not in self.partitions:
            raise ValueError(f"unknown partition {partition}")
        entry = self.partitions[str(partition)]
        if entry[0] is not None:
            raise ValueError(f"partition {partition} is taken by {entry[0]}")
        entry[0] = sub
        self.subs[sub] = str(partition)
        return 0

    def _ack(self, number: int) -> list:
        self.infos[number][1] -= 1
        return [("info", None, [self.infos.pop(number)[0]])] if not self.infos[number][1] else []

    def ask(self, n: int, sub: str) -> tuple[int, list]:
        entry, out, now, left = self.partitions[self.subs[sub]], [], [], n
        if isinstance(entry[1], int):
            entry[1] += n
        else:
            queue = entry[1]
            while queue and left:  # a message at the head waits for the next ask
                kind, x = queue.popleft()
                if kind == "info":
                    if now:
                        out.append(("deliver", sub, now))
                        now = []
                    out += self._ack(x)
                else:
                    now.append(x)
                    left -= 1
            if now:
                out.append(("deliver", sub, now))
            if not queue and left:
                entry[1] = left
        paid = min(self.pending, n)
        self.pending -= paid
        self.waiting += n - paid
        return n - paid, out

    def cancel(self, sub: str) -> tuple[int, list]:
        entry = self.partitions[self.subs.pop(sub)]
        rest, entry[0], entry[1] = entry[1], None, 0
        if isinstance(rest, int):
            self.pending += rest
            return 0, []
        lost = [x for kind, x in rest if kind == "event"]
        out = [o for kind, x in rest if kind == "info" for o in self._ack(x)]
        self.waiting += len(lost)
        return len(lost), [("dropped", sub, lost), *out] if lost else out

    def dispatch(self, events: list) -> tuple[list, list]:
        mine: dict[str, list] = {}
        for at, e in enumerate(events):
            if not self.waiting:
                break
            e, p = self.where(e)
            if p is not None:
                if str(p) not in self.partitions:
                    raise ValueError(f"unknown partition {p}")
                mine.setdefault(str(p), []).append(e)
                self.waiting -= 1
        else:
            at = len(events)
        out = []
        for p, new in mine.items():
            entry = self.partitions[p]
            if isinstance(entry[1], int):
                now, rest = new[: entry[1]], new[entry[1] :]
                entry[1] -= len(now)
                if now:
                    out.append(("deliver", entry[0], now))
                if not entry[1]:
                    entry[1] = deque(("event", e) for e in rest)
            else:
                entry[1].extend(("event", e) for e in new)
        return list(events[at:]), out

    def info(self, message) -> list:
        behind = [x for x in self.partitions.values() if not isinstance(x[1], int)]
        if not behind:
            return [("info", None, [message])]
        self.count += 1
        self.infos[self.count] = [message, len(behind)]
        for x in behind:
            x[1].append(("info", self.count))
        return []

    def state(self):
        return self.waiting, self.pending


@dataclass
class Producer:
    """A producer stage: its dispatcher, its buffer and its demand mode."""

    dispatcher: object
    buffer: Buffer
    mode: str = "forward"
    subs: set = field(default_factory=set)
    later: list = field(default_factory=list)

    def step(self, op: str, sub=None, n=0, events=(), opts=None) -> list[tuple]:
        """Outputs (op, sub, number or events) of one log row."""
        opts = opts or {}
        if op == "subscribe":
            if sub in self.subs:
                return [("cancelled", sub, ["duplicated_subscription"])]
            out = self.step("cancel", opts["current"], events=["resubscribe"]) if opts.get("current") else []
            self.subs.add(sub)
            try:
                self.dispatcher.subscribe(sub, **{k: v for k, v in opts.items() if k in ("partition", "selector", "consumer")})
            except ValueError as e:
                self.subs.discard(sub)
                return [*out, ("cancelled", sub, [str(e)])]
            return out
        if op == "ask":
            if sub not in self.subs:
                return [("cancelled", sub, ["unknown_subscription"])]
            if n < 0:
                raise ValueError("a negative demand")
            return self._asked(*self.dispatcher.ask(n, sub)) if n else []
        if op == "cancel":
            if sub not in self.subs:
                return []
            self.subs.discard(sub)
            return [("cancelled", sub, list(events) or ["cancel"]), *self._asked(*self.dispatcher.cancel(sub))]
        if op == "dispatch":
            return self._dispatch(list(events))
        if op == "info":
            return [] if self.buffer.info(events[0]) else self.dispatcher.info(events[0])
        if op == "mode":
            if sub == "accumulate":
                self.mode = sub
                return []
            if sub != "forward":
                raise ValueError(f"unknown mode {sub}")
            self.mode, later, self.later, out = "forward", self.later, [], []
            for kind, x in later:
                out += self._serve(x) if kind == "demand" else self._dispatch(x)
            return out
        raise ValueError(f"unknown op {op}")

    def _asked(self, n: int, out: list) -> list:
        return [*out, *self._serve(n)]

    def _serve(self, n: int) -> list:
        out, reasks = [], []
        while n and (len(self.buffer) or getattr(self.buffer, "front", None)):
            for m in self.buffer.pop_front():
                out += self.dispatcher.info(m)
            n, events, infos = self.buffer.take(n)
            if self.mode == "accumulate":  # taken from the buffer, and handed out when the mode is forward again
                self.later.append(("dispatch", events))
            else:
                left, sent = self.dispatcher.dispatch(events)
                if left:
                    raise AssertionError("a dispatcher refused events that it had asked for")
                self._sort(sent, out, reasks)
            for m in infos:
                out += self.dispatcher.info(m)
        if n:
            if self.mode == "accumulate":
                self.later.append(("demand", n))
            else:
                out.append(("handle_demand", None, n))
        return out + self._again(reasks)

    def _dispatch(self, events: list) -> list:
        if not events:
            return []
        if self.mode == "accumulate":
            self.later.append(("dispatch", events))
            return []
        left, sent = self.dispatcher.dispatch(events)
        self._accepted(len(events) - len(left))
        out, reasks = [], []
        self._sort(sent, out, reasks)
        lost, freed = self.buffer.store(left)
        if lost:
            out.append(("discarded", None, lost))
        for m in freed:
            out += self.dispatcher.info(m)
        return out + self._again(reasks)

    def _accepted(self, n: int) -> None:
        """The dispatcher took n events."""

    @staticmethod
    def _sort(sent: list, out: list, reasks: list) -> None:
        for x in sent:
            (reasks if x[0] == "reask" else out).append(x)

    def _again(self, reasks: list) -> list:
        """Asks for what selectors discarded: messages of their own, after the one that caused them is done with."""
        out = []
        for _, sub, n in reasks:
            out += self._asked(*self.dispatcher.ask(n, sub))
        return out


@dataclass
class Consumer:
    """A consumer's accounting: each message is cut into batches, each batch may ask for more."""

    subs: dict = field(default_factory=dict)

    def step(self, op: str, sub=None, n=0, events=(), opts=None) -> list[tuple]:
        if op == "subscribe":
            o = SubscriptionOptions(max_demand=int((opts or {}).get("max", 1000)), min_demand=int(opts["min"]) if opts and "min" in opts else None)
            self.subs[sub] = [o, o.max_demand, o.max_demand, (opts or {}).get("manual") == "true"]
            return [] if self.subs[sub][3] else [("ask", sub, o.max_demand)]
        if sub not in self.subs:
            return [("cancelled", sub, ["unknown_subscription"])] if op == "receive" else []
        if op == "cancel":
            del self.subs[sub]
            return [("cancelled", sub, list(events) or ["cancel"])]
        if op != "receive":
            raise ValueError(f"unknown op {op}")
        entry, events, out = self.subs[sub], list(events), []
        if entry[3]:
            return [("deliver", sub, events)] if events else []
        batches, entry[1], entry[2] = split_message(len(events), entry[1], entry[2], entry[0])
        for size, ask, excess in batches:
            out.append(("deliver", sub, events[:size]))
            events = events[size:]
            if excess:
                out.append(("excess", sub, excess))
            if ask:
                out.append(("ask", sub, ask))
        return out


@dataclass
class ProducerConsumer(Producer):
    """A stage in the middle: what comes from above waits at a gate until there is demand from below.

    A message that the gate lets in is worked on whole, even if it gives more events than were asked for: the rest is
    buffered.  Infos and ends of producers stand in the queue behind messages that came before them.
    """

    work: Callable[[list], list] = list
    above: Consumer = field(default_factory=Consumer)
    queue: deque = field(default_factory=deque)
    demand: int = 0
    reasks: deque = field(default_factory=deque)

    def step(self, op: str, sub=None, n=0, events=(), opts=None) -> list[tuple]:
        out = self._one(op, sub, n, list(events), opts)
        while self.reasks:  # messages of their own, after all that the row caused
            _, who, more = self.reasks.popleft()
            out += self._asked(*self.dispatcher.ask(more, who))
        return out

    def _one(self, op: str, sub, n, events: list, opts) -> list[tuple]:
        if op == "subscribe_to":
            return self.above.step("subscribe", sub, opts=opts)
        if op == "receive":
            if sub not in self.above.subs:
                return [("cancelled", sub, ["unknown_subscription"])]
            self.queue.append(("events", sub, events))
            return self._drain()
        if op == "ended":  # nothing more is asked of it, but its end is told after its messages
            told = self.above.step("cancel", sub, events=events)
            if not self.queue:
                return told
            self.queue.extend(told)
            return []
        if op == "info" and self.queue:
            self.queue.append(("info", None, events))
            return []
        if op == "mode":
            raise ValueError("only a producer has a demand mode")
        return super().step(op, sub, n, events, opts)

    def _asked(self, n: int, out: list) -> list:
        self.demand += n
        return [*out, *self._buffered(self.demand), *self._drain()]

    def _buffered(self, n: int) -> list:
        out = []
        while n and (len(self.buffer) or getattr(self.buffer, "front", None)):
            for m in self.buffer.pop_front():
                out += self.dispatcher.info(m)
            n, events, infos = self.buffer.take(n)
            out += self._dispatch(events)
            for m in infos:
                out += self.dispatcher.info(m)
        return out

    def _drain(self) -> list:
        out = []
        while self.demand and self.queue:
            kind, sub, x = self.queue.popleft()
            if kind == "info":
                out += super().step("info", events=x)
            elif kind == "cancelled":
                out.append((kind, sub, x))
            else:
                known = sub in self.above.subs
                for op, who, y in self.above.step("receive", sub, events=x) if known else [("deliver", sub, x)]:
                    out += self._dispatch(list(self.work(y))) if op == "deliver" else [(op, who, y)]
        return out

    def _accepted(self, n: int) -> None:
        self.demand = max(0, self.demand - n)

    def _again(self, reasks: list) -> list:
        self.reasks.extend(reasks)
        return []


@dataclass
class Supervisor:
    """Demand of per-event work: finished children are asked again once there are `min` of them."""

    producers: dict = field(default_factory=dict)

    def step(self, op: str, sub=None, n=0, events=(), opts=None) -> list[tuple]:
        """ops: subscribe; receive (n started, opts down: of those ended at once); down (n ended; sub None: manual)."""
        if op == "subscribe":
            o = SubscriptionOptions(max_demand=int((opts or {}).get("max", 1000)), min_demand=int(opts["min"]) if opts and "min" in opts else None)
            self.producers[sub] = [0, 0, o.min_demand, o.max_demand]
            return [("ask", sub, o.max_demand)]
        if sub not in self.producers:
            return []
        started, down = (n, int((opts or {}).get("down", 0))) if op == "receive" else (0, n)
        count, pending, low, high = self.producers[sub]
        out = [("excess", sub, count + started - high)] if count + started > high else []
        pending += down
        if pending and pending >= low:
            out.append(("ask", sub, pending))
            pending = 0
        self.producers[sub] = [count + started - down, pending, low, high]
        return out
