"""Golden traces of the state machines, batching and options."""

import json
import random
from pathlib import Path

import pytest
from model import BroadcastState, Buffer, Consumer, DemandState, PartitionState, Producer, ProducerConsumer, Supervisor

from sluice.operators.batching import cycle, split_message
from sluice.options import OptionError, PartitionOptions, ProducerOptions, SubscriptionOptions, SupervisorOptions
from sluice.streaming.pipeline import Subscriptions

GOLDEN = json.loads((Path(__file__).parent / "golden.json").read_text())
WHERE = {
    "parity": lambda e: (e, "even" if e % 2 == 0 else "odd"),
    "parity3": lambda e: (e, None if e % 3 == 0 else "even" if e % 2 == 0 else "odd"),
    "m2": lambda e: (e, "0"),
}


def sent(out):
    found = {}
    for op, sub, events in out:
        if op == "deliver":
            found.setdefault(sub, []).extend(events)
    return found


def run_steps(state, steps):
    for op, *args in steps:
        if op == "subscribe":
            sub, expected = args[0], args[-1]
            assert state.subscribe(sub, **({"partition": args[1]} if len(args) == 3 else {})) == expected
        elif op == "ask":
            assert state.ask(args[0], args[1]) == (args[2], [])
        elif op == "ask_recv":
            n, out = state.ask(args[0], args[1])
            assert n == args[2] and sent(out) == {args[1]: args[3]}
        elif op == "cancel":
            assert state.cancel(args[0])[0] == args[1]
        elif op == "state":
            assert list(state.state()) == args
        elif op == "dispatch":
            left, out = state.dispatch(list(args[0]))
            assert left == args[1] and sent(out) == args[2]
        else:
            raise AssertionError(op)


@pytest.mark.parametrize("case", GOLDEN["demand"])
def test_demand(case):
    run_steps(DemandState(), case["steps"])


@pytest.mark.parametrize("case", GOLDEN["broadcast"])
def test_broadcast(case):
    run_steps(BroadcastState(), case["steps"])


@pytest.mark.parametrize("case", GOLDEN["partition"])
def test_partition(case):
    run_steps(PartitionState(case["partitions"], WHERE[case["hash"]]), case["steps"])


@pytest.mark.parametrize("case", GOLDEN["buffer"])
def test_buffer(case):
    keep = next((s[1] for s in case["steps"] if s[0] == "store"), "last")
    buffer = Buffer(case["size"], keep)
    for op, *args in case["steps"]:
        if op == "store":
            assert buffer.store(args[1])[0] == args[2]
        elif op == "info":
            assert buffer.info(args[0])
        elif op == "size":
            assert len(buffer) == args[0]
        else:
            assert list(buffer.take(args[0])) == args[1]


@pytest.mark.parametrize("case", GOLDEN["batches"])
def test_batches(case):
    lead, rest = cycle(SubscriptionOptions(max_demand=case["max"], min_demand=case["min"]))
    spans, at, i = [], 0, 0
    while at <= 2000:
        size = (lead + rest * (2000 // len(rest) + 2000))[i][0]
        spans.append([at, at + size - 1])
        at, i = at + size, i + 1
    assert spans[: len(case["prefix"])] == case["prefix"]
    assert all(s in spans for s in case.get("contains", []))


def test_message_borders_are_data():
    opts, asked, out = SubscriptionOptions(max_demand=1000, min_demand=750), 1000, 1000
    asks = []
    for _ in range(3):
        batches, asked, out = split_message(100, asked, out, opts)
        asks += [a for _, a, _ in batches]
    assert asks == [0, 0, 300]


def test_excess_is_delivered_and_marked():
    batches, _, _ = split_message(12, 10, 10, SubscriptionOptions(max_demand=10, min_demand=5))
    assert sum(n for n, _, _ in batches) == 12
    consumer = Consumer()
    consumer.step("subscribe", "s", opts={"max": "10", "min": "0"})
    out = consumer.step("receive", "s", events=list(range(12)))
    assert sum(len(e) for op, _, e in out if op == "deliver") == 12


def test_selector_is_asked_again():
    state = BroadcastState()
    state.subscribe("1", selector=lambda e: e.startswith("pre"))
    state.subscribe("2", selector=lambda e: e.startswith("pref"))
    state.ask(4, "1"), state.ask(4, "2")
    _, out = state.dispatch(["pref-1234", "pref-5678", "pre0000", "foo0000"])
    assert {s: n for op, s, n in out if op == "reask"} == {"1": 1, "2": 2}


def test_producer_buffers_and_serves_from_the_buffer_first():
    stage = Producer(DemandState(), Buffer(5, "last"))
    stage.step("subscribe", "a")
    assert stage.step("dispatch", events=list("abcde")) == []
    assert stage.step("dispatch", events=list("fgh")) == [("discarded", None, 3)]
    assert stage.step("ask", "a", 4) == [("deliver", "a", list("defg"))]
    assert stage.step("ask", "a", 4) == [("deliver", "a", ["h"]), ("handle_demand", None, 3)]
    assert stage.step("ask", "b", 1) == [("cancelled", "b", ["unknown_subscription"])]
    assert stage.step("subscribe", "a") == [("cancelled", "a", ["duplicated_subscription"])]


def test_info_waits_for_events_before_it_or_their_loss():
    stage = Producer(DemandState(), Buffer(2, "last"))
    stage.step("subscribe", "a")
    assert stage.step("info", events=["now"]) == [("info", None, ["now"])]
    stage.step("dispatch", events=["x"])
    assert stage.step("info", events=["later"]) == []
    assert stage.step("dispatch", events=["y", "z"]) == [("discarded", None, 1), ("info", None, ["later"])]


def test_unbounded_buffer_delays_an_info_that_demand_just_reaches():
    stage = Producer(DemandState(), Buffer(None))
    stage.step("subscribe", "a")
    stage.step("dispatch", events=["x"])
    stage.step("info", events=["m"])
    assert stage.step("ask", "a", 1) == [("deliver", "a", ["x"])]
    assert stage.step("ask", "a", 1) == [("info", None, ["m"]), ("handle_demand", None, 1)]


def test_accumulate_keeps_order_and_does_not_merge():
    stage = Producer(DemandState(), Buffer(10), "accumulate")
    stage.step("subscribe", "a")
    assert stage.step("ask", "a", 2) == [] and stage.step("dispatch", events=[1, 2, 3]) == [] and stage.step("ask", "a", 1) == []
    assert stage.step("mode", "forward") == [("handle_demand", None, 2), ("deliver", "a", [1, 2, 3]), ("handle_demand", None, 1)]
    stage.step("mode", "accumulate")
    with pytest.raises(ValueError):
        stage.step("mode", "backward")


def test_partition_cancel_drops_its_queue():
    state = PartitionState(["0", "1"], lambda e: (e, "0"))
    state.subscribe("b", partition="1"), state.ask(3, "b"), state.subscribe("a", partition="0")
    state.dispatch([1, 2, 3])
    assert state.cancel("a") == (3, [("dropped", "a", [1, 2, 3])])
    with pytest.raises(ValueError):
        state.subscribe("c", partition="9")
    with pytest.raises(ValueError):
        state.subscribe("c", partition="1")


def test_partition_info_waits_for_all_that_are_behind():
    state = PartitionState(["0", "1"], lambda e: (e, str(e % 2)))
    state.subscribe("a", partition="0"), state.subscribe("b", partition="1")
    assert state.info("free") == [("info", None, ["free"])]
    state.ask(1, "a"), state.ask(1, "b")
    state.dispatch([2, 3])
    assert state.info("m") == []
    assert state.ask(1, "a")[1] == []
    assert state.ask(1, "b")[1] == [("info", None, ["m"])]


def test_supervisor_asks_for_ended_children():
    s = Supervisor()
    assert s.step("subscribe", "p", opts={"max": "10", "min": "8"}) == [("ask", "p", 10)]
    assert s.step("receive", "p", 10, opts={"down": "3"}) == []
    assert s.step("down", "p", 4) == []
    assert s.step("down", "p", 1) == [("ask", "p", 8)]
    assert s.step("down", None, 1) == []


def test_random_demand_matches_the_prefix_form():
    rng = random.Random(3)
    for _ in range(300):
        demands = [rng.randrange(6) for _ in range(rng.randrange(1, 6))]
        state = DemandState()
        for i, d in enumerate(demands):
            state.subscribe(i)
        for i, d in enumerate(demands):
            state.ask(d, i)
        order = [(-n, at) for at, (n, _) in enumerate(state.state()[0])]
        assert order == sorted(order)
        n = rng.randrange(20)
        left, out = state.dispatch(list(range(n)))
        got = [e for _, _, es in out for e in es]
        assert got + left == list(range(n)) and len(got) == min(n, sum(demands))


@pytest.mark.parametrize(
    "make",
    [
        lambda: SubscriptionOptions(max_demand=0),
        lambda: SubscriptionOptions(max_demand=5, min_demand=5),
        lambda: SubscriptionOptions(cancel="never"),
        lambda: ProducerOptions(buffer_size=0),
        lambda: ProducerOptions(demand="later"),
        lambda: PartitionOptions(()),
        lambda: PartitionOptions(("a", "b")),
        lambda: SupervisorOptions(restart="permanent"),
        lambda: SupervisorOptions(subscribe_to="x"),
    ],
)
def test_options_are_checked(make):
    with pytest.raises(OptionError):
        make()


def test_subscriptions_apply_policies():
    s = Subscriptions(None, stop_sources=True)
    s.connect("a", "src"), s.connect("b", "src", cancel="transient"), s.connect("c", "src", cancel="temporary")
    with pytest.raises(OptionError):
        s.connect("a", "src")
    assert s.ended("a", "normal") == []
    s.connect("a", "src")
    assert s.ended("src", "normal") == ["a"]
    t = Subscriptions(None, stop_sources=True)
    t.connect("a", "src")
    assert t.ended("a", "normal") == ["src"]


def test_selector_reasks_come_after_the_leftovers_are_stored():
    stage = Producer(BroadcastState(), Buffer(10))
    for sub in "ab":
        stage.step("subscribe", sub, opts={"selector": lambda e: e.startswith("y")})
        stage.step("ask", sub, 2)
    out = stage.step("dispatch", events=["x1", "x2", "y3", "y4"])
    assert sorted(
        x for x in out if x[0] == "deliver"
    ) == [("deliver", "a", ["y3", "y4"]), ("deliver", "b", ["y3", "y4"])]
    assert not len(stage.buffer) and not any(x[0] == "handle_demand" for x in out)


def test_a_queued_message_waits_for_the_next_ask():
    state = PartitionState(["0", "1"], lambda e: (e, "0" if e < 10 else "1"))
    state.subscribe("b", "1")
    state.ask(5, "b")
    state.dispatch([1, 2])
    assert state.info("m") == []
    state.subscribe("a", "0")
    assert state.ask(2, "a")[1] == [("deliver", "a", [1, 2])]
    assert ("info", None, ["m"]) in state.ask(1, "a")[1]


def test_accumulate_holds_what_the_buffer_gives():
    stage = Producer(DemandState(), Buffer(10))
    stage.step("subscribe", "a")
    stage.step("dispatch", events=[1, 2, 3])
    stage.step("mode", "accumulate")
    assert stage.step("ask", "a", 2) == []
    assert stage.step("mode", "forward") == [("deliver", "a", [1, 2])]


def test_a_message_does_not_overtake_one_that_was_put_back():
    stage = Producer(DemandState(), Buffer(None))
    stage.step("subscribe", "a")
    stage.step("dispatch", events=[1])
    assert stage.step("info", events=["m"]) == []
    assert stage.step("ask", "a", 1) == [("deliver", "a", [1])]
    assert stage.step("info", events=["m2"]) == []
    assert [x[2] for x in stage.step("ask", "a", 1) if x[0] == "info"] == [["m"], ["m2"]]


def middle(work=list, dispatcher=None):
    stage = ProducerConsumer(dispatcher or DemandState(), Buffer(10), work=work)
    assert stage.step("subscribe_to", "up", opts={"max": "4", "min": "2"}) == [("ask", "up", 4)]
    return stage


def test_gate_waits_for_demand():
    stage = middle()
    stage.step("subscribe", "a")
    assert stage.step("receive", "up", events=[1, 2]) == []
    assert stage.step("receive", "up", events=[3, 4]) == []
    # a message is let in whole: what was not asked for is buffered, and the next message waits
    assert stage.step("ask", "a", 1) == [("deliver", "a", [1]), ("ask", "up", 2)]
    assert (list(stage.buffer.events), len(stage.queue)) == ([(0, 2)], 1)
    assert stage.step("ask", "a", 2) == [("deliver", "a", [2]), ("deliver", "a", [3]), ("ask", "up", 2)]
    assert stage.step("ask", "a", 5) == [("deliver", "a", [4])]
    assert stage.demand == 4


def test_gate_opens_with_demand_that_was_left():
    stage = middle(lambda batch: [e for e in batch for _ in range(3)])
    stage.step("subscribe", "a")
    assert stage.step("ask", "a", 4) == []
    assert stage.step("receive", "up", events=[1])[0] == ("deliver", "a", [1, 1, 1])
    assert stage.step("receive", "up", events=[2])[0] == ("deliver", "a", [2])
    assert len(stage.buffer) == 2


def test_gate_keeps_infos_and_ends_behind_messages():
    stage = middle()
    stage.step("subscribe", "a")
    assert stage.step("info", events=["now"]) == [("info", None, ["now"])]
    stage.step("receive", "up", events=[1])
    assert stage.step("info", events=["later"]) == []
    assert stage.step("ended", "up", events=["normal"]) == []
    # the producer is gone: no more is asked of it; what stands behind the message needs demand of its own
    assert stage.step("ask", "a", 1) == [("deliver", "a", [1])]
    assert stage.step("ask", "a", 1) == [("info", None, ["later"]), ("cancelled", "up", ["normal"])]
    assert stage.step("receive", "up", events=[2]) == [("cancelled", "up", ["unknown_subscription"])]
    assert stage.step("ended", "up") == []


def test_gate_serves_selectors_again():
    stage = middle(dispatcher=BroadcastState())
    stage.step("subscribe", "a", opts={"selector": lambda e: e > 1})
    stage.step("ask", "a", 1)
    # the discarded event is asked for again, after the rest of the message was buffered
    out = stage.step("receive", "up", events=[1, 2])
    assert out == [("ask", "up", 2), ("deliver", "a", [2])]


def test_gate_has_no_mode():
    with pytest.raises(ValueError):
        middle().step("mode", "accumulate")
