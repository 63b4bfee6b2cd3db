"""Hand-written telemetry event sequences for the trace and fold tests."""

import datetime
import json
import random

EVENT_DDL = "seq long, run_id string, type string, agent string, timestamp string, data string"


BASE = datetime.datetime(2024, 5, 1, 10, 0, 0)


def ev(seq, etype, run="r1", agent="ticket", sec=None, **data):
    t = BASE + datetime.timedelta(seconds=seq if sec is None else sec)
    ts = t.strftime("%Y-%m-%dT%H:%M:%S.%f") + "+00:00"
    return (seq, run, etype, agent, ts, json.dumps(data))


def frame(spark, rows):
    return spark.createDataFrame(rows, EVENT_DDL)


def random_well_nested(rng: random.Random, run: str, n_steps: int, seq0: int = 0):
    """A random well-nested event sequence: opens and matching closes, tokens/reasoning in between."""
    out, stack, seq = [], [], seq0
    opens = [("invocation_start", "invocation_end"), ("model_call_start", "model_call_end"),
             ("tool_start", "tool_end"), ("sub_agent_start", "sub_agent_end")]

    def add(etype, **d):
        nonlocal seq
        out.append(ev(seq, etype, run=run, sec=seq - seq0, **d))
        seq += 1

    add("run_start", agent_type="ticket")
    stack.append(("run_start", "run_end", None))
    for _ in range(n_steps):
        r = rng.random()
        if r < 0.35 and len(stack) < 6:
            o, c = rng.choice(opens)
            tid = f"t{seq}" if o in ("tool_start", "sub_agent_start") else None
            d = {"tool_name": "q", "tool_use_id": tid} if o == "tool_start" else (
                {"sub_agent_name": "a", "tool_use_id": tid} if o == "sub_agent_start" else {"agent_name": "x"})
            add(o, **d)
            stack.append((o, c, tid))
        elif r < 0.7 and len(stack) > 1:
            o, c, tid = stack.pop()
            d = {"tool_use_id": tid, "status": rng.choice(["success", "error"])} if tid else {}
            if c == "model_call_end":
                d = {"stop_reason": rng.choice(["end_turn", "tool_use"])}
            add(c, **d)
        elif r < 0.85:
            add("token", text=rng.choice(["a", "bc", "d"]))
        else:
            add("reasoning", text=rng.choice(["x", "yz"]))
    while len(stack) > 1:
        o, c, tid = stack.pop()
        add(c, **({"tool_use_id": tid, "status": "success"} if tid else {}))
    add("run_end", success=True)
    return out
