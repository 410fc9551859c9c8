"""Operation logs against step-by-step models."""

import random

import pytest

from floodsift.functions.hashing import SketchShape
from floodsift.operators import replay
from floodsift.schemas import OPS

P = 65521


def bucket(row, x, width):
    return ((row + 1) * x % P) % width


def ops_table(spark, logs):
    rows = [(sketch, n, kind, payload) for sketch, log in logs.items() for n, (kind, payload) in enumerate(log)]
    return spark.createDataFrame(rows, OPS)


def answers(df):
    return {(r.sketch_id, r.seq): r["count"] for r in df.collect()}


def clearing_log(rng, length, keys):
    log = []
    for _ in range(length):
        draw = rng.random()
        if draw < 1 / 300:
            log.append(("clear", None))
        else:
            log.append(("insert" if draw < 0.65 else "query", rng.choice(keys)))
    return log


def cms_model(log, depth, width):
    cells, found = {}, {}
    for n, (kind, x) in enumerate(log):
        if kind == "clear":
            cells = {}
            continue
        slots = [(row, bucket(row, x, width)) for row in range(depth)]
        if kind == "insert":
            for slot in slots:
                cells[slot] = cells.get(slot, 0) + 1
        else:
            found[n] = min(cells.get(slot, 0) for slot in slots)
    return found


@pytest.mark.parametrize("depth, width", [(1, 512), (4, 512)])
def test_clearing_logs(spark, depth, width):
    rng = random.Random(depth)
    keys = [rng.randrange(1 << 32) for _ in range(400)]
    logs = {sketch: clearing_log(rng, 2000, keys) for sketch in (0, 1)}
    ops = ops_table(spark, logs)
    if depth == 1:
        got = answers(replay.hashtab_replay(ops, width))
    else:
        got = answers(replay.cms_replay(ops, SketchShape(depth=depth, width=width)))
    assert got == {(s, n): c for s, log in logs.items() for n, c in cms_model(log, depth, width).items()}


def test_rolling_log(spark):
    rng = random.Random(9)
    depth, width = 4, 64
    keys = [rng.randrange(1 << 32) for _ in range(100)]
    tables = [{}, {}, {}]
    head = mode = 0
    log, expected = [], {}
    for n in range(4000):
        draw = rng.random()
        if draw < 0.01:
            tables[(head + 1) % 3] = {}
            head = (head + 2) % 3
            log.append(("change_roles", None))
        elif draw < 0.03:
            mode ^= 1
            log.append(("set_mode", mode))
        else:
            x = rng.choice(keys)
            slots = [(row, bucket(row, x, width)) for row in range(depth)]
            if mode == 0:
                for slot in slots:
                    tables[head][slot] = tables[head].get(slot, 0) + 1
            else:
                expected[5, n] = min(tables[(head + 1) % 3].get(slot, 0) for slot in slots)
            log.append(("input", x))
    got = answers(replay.rolling_cms_replay(ops_table(spark, {5: log}), SketchShape(depth, width)))
    assert got == expected and max(got.values()) > 0


def test_wrapping_counters(spark):
    log = [("insert", 3)] * 300 + [("query", 3)]
    shape = SketchShape(depth=2, width=16, counter_bits=8)
    assert answers(replay.cms_replay(ops_table(spark, {0: log}), shape)) == {(0, 300): 44}
