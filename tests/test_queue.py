"""The admission queue: the rules one by one, and a stream that is stopped and started again against plain code."""

import random

import pytest

from lodestack.streaming import queue

SCHEMA = "queue string, seq long, at double, kind string, doc_id long"


def plain(events, slots, grace):
    """The rules with lists."""
    waiting, active, stopped, out = [], [], None, []
    for q, seq, at, kind, doc in events:
        if stopped is not None and at > stopped + grace:
            out += [(q, seq, d, "forgotten", None) for d in active + waiting]
            waiting, active, stopped = [], [], None
        if kind == "stop":
            stopped = at
        if kind == "done" and doc in active:
            active.remove(doc)
        if kind == "enqueue" and doc not in active and doc not in waiting:
            waiting.append(doc)
        if kind in ("enqueue", "state"):
            out.append((q, seq, doc, "processing", None) if doc in active else (q, seq, doc, "queued", waiting.index(doc) + 1) if doc in waiting else (q, seq, doc, "unknown", None))
        while waiting and len(active) < slots:
            active.append(waiting.pop(0))
            out.append((q, seq, active[-1], "started", None))
        if not active:
            stopped = None
    return out


def streamed(spark, tmp_path, batches, slots=3, grace=30.0):
    """Answers to batches of files; the query ends after each batch and the next starts from the checkpoint."""
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for rows in batches:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
            stream = queue.admit(spark.readStream.schema(SCHEMA).parquet(source), slots, grace)
            stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination(120)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return [tuple(r) for r in spark.read.parquet(out).collect()]


def test_rules(spark, tmp_path):
    asked = [("enqueue", d) for d in (1, 2, 3, 4, 5)] + [("enqueue", 1), ("enqueue", 5), ("state", 4), ("state", 9), ("done", 2), ("state", 5), ("done", 7), ("enqueue", 2)]
    first = [("q", i, float(i), k, d) for i, (k, d) in enumerate(asked)]
    got = streamed(spark, tmp_path, [first, [("q", 20, 20.0, "stop", None), ("q", 21, 21.0, "done", 1), ("q", 22, 40.0, "state", 2), ("q", 23, 60.0, "state", 2), ("q", 24, 61.0, "enqueue", 2)]])
    by = {}
    for _, seq, doc, status, position in got:
        by.setdefault(seq, []).append((doc, status, position))
    # an answer comes before the slots are filled
    assert by[0] == [(1, "queued", 1), (1, "started", None)] and by[3] == [(4, "queued", 1)] and by[4] == [(5, "queued", 2)]
    assert by[5] == [(1, "processing", None)] and by[6] == [(5, "queued", 2)] and by[7] == [(4, "queued", 1)] and by[8] == [(9, "unknown", None)]
    assert by[9] == [(4, "started", None)] and by[10] == [(5, "queued", 1)] and 11 not in by and by[12] == [(2, "queued", 2)]
    # stopping lets what waits go on for the grace period
    assert by[21] == [(5, "started", None)] and by[22] == [(2, "queued", 1)]
    assert sorted(by[23]) == [(2, "forgotten", None), (2, "unknown", None), (3, "forgotten", None), (4, "forgotten", None), (5, "forgotten", None)]
    assert by[24] == [(2, "queued", 1), (2, "started", None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_a_stream_with_restarts_equals_plain_code(spark, tmp_path, seed):
    rng = random.Random(seed)
    events, at = {q: [] for q in "ab"}, 0.0
    for seq in range(240):
        at += rng.random() * 3
        kind = rng.choices(["enqueue", "done", "state", "stop"], [8, 5, 3, 0.3])[0]
        q = rng.choice("ab")
        events[q].append((q, seq, at, kind, None if kind == "stop" else rng.randrange(12)))
    everything = [e for rows in events.values() for e in rows]
    batches = [[e for e in everything if e[1] // 80 == i] for i in range(3)]
    for rows in batches:
        rng.shuffle(rows)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(streamed(spark, tmp_path, batches, 2, 9.0), key=key) == sorted((r for rows in events.values() for r in plain(rows, 2, 9.0)), key=key)
