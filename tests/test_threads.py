"""Thread state: a stream that is stopped and started again equals the table's states and plain code."""

import random

from pyspark.sql import functions as F

from lodestack.streaming import threads

SCHEMA = "thread long, seq long, kind string, key string"
RESETS = ("question", "restart")


def plain(events, cap):
    out = {}
    for thread in {e[0] for e in events}:
        own = sorted(e for e in events if e[0] == thread)
        begun = max((s for _, s, k, _ in own if k in RESETS), default=-1)
        current = [(k, key) for _, s, k, key in own if s > begun and k not in RESETS]
        tools = [key for k, key in current if k == "tool" and key is not None]
        pages = {}
        for _, s, k, key in own:
            if k == "page" and key is not None:
                pages.setdefault(key, s)
        kept = sorted(pages, key=lambda p: (-pages[p], p))[:cap]
        out[thread] = (len(own), own[-1][1], sum(k in RESETS for _, _, k, _ in own), len(current), ",".join(f"{t}={tools.count(t)}" for t in sorted(set(tools))), ",".join(reversed(kept)))
    return out


def some_events(seed, threads_=7, each=60):
    rng = random.Random(seed)
    return [(t, s, rng.choice(["question", "tool", "tool", "page", "page", "other", "restart"]) if t else "tool", rng.choice([None, "a", "b", f"p{rng.randrange(30)}"])) for t in range(threads_) for s in range(each)]


def shown(df):
    return {r.thread: tuple(r)[1:] for r in df.collect()}


def test_states_equal_plain_code(spark):
    events = some_events(1)
    assert shown(threads.states(spark.createDataFrame(events, SCHEMA), RESETS, 5)) == plain(events, 5)
    assert shown(threads.states(spark.createDataFrame([], SCHEMA), RESETS)) == {}


def test_a_stream_with_a_restart_equals_the_table(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    events = some_events(2)
    parts = [[e for e in events if e[1] // 15 == i] for i in range(4)]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for half in (parts[:2], parts[2:]):
            for rows in half:
                spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
            stream = threads.follow(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source), RESETS, 5)
            # each half is a query of its own, started from the checkpoint
            stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")).start().awaitTermination(120)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    rows = spark.read.parquet(out)
    assert rows.select("batch").distinct().count() == 4
    final = rows.groupBy("thread").agg(F.max_by(F.struct("n", "last", "turn", "since", "tools", "pages"), "n").alias("s")).select("thread", "s.*")
    assert shown(final) == shown(threads.states(spark.createDataFrame(events, SCHEMA), RESETS, 5)) == plain(events, 5)
