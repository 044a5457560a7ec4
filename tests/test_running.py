"""Running values of groups that lie in several ranges, against plain loops."""

import random

from pyspark.sql import functions as F

from lodestack.operators import chat
from lodestack.operators.running import running


def test_running_equals_plain_loops(spark):
    rng = random.Random(1)
    rows = [(g, i, rng.choice([None, 1, 2, 5]), rng.choice([None, None, "x", "y"])) for g, n in ((1, 3000), (None, 900), (2, 1), (3, 50)) for i in range(n)]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = running(spark.createDataFrame(rows, "g long, i long, v long, w string"), ["g"], ["i"], {"total": F.col("v")}, {"latest": F.col("w")})
        got = {(r.g, r.i): (r.total, r.latest) for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert df.columns == ["g", "i", "v", "w", "total", "latest"]
    total, latest = {}, {}
    for g, i, v, w in sorted(rows, key=lambda r: (r[0] or 0, r[1])):
        total[g], latest[g] = total.get(g, 0) + (v or 0), w if w is not None else latest.get(g)
        assert got.pop((g, i)) == (total[g], latest[g])
    assert not got


def test_one_long_session_is_split(spark):
    messages = spark.range(400_000, numPartitions=4).select(F.lit(7).cast("long").alias("session_id"), F.col("id").alias("seq"), F.when(F.col("id") % 10 == 0, "user").otherwise("assistant").alias("role"))
    out = chat.turn_index(messages)
    assert out.where(F.col("turn") != F.floor(F.col("seq") / 10) + 1).count() == 0 and out.count() == 400_000
    # no window holds the session: each stands within a range of it
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(session_id" in plan and all("_range" in line for line in plan.splitlines() if "windowspecdefinition(session_id" in line)
