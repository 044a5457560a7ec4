"""State of conversation threads: channels that each turn begins anew, and channels that last as long as the thread.

events(thread, seq, kind, key). An event of a kind in `resets` begins a turn. Of each thread are known: n and last, how many events there were and the greatest seq; turn, how many
turns began; since, how many events came in the current turn; tools, how often each key of a tool event was called in it; pages, the latest `cap` distinct keys of page events,
over all turns, in order of their first sight. `states` says it for a table, `follow` for a stream, whose state outlives restarts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "thread long, n long, last long, turn long, since long, tools string, pages string"
TOOL, PAGE = "tool", "page"
CAP = 50


def _shown(names: str, counts: str | None = None):
    """A list of struct(place, name) or struct(name, count) columns as text."""
    entry = (lambda x: F.concat(x[names], F.lit("="), x[counts].cast("string"))) if counts else (lambda x: x[names])
    return lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), entry), ",")


def states(events: DataFrame, resets: tuple[str, ...], cap: int = CAP) -> DataFrame:
    """STATE of each thread: aggregates, none of which gathers a thread's events."""
    begins = F.col("kind").isin(*resets)
    session = events.groupBy("thread").agg(F.count("*").alias("n"), F.max("seq").alias("last"), F.count_if(begins).alias("turn"), F.max(F.when(begins, F.col("seq"))).alias("begun"))
    current = events.join(session.select("thread", "begun"), "thread").where(~begins & (F.col("seq") > F.coalesce("begun", F.lit(-1))))
    since = current.groupBy("thread").agg(F.count("*").alias("since"))
    called = current.where((F.col("kind") == TOOL) & F.col("key").isNotNull()).groupBy("thread", "key").agg(F.count("*").alias("calls"))
    tools = called.groupBy("thread").agg(_shown("key", "calls")(F.struct("key", "calls")).alias("tools"))
    first = events.where((F.col("kind") == PAGE) & F.col("key").isNotNull()).groupBy("thread", "key").agg(F.min("seq").alias("seq"))
    newest = first.withColumn("back", F.row_number().over(W.partitionBy("thread").orderBy(F.col("seq").desc(), "key"))).where(F.col("back") <= cap)
    pages = newest.groupBy("thread").agg(_shown("key")(F.struct((-F.col("back")).alias("place"), "key")).alias("pages"))
    out = session.join(since, "thread", "left").join(tools, "thread", "left").join(pages, "thread", "left")
    return out.select("thread", "n", "last", "turn", F.coalesce("since", F.lit(0)).alias("since"), F.coalesce("tools", F.lit("")).alias("tools"), F.coalesce("pages", F.lit("")).alias("pages"))


class ThreadProcessor(StatefulProcessor):
    """Keeps a thread's channels between micro-batches; a micro-batch's events of one thread are put in order in memory."""

    def __init__(self, resets: tuple[str, ...], cap: int = CAP):
        self.resets, self.cap = resets, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.session = handle.getValueState("session", "n long, last long, turn long, begun long, since long")
        self.tools = handle.getMapState("turn_tools", "tool string", "calls long")
        self.pages = handle.getMapState("session_pages", "page string", "seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("seq", kind="stable")
        n, last, turn, begun, since = self.session.get() if self.session.exists() else (0, -1, 0, -1, 0)
        begins = events["kind"].isin(self.resets)
        newest = int(events.loc[begins, "seq"].max()) if begins.any() else -1
        if newest > begun:
            # a turn begins: its channels start from nothing
            begun, since = newest, 0
            self.tools.clear()
        current = events[~begins & (events["seq"] > begun)]
        n, last, turn, since = n + len(events), max(last, int(events["seq"].max())), turn + int(begins.sum()), since + len(current)
        for tool, calls in current.loc[(current["kind"] == TOOL) & current["key"].notna(), "key"].value_counts().items():
            before = self.tools.getValue((tool,))[0] if self.tools.containsKey((tool,)) else 0
            self.tools.updateValue((tool,), (before + int(calls),))
        seen = events[(events["kind"] == PAGE) & events["key"].notna()].drop_duplicates("key")
        for page, seq in zip(seen["key"], seen["seq"], strict=True):
            if not self.pages.containsKey((page,)) or self.pages.getValue((page,))[0] > seq:
                self.pages.updateValue((page,), (int(seq),))
        pages = sorted((-s[0], p[0]) for p, s in self.pages.iterator())[: self.cap]
        self.session.update((n, last, turn, begun, since))
        tools = ",".join(f"{t[0]}={c[0]}" for t, c in sorted(self.tools.iterator()))
        yield pd.DataFrame([{"thread": key[0], "n": n, "last": last, "turn": turn, "since": since, "tools": tools, "pages": ",".join(p for _, p in reversed(pages))}])

    def close(self) -> None:
        pass


def follow(events: DataFrame, resets: tuple[str, ...], cap: int = CAP) -> DataFrame:
    """STATE of each thread of a stream after each micro-batch that has events of it, in update mode; the state store has to be RocksDB's.

    Seqs are not negative; an event that comes after later ones counts for the thread, and for the turn if that had begun before it.
    """
    rows = events.select("thread", "seq", "kind", "key")
    return rows.groupBy("thread").transformWithStateInPandas(statefulProcessor=ThreadProcessor(resets, cap), outputStructType=STATE, outputMode="Update", timeMode="None")
