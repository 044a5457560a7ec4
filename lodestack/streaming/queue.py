"""Admission of documents to processing: a first-in, first-out queue with so many slots, as state of a stream.

events(queue, seq, at, kind, doc_id), seqs rising within a queue. Kinds: "enqueue" asks for processing, "done" ends it, "state" asks how things stand, "stop" ends the queue: what
isn't done a grace period later is forgotten. A document that is queued or processed isn't queued again. Slots that are free after an event take the documents that
have waited longest.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SLOTS, GRACE_SECONDS = 3, 30.0
#: What happens: an answer to enqueue or state ("queued" with a position, "processing", "unknown"), "started", and "forgotten".
ANSWERS = "queue string, seq long, doc_id long, status string, position int"


class Admission(StatefulProcessor):
    """Keeps a queue's waiting and active documents; a micro-batch's events of one queue are put in order in memory. One queue is one task, by its nature."""

    def __init__(self, slots: int = SLOTS, grace: float = GRACE_SECONDS):
        self.slots, self.grace = slots, grace

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", "doc_id long")
        self.active = handle.getListState("active", "doc_id long")
        self.stopped = handle.getValueState("stopped", "at double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("seq", kind="stable")
        # a document's number when it was queued; positions are counted from how many have left the front
        waiting = OrderedDict((r[0], i) for i, r in enumerate(self.waiting.get()) if r[0] is not None) if self.waiting.exists() else OrderedDict()
        active = OrderedDict.fromkeys(r[0] for r in self.active.get()) if self.active.exists() else OrderedDict()
        stopped = self.stopped.get()[0] if self.stopped.exists() else None
        left, number, out = 0, len(waiting), []

        def standing(doc: int) -> tuple[str, int | None]:
            return ("processing", None) if doc in active else ("queued", waiting[doc] - left + 1) if doc in waiting else ("unknown", None)

        for seq, at, kind, doc in events[["seq", "at", "kind", "doc_id"]].itertuples(index=False):
            if stopped is not None and at > stopped + self.grace:
                out += [(seq, d, "forgotten", None) for d in [*active, *waiting]]
                left += len(waiting)
                active, waiting, stopped = OrderedDict(), OrderedDict(), None
            if kind == "stop":
                stopped = at
            elif kind == "done":
                active.pop(doc, None)
            elif kind == "enqueue" and standing(doc)[0] == "unknown":
                waiting[doc] = number
                number += 1
            if kind in ("enqueue", "state"):
                out.append((seq, doc, *standing(doc)))
            while waiting and len(active) < self.slots:
                first, _ = waiting.popitem(last=False)
                left += 1
                active[first] = None
                out.append((seq, first, "started", None))
            if stopped is not None and not active:
                stopped = None
        for state, docs in ((self.waiting, waiting), (self.active, active)):
            state.put([(int(d),) for d in docs]) if docs else state.clear()
        self.stopped.update((float(stopped),)) if stopped is not None else self.stopped.clear()
        answers = pd.DataFrame(out, columns=["seq", "doc_id", "status", "position"]).astype({"seq": "int64", "doc_id": "int64", "position": "Int32"})
        answers.insert(0, "queue", key[0])
        yield answers

    def close(self) -> None:
        pass


def admit(events: DataFrame, slots: int = SLOTS, grace: float = GRACE_SECONDS) -> DataFrame:
    """ANSWERS to a stream of events, in append mode; the state store has to be RocksDB's, and what waits outlives restarts."""
    rows = events.select("queue", "seq", "at", "kind", "doc_id")
    return rows.groupBy("queue").transformWithStateInPandas(statefulProcessor=Admission(slots, grace), outputStructType=ANSWERS, outputMode="Append", timeMode="None")
