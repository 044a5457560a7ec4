"""Stored tables: changes of touched partitions only, break-off, cascade; against a dict."""

import random

import pytest
from pyspark.sql import functions as F

from lodestack.operators.stored import StoredTable, cascade

SCHEMA = "id long, name string, tags array<string>"


def contents(table):
    return {tuple(r[k] for k in table.key): (r.name, r.tags) for r in table.rows().collect()}


@pytest.fixture
def table(spark, tmp_path):
    return StoredTable(spark, f"{tmp_path}/t", SCHEMA, ["id"], n_partitions=8)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_changes_equal_a_dict(spark, table):
    rng, want = random.Random(1), {}
    assert contents(table) == {} and table.upsert(frame(spark, [])) == []
    for step in range(6):
        rows = [(i, rng.choice([None, f"n{step}"]), rng.choice([None, [], [f"t{step}"]])) for i in rng.sample(range(30), 6)]
        if step % 3 == 0:
            table.upsert(frame(spark, rows))
            want.update({(i,): (n, t) for i, n, t in rows})
        elif step % 3 == 1:
            table.insert_missing(frame(spark, rows))
            want = {(i,): (n, t) for i, n, t in rows} | want
        else:
            table.patch(frame(spark, rows))
            want.update({(i,): (n if n is not None else want[i,][0], t or want[i,][1]) for i, n, t in rows if (i,) in want})
            table.delete(spark.createDataFrame([(rows[0][0],), (999,)], "id long"))
            want.pop((rows[0][0],), None)
        assert contents(table) == want
    # another object finds it
    assert contents(StoredTable(spark, table.path, SCHEMA, ["id"], n_partitions=99)) == want and table.manifest()["version"] >= 6
    assert table.replace(frame(spark, [(1, "x", [])])) == list(range(8)) and contents(table) == {(1,): ("x", [])}


def test_only_touched_partitions_are_read_and_written(spark, table):
    table.upsert(frame(spark, [(i, "a", None) for i in range(100)]))
    before = table.writes()
    touched = table.upsert(frame(spark, [(7, "b", None)]))
    after = table.writes()
    assert len(touched) == 1 and len(before) == 8 and {p for p in before if before[p] != after[p]} == set(touched)
    read = table.rows(touched)
    assert {f.split("partition=")[1].split("/")[0] for f in read.inputFiles()} == {str(touched[0])} and contents(table)[7,] == ("b", None)


@pytest.mark.parametrize("stage", ["merge", "publish"])
def test_a_change_that_breaks_off_leaves_the_old_version(spark, table, monkeypatch, stage):
    table.upsert(frame(spark, [(i, "a", None) for i in range(20)]))
    before = contents(table)

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        if stage == "publish":
            m.setattr(StoredTable, "_publish", broken)
            with pytest.raises(RuntimeError):
                table.upsert(frame(spark, [(1, "b", None)]))
        else:
            # a task fails while the new partitions are written
            with pytest.raises(Exception, match="lost"):
                table.change(frame(spark, [(1, "b", None)]), lambda old, new: new.withColumn("name", F.raise_error(F.lit("lost")).cast("string")))
    assert contents(table) == before
    table.upsert(frame(spark, [(1, "b", None)]))
    assert contents(table) == before | {(1,): ("b", None)}


def test_cascade(spark, tmp_path):
    docs = StoredTable(spark, f"{tmp_path}/docs", SCHEMA, ["id"], 4)
    chunks = StoredTable(spark, f"{tmp_path}/chunks", "id long, place int, name string, tags array<string>", ["id", "place"], 4)
    docs.upsert(frame(spark, [(1, "a", None), (2, "b", None)]))
    chunks.upsert(spark.createDataFrame([(i, p, "c", None) for i in (1, 2) for p in range(9)], chunks.schema))
    cascade(spark.createDataFrame([(1,), (5,)], "id long"), "id", [docs, chunks])
    assert set(contents(docs)) == {(2,)} and set(contents(chunks)) == {(2, p) for p in range(9)}
