"""Tables switched together, tables of several threads, and replacements that fail half-way."""

import threading

import pytest
from pyspark.sql import functions as F

from parcelyn import storage
from parcelyn.operators import clusters as K

KIND = "id long, name string, price int"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame(rows, KIND)


def test_change_writes_the_buckets_it_touches(spark, tmp_path):
    t = storage.Tables(spark, f"{tmp_path}/tables")
    old = [(i, f"n{i}", i) for i in range(2000)]
    t.create("listings", table(spark, old), ["id"], buckets=100)
    t.create("prices", table(spark, [(1, "p", 5)]), ["id", "name"], buckets=4)
    before = t._state()["tables"]["listings"]["paths"]
    touched = t.change({"listings": table(spark, [(7, None, 70), (5000, "new", 1)]), "prices": table(spark, [(1, "q", 6)])}, {"listings": spark.createDataFrame([(9,)], "id long")})
    after = t._state()["tables"]["listings"]["paths"]
    assert touched["listings"] <= 3 and sum(before[b] != after.get(b) for b in before) <= 3
    due = {r[0]: r for r in old} | {7: (7, "n7", 70), 5000: (5000, "new", 1)}
    del due[9]
    assert rows_of(t.read("listings")) == sorted(due.values(), key=repr)
    assert rows_of(t.read("prices")) == [(1, "p", 5), (1, "q", 6)] and t.names() == ["listings", "prices"]
    assert t.change({"listings": table(spark, [(7, None, 71)])}, protected=("price",)) == {"listings": 1}
    assert (7, "n7", 70) in rows_of(t.read("listings"))
    assert t.clean() >= 3 and len(rows_of(t.read("listings"))) == 2000


def test_failure_between_two_tables_leaves_both(spark, tmp_path, monkeypatch):
    t = storage.Tables(spark, f"{tmp_path}/tables")
    t.create("a", table(spark, [(1, "x", 1)]), ["id"], buckets=2)
    t.create("b", table(spark, [(1, "y", 1)]), ["id"], buckets=2)
    bad = table(spark, [(1, "z", 2)]).withColumn("price", F.raise_error("lost").cast("int"))
    with pytest.raises(Exception, match="lost"):
        t.change({"a": table(spark, [(1, "changed", 2)]), "b": bad})
    assert rows_of(t.read("a")) == [(1, "x", 1)] and rows_of(t.read("b")) == [(1, "y", 1)]
    began = t.read("a")
    t.change({"a": table(spark, [(1, "changed", 2)]), "b": table(spark, [(2, "more", 3)])})
    assert rows_of(began) == [(1, "x", 1)] and rows_of(t.read("a")) == [(1, "changed", 2)] and len(rows_of(t.read("b"))) == 2
    t.change(deletes={"a": spark.createDataFrame([(1,)], "id long")})
    assert rows_of(t.read("a")) == []


def test_replacement_that_fails_between_its_moves(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    table(spark, [(1, "old", 1)]).write.parquet(path)
    move = storage._moved

    def failing(spark, source, target):
        if ".new-" in source:
            raise OSError("cut off")
        move(spark, source, target)

    monkeypatch.setattr(storage, "_moved", failing)
    with pytest.raises(OSError, match="cut off"):
        storage.replace_table(spark, table(spark, [(1, "new", 2)]), path)
    assert rows_of(spark.read.parquet(path)) == [(1, "old", 1)]
    monkeypatch.setattr(storage, "_moved", move)
    # A driver lost after the first move.
    move(spark, path, f"{path}.old-1")
    storage.mended(spark, path)
    assert rows_of(spark.read.parquet(path)) == [(1, "old", 1)]
    storage.replace_table(spark, spark.read.parquet(path).withColumn("price", F.col("price") + 1), path)
    storage.mended(spark, path)
    assert rows_of(spark.read.parquet(path)) == [(1, "old", 2)]


def test_release_in_two_threads(spark):
    """Each run deletes what it wrote itself, however the two overlap."""
    ready, done, seen = threading.Barrier(2), threading.Barrier(2), {}

    def run(name):
        first = storage.n_written()
        storage.written(spark.range(3), f"{name}-a")
        kept = storage.written(spark.range(5), f"{name}-b")
        ready.wait(60)
        if name == "one":
            storage.release(spark, first)
            done.wait(60)
        else:
            done.wait(60)
            seen[name] = kept.count()
            storage.release(spark, first, keep_last=True)
            seen["after"] = kept.count()

    threads = [threading.Thread(target=run, args=(n,)) for n in ("one", "two")]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert seen == {"two": 5, "after": 5}


def test_repeated_verdicts(spark):
    """The last command counts; equal last ones and repeats without an order are refused; every command has an outcome."""
    kind = "id string, status string, verdict_locked boolean, verdict_locked_at timestamp, verdict_locked_by string"
    c = spark.createDataFrame([(f"c{i}", "PENDING", False, None, None) for i in range(1, 5)], kind)
    rows = [("c1", "APPROVED", "a", 1), ("c1", "PENDING", "b", 2), ("c2", "PENDING", "a", 1), ("c2", "APPROVED", "b", 2), ("c3", "APPROVED", "a", 3), ("c3", "APPROVED", "b", 3), ("c4", "SOLD", "a", 9), ("c4", "APPROVED", "a", None), ("c9", "APPROVED", "a", 1), ("c4", None, "a", 1)]
    commands = spark.createDataFrame(rows, "id string, verdict string, by string, at int")
    got, outcomes = K.verdicts(c, commands, F.current_timestamp(), order="at")
    assert rows_of(got.select("id", "status", "verdict_locked", "verdict_locked_by")) == [("c1", "PENDING", False, None), ("c2", "APPROVED", True, "b"), ("c3", "PENDING", False, None), ("c4", "APPROVED", True, "a")]
    assert sorted(r.outcome for r in outcomes.collect()) == sorted(["superseded", "done", "superseded", "done", "ambiguous", "ambiguous", "unknown verdict", "done", "unknown cluster", "unknown verdict"])
    got, outcomes = K.verdicts(c, commands.where("id = 'c1'"), F.current_timestamp())
    assert got.count() == 4 and {r.outcome for r in outcomes.collect()} == {"ambiguous"}
