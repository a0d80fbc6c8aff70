"""State by stretches of event time: disorder over batches, late rows, idle keys."""

from datetime import datetime, timedelta


from parcelyn.streaming import jobs

T0 = datetime(2024, 1, 1)


def run(spark, path, batches, job):
    """Each batch is one file; the rows that a job gives over all of them."""
    schema = "domain string, created_at timestamp, id long, success boolean, stage int"
    for k, rows in enumerate(batches):
        spark.createDataFrame([(d, T0 + timedelta(hours=h), i, ok, s) for d, h, i, ok, s in rows], schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        # Files are taken in the order in which they were made.
        import time

        time.sleep(1.1 if k < len(batches) - 1 else 0)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    job(stream).writeStream.option("checkpointLocation", f"{path}/log").trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("append").parquet(f"{path}/out")).start().awaitTermination()
    return sorted((r.domain, r.stage, (r.created_at - T0).total_seconds() / 3600) for r in spark.read.schema("domain string, stage int, created_at timestamp").parquet(f"{path}/out").collect())


def test_disorder_late_rows_and_idle_keys(spark, tmp_path):
    late = [("a", 0.0, 5, False, 1)]
    batches = [
        [("a", 3.0, 3, True, 1), ("b", 1.0, 1, True, 2), ("c", 0.0, 1, True, 1)],
        [("a", 1.0, 1, True, 1), ("a", 2.0, 2, True, 1), ("b", 1.0, 2, True, 2), ("c", 1.0, 2, True, 1)],
        [("b", 0.5, 0, False, 2), ("b", 2.0, 3, True, 2), ("z", 30.0, 0, False, 0)],
        [*late, ("c", 200.0, 3, True, 1), ("z", 201.0, 0, False, 0)],
        [("c", 201.5, 4, True, 1), ("c", 202.0, 5, True, 1), ("z", 300.0, 0, False, 0)],
    ]
    # a: three in order although the third came first, and the late failure is dropped; b: a failure before three;
    # c: two, a silence longer than idle, then three more, of which only the last make a streak.
    got = run(spark, str(tmp_path), batches, lambda x: jobs.promotions(x, "10 hours", idle="48 hours"))
    assert got == [("a", 1, 3.0), ("b", 2, 2.0), ("c", 1, 202.0)]


def test_folds_over_many_stretches(spark, tmp_path):
    rows = [("d", h * 0.9, i, i % 7 != 0, 1) for i, h in enumerate(range(60))]
    shuffled = [rows[k::4] for k in (2, 0, 3, 1)]
    got = run(spark, str(tmp_path), [*shuffled, [("z", 500.0, 0, False, 0)]], lambda x: jobs.promotions(x, "100 hours"))
    due, streak = [], 0
    for _, h, _, ok, stage in rows:
        streak = streak + 1 if ok else 0
        if streak == 3:
            due.append(("d", stage, h))
    assert [(d, s, round(h, 3)) for d, s, h in got] == [(d, s, round(h, 3)) for d, s, h in due]
