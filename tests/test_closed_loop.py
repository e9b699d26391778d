"""The log as a stream's sink: restarts, batches run again, curated records by key, suggestions from earlier batches."""

from pyspark.sql import functions as F

from coastline.operators import feedback, spread
from coastline.streaming import closed_loop

SCHEMA = "record_id bigint, interface_type string, dimension_result double, theoretical_dimension double, r_squared double, extra string"
DEFAULT = {"initial_delta": 1.0, "delta_factor": 1.2, "num_steps": 15.0}


def put(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, at, **kw):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    closed_loop.sink(stream, f"{at}/log", f"{at}/state", **kw).awaitTermination()
    return sorted(closed_loop.read(spark, f"{at}/log", "record_id").select("record_id", "success", "batch_id", "curated_version").collect(), key=str)


def test_restart_and_repeated_batch_leave_the_same_log(spark, tmp_path):
    at = str(tmp_path)
    put(spark, [(1, "a", 1.5, 1.5, 0.9, "x"), (2, "a", 1.0, 1.5, 0.9, None)], f"{at}/in")
    first = run(spark, at)
    assert [(r.record_id, r.success, r.batch_id) for r in first] == [(1, True, 0), (2, False, 0)]
    assert run(spark, at) == first
    put(spark, [(3, "a", 1.5, 1.5, 0.9, ""), (2, "a", 1.5, 1.5, 0.9, "newer"), (None, "a", None, 1.5, 0.9, "x"), (None, "a", None, 1.5, 0.9, "x")], f"{at}/in")
    both = run(spark, at)
    assert sorted((str(r.record_id), r.success, r.batch_id) for r in both) == [("1", True, 0), ("2", True, 1), ("3", True, 1), ("None", False, 1), ("None", False, 1)]
    # a crash after writing and before committing: the batch's commit is missing, and it is run again
    for name in ("1", ".1.crc"):
        (tmp_path / "state" / "commits" / name).unlink(missing_ok=True)
    assert run(spark, at) == both


def test_curated_records_replace_by_key(spark, tmp_path):
    at = str(tmp_path)
    assert closed_loop.read(spark, f"{at}/log", "record_id") is None
    put(spark, [(1, "a", 1.5, 1.5, 0.9, "x"), (2, "a", 1.0, 1.5, 0.9, None)], f"{at}/in")
    run(spark, at)
    curated = spark.createDataFrame([(2, "a", 1.5, 1.5, 0.9, "c"), (9, "b", 1.2, 1.2, 0.9, "c")], SCHEMA)
    for version in (1, 2, 2):
        closed_loop.inject(feedback.with_outcome(curated), f"{at}/log", version)
    got = {r.record_id: (r.success, r.batch_id, r.curated_version) for r in closed_loop.read(spark, f"{at}/log", "record_id").collect()}
    assert got == {1: (True, 0, None), 2: (True, None, 2), 9: (True, None, 2)}


def test_suggestions_come_from_earlier_batches(spark, tmp_path):
    at = str(tmp_path)

    def score(batch, number):
        known = closed_loop.read(spark, f"{at}/log", "record_id", before=number) if number else None
        out = closed_loop.suggested(batch, known, DEFAULT if number == 0 else {n: 9.0 for n in DEFAULT})
        return feedback.with_outcome(out)

    put(spark, [(1, "a", 1.5, 1.5, 0.9, "x"), (2, "b", 1.0, 1.5, 0.9, "x")], f"{at}/in")
    run(spark, at, score=score)
    put(spark, [(3, "a", 1.5, 1.5, 0.9, "x"), (4, "b", 1.5, 1.5, 0.9, "x")], f"{at}/in")
    run(spark, at, score=score)
    got = {r.record_id: r.suggested_parameters.initial_delta for r in closed_loop.read(spark, f"{at}/log", "record_id").collect()}
    assert got == {1: 1.0, 2: 1.0, 3: 1.0, 4: 9.0}


def test_partitions_of_a_log_that_is_read_grow_with_its_rows(spark, tmp_path, monkeypatch):
    at = str(tmp_path)
    put(spark, [(i, "a", 1.5, 1.5, 0.9, "x") for i in range(60)], f"{at}/in")
    assert len(run(spark, at)) == 60
    monkeypatch.setattr(spread, "ROWS", 5)
    got = closed_loop.read(spark, f"{at}/log", "record_id")
    assert got.count() == 60 and got.select(F.spark_partition_id()).distinct().count() > 4
