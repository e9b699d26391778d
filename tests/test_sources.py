"""Readers, writers and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from coastline.operators import contour, generators, temporal
from coastline.plans import comprehensive, studies
from coastline.sources import fields, logs, segments
from coastline.streaming import feedback_stream


def test_lenient_and_strict_segments(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# t\n\n1,0,2.5,1e-1 9\n.5 5. 7\n1 2 3\n  # x\n4\t5\t6\t7\n")
    got = segments.read(spark, str(tmp_path / "a.txt")).orderBy("seg_idx").collect()
    assert [(r.curve_id, r.seg_idx, r.x1, r.y2) for r in got] == [("a.txt", 0, 1.0, 0.1), ("a.txt", 1, 4.0, 7.0)]
    with pytest.raises(Exception, match="not four numbers"):
        segments.read(spark, str(tmp_path / "a.txt"), strict=True).collect()


def test_segment_files_round_trip(spark, tmp_path):
    segs = generators.koch(spark, 2)
    segments.write(segs, str(tmp_path / "out"), "Koch", 1.26)
    back = segments.read(spark, f"{tmp_path}/out/curve_id=koch/*.txt").count()
    assert back == 16


def test_feedback_log(spark, tmp_path):
    path = str(tmp_path / "log")
    assert logs.read_feedback(spark, path).count() == 0
    segs = generators.koch(spark, 2)
    expected = spark.createDataFrame([("koch", 1.2618595)], "curve_id string, theoretical_dimension double")
    records = comprehensive.learning_round(segs, expected, logs.read_feedback(spark, path))
    full = records.withColumns({"timestamp": F.lit("2024-01-01T00:00:00"), "computation_time": F.lit(0.1)})
    logs.append_feedback(full.select(*[c.strip().split(" ")[0] for c in ("timestamp", "interface_type", "features", "suggested_parameters", "dimension_result", "theoretical_dimension", "accuracy_score", "r_squared", "computation_time", "success", "failure_mode", "implementation")]), path)
    back = logs.read_feedback(spark, path).collect()
    assert len(back) == 1 and back[0].features.n_segments == 16 and back[0].interface_type == "koch_curve"
    again = comprehensive.learning_round(segs, expected, logs.read_feedback(spark, path)).first()
    assert again.interface_type == "koch_curve"


def vtk(nx, ny, f):
    xs, ys = np.linspace(0, 1, nx), np.linspace(0, 1, ny)
    values = "\n".join(" ".join(f"{f(x, y):.9f}" for x in xs) for y in ys)
    return (
        f"# vtk DataFile Version 3.0\nt\nASCII\nDATASET RECTILINEAR_GRID\nDIMENSIONS {nx} {ny} 1\nX_COORDINATES {nx} float\n{' '.join(map(str, xs))}\nY_COORDINATES {ny} float\n{' '.join(map(str, ys))}\n"
        f"Z_COORDINATES 1 float\n0\nPOINT_DATA {nx * ny}\nSCALARS F float 1\nLOOKUP_TABLE default\n{values}\n"
    )


def test_field_to_contour(spark, tmp_path):
    (tmp_path / "RT4x4-2000.vtk").write_text(vtk(21, 21, lambda x, y: (x - 0.5) ** 2 + (y - 0.5) ** 2))
    field = fields.read_vtk(spark, str(tmp_path))
    assert field.count() == 441
    segs = contour.contours(field, 0.09)
    length = segs.agg(F.sum(F.expr("sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))"))).first()[0]
    assert length == pytest.approx(2 * np.pi * 0.3, rel=0.01)


def test_saved_run_round_trip(spark, tmp_path):
    rows = [("a", 1.0, 10, 0.1, 1.4, 15, 1.2, 0.99), ("a", 0.0, 5, 0.2, 1.4, 15, 1.1, 0.98)]
    ev = spark.createDataFrame(rows, "series_id string, time double, n_segments long, initial_delta double, delta_factor double, num_steps int, dimension double, r_squared double")
    (tmp_path / "run.json").write_text(logs.run_json(ev).first().json)
    back = logs.read_run(spark, str(tmp_path / "run.json")).orderBy("time").collect()
    assert [(r.time, r.n_segments, r.num_steps) for r in back] == [(0.0, 5, 15), (1.0, 10, 15)]


def stream_of(spark, tmp_path, batches):
    for rows in batches:
        spark.createDataFrame(rows, feedback_stream.FRAME).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(feedback_stream.FRAME).json(str(tmp_path / "in"))
        out = feedback_stream.temporal_parameters(stream, "3 seconds").writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
        out.start(str(tmp_path / "out")).awaitTermination(120)
    return spark.read.parquet(str(tmp_path / "out"))


def test_stream_equals_batch(spark, tmp_path):
    """Frames out of order within the watermark, and counts of zero; the last batch lets the watermark pass all frames."""
    sizes = [475, 2624, 0, 4116, 0, 0, 5435, 6000]
    frames = [("a", float(t), n, 0.3975) for t, n in enumerate(sizes)] + [("b", float(t), 100 * 2**t, 1.0) for t in range(8)]
    early = [f for f in frames if f[1] < 5]
    batches = [[f for f in early if f[1] != 2], [f for f in frames if f[1] in (2, 5)] + [frames[-1]], [f for f in frames if f[1] >= 6 and f != frames[-1]], [("z", 1000.0, 1, 1.0)], [("z", 2000.0, 1, 1.0)]]
    got = {(r.series_id, r.time, round(r.initial_delta, 12), round(r.delta_factor, 9), r.num_steps) for r in stream_of(spark, tmp_path, batches).collect() if r.series_id != "z"}
    batch = temporal.recurrence(spark.createDataFrame(frames, feedback_stream.FRAME))
    assert got == {(r.series_id, r.time, round(r.initial_delta, 12), round(r.delta_factor, 9), r.num_steps) for r in batch.collect()}


def test_run_over_files(spark, tmp_path):
    for k in range(4):
        (tmp_path / f"RT4x4-{2000 + 1000 * k}.vtk").write_text(vtk(21, 21, lambda x, y, k=k: (x - 0.5) ** 2 + (y - 0.5) ** 2 + 0.4 - 0.01 * k))
    got = studies.evolution_of_files(spark, str(tmp_path), 2.0, 4.0, 1.0).orderBy("time").collect()
    assert [r.time for r in got] == [2.0, 3.0, 4.0] and [r.num_steps for r in got] == [15, 15, 15]
    assert all(r.n_segments > 50 for r in got)
    field = fields.read_vtk(spark, str(tmp_path))
    assert all(0.8 < r.dimension < 1.3 for r in studies.evolution(field, applied=False).collect())


def test_report(spark, tmp_path):
    best, scored = studies.optimise(generators.koch(spark, 2), 1.2618595)
    lines = studies.report(best, scored, 1.2618595, "koch")
    assert lines[1] == "Curve: koch" and len(lines) == 5 + 8 + 2 + 20
    studies.write_report(spark, lines, str(tmp_path / "r"))
    assert [r.value for r in spark.read.text(str(tmp_path / "r")).collect()] == lines
    with pytest.raises(ValueError):
        studies.optimise(generators.koch(spark, 2).unionByName(generators.hilbert(spark, 2)), 1.5)
