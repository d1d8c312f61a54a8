"""Text read in splits, and rows counted while they are written."""

from pyspark.sql import functions as F

from colonnade.sources import gates, logs, segment_text
from colonnade.streaming.jobs import settings


def test_lines_are_numbered_across_splits(spark, tmp_path):
    """Splits of a hundred bytes: every line keeps its number in the file, also one longer than a split."""
    files = {"a": [f"line {i} " + "x" * (i * 7 % 50) for i in range(100)] + ["y" * 350, "last"], "b": ["only"], "c": ["", "p", "", "q", ""]}
    for name, lines in files.items():
        (tmp_path / f"run={name}").mkdir()
        (tmp_path / f"run={name}" / "log.txt").write_text("\n".join(lines) + "\n")
    with settings(spark, {"spark.sql.files.maxPartitionBytes": "100", "spark.sql.files.openCostInBytes": "1"}):
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        every = logs.numbered_lines(spark, str(tmp_path))
        got = {(r.run, r.line_no): (r.line, r.n_lines) for r in every.collect()}
        assert got == {(n, i): (x, len(f)) for n, f in files.items() for i, x in enumerate(f, 1)}
        for last in (1, 3, 40, 1000):
            tail = sorted((r.run, r.line_no, r.line) for r in logs.last_lines(spark, str(tmp_path), last).collect())
            assert tail == sorted((n, i, x) for n, f in files.items() for i, x in list(enumerate(f, 1))[-last:])


def test_written_logs_come_back(spark, tmp_path):
    lines = spark.range(500).select((F.col("id") % 3).alias("run"), F.col("id"), F.concat(F.lit("l"), "id").alias("line"))
    logs.log_files(lines, "run", "id", "line", str(tmp_path / "logs"))
    got = {(r.run, r.line_no): r.line for r in logs.numbered_lines(spark, str(tmp_path / "logs")).collect()}
    assert got == {(i % 3, i // 3 + 1): f"l{i}" for i in range(500)}


def test_rows_are_counted_while_good_ones_are_written(spark, tmp_path):
    rows = spark.range(1000).withColumn("kind", F.when(F.col("id") % 10 == 0, "dark").when(F.col("id") % 10 == 1, "odd").when(F.col("id") != 7, "ok"))
    counts = gates.write_accepted(rows, F.col("kind"), ["dark", "small"], str(tmp_path / "good"))
    assert counts == {"ok": 799, "dark": 100, "small": 0, "other": 101}
    back = spark.read.parquet(str(tmp_path / "good"))
    assert back.count() == 799 and back.columns == ["id", "kind"]
    none = gates.write_accepted(rows.where("false"), F.col("kind"), ["dark"], str(tmp_path / "none"))
    assert none == {"ok": 0, "dark": 0, "other": 0}


def test_files_are_written_by_many_tasks(spark, tmp_path):
    """short files are not left to one task, which the partition numbers in their names show."""
    lines = spark.range(400).select((F.col("id") % 100).alias("k"), "id", F.concat(F.lit("l"), "id").alias("line"))
    segment_text.write_files(lines, "k", "id", "line", str(tmp_path / "files"))
    got = segment_text.read_files(spark, str(tmp_path / "files"))
    assert {(r.k, r.line_no, r.line) for r in got.collect()} == {(i % 100, i // 100, f"l{i}") for i in range(400)}
    assert len({r.path.rsplit("/", 1)[1].split("-")[1] for r in got.select("path").distinct().collect()}) > 4


def test_cells_are_dealt_to_tasks_by_rows(spark, monkeypatch):
    """However few bytes the cells have, a task joins a bounded number of them to their verdicts."""
    from colonnade import session
    from colonnade.plans.registry import Tables, load_all

    monkeypatch.setattr(session, "TASK_ROWS", 200)
    t = Tables(spark, "/root/testdata/sf0.001")
    df = load_all()["q_quarantine"].run(t)
    plan = df._jdf.queryExecution().toString()
    tasks = -(-t.fx_pixels.count() // 200)
    assert tasks > 8 and plan.split("Physical Plan")[1].count(f", {tasks}), REPARTITION_BY_NUM") >= 2
    assert df.agg({"n_cells": "sum"}).first()[0] == t.fx_pixels.count()
