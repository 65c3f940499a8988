"""Scans, small files, the log and the stream."""

import pytest
from pyspark.sql import functions as F

from ctxspark.sources import config
from ctxspark.sources.scan import scanned
from ctxspark.streaming.usage_stream import drained, log_stream, windowed_usage


def test_scan(spark, tmp_path):
    root = tmp_path / "repo"
    for path, content in {
        ".gitignore": b"build/\n*.log\n!keep.log\n", "src/a.ts": b"let a = 1;\n", "pkg/__init__.py": b"x", ".github/w.yml": b"on: push", "node_modules/m/i.js": b"x", "build/o.js": b"x", "debug.log": b"x",
        "keep.log": b"x", "logo.png": b"x", "src/mystery.fmt": b"a\0b", "src/empty.ts": b"", "src/bad.txt": b"\xff\xfe ok", "big.txt": b"x" * 600_000,
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(content)
    (root / "broken").symlink_to(root / "nowhere")
    got = {r.path: r.text for r in scanned(spark, {"r": str(root), "gone": str(tmp_path / "none")}, ["src/*.md"]).collect()}
    assert sorted(got) == [".github/w.yml", ".gitignore", "keep.log", "pkg/__init__.py", "src/a.ts", "src/bad.txt"]
    assert "\ufffd" in got["src/bad.txt"]


def test_options_and_aliases(tmp_path):
    assert config.options_file(str(tmp_path / "none.json")) == {}
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(ValueError, match="isn't valid JSON"):
        config.options_file(str(tmp_path / "bad.json"))
    text = '{ // paths\n "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*", "lib/*"],}, }, }'
    assert config.alias_rows("r", text) == [("r", "@/", "", "src/*", ".", 1), ("r", "@/", "", "lib/*", ".", 2)]


def test_log(spark, tmp_path):
    path = str(tmp_path / "log")
    assert config.read_log(spark, path).count() == 0
    config.append_log(spark.createDataFrame([("run", "t")], "type string, task string"), path)
    (tmp_path / "log" / "part-bad.json").write_text('{"type": "feedback", "outcome": "hit"}\n\nnot json\n')
    assert sorted(r.type for r in config.read_log(spark, path).collect()) == ["feedback", "run"]


def test_stream(spark, tmp_path):
    rows = [(1, "run", "2024-01-01 10:00:00", None), (1, "run", "2024-01-01 10:00:00", None), (2, "feedback", "2024-01-01 11:00:00", "Hit"), (3, "feedback", "2024-01-02 11:00:00", "miss")]
    df = spark.createDataFrame(rows, "entry_id long, entry_type string, logged_at string, outcome string").withColumn("logged_at", F.col("logged_at").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    got = drained(windowed_usage(log_stream(spark, str(tmp_path / "in"), df.schema)))
    assert sorted((str(r.day)[:10], r.runs, r.hits, r.misses) for r in got.collect()) == [("2024-01-01", 1, 1, 0), ("2024-01-02", 0, 0, 1)]
