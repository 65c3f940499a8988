"""Connectors with a mocked transport, SQL functions, and the command line."""

import json

import pytest

from ctxspark import cli
from ctxspark.functions.register import register
from ctxspark.sources import services


def test_embedders(monkeypatch):
    monkeypatch.delenv("VOYAGE_API_KEY", raising=False)
    with pytest.raises(ValueError, match="VOYAGE_API_KEY"):
        services.Embedder("voyage")
    monkeypatch.setenv("VOYAGE_API_KEY", "k")
    monkeypatch.setenv("OPENAI_API_KEY", "k")
    calls = []

    def post(url, headers, body):
        calls.append((url, headers, body))
        return 200, {"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]}

    voyage = services.Embedder("voyage", post=post)
    assert voyage.namespace == "voyage:voyage-code-3" and voyage.embed(["a", "b"]) == [[1.0], [2.0]] and voyage.embed([]) == []
    assert calls[0][2]["input_type"] == "document" and calls[0][1]["Authorization"] == "Bearer k" and len(calls) == 1
    assert "input_type" not in (services.Embedder("openai", "m", post).embed(["a", "b"]) and calls[1][2])
    with pytest.raises(RuntimeError, match="429"):
        services.Embedder("openai", post=lambda *a: (429, {})).embed(["a"])


def test_judges(monkeypatch):
    for name in ("OPENAI_API_KEY", "ANTHROPIC_API_KEY"):
        monkeypatch.setenv(name, "k")
    said = {"verdicts": [{"id": "b", "keep": False, "reason": "no"}]}
    want = [{"id": "a", "keep": True, "reason": services.NOT_JUDGED}, {"id": "b", "keep": False, "reason": "no"}]
    chat = lambda u, h, b: (200, {"choices": [{"message": {"content": json.dumps(said)}}]})
    tool = lambda u, h, b: (200, {"content": [{"type": "tool_use", "input": said}]}) if b["tool_choice"]["name"] == "report_verdicts" else (500, {})
    assert services.verdicts("openai", "", "t", ["a", "b"], ["x", "y"], chat) == want
    assert services.verdicts("anthropic", "", "t", ["a", "b"], ["x", "y"], tool) == want
    broken = services.verdicts("openai", "", "t", ["a"], ["x"], lambda *a: (200, {"choices": [{"message": {"content": "oh"}}]}))
    assert broken == [{"id": "a", "keep": True, "reason": services.NOT_READABLE}]


def test_services_in_tasks(spark, monkeypatch):
    monkeypatch.setenv("OPENAI_API_KEY", "k")

    def post(url, headers, body):
        if "input" in body:
            return 200, {"data": [{"index": i, "embedding": [float(len(t))]} for i, t in enumerate(body["input"])]}
        return 200, {"choices": [{"message": {"content": '{"verdicts": [{"id": "x", "keep": false, "reason": "r"}]}'}}]}

    misses = spark.createDataFrame([("k1", "ab"), ("k2", "abc")], "entry_key string, text string")
    got = services.embedded(misses, services.Embedder("openai", post=post), 1).collect()
    assert sorted((r.entry_key, r.vector) for r in got) == [("k1", [2.0]), ("k2", [3.0])]
    top = spark.createDataFrame([(1, "t", "x", "a", 1), (1, "t", "y", "b", 2)], "query_id long, task string, id string, text string, rank int")
    assert sorted((r.id, r.keep, r.ord) for r in services.judged(top, "openai", post=post).collect()) == [("x", False, 1), ("y", True, 2)]


def test_sql_functions(spark):
    register(spark)
    spark.createDataFrame([("a.py", "import b\n" * 3), ("n", None)], "path string, text string").createOrReplaceTempView("files_")
    assert spark.sql("SELECT spec, reexport FROM files_, LATERAL imports_of(path, text)").collect() == [("b", False)]
    assert spark.sql("SELECT start_line, end_line FROM files_, LATERAL spans_of(path, text, 2)").collect() == [(1, 2), (3, 3)]
    assert spark.sql("SELECT count_tokens('hello world') AS n, count_tokens(NULL) AS z").first() == (2, 0)


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "login.ts").write_text("export function loginUser() {}\n")
    at = ["--path", str(tmp_path)]
    assert cli.main(["run", "", *at]) == 1 and cli.main(["feedback", "maybe", *at]) == 1 and cli.main(["run", "x", "--budget", "0", *at]) == 1
    capsys.readouterr()
    assert cli.main(["init", *at]) == 0 and cli.main(["init", *at]) == 1
    assert cli.main(["run", "fix the loginUser bug", "--budget", "500", *at]) == 0
    out = capsys.readouterr().out
    assert out.startswith("# Context Bundle") and "src/login.ts" in out and "**Token budget:** 500" in out
    assert cli.main(["feedback", "hit", *at]) == 0 and cli.main(["stats", *at]) == 0
    stats = json.loads(capsys.readouterr().err.strip().splitlines()[-1])
    assert stats["runs"] == 1 and stats["hits"] == 1 and stats["hit_rate"] == 1.0
    (tmp_path / "ctxspark.json").write_text("{")
    assert cli.main(["stats", *at]) == 1
