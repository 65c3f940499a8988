"""``python -m ctxspark.cli run "<task>" | init | stats | feedback hit|miss``: bundles on standard output, all else on standard error."""

from __future__ import annotations

import argparse
import json
import os
import sys
from datetime import datetime, timezone

from pyspark.sql import functions as F

from ctxspark.operators import graph, rerank, sources_syntax, usage
from ctxspark.plans import pipeline
from ctxspark.session import local_session
from ctxspark.sources import config, scan

OPTIONS, LOG = "ctxspark.json", ".ctxspark-usage"


def _log(spark, root: str, **entry) -> None:
    stamp = datetime.now(timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")
    row = {f.name: entry.get(f.name) for f in config.METRICS_LOG.fields} | {"timestamp": stamp}
    config.append_log(spark.createDataFrame([tuple(row[f.name] for f in config.METRICS_LOG.fields)], config.METRICS_LOG).coalesce(1), os.path.join(root, LOG))


def aliases_of(spark, root: str):
    """The path patterns of the repository's compiler configuration, if it has one."""
    rows: list[tuple] = []
    for name in ("tsconfig.json", "jsconfig.json"):
        at = os.path.join(root, name)
        if not rows and os.path.exists(at):
            with open(at, encoding="utf-8") as f:
                rows = config.alias_rows("repo", f.read())
    return spark.createDataFrame(rows, config.ALIASES)


def run(spark, root: str, task: str, budget: int, log: bool, pins: list[str] = [], rerank_candidates: bool = False) -> str:
    """The bundle of one task over one repository folder."""
    files = scan.scanned(spark, {"repo": root}, [LOG + "/", OPTIONS])
    imports = graph.with_aliases(sources_syntax.syntax_imports(files), aliases_of(spark, root), ["repo_id"])
    direct = graph.resolved_imports(imports.select("repo_id", "path", "spec", "ord", "base").distinct(), files, ["repo_id"])
    again = graph.resolved_imports(imports.filter("reexport").select("repo_id", "path", "spec", "ord", "base").distinct(), files, ["repo_id"])
    closure = graph.reexport_closure(again.withColumnRenamed("path", "src"), ["repo_id"])
    edges = graph.with_barrels(direct.withColumnRenamed("path", "src"), closure, ["repo_id"])
    tasks = spark.createDataFrame([(1, task, "repo", budget)], "query_id long, task string, repo_id string, budget long")
    pinned = spark.createDataFrame([("repo", x) for x in pins], "repo_id string, path string") if pins else None
    bundles, chosen = pipeline.compiled(files, tasks, edges, pins=pinned, judge=rerank.keyword_verdicts if rerank_candidates else None)
    if log:
        sums = chosen.agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).first()
        _log(spark, root, type="run", task=task, budgetTokens=budget, tokensUsed=sums["t"] or 0, chunksIncluded=sums["n"])
    return bundles.first()["bundle"]


def main(argv: list[str] | None = None) -> int:
    """Exit code 0, or 1 with a message on standard error."""
    p = argparse.ArgumentParser(prog="ctxspark")
    p.add_argument("command", choices=["run", "init", "stats", "feedback"])
    p.add_argument("what", nargs="?", default="")
    p.add_argument("--path", default=".")
    p.add_argument("--budget", type=int)
    p.add_argument("--out")
    p.add_argument("--pin", action="append", default=[], help="a file that is always in, relative to the path; may be repeated")
    p.add_argument("--rerank", action="store_true", help="judge the first candidates by their keywords")
    p.add_argument("--no-log", action="store_true")
    a = p.parse_args(argv)
    at = os.path.join(a.path, OPTIONS)
    try:
        options = config.options_file(at)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    if a.command == "init":
        if os.path.exists(at):
            print(f"{at} exists and stays as it is", file=sys.stderr)
            return 1
        with open(at, "w", encoding="utf-8") as f:
            json.dump({"budget": 8000}, f)
        return 0
    if a.command == "feedback" and a.what not in ("hit", "miss") or a.command == "run" and not a.what.strip():
        print("feedback takes hit or miss" if a.command == "feedback" else "run needs a task", file=sys.stderr)
        return 1
    budget = a.budget if a.budget is not None else options.get("budget", 8000)
    if not isinstance(budget, int) or budget <= 0:
        print("the budget must be a positive whole number", file=sys.stderr)
        return 1
    spark = local_session()
    if a.command == "feedback":
        _log(spark, a.path, type="feedback", outcome=a.what)
    elif a.command == "stats":
        log = config.read_log(spark, os.path.join(a.path, LOG)).select(
            F.col("type").alias("entry_type"), F.col("tokensUsed").alias("tokens_used"), F.col("budgetTokens").alias("budget_tokens"), "outcome")
        print(json.dumps(usage.summary(log).first().asDict()), file=sys.stderr)
    else:
        bundle = run(spark, a.path, a.what, budget, not a.no_log, a.pin or options.get("pin", []), a.rerank or bool(options.get("rerank")))
        if a.out:
            with open(a.out, "w", encoding="utf-8") as f:
                f.write(bundle)
        else:
            sys.stdout.write(bundle)
    return 0


if __name__ == "__main__":
    sys.exit(main())
