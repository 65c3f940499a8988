"""Embedding and judging services, reached from Arrow batches through an injected transport.

A transport is ``post(url, headers, body) -> (status, parsed answer)``; tests and offline runs pass their own.
"""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

Post = Callable[[str, dict, dict], tuple[int, dict]]

# Addresses, default models and the variables that hold the keys.
EMBEDDERS = {
    "openai": ("https://api.openai.com/v1/embeddings", "text-embedding-3-small", "OPENAI_API_KEY"),
    "voyage": ("https://api.voyageai.com/v1/embeddings", "voyage-code-3", "VOYAGE_API_KEY"),
}
JUDGES = {
    "openai": ("https://api.openai.com/v1/chat/completions", "gpt-4o-mini", "OPENAI_API_KEY"),
    "anthropic": ("https://api.anthropic.com/v1/messages", "claude-haiku-4-5", "ANTHROPIC_API_KEY"),
}
NOT_JUDGED, NOT_READABLE = "not evaluated by reranker; kept by default", "reranker response unparseable; kept by default"
INSTRUCTION = "Decide for every snippet whether the task needs it. Answer with JSON: {\"verdicts\": [{\"id\", \"keep\", \"reason\"}]}."


def http_post(url: str, headers: dict, body: dict) -> tuple[int, dict]:
    """One JSON request over HTTP."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=120) as answer:
            return answer.status, json.load(answer)
    except urllib.error.HTTPError as e:
        return e.code, {"error": e.read().decode(errors="replace")[:500]}


def _key(name: str) -> str:
    if not os.environ.get(name):
        raise ValueError(f"{name} isn't set; export it to use this service")
    return os.environ[name]


@dataclass(frozen=True)
class Embedder:
    """A remote embedder; its namespace keeps its vectors apart from those of other services and models."""

    service: str
    model: str = ""
    post: Post = http_post
    key: str = field(default="", repr=False)

    def __post_init__(self) -> None:
        """The key is read where the embedder is made, on the driver, and goes to the tasks with it."""
        object.__setattr__(self, "key", self.key or _key(EMBEDDERS[self.service][2]))

    @property
    def namespace(self) -> str:
        return f"{self.service}:{self.model or EMBEDDERS[self.service][1]}"

    def embed(self, texts: list[str]) -> list[list[float]]:
        """One vector per text, in the order of the texts; none for none. A bad status raises an error that names it."""
        if not texts:
            return []
        url = EMBEDDERS[self.service][0]
        body = {"model": self.namespace.partition(":")[2], "input": texts} | ({"input_type": "document"} if self.service == "voyage" else {})
        status, answer = self.post(url, {"Authorization": f"Bearer {self.key}"}, body)
        if not 200 <= status < 300:
            raise RuntimeError(f"{self.service} embedding request failed: {status} {answer}")
        return [d["embedding"] for d in sorted(answer["data"], key=lambda d: d["index"])]


def embedded(misses: DataFrame, embedder: Embedder, batch: int = 64) -> DataFrame:
    """``entry_key, vector`` for rows of ``entry_key, text``, a request per ``batch`` rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i:i + batch]
                yield pd.DataFrame({"entry_key": part.entry_key, "vector": embedder.embed(list(part.text))})

    return misses.select("entry_key", "text").mapInPandas(run, "entry_key string, vector array<double>")


def verdicts(service: str, model: str, task: str, ids: list[str], texts: list[str], post: Post = http_post, key: str = "") -> list[dict]:
    """A verdict per candidate; what the service leaves out, or answers unreadably, is kept."""
    url, default, name = JUDGES[service]
    key = key or _key(name)
    listed = "\n\n".join(f'{n}. id="{i}"\n{t}' for n, (i, t) in enumerate(zip(ids, texts), 1))
    ask = {"role": "user", "content": f"Task: {task}\n\nCandidates:\n\n{listed}"}
    if service == "anthropic":
        one = {"type": "object", "properties": {"id": {"type": "string"}, "keep": {"type": "boolean"}, "reason": {"type": "string"}}, "required": ["id", "keep", "reason"]}
        tool = {"name": "report_verdicts", "input_schema": {"type": "object", "properties": {"verdicts": {"type": "array", "items": one}}, "required": ["verdicts"]}}
        body = {"model": model or default, "max_tokens": 4096, "system": INSTRUCTION, "messages": [ask], "tools": [tool], "tool_choice": {"type": "tool", "name": "report_verdicts"}}
        _, answer = post(url, {"x-api-key": key, "anthropic-version": "2023-06-01"}, body)
        found = next((b["input"] for b in answer.get("content", []) if b.get("type") == "tool_use"), {})
    else:
        body = {"model": model or default, "response_format": {"type": "json_object"}, "messages": [{"role": "system", "content": INSTRUCTION}, ask]}
        _, answer = post(url, {"Authorization": f"Bearer {key}"}, body)
        try:
            found = json.loads(answer["choices"][0]["message"]["content"])
        except (KeyError, IndexError, TypeError, ValueError):
            return [{"id": i, "keep": True, "reason": NOT_READABLE} for i in ids]
    by = {v["id"]: v for v in found.get("verdicts") or []}
    return [{"id": i, "keep": True, "reason": NOT_JUDGED} | by.get(i, {}) for i in ids]


def judged(candidates: DataFrame, service: str, model: str = "", post: Post = http_post) -> DataFrame:
    """``query_id, id, keep, reason, ord`` for the top candidates (``query_id, task, id, text, rank``), a request per query.

    Only a query's first ranks come here (20 by default), so a group is small.
    """

    key = _key(JUDGES[service][2])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank")
        out = pd.DataFrame(verdicts(service, model, group.task.iloc[0], list(group.id), list(group.text), post, key))
        return out.assign(query_id=group.query_id.iloc[0], ord=group["rank"].to_numpy())[["query_id", "id", "keep", "reason", "ord"]]

    return candidates.select("query_id", "task", "id", "text", "rank").groupBy("query_id").applyInPandas(run, "query_id long, id string, keep boolean, reason string, ord int")
