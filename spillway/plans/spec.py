"""Jobs as data: a job is a graph of nodes, a node is source, steps, an optional reduction and sinks."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

import yaml

#: The names that a job may use, with their fields and defaults (... marks a field that must be given).
SOURCES: dict[str, dict[str, Any]] = {
    "ndjson-file": {"url": ..., "schema": None},
    "json-file": {"url": ..., "schema": None},
    "csv-file": {"url": ...},
    "inline": {"rows": ...},
    "ref": {"node": ...},
    "kvstore": {"name": ...},
    "lucene": {"name": ..., "query": None},
    "sql": {"sql": ...},
    "sqlite": {"path": ..., "query": ..., "params": ()},
    "nats": {"subject": ..., "servers": None, "schema": None},
    "kafka": {"bootstrap": ..., "topic": ..., "groupId": None, "schema": None},
    "parquet": {"url": ..., "order": None},
    "file-stream": {"url": ..., "schema": ..., "format": "json", "maxFilesPerTrigger": None},
}
STEPS: dict[str, dict[str, Any]] = {
    "filter": {"expr": ...},
    "project": {"cols": ...},
    "rename": {"from": ..., "to": ...},
    "set-field": {"name": ..., "value": None},
    "to-typed": {"fields": ..., "passthrough": False},
    "lookup": {"from": ..., "onField": ..., "withKey": ..., "adds": ()},
    "groovy-map": {"script": ...},
    "expr-map": {"fields": ..., "keep": False, "where": None},
    "jvs-groovy": {"script": ..., "typeJson": None},
    "jvs-enrich": {"tags": (), "typeJsonResource": None},
    "jvs-translate": {"targetLangs": (), "sourceLang": None, "mlsFields": (), "ollamaUrl": None, "model": None},
    "jvssql": {"sql": ...},
}
SINKS: dict[str, dict[str, Any]] = {
    "ndjson-file": {"url": ..., "registerAsTable": None},
    "csv-file": {"url": ..., "cols": ...},
    "json-file": {"url": ..., "pretty": False},
    "kvstore": {"name": ..., "keyExpr": ..., "registerAsTable": None},
    "lucene": {"name": ..., "storeSource": True},
    "jvs-lucene": {"name": ..., "typeJsonResource": None, "storeSource": True},
    "nats": {"subject": ..., "servers": None},
    "kafka": {"bootstrap": ..., "topic": ..., "keyExpr": None},
    "counting": {"label": "count"},
    "memory-table": {"name": ...},
    "parquet": {"url": ...},
}
AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX", "DISTINCT_COUNT", "FIRST", "LAST", "COLLECT")

#: Kinds that plug-ins have added: their fields are not checked.
PLUGGED: dict[str, set[str]] = {"source": set(), "step": set(), "sink": set()}


class SpecError(ValueError):
    """A job that can't be understood."""


@dataclass(frozen=True)
class Part:
    """A source, step or sink."""

    kind: str
    args: Mapping[str, Any]

    def __getitem__(self, name: str) -> Any:
        return self.args[name]


@dataclass(frozen=True)
class Aggregate:
    name: str
    kind: str
    of: str | None = None


@dataclass(frozen=True)
class Reduce:
    group_by: tuple[str, ...] = ()
    aggs: tuple[Aggregate, ...] = ()
    shuffle: bool = False
    buckets: int = 2


@dataclass(frozen=True)
class Node:
    id: str
    source: Part
    steps: tuple[Part, ...] = ()
    reduce: Reduce | None = None
    sinks: tuple[Part, ...] = ()
    depends: tuple[str, ...] = ()
    partition: Mapping[str, Any] | None = None


@dataclass(frozen=True)
class Job:
    id: str
    nodes: tuple[Node, ...] = ()
    version: str = "1"
    restartable: bool = False
    text: str = field(default="", compare=False, repr=False)

    def as_dict(self) -> dict[str, Any]:
        def part(p: Part) -> dict[str, Any]:
            return {"kind": p.kind, **p.args}

        def node(n: Node) -> dict[str, Any]:
            pipeline: dict[str, Any] = {"source": part(n.source), "steps": [part(s) for s in n.steps], "sinks": [part(s) for s in n.sinks]}
            if n.reduce:
                pipeline["reduce"] = {"group-by": list(n.reduce.group_by), "aggs": [{"name": a.name, "kind": a.kind, "of": a.of} for a in n.reduce.aggs], "shuffle": n.reduce.shuffle, "buckets": n.reduce.buckets}
            return {"id": n.id, "depends": list(n.depends), "pipeline": pipeline} | ({"partition": dict(n.partition)} if n.partition else {})

        return {"job": self.id, "version": self.version, "restartable": self.restartable, "nodes": [node(n) for n in self.nodes]}

    def to_yaml(self) -> str:
        return yaml.safe_dump(json.loads(json.dumps(self.as_dict(), default=str)), sort_keys=False, allow_unicode=True)


def part(what: str, given: Any, kinds: Mapping[str, Mapping[str, Any]]) -> Part:
    if not isinstance(given, Mapping) or "kind" not in given:
        raise SpecError(f"a {what} needs a kind: {given!r}")
    kind = given["kind"]
    if kind in PLUGGED[what]:
        return Part(kind, {k: v for k, v in given.items() if k != "kind"})
    if kind not in kinds:
        raise SpecError(f"unknown {what} kind '{kind}'; known: {', '.join(sorted(kinds))}")
    args = {}
    for name, default in kinds[kind].items():
        value = given.get(name, default)
        if value is ...:
            raise SpecError(f"{what} '{kind}' needs '{name}'")
        args[name] = tuple(value) if isinstance(default, tuple) and value is not None else default if value is None else value
    return Part(kind, args)


def reduce_of(given: Mapping[str, Any]) -> Reduce:
    aggs = []
    for a in given.get("aggs") or ():
        kind = str(a.get("kind", "")).upper()
        if kind not in AGGREGATES:
            raise SpecError(f"unknown aggregate kind '{a.get('kind')}'; known: {', '.join(AGGREGATES)}")
        aggs.append(Aggregate(str(a["name"]), kind, a.get("of")))
    return Reduce(tuple(given.get("group-by") or given.get("groupBy") or ()), tuple(aggs), bool(given.get("shuffle", False)), int(given.get("buckets") or 2))


def node_of(given: Mapping[str, Any]) -> Node:
    if not given.get("id"):
        raise SpecError("a node needs an id")
    pipeline = given.get("pipeline") or {}
    if not pipeline.get("source"):
        raise SpecError(f"node '{given['id']}' has no source")
    return Node(
        str(given["id"]),
        part("source", pipeline["source"], SOURCES),
        tuple(part("step", s, STEPS) for s in pipeline.get("steps") or ()),
        reduce_of(pipeline["reduce"]) if pipeline.get("reduce") else None,
        tuple(part("sink", s, SINKS) for s in pipeline.get("sinks") or ()),
        tuple(map(str, given.get("depends") or ())),
        given.get("partition"),
    )


def job_of(given: Mapping[str, Any], text: str = "") -> Job:
    name = given.get("job") or given.get("id")
    if not name:
        raise SpecError("a job needs a name: 'job:' or 'id:'")
    return Job(str(name), tuple(node_of(n) for n in given.get("nodes") or ()), str(given.get("version") or "1"), bool(given.get("restartable", False)), text)


def parse(text: str) -> Job:
    """From YAML or JSON; properties that nothing knows are ignored."""
    try:
        given = json.loads(text) if text.lstrip()[:1] in ("{", "[") else yaml.safe_load(text)
    except (ValueError, yaml.YAMLError):
        try:
            given = yaml.safe_load(text)  # flow-style YAML starts with a brace, too
        except yaml.YAMLError as e:
            raise SpecError(f"neither JSON nor YAML: {e}") from e
    if not isinstance(given, Mapping):
        raise SpecError("a job must be a mapping")
    return job_of(given, text)
