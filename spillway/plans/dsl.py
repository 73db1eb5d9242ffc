"""A builder for jobs, for loops and variables that a YAML text can't hold.

    with job("rollup") as j:
        with j.node("sales") as n:
            n.source(ndjson="sales.ndjson")
            n.step(filter="units > 5")
            n.reduce(by=["region"], n="count", total=("sum", "units"))
            n.sink(memory_table="by-region")
    spec = j.spec()
"""

from __future__ import annotations

from typing import Any

from spillway.plans import spec

#: Short names, and the field that a name's value goes to.
SOURCE_NAMES = {
    "inline": ("inline", "rows"), "ndjson": ("ndjson-file", "url"), "json": ("json-file", "url"), "csv": ("csv-file", "url"), "ref": ("ref", "node"), "kvstore": ("kvstore", "name"), "lucene": ("lucene", "name"),
    "sql": ("sql", "sql"), "sqlite": ("sqlite", "path"), "nats": ("nats", "subject"), "kafka": ("kafka", "topic"), "parquet": ("parquet", "url"), "file_stream": ("file-stream", "url"),
}
STEP_NAMES = {
    "filter": ("filter", "expr"), "project": ("project", "cols"), "rename": ("rename", "from"), "set_field": ("set-field", "name"), "to_typed": ("to-typed", "fields"), "lookup": ("lookup", "from"), "groovy_map": ("groovy-map", "script"),
    "expr_map": ("expr-map", "fields"), "jvs_groovy": ("jvs-groovy", "script"), "jvs_enrich": ("jvs-enrich", "tags"), "jvs_translate": ("jvs-translate", "targetLangs"), "jvssql": ("jvssql", "sql"),
}
SINK_NAMES = {
    "ndjson": ("ndjson-file", "url"), "csv": ("csv-file", "url"), "json": ("json-file", "url"), "kvstore": ("kvstore", "name"), "lucene": ("lucene", "name"), "jvs_lucene": ("jvs-lucene", "name"), "nats": ("nats", "subject"),
    "kafka": ("kafka", "topic"), "counting": ("counting", "label"), "memory_table": ("memory-table", "name"), "parquet": ("parquet", "url"),
}
#: What a short form leaves out.
FILLED = {"lookup": {"onField": "id", "withKey": "id"}, "sqlite": {"query": "SELECT 1"}, "kafka": {"bootstrap": "localhost:9092"}, "sink kvstore": {"keyExpr": "id"}}


def _named(what: str, given: dict[str, Any], names: dict[str, tuple[str, str]]) -> dict[str, Any]:
    own = [k for k in given if k in names and not (k == "sql" and "sqlite" in given)]
    if len(own) != 1:
        raise spec.SpecError(f"one {what} of {', '.join(names)} is wanted, not {', '.join(given) or 'none'}")
    kind, main = names[own[0]]
    rest = {k.rstrip("_"): v for k, v in given.items() if k != own[0]}
    return FILLED.get(own[0], {}) | FILLED.get(f"{what} {own[0]}", {}) | {"kind": kind, main: given[own[0]]} | rest


class NodeBuilder:
    def __init__(self, name: str, depends: tuple[str, ...]):
        self.given: dict[str, Any] = {"id": name, "depends": list(depends), "pipeline": {"steps": [], "sinks": []}}

    def __enter__(self) -> NodeBuilder:
        return self

    def __exit__(self, *_: object) -> None:
        return None

    def depends(self, *names: str) -> NodeBuilder:
        self.given["depends"] += names
        return self

    def source(self, **given: Any) -> NodeBuilder:
        self.given["pipeline"]["source"] = _named("source", given, SOURCE_NAMES)
        return self

    def step(self, **given: Any) -> NodeBuilder:
        self.given["pipeline"]["steps"].append(_named("step", given, STEP_NAMES))
        return self

    def reduce(self, by: list[str] | None = None, shuffle: bool = False, buckets: int = 2, **aggs: str | tuple[str, str]) -> NodeBuilder:
        made = [{"name": k, "kind": v if isinstance(v, str) else v[0], "of": None if isinstance(v, str) else v[1]} for k, v in aggs.items()]
        self.given["pipeline"]["reduce"] = {"group-by": by or [], "aggs": made, "shuffle": shuffle, "buckets": buckets}
        return self

    def sink(self, **given: Any) -> NodeBuilder:
        self.given["pipeline"]["sinks"].append(_named("sink", given, SINK_NAMES))
        return self

    def partition(self, **given: Any) -> NodeBuilder:
        self.given["partition"] = given
        return self


class JobBuilder:
    def __init__(self, name: str, version: str = "1", restartable: bool = False):
        self.given = {"job": name, "version": version, "restartable": restartable}
        self.nodes: list[NodeBuilder] = []

    def __enter__(self) -> JobBuilder:
        return self

    def __exit__(self, *_: object) -> None:
        return None

    def node(self, name: str, *depends: str) -> NodeBuilder:
        self.nodes.append(NodeBuilder(name, depends))
        return self.nodes[-1]

    def spec(self) -> spec.Job:
        return spec.job_of(self.given | {"nodes": [n.given for n in self.nodes]})


def job(name: str, version: str = "1", restartable: bool = False) -> JobBuilder:
    return JobBuilder(name, version, restartable)
