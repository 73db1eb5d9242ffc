"""Parsing, the builder and the graph."""

import pytest

from spillway import SpecError, job, parse
from spillway.plans.dag import GraphError, check_refs, ranks

TEXT = """
job: t
restartable: true
unknown: ignored
nodes:
  - id: a
    pipeline:
      source: {kind: inline, rows: [{x: 1}]}
      steps: [{kind: filter, expr: "x > 0"}, {kind: to-typed, fields: [{name: x, type: core_long, role: key}]}]
      reduce: {group-by: [x], shuffle: true, aggs: [{name: n, kind: count}]}
      sinks: [{kind: memory-table, name: m}, {kind: lucene, name: l}]
  - {id: b, depends: [a], pipeline: {source: {kind: ref, node: a}}}
"""


def test_yaml_json_and_back():
    spec = parse(TEXT)
    assert (spec.id, spec.version, spec.restartable) == ("t", "1", True)
    assert spec.nodes[0].reduce.aggs[0].kind == "COUNT" and spec.nodes[0].reduce.buckets == 2
    assert spec.nodes[0].sinks[1]["storeSource"] is True
    assert parse(spec.to_yaml()) == spec
    import json

    assert parse(json.dumps(spec.as_dict())) == spec
    assert parse('{id: flow, nodes: []}').id == "flow"


@pytest.mark.parametrize(
    ("text", "says"),
    [
        ("nodes: []", "name"),
        ("job: a\nnodes: [{id: n, pipeline: {source: {kind: magic}}}]", "magic"),
        ("job: a\nnodes: [{id: n, pipeline: {}}]", "no source"),
        ("job: a\nnodes: [{pipeline: {}}]", "id"),
        ("job: a\nnodes: [{id: n, pipeline: {source: {kind: csv-file}}}]", "url"),
        ("job: a\nnodes: [{id: n, pipeline: {source: {kind: inline, rows: []}, reduce: {aggs: [{name: a, kind: MEDIAN}]}}}]", "MEDIAN"),
        ("- 1", "mapping"),
        ("{:", "neither"),
    ],
)
def test_errors_name_what_is_wrong(text, says):
    with pytest.raises(SpecError, match=says):
        parse(text)


def test_builder():
    with job("loop") as j:
        for i in range(3):
            with j.node(f"n{i}") as n:
                n.source(inline=[{"i": i}]).sink(counting=f"c{i}")
        with j.node("last", "n0") as n:
            n.source(sqlite="/tmp/x.db").step(filter="i > 0").step(lookup="n0", adds=["i"]).step(rename="a", to="b").reduce(by=["b"], n="count", s=("sum", "i"))
            n.sink(kvstore="k").sink(kafka="t")
    spec = j.spec()
    assert [n.id for n in spec.nodes] == ["n0", "n1", "n2", "last"]
    last = spec.nodes[-1]
    assert last.source["query"] == "SELECT 1" and last.steps[1]["onField"] == "id" and last.steps[2]["to"] == "b"
    assert last.sinks[0]["keyExpr"] == "id" and last.sinks[1]["bootstrap"] == "localhost:9092"
    assert [a.kind for a in last.reduce.aggs] == ["COUNT", "SUM"]
    with pytest.raises(SpecError):
        job("x").node("n").source(magic=1)
    with pytest.raises(SpecError, match="no source"):
        b = job("x")
        b.node("n")
        b.spec()


def nodes(**depends):
    return parse("job: g\nnodes:\n" + "".join(f"  - {{id: {k}, depends: {v}, pipeline: {{source: {{kind: inline, rows: []}}}}}}\n" for k, v in depends.items()))


def test_ranks():
    assert [[n.id for n in r] for r in ranks(nodes(d=["b", "c"], a=[], b=["a"], c=["a"]))] == [["a"], ["b", "c"], ["d"]]
    with pytest.raises(GraphError, match="cycle"):
        ranks(nodes(a=["b"], b=["a"]))
    with pytest.raises(GraphError, match="cycle"):
        ranks(nodes(a=["a"]))
    with pytest.raises(GraphError, match="unknown"):
        ranks(nodes(a=["z"]))


def test_a_reference_must_be_ordered():
    spec = parse("job: g\nnodes:\n  - {id: a, pipeline: {source: {kind: inline, rows: []}}}\n  - {id: b, pipeline: {source: {kind: ref, node: a}}}")
    with pytest.raises(GraphError, match="depend"):
        check_refs(spec)
