"""Steps on odd values, files, jobs and their lives, streams, plug-ins."""

import gzip
import json
import socket
import threading
import time
from collections import Counter

import pytest
import yaml
from pyspark.sql import functions as F

from spillway import Engine, compile_job, decorate_sinks, parse, plugins, register_function, register_sink, register_source, register_step
from spillway.plans.jobs import History, JobStatus, Registry, Restartable
from spillway.sources.stores import whole_path


def one(spark, source, steps=(), reduce=None):
    """Rows of a job with a single node, as dicts."""
    spec = parse(json.dumps({"job": "t", "nodes": [{"id": "n", "pipeline": {"source": source, "steps": list(steps), "reduce": reduce}}]}))
    return [r.asDict(recursive=True) for r in compile_job(spec, spark)["n"].collect()]


def inline(*rows):
    return {"kind": "inline", "rows": list(rows)}


ROWS = inline({"k": 1, "t": "US", "m": 5}, {"k": 2, "t": "us.x", "m": "5"}, {"k": 3, "m": "5.0"}, {"k": 4, "t": "a\nb", "m": None}, {"k": 5, "t": "axb", "m": True})


@pytest.mark.parametrize(
    ("expr", "keys"),
    [
        ("m == 5", [1, 2]),
        ("m == '5'", [1, 2]),
        ("m != 5", [3, 4, 5]),
        ("m == 5.0", [1, 3]),
        ("m > 4", [1, 2, 3]),
        ("m < 4", [4, 5]),
        ("t == null", [3]),
        ("t != 'US'", [2, 3, 4, 5]),
        ("t LIKE 'us%'", [1, 2]),
        ("t like 'US.X'", [2]),
        ("t LIKE 'a_b'", [5]),
        ("t LIKE '(us|axb)'", [1, 5]),
        ("t < 'zzz'", [1, 2, 3, 4, 5]),
        ("t >= 'a'", []),
        ("nowhere <= 3", [1, 2, 3, 4, 5]),
        ("nowhere == x", []),
        ("  k>=4  ", [4, 5]),
    ],
)
def test_filter(spark, expr, keys):
    assert sorted(r["k"] for r in one(spark, ROWS, [{"kind": "filter", "expr": expr}])) == keys


def test_filter_grammar(spark):
    with pytest.raises(ValueError, match="filter"):
        one(spark, ROWS, [{"kind": "filter", "expr": "k > 1 AND"[:3]}])


def test_typed(spark):
    fields = [{"name": "l", "type": "core_long"}, {"name": "d", "type": "core_double"}, {"name": "b", "type": "core_boolean"}, {"name": "ts", "type": "core_timestamp"}, {"name": "a", "type": "array<core_string>"}, {"name": "gone", "type": "core_long"}]
    rows = one(spark, inline({"l": " 12 ", "d": "1e2", "b": "Y", "ts": "2025-01-01T00:00:00Z", "a": "a, b, c,,"}), [{"kind": "to-typed", "fields": fields}])
    assert rows == [{"l": 12, "d": 100.0, "b": True, "ts": 1735689600000, "a": ["a", "b", "c"], "gone": None}]
    for bad in ({"l": "3.9"}, {"l": "12L"}, {"b": "t"}, {"ts": "2025-01-01"}, {"d": "x"}):
        name = next(iter(bad))
        kind = {"l": "core_long", "b": "core_boolean", "ts": "core_timestamp", "d": "core_double"}[name]
        assert one(spark, inline(bad), [{"kind": "to-typed", "fields": [{"name": name, "type": kind}]}]) == []
    assert one(spark, inline({"l": 3.9}), [{"kind": "to-typed", "fields": [{"name": "l", "type": "core_long"}]}]) == [{"l": 3}]
    assert one(spark, inline({"b": 1}), [{"kind": "to-typed", "fields": [{"name": "b", "type": "core_boolean"}]}]) == [{"b": True}]
    assert one(spark, inline({"a": [1, 2]}), [{"kind": "to-typed", "fields": [{"name": "a", "type": "array<core_string>"}]}]) == [{"a": ["1", "2"]}]
    nested = one(spark, inline({"o": {"x": "5", "y": "k"}}), [{"kind": "to-typed", "passthrough": True, "fields": [{"name": "o.x", "type": "core_long"}]}])
    assert nested == [{"o": {"x": 5, "y": "k"}}]
    made = one(spark, inline({"o": {"x": "5", "y": "6"}}), [{"kind": "to-typed", "fields": [{"name": "o.x", "type": "core_long"}, {"name": "o.y", "type": "core_string"}]}])
    assert made == [{"o": {"x": 5, "y": "6"}}]


def test_reduce_keeps_order_and_texts(spark):
    rows = one(spark, inline({"g": "b", "v": 10}, {"g": "a", "v": "bogus"}, {"g": "b", "v": 20}, {"v": None}), (), {"group-by": ["g"], "aggs": [{"name": "s", "kind": "SUM", "of": "v"}, {"name": "a", "kind": "AVG", "of": "v"}, {"name": "c", "kind": "COLLECT", "of": "v"}, {"name": "f", "kind": "DISTINCT_COUNT", "of": "v"}]})
    by = {r["g"]: r for r in rows}
    assert by["b"] == {"g": "b", "s": 30.0, "a": 15.0, "c": ["10", "20"], "f": 2}
    assert by["a"]["s"] == 0.0 and by["<null>"]["c"] == []


def test_lookup_matches_text(spark):
    text = """
job: l
nodes:
  - {id: t, pipeline: {source: {kind: inline, rows: [{id: 5, x: first}, {id: 5, x: second}, {id: "7", x: null}]}}}
  - id: n
    depends: [t]
    pipeline:
      source: {kind: inline, rows: [{k: "5", x: old}, {k: "5.0", x: old}, {k: "7", x: old}, {x: old}]}
      steps: [{kind: lookup, from: t, onField: id, withKey: k, adds: [x]}]
"""
    rows = compile_job(parse(text), spark)["n"].collect()
    assert [(r["k"], r["x"]) for r in rows] == [("5", "first"), ("5.0", "old"), ("7", None), (None, "old")]


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b,c\n\n"Doe, John",x\n"he said ""hi""",,z,too much\nmid"dle, q"uote,2,3\n')
    assert one(spark, {"kind": "csv-file", "url": str(tmp_path / "a.csv")}) == [{"a": "Doe, John", "b": "x", "c": None}, {"a": 'he said "hi"', "b": "", "c": "z"}, {"a": "middle, quote", "b": "2", "c": "3"}]
    (tmp_path / "h.csv").write_text("a,b\n")
    assert one(spark, {"kind": "csv-file", "url": str(tmp_path / "h.csv")}) == []


def test_json_files(spark, tmp_path):
    (tmp_path / "a.ndjson").write_text('{"v": 10}\n\n{"v": "bogus", "w": 1}\n')
    rows = one(spark, {"kind": "ndjson-file", "url": str(tmp_path / "a.ndjson")}, (), {"aggs": [{"name": "s", "kind": "SUM", "of": "v"}, {"name": "n", "kind": "COUNT"}]})
    assert rows == [{"s": 10.0, "n": 2}]
    with gzip.open(tmp_path / "b.ndjson.gz", "wt") as f:
        f.write('{"v": 1}\n')
    assert one(spark, {"kind": "ndjson-file", "url": f"file:{tmp_path}/b.ndjson.gz"}) == [{"v": 1}]
    (tmp_path / "bad.ndjson").write_text('{"v": 1}\n{"v": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        one(spark, {"kind": "ndjson-file", "url": str(tmp_path / "bad.ndjson")})
    (tmp_path / "a.json").write_text('[{"v": 1}, {"v": 2}]')
    assert one(spark, {"kind": "json-file", "url": str(tmp_path / "a.json")}) == [{"v": 1}, {"v": 2}]
    (tmp_path / "o.json").write_text('{"v": 1}')
    with pytest.raises(ValueError, match="top-level array"):
        one(spark, {"kind": "json-file", "url": str(tmp_path / "o.json")})


def test_scripts_are_not_evaluated(spark):
    with pytest.raises(ValueError, match="not evaluated"):
        one(spark, inline({"a": 1}), [{"kind": "groovy-map", "script": "row.a = 2"}])

    @register_function("doubled")
    def doubled(row):
        return None if row["a"] > 2 else {**row, "a": 2 * row["a"]}

    assert sorted(r["a"] for r in one(spark, inline({"a": 1}, {"a": 2}, {"a": 3}), [{"kind": "groovy-map", "script": "doubled"}])) == [2, 4]


def test_typed_steps(spark):
    script = {"copyAll": True, "copy": {"deep": "o.x"}, "set": {"b": "a + 1"}, "append": {"l": "a"}, "times": {"t": {"n": "a", "as": "i", "each": "i * 2"}}, "when": [{"if": "a > 1", "set": {"size": "'big'"}}], "where": "a < 3"}
    rows = one(spark, inline({"a": 1, "o": {"x": "p"}, "l": [9]}, {"a": 2, "o": {"x": None}, "l": None}, {"a": 3, "o": None, "l": []}), [{"kind": "jvs-groovy", "script": script}, {"kind": "project", "cols": ["a", "b", "deep", "l", "t", "size"]}])
    assert rows == [{"a": 1, "b": 2, "deep": "p", "l": [9, 1], "t": [0], "size": None}, {"a": 2, "b": 3, "deep": None, "l": [2], "t": [0, 2], "size": "big"}]
    typed = one(spark, inline({"a": "7"}), [{"kind": "jvs-groovy", "script": "copyAll: true", "typeJson": {"fields": [{"name": "a", "type": "core_long"}]}}])
    assert typed == [{"a": 7}]
    for script in ("target.a = 1", "{run: x}"):
        with pytest.raises(ValueError, match="not evaluated"):
            one(spark, inline({"a": 1}), [{"kind": "jvs-groovy", "script": script}])


MLS = {"kind": "jvs-groovy", "script": {"set": {"id": "id"}, "mls": {"title": [{"lang": "en", "text": "t"}]}}}


def test_texts_in_several_languages(spark, tmp_path):
    plugins.register_enricher("length", "chars")(lambda text: F.length(text))
    plugins.register_translator("loud")(lambda texts, source, target: [f"{target} {t.upper()}" for t in texts])
    given = inline({"id": 1, "t": "One two. Three!"}, {"id": 2, "t": None}, {"id": 3, "t": ""})
    rows = one(spark, given, [MLS, {"kind": "jvs-enrich"}, {"kind": "jvs-translate", "targetLangs": ["fr", "en"], "model": "loud"}])
    by = {r["id"]: r["title"]["mls"] for r in rows}
    assert [(m["lang"], m["text"]) for m in by[1]] == [("en", "One two. Three!"), ("fr", "fr ONE TWO. THREE!")]
    assert by[1][0]["clean"] == "one two three" and by[1][0]["segmented"] == ["One two.", "Three!"] and by[1][0]["chars"] == 15 and by[1][1]["clean"] is None
    assert len(by[2]) == 1 and by[2][0]["clean"] is None and [m["lang"] for m in by[3]] == ["en", "fr"]
    for step, why in (({"kind": "jvs-enrich", "tags": ["pos"]}, "register_enricher"), ({"kind": "jvs-translate", "targetLangs": ["fr"], "model": "none"}, "register_translator")):
        with pytest.raises(ValueError, match=why):
            one(spark, given, [MLS, step])
    assert one(spark, inline({"a": 1}), [{"kind": "jvs-enrich"}, {"kind": "jvs-translate", "targetLangs": ["fr"]}]) == [{"a": 1}]
    engine = Engine(spark, tmp_path)
    job = {"job": "i", "nodes": [{"id": "a", "pipeline": {"source": given, "steps": [MLS], "sinks": [{"kind": "jvs-lucene", "name": "x"}]}}, {"id": "b", "depends": ["a"], "pipeline": {"source": {"kind": "lucene", "name": "x", "query": "title.en:three"}}}]}
    run = engine.run(yaml.safe_dump(job))
    assert run.status.state == "SUCCEEDED", run.status.error
    assert [r["id"] for r in run.table("b").collect()] == [1]


def test_plugins(spark, tmp_path):
    seen = []
    register_source("three")(lambda context, args: context.spark.range(args["n"]))
    register_step("plus")(lambda df, args, context: df.withColumn("id", df["id"] + args["by"]))
    register_sink("listed")(lambda df, args, context: seen.extend(r["id"] for r in df.collect()))
    decorate_sinks(lambda node, sink, df: seen.append(sink.kind))
    try:
        run = Engine(spark, tmp_path).run("job: p\nnodes: [{id: n, pipeline: {source: {kind: three, n: 3}, steps: [{kind: plus, by: 10}], sinks: [{kind: listed}]}}]")
    finally:
        plugins.DECORATORS.clear()
    assert run.status.state == "SUCCEEDED" and seen[0] == "listed" and sorted(seen[1:]) == [10, 11, 12]


def test_engine_counts_and_history(spark, tmp_path):
    engine = Engine(spark, tmp_path, count_rows_in=True)
    rows = [{"r": r, "p": p} for r, p in (("x", 5), ("x", 50), ("y", 70))]
    text = yaml.safe_dump({"job": "c", "nodes": [
        {"id": "a", "pipeline": {"source": inline(*rows), "steps": [{"kind": "filter", "expr": "p > 10"}], "sinks": [{"kind": "counting", "label": "seen"}, {"kind": "csv-file", "url": str(tmp_path / "o.csv"), "cols": ["r", "q", "p"]}, {"kind": "ndjson-file", "url": str(tmp_path / "o.ndjson"), "registerAsTable": "o-table"}]}},
        {"id": "b", "depends": ["a"], "pipeline": {"source": {"kind": "ref", "node": "a"}, "reduce": {"group-by": ["r"], "aggs": [{"name": "n", "kind": "COUNT"}]}, "sinks": [{"kind": "memory-table", "name": "by-r"}]}},
    ]})
    run = engine.run(text)
    status = run.status
    assert status.state == "SUCCEEDED", status.error
    assert (status.node("a").rows_in, status.node("a").rows_out, status.node("a").sinks) == (3, 2, {"seen": 2})
    assert (status.node("a").rank, status.node("b").rank) == (0, 1)
    assert {(r["r"], r["n"]) for r in run.table("by-r").collect()} == {("x", 1), ("y", 1)}
    assert sorted((tmp_path / "o.csv").read_text().splitlines()) == ["r,q,p", "x,,50", "y,,70"]
    assert sorted(json.loads(x)["p"] for x in (tmp_path / "o.ndjson").read_text().splitlines()) == [50, 70]
    assert spark.table("o_table").count() == 2
    assert engine.past()[0]["jobId"] == status.job_id and engine.job(status.job_id)["state"] == "SUCCEEDED"
    assert any(e["message"] == "RUNNING" for e in engine.events(status.job_id))
    assert Engine(spark, tmp_path).job(status.job_id)["job"] == "c"


def test_a_failed_node_stops_later_ranks(spark, tmp_path):
    text = "job: f\nnodes:\n  - {id: a, pipeline: {source: {kind: csv-file, url: /nowhere.csv}}}\n  - {id: b, depends: [a], pipeline: {source: {kind: inline, rows: []}}}"
    status = Engine(spark, tmp_path).run(text).status
    assert (status.state, status.node("a").state, status.node("b").state) == ("FAILED", "FAILED", "PENDING")
    cyclic = Engine(spark, tmp_path).run("job: f\nnodes: [{id: a, depends: [a], pipeline: {source: {kind: inline, rows: []}}}]").status
    assert cyclic.state == "FAILED" and "cycle" in cyclic.error
    for sink in ("{kind: csv-file, url: /proc/nowhere/x.csv, cols: [a]}", "{kind: kafka, bootstrap: h, topic: t}"):
        assert Engine(spark, tmp_path).run(f"job: f\nnodes: [{{id: a, pipeline: {{source: {{kind: inline, rows: [{{a: 1}}]}}, sinks: [{sink}]}}}}]").status.state == "FAILED"


def test_registry_history_restartable(tmp_path):
    history = History(tmp_path / "h" / "h.ndjson")
    assert history.tail() == []
    for i in range(3):
        history.append({"jobId": f"j{i}", "state": "ODD" if i == 2 else "FAILED"})
    history.path.write_text(history.path.read_text() + "not json\n")
    assert [x["jobId"] for x in history.tail(2)] == ["j2", "j1"]
    registry = Registry(2, history)
    assert registry.get("j2")["state"] == "SUCCEEDED" and registry.get("j0") is None
    running = JobStatus(parse("job: r\nnodes: []"))
    running.state = "RUNNING"
    registry = Registry(1)
    registry.put(running)
    registry.put(JobStatus(parse("job: s\nnodes: []")))
    assert registry.get(running.job_id) is not None
    store = Restartable(tmp_path / "r.json")
    store.put("a", "job: a")
    store.put("b", "job: b")
    store.remove("a")
    assert list(Restartable(tmp_path / "r.json").all()) == ["b"]
    store.path.write_text("{broken")
    assert store.all() == {}


def test_resume(spark, tmp_path):
    Restartable(tmp_path / "restartable.json").put("old", "job: again\nrestartable: true\nnodes: [{id: a, pipeline: {source: {kind: inline, rows: [{a: 1}]}}}]")
    Restartable(tmp_path / "restartable.json").put("bad", "- no job")
    (run,) = Engine(spark, tmp_path).resume()
    run.thread.join(60)
    assert run.status.job_id == "old" and run.status.state == "SUCCEEDED"
    assert list(Restartable(tmp_path / "restartable.json").all()) == ["bad"]


def test_bundled_and_places(spark, tmp_path):
    engine = Engine(spark, tmp_path)
    assert "store-and-search" in engine.bundled()
    assert engine.run_bundled("store-and-search").status.state == "SUCCEEDED"
    assert set(engine.places()) == {"kvstore:notes", "lucene:notes"}
    with pytest.raises(KeyError):
        engine.bundled_text("../secrets")


class FakeNats(threading.Thread):
    """Speaks as much of the protocol as a client of one subject needs, and keeps what is published."""

    def __init__(self, give=()):
        super().__init__(daemon=True)
        self.server, self.give, self.got = socket.create_server(("127.0.0.1", 0)), list(give), []
        self.port = self.server.getsockname()[1]

    def run(self):
        while True:
            conn, _ = self.server.accept()
            threading.Thread(target=self.serve, args=(conn,), daemon=True).start()

    def serve(self, conn):
        conn.sendall(b"INFO {}\r\n")
        f = conn.makefile("rb")
        for line in f:
            if line.startswith(b"PING"):
                conn.sendall(b"PONG\r\n")
            elif line.startswith(b"SUB"):
                for body in self.give:
                    conn.sendall(f"MSG s 1 {len(body)}\r\n".encode() + body + b"\r\n")
            elif line.startswith(b"PUB"):
                self.got.append(f.read(int(line.split()[-1])))
                f.readline()


def test_nats_publish(spark, tmp_path):
    server = FakeNats()
    server.start()
    text = f"job: p\nnodes: [{{id: a, pipeline: {{source: {{kind: inline, rows: [{{a: 1}}, {{a: 2}}]}}, sinks: [{{kind: nats, subject: s, servers: 'nats://127.0.0.1:{server.port}'}}]}}}}]"
    assert Engine(spark, tmp_path).run(text).status.state == "SUCCEEDED"
    assert sorted(json.loads(x)["a"] for x in server.got) == [1, 2]


def test_nats_stream_is_cancelled(spark, tmp_path):
    server = FakeNats([b'{"n": 1}', b"", b"no json", b'{"n": 3}'])
    server.start()
    text = f"job: s\nnodes: [{{id: a, pipeline: {{source: {{kind: nats, subject: s, servers: '127.0.0.1:{server.port}', schema: n long}}, sinks: [{{kind: memory-table, name: got}}]}}}}]"
    engine = Engine(spark, tmp_path)
    run = engine.submit(text)
    until = time.time() + 60
    while time.time() < until and run.status.node("a").rows_out < 3 and run.status.state in ("PENDING", "RUNNING"):
        time.sleep(0.3)
    assert engine.cancel(run.status.job_id) and engine.cancel(run.status.job_id)
    run.thread.join(60)
    assert run.status.state == "CANCELLED", run.status.error
    assert sorted((r["n"] or 0, r["_raw"]) for r in run.table("got").collect()) == [(0, "no json"), (1, None), (3, None)]


def test_file_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"v": 1}\n{"v": 5}\n')
    text = f"job: s\nnodes: [{{id: a, pipeline: {{source: {{kind: file-stream, url: '{tmp_path}/in', schema: v long}}, steps: [{{kind: filter, expr: 'v > 2'}}], sinks: [{{kind: ndjson-file, url: '{tmp_path}/out/'}}]}}}}]"
    engine = Engine(spark, tmp_path / "home")
    assert engine.run(text, job_id="fixed").status.state == "SUCCEEDED"
    (tmp_path / "in" / "b.json").write_text('{"v": 7}\n')
    assert Engine(spark, tmp_path / "home").run(text, job_id="fixed").status.state == "SUCCEEDED"
    assert sorted(json.loads(x)["v"] for p in (tmp_path / "out").glob("batch-*/part-*") for x in p.read_text().splitlines()) == [5, 7]


def test_kafka_says_what_is_missing(spark, tmp_path):
    with pytest.raises(ValueError, match="groupId"):
        one(spark, {"kind": "kafka", "bootstrap": "h", "topic": "t"})
    with pytest.raises(RuntimeError, match="connector"):
        one(spark, {"kind": "kafka", "bootstrap": "h", "topic": "t", "groupId": "g"})


def test_csv_folder_of_several_parts(spark, tmp_path):
    from spillway.sinks import write

    write.csv(spark.range(20).repartition(4).selectExpr("id AS a", "concat('x, ', id) AS b"), {"url": f"{tmp_path}/c/", "cols": ["a", "b"]}, None)
    assert len(list((tmp_path / "c").glob("part-*"))) > 1
    rows = one(spark, {"kind": "csv-file", "url": f"{tmp_path}/c/"})
    assert sorted((int(r["a"]), r["b"]) for r in rows) == [(i, f"x, {i}") for i in range(20)]


def test_distinct_count_of_a_stream_is_exact(spark, tmp_path):
    spark.range(9000).selectExpr("id % 3 AS g", "id div 6 AS v").write.json(f"{tmp_path}/in")
    text = f"job: s\nnodes: [{{id: a, pipeline: {{source: {{kind: file-stream, url: '{tmp_path}/in', schema: 'g long, v long'}}, reduce: {{group-by: [g], aggs: [{{name: n, kind: DISTINCT_COUNT, of: v}}]}}}}}}]"
    run = Engine(spark, tmp_path / "home").run(text)
    assert run.status.state == "SUCCEEDED", run.status.error
    assert [r["n"] for r in run.table("a").collect()] == [1500] * 3


def put(spark, home, rows, key="k"):
    text = yaml.safe_dump({"job": "w", "nodes": [{"id": "a", "pipeline": {"source": inline(*rows), "sinks": [{"kind": "kvstore", "name": "s", "keyExpr": key}]}}]})
    run = Engine(spark, home).run(text)
    assert run.status.state == "SUCCEEDED", run.status.error


def test_kvstore_takes_later_writes_up(spark, tmp_path):
    read = lambda: {r["k"]: (r["v"], r["w"]) for r in compile_job(parse("job: r\nnodes: [{id: a, pipeline: {source: {kind: kvstore, name: s}}}]"), spark, str(tmp_path))["a"].collect()}
    with pytest.raises(ValueError, match="no kvstore"):
        read()
    put(spark, tmp_path, [{"k": "a", "v": 1, "w": "x"}, {"k": "b", "v": 2, "w": "y"}, {"k": "a", "v": 3, "w": None}, {"k": None, "v": 9, "w": "lost"}])
    assert read() == {"a": (3, None), "b": (2, "y")}
    put(spark, tmp_path, [{"k": "c", "v": 4, "w": "z"}, {"k": "b", "v": 5}])
    assert read() == {"a": (3, None), "b": (5, None), "c": (4, "z")}
    put(spark, tmp_path, [{"k": "a", "v": "text", "w": "t"}])
    assert read() == {"a": ("text", "t"), "b": ("5", None), "c": ("4", "z")}
    (tmp_path / "kv" / "s" / "v-00000009").mkdir()  # a write that broke off
    assert len(read()) == 3
    put(spark, tmp_path, [{"k": "d", "v": "1", "w": "1"}])
    assert len(read()) == 4 and len([x for x in (tmp_path / "kv" / "s").iterdir() if (x / "_SUCCESS").exists()]) == 2


def test_a_stream_keeps_the_rows_of_all_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    sinks = [{"kind": "ndjson-file", "url": f"{tmp_path}/o.ndjson"}, {"kind": "csv-file", "url": f"{tmp_path}/o.csv", "cols": ["v"]}, {"kind": "json-file", "url": f"{tmp_path}/o.json"}, {"kind": "parquet", "url": f"{tmp_path}/o.parquet"}, {"kind": "kvstore", "name": "s", "keyExpr": "v"}, {"kind": "lucene", "name": "i"}, {"kind": "ndjson-file", "url": f"{tmp_path}/folder/"}]
    text = yaml.safe_dump({"job": "s", "nodes": [{"id": "a", "pipeline": {"source": {"kind": "file-stream", "url": f"{tmp_path}/in", "schema": "v long", "maxFilesPerTrigger": 1}, "sinks": sinks}}]})
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text(f'{{"v": {k}}}\n{{"v": {k + 10}}}\n')
    for more in (None, '{"v": 99}\n'):  # the second run goes on from the checkpoint
        if more:
            (tmp_path / "in" / "more.json").write_text(more)
        run = Engine(spark, tmp_path / "home").run(text, job_id="fixed")
        assert run.status.state == "SUCCEEDED", run.status.error
        want = [0, 1, 2, 10, 11, 12] + ([99] if more else [])
        back = lambda source: sorted(int(r["v"]) for r in compile_job(parse(yaml.safe_dump({"job": "r", "nodes": [{"id": "a", "pipeline": {"source": source}}]})), spark, str(tmp_path / "home"))["a"].collect())
        for source in ({"kind": "ndjson-file", "url": f"{tmp_path}/o.ndjson"}, {"kind": "csv-file", "url": f"{tmp_path}/o.csv"}, {"kind": "json-file", "url": f"{tmp_path}/o.json"}, {"kind": "parquet", "url": f"{tmp_path}/o.parquet"}, {"kind": "kvstore", "name": "s"}, {"kind": "lucene", "name": "i"}, {"kind": "ndjson-file", "url": f"{tmp_path}/folder/"}):
            assert back(source) == want, source


def test_home_is_any_url_that_spark_reads(spark, tmp_path):
    engine = Engine(spark, f"file:{tmp_path}/h/")
    assert engine.home == f"file:{tmp_path}/h" and whole_path("s3://bucket/home/") == "s3://bucket/home"
    assert engine.run_bundled("store-and-search").status.state == "SUCCEEDED"
    assert (tmp_path / "h" / "history.ndjson").exists() and engine.places() == {"kvstore:notes": f"file:{tmp_path}/h/kv/notes", "lucene:notes": f"file:{tmp_path}/h/index/notes"}
    assert [x["job"] for x in Engine(spark, f"file:{tmp_path}/h").past()] == ["store-and-search"]
    engine.restartable.put("a", "job: a")
    assert list(Engine(spark, f"file:{tmp_path}/h").restartable.all()) == ["a"]


@pytest.mark.parametrize("sink", ["lucene", "jvs-lucene"])
def test_a_task_of_an_index_has_a_bound(spark, tmp_path, monkeypatch, sink):
    """All documents come in one partition, as from one small file of many rows; what a task indexes stays bounded, and every posting is there once."""
    monkeypatch.setattr("spillway.sinks.write.INDEX_CHARS", 20_000, raising=False)
    monkeypatch.setattr("spillway.sinks.write.INDEX_ROWS", 700, raising=False)
    title = "struct(array(struct('en' AS lang, concat('en ', id, ' en') AS text), struct('en' AS lang, 'more en' AS text), struct(null AS lang, null AS text)) AS mls) AS title"
    spark.range(0, 3000, 1, 1).selectExpr("id", "concat('Brand#', id % 7, ' a b a') AS t", "if(id % 2 = 0, null, id % 3) AS n", *([title] if sink == "jvs-lucene" else [])).write.parquet(f"{tmp_path}/in")
    source = {"kind": "parquet", "url": f"{tmp_path}/in"}
    run = Engine(spark, tmp_path / "home").run(yaml.safe_dump({"job": "i", "nodes": [{"id": "a", "pipeline": {"source": source, "sinks": [{"kind": sink, "name": "x"}]}}]}))
    assert run.status.state == "SUCCEEDED", run.status.error
    home = f"{tmp_path}/home/index/x/v-00000001"
    docs = {r["doc"]: r["id"] for r in spark.read.parquet(f"{home}/documents").collect()}
    assert sorted(docs.values()) == list(range(3000))
    want = Counter()
    for i in docs.values():
        for field, terms in {"id": [str(i)], "t": ["brand", str(i % 7), "a", "b", "a"], "n": [str(i % 3)] * (i % 2), "title.en": ["en", str(i), "en", "more", "en"] * (sink == "jvs-lucene")}.items():
            want.update((term, field, i) for term in terms)
    postings = spark.read.parquet(f"{home}/postings").withColumn("file", F.input_file_name()).collect()
    assert len(postings) == len(want) and {(r["term"], r["field"], docs[r["doc"]]): r["count"] for r in postings} == want
    files = Counter(r["file"] for r in postings)
    assert len(files) > 3 and max(files.values()) <= 10_000
    assert len({r["doc"]: r["file"] for r in postings}) == len({(r["doc"], r["file"]) for r in postings})  # dealt by document
    assert max(r["n"] for r in spark.read.parquet(f"{home}/all").groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()) <= 700
    back = lambda query: sorted(r["id"] for r in compile_job(parse(yaml.safe_dump({"job": "r", "nodes": [{"id": "a", "pipeline": {"source": {"kind": "lucene", "name": "x", "query": query}}}]})), spark, str(tmp_path / "home"))["a"].collect())
    assert back("+t:brand +n:2") == [i for i in range(3000) if i % 2 and i % 3 == 2] and back("id:17 id:2999") == [17, 2999] and len(back("-t:brand")) == 0


def test_ndjson_with_a_schema_and_nested_types(spark, tmp_path):
    (tmp_path / "a.ndjson").write_text('{"v": 1, "o": {"p": 1.5, "q": [1, 2]}, "z": null}\n{"v": 2, "o": {"p": 2}}\n')
    assert one(spark, {"kind": "ndjson-file", "url": str(tmp_path / "a.ndjson")}) == [{"o": {"p": 1.5, "q": [1, 2]}, "v": 1, "z": None}, {"o": {"p": 2.0, "q": None}, "v": 2, "z": None}]
    assert one(spark, {"kind": "ndjson-file", "url": str(tmp_path / "a.ndjson"), "schema": "v string, w long"}) == [{"v": "1", "w": None}, {"v": "2", "w": None}]
    (tmp_path / "b.json").write_text('[{"v": 1}, {"v": 2}]')
    assert one(spark, {"kind": "json-file", "url": str(tmp_path / "b.json"), "schema": "v double"}) == [{"v": 1.0}, {"v": 2.0}]
