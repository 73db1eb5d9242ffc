"""From a job to DataFrames, one per node, and from those to actions."""

from __future__ import annotations

import re
import threading
import time
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from spillway import plugins
from spillway.functions.semantics import visible
from spillway.operators.reduce import ORDERED, reduce
from spillway.operators.steps import apply_step
from spillway.plans.spec import Job, Node
from spillway.sinks.write import LAZY, writer
from spillway.sources.read import open_source
from spillway.sources.stores import whole_path


class GraphError(ValueError):
    """Nodes that can't be put in order."""


def ranks(job: Job) -> list[list[Node]]:
    """Nodes by rank, in the job's order: a node's rank is one above the highest that it depends on."""
    by_id: dict[str, Node] = {}
    for n in job.nodes:
        if n.id in by_id:
            raise GraphError(f"two nodes are named '{n.id}'")
        by_id[n.id] = n
    for n in job.nodes:
        for d in n.depends:
            if d not in by_id:
                raise GraphError(f"node '{n.id}' depends on unknown node '{d}'")
    out: list[list[Node]] = []
    done: set[str] = set()
    while len(done) < len(by_id):
        ready = [n for n in job.nodes if n.id not in done and all(d in done for d in n.depends)]
        if not ready:
            raise GraphError(f"a cycle holds {', '.join(n.id for n in job.nodes if n.id not in done)}")
        out.append(ready)
        done |= {n.id for n in ready}
    return out


def refs(node: Node) -> set[str]:
    """Tables that a node reads: its source, its lookups, and what its SQL names."""
    out = {str(node.source["node"])} if node.source.kind == "ref" else set()
    out |= {str(s["from"]) for s in node.steps if s.kind == "lookup"}
    return out


def makers_of(job: Job) -> dict[str, set[str]]:
    """Which nodes make a table: that of the node's own name, and its memory tables."""
    out: dict[str, set[str]] = {}
    for n in job.nodes:
        for name in (n.id, *(str(s["name"]) for s in n.sinks if s.kind == "memory-table")):
            out.setdefault(name, set()).add(n.id)
    return out


def order_needed(job: Job) -> set[str]:
    """Nodes whose rows need the hidden order column: for the first or last of a group, a list, the first match of a lookup, the last row of a key.

    Elsewhere it is left out, so that no scan has to make it. Parts of one's own get it, since they may read it.
    """
    makers, by_id = makers_of(job), {n.id: n for n in job.nodes}
    needed: set[str] = set()
    for n in job.nodes:
        plugged = n.source.kind in plugins.SOURCES or any(s.kind in plugins.STEPS for s in n.steps) or any(s.kind in plugins.SINKS for s in n.sinks)
        if plugged or any(s.kind == "kvstore" for s in n.sinks) or (n.reduce and any(a.kind in ORDERED for a in n.reduce.aggs)):
            needed.add(n.id)
        for s in n.steps:
            if s.kind == "lookup":
                needed |= makers.get(str(s["from"]), set())
    stack = list(needed)
    while stack:
        source = by_id[stack.pop()].source
        more = (makers.get(str(source["node"]), set()) if source.kind == "ref" else set()) - needed
        needed |= more
        stack += more
    return needed


def check_refs(job: Job) -> None:
    """A node that another one reads must come before it by ``depends``: else it might not be there yet."""
    by_id, makers = {n.id: n for n in job.nodes}, makers_of(job)

    def before(n: Node) -> set[str]:
        seen: set[str] = set()
        stack = list(n.depends)
        while stack:
            if (x := stack.pop()) not in seen and x in by_id:
                seen.add(x)
                stack += by_id[x].depends
        return seen

    for n in job.nodes:
        for r in refs(n):
            if r in makers and not makers[r] & before(n):
                raise GraphError(f"node '{n.id}' reads '{r}' but doesn't depend on the node that makes it")


def snake(name: str) -> str:
    return re.sub(r"\W", "_", name)


class Context:
    """Tables and places of one run."""

    def __init__(self, spark: SparkSession, home: str | None = None, views: Mapping[str, DataFrame] | None = None):
        self.spark, self.tables, self._home = spark, dict(views or {}), whole_path(home or "spillway-home")
        self.lock = threading.Lock()
        self.registered: list[str] = []
        self.ordered: set[str] = set()

    def home(self, name: str) -> str:
        return f"{self._home}/{name}"

    def table(self, name: str) -> DataFrame | None:
        return self.tables.get(name)

    def put(self, name: str, df: DataFrame) -> None:
        with self.lock:
            self.tables[name] = df

    def register(self, name: str, df: DataFrame) -> None:
        """For SQL outside the run, too; a stream has no such view."""
        if not df.isStreaming:
            visible(df).createOrReplaceTempView(snake(name))
            self.registered.append(snake(name))

    def sql(self, query: str, more: Mapping[str, DataFrame] | None = None) -> DataFrame:
        """Over the run's tables, kebab-case names in snake case, without leaving views behind."""
        with self.lock:
            named = {snake(k): v for k, v in {**self.tables, **(more or {})}.items()}
        session = self.spark
        hidden: dict[str, DataFrame | None] = {}
        with _sql_lock:
            for name, df in named.items():
                hidden[name] = session.table(name) if session.catalog.tableExists(name) and name not in self.registered else None
                visible(df).createOrReplaceTempView(name)
            try:
                return session.sql(query)
            finally:
                for name, old in hidden.items():
                    if name in self.registered:
                        continue
                    session.catalog.dropTempView(name)
                    if old is not None:
                        old.createOrReplaceTempView(name)


_sql_lock = threading.Lock()


def node_frame(node: Node, context: Context, rows_in: Observation | None = None) -> DataFrame:
    """A node's rows, lazily."""
    df = open_source(context, node.source, node.id in context.ordered)
    if rows_in is not None:
        df = df.observe(rows_in, F.count(F.lit(1)).alias("n"))
    for step in node.steps:
        df = apply_step(df, step, context)
    if node.reduce:
        df = reduce(df, node.reduce)
    return df


def compile_job(job: Job, spark: SparkSession, home: str | None = None, views: Mapping[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Every node as a lazy DataFrame, nothing run: Catalyst sees through the edges of the graph."""
    context = Context(spark, home, views)
    check_refs(job)
    context.ordered = order_needed(job)
    out = {}
    for rank in ranks(job):
        for node in rank:
            df = node_frame(node, context)
            context.put(node.id, df)
            for s in node.sinks:
                if s.kind == "memory-table":
                    context.put(str(s["name"]), df)
            out[node.id] = visible(df)
    return out


def observed(observation: Observation, seconds: float = 5.0) -> int | None:
    """What was counted, or None if no query that counts has ended; ``get`` would wait for ever."""
    until = time.monotonic() + seconds
    while True:
        found = observation._jo.getOrEmpty() if observation._jo is not None else None
        if found is not None and found.size():
            return int(observation.get["n"])
        if time.monotonic() > until:
            return None
        time.sleep(0.02)


def run_node(node: Node, context: Context, readers: int, status, cancelled: threading.Event, count_rows_in: bool = False) -> DataFrame:
    """Builds a node's rows and writes its sinks, each by one action; rows that several actions need are kept meanwhile."""
    writers = [(s, writer(s)) for s in node.sinks if s.kind not in LAZY]
    rows_in = Observation(f"in-{node.id}") if count_rows_in else None
    df = node_frame(node, context, rows_in)
    if df.isStreaming:
        from spillway.streaming.run import run_stream

        return run_stream(node, df, writers, context, status, cancelled)
    rows_out = Observation(f"out-{node.id}")
    labels = [str(s["label"]) for s in node.sinks if s.kind == "counting"]
    counted = df.observe(rows_out, F.count(F.lit(1)).alias("n"))
    actions = max(1, len(writers))
    if actions + readers > 1:
        counted = counted.persist(StorageLevel.MEMORY_AND_DISK)
        context.kept.append(counted)
    context.put(node.id, counted)
    for s in node.sinks:
        if s.kind == "memory-table":
            context.put(str(s["name"]), counted)
            context.register(str(s["name"]), counted)
    for sink, write in writers:
        given = counted
        for decorate in plugins.DECORATORS:
            given = decorate(node, sink, given) or given
        try:
            write(given, sink.args, context)
        except Exception as e:
            status.event(node.id, f"sink {sink.kind} failed: {e}")
            raise
    if not writers:
        counted.write.format("noop").mode("overwrite").save()
    n = observed(rows_out)
    if n is None:  # a sink of one's own that ran no query over the rows as they are
        counted.write.format("noop").mode("overwrite").save()
        n = observed(rows_out)
    status.counts(node.id, observed(rows_in) if rows_in is not None else None, n or 0, {label: n or 0 for label in labels})
    return counted


def run_job(job: Job, spark: SparkSession, status, cancelled: threading.Event, home: str | None = None, views: Mapping[str, DataFrame] | None = None, count_rows_in: bool = False, threads: int = 4) -> Context:
    """Rank by rank; the nodes of a rank run side by side, and one that fails keeps later ranks from starting."""
    context = Context(spark, home, views)
    context.kept = []
    check_refs(job)
    context.ordered = order_needed(job)
    readers = {n.id: sum(n.id in refs(m) or bool({str(s["name"]) for s in n.sinks if s.kind == "memory-table"} & refs(m)) for m in job.nodes) for n in job.nodes}
    try:
        for k, rank in enumerate(ranks(job)):
            if cancelled.is_set():
                break

            def one(node: Node) -> None:
                spark.sparkContext.addJobTag(f"spillway-{status.job_id}")
                status.start(node.id)
                try:
                    run_node(node, context, readers[node.id], status, cancelled, count_rows_in)
                    status.finish(node.id, "CANCELLED" if cancelled.is_set() else "SUCCEEDED")
                except Exception as e:
                    status.finish(node.id, "CANCELLED" if cancelled.is_set() else "FAILED", f"{type(e).__name__}: {e}")

            with ThreadPoolExecutor(max_workers=min(threads, len(rank))) as pool:
                list(pool.map(one, rank))
            if any(status.node(n.id).state == "FAILED" for n in rank):
                break
    finally:
        for df in context.kept:
            df.unpersist()
    return context
