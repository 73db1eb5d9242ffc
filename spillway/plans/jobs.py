"""The life of a job: status, registry, history, restart, and the engine that holds them."""

from __future__ import annotations

import json
import os
import threading
import time
import uuid
from collections import OrderedDict
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from spillway.functions.semantics import visible
from spillway.plans import dag, spec
from spillway.sources.stores import TextFile, is_url, names_in, whole_path

STATES = ("PENDING", "RUNNING", "SUCCEEDED", "FAILED", "CANCELLED")
EXAMPLES = Path(__file__).resolve().parent.parent / "examples"


@dataclass
class NodeStatus:
    id: str
    rank: int = 0
    depends: tuple[str, ...] = ()
    state: str = "PENDING"
    rows_in: int | None = None
    rows_out: int = 0
    sinks: dict[str, int] = field(default_factory=dict)
    started: float | None = None
    ended: float | None = None
    error: str | None = None


class JobStatus:
    def __init__(self, job: spec.Job, job_id: str | None = None):
        self.job, self.job_id, self.state, self.error = job, job_id or uuid.uuid4().hex, "PENDING", None
        self.started, self.ended = time.time(), None
        self.nodes: dict[str, NodeStatus] = {n.id: NodeStatus(n.id, depends=n.depends) for n in job.nodes}
        self.events: list[dict[str, Any]] = []
        self.lock = threading.Lock()

    def node(self, name: str) -> NodeStatus:
        return self.nodes[name]

    def event(self, node: str | None, text: str) -> None:
        with self.lock:
            self.events.append({"at": time.time(), "node": node, "message": text})

    def ranked(self, ranks: list[list[spec.Node]]) -> None:
        for k, rank in enumerate(ranks):
            for n in rank:
                self.nodes[n.id].rank = k

    def start(self, node: str) -> None:
        self.nodes[node].state, self.nodes[node].started = "RUNNING", time.time()
        self.event(node, "RUNNING")

    def counts(self, node: str, rows_in: int | None, rows_out: int, sinks: Mapping[str, int]) -> None:
        with self.lock:
            own = self.nodes[node]
            own.rows_in, own.rows_out = rows_in, rows_out
            own.sinks.update(sinks)

    def finish(self, node: str, state: str, error: str | None = None) -> None:
        own = self.nodes[node]
        own.state, own.ended, own.error = state, time.time(), error
        self.event(node, f"{state}: {error}" if error else state)

    def snapshot(self) -> dict[str, Any]:
        with self.lock:
            return {
                "jobId": self.job_id, "job": self.job.id, "state": self.state, "error": self.error, "startedAt": self.started, "endedAt": self.ended,
                "rowsIn": sum(n.rows_in or 0 for n in self.nodes.values()), "rowsOut": sum(n.rows_out for n in self.nodes.values()),
                "durationMs": int(1000 * ((self.ended or time.time()) - self.started)),
                "nodes": [{"id": n.id, "state": n.state, "rank": n.rank, "deps": list(n.depends), "rowsIn": n.rows_in, "rowsOut": n.rows_out, "sinkCounts": dict(n.sinks), "error": n.error} for n in self.nodes.values()],
            }


class History:
    """Finished jobs, a line of JSON each; what can't be read is left out."""

    def __init__(self, path: str | os.PathLike[str], spark: SparkSession | None = None):
        self.file, self.lock, self.path = TextFile(str(path), spark), threading.Lock(), Path(path)

    def append(self, snapshot: Mapping[str, Any]) -> None:
        line = json.dumps(snapshot) + "\n"
        try:
            with self.lock:
                if is_url(self.file.path):
                    self.file.write((self.file.read() or "") + line)
                    return
                path = Path(self.file.path)
                path.parent.mkdir(parents=True, exist_ok=True)
                with path.open("a") as f:
                    f.write(line)
        except OSError:
            return  # history is best effort: a full disk must not fail a job that is done

    def tail(self, limit: int = 200) -> list[dict[str, Any]]:
        """The newest first."""
        out: list[dict[str, Any]] = []
        for line in reversed((self.file.read() or "").splitlines()):
            if len(out) >= limit:
                break
            try:
                if isinstance(x := json.loads(line), dict):
                    out.append(x)
            except ValueError:
                continue
        return out


class Registry:
    """The latest jobs, at most ``capacity``; a running one at the old end is not pushed out."""

    def __init__(self, capacity: int = 64, history: History | None = None):
        self.capacity, self.history, self.held, self.lock = capacity, history, OrderedDict(), threading.Lock()
        for old in reversed(history.tail(capacity) if history else []):
            if isinstance(old.get("jobId"), str):
                state = old.get("state")
                self.held[old["jobId"]] = old | {"state": state if state in STATES else "SUCCEEDED"}

    def put(self, status: JobStatus) -> None:
        with self.lock:
            self.held[status.job_id] = status
            while len(self.held) > self.capacity:
                first = next(iter(self.held.values()))
                if isinstance(first, JobStatus) and first.state in ("PENDING", "RUNNING"):
                    break
                self.held.popitem(last=False)

    def get(self, job_id: str) -> dict[str, Any] | None:
        found = self.held.get(job_id)
        return found.snapshot() if isinstance(found, JobStatus) else found

    def all(self) -> list[dict[str, Any]]:
        with self.lock:
            return [x.snapshot() if isinstance(x, JobStatus) else x for x in reversed(self.held.values())]

    def ended(self, status: JobStatus) -> None:
        if self.history:
            self.history.append(status.snapshot())


class Restartable:
    """Texts of running restartable jobs in one file, replaced as a whole; a file that can't be read is empty."""

    def __init__(self, path: str | os.PathLike[str], spark: SparkSession | None = None):
        self.file, self.lock, self.path = TextFile(str(path), spark), threading.Lock(), Path(path)

    def all(self) -> dict[str, dict[str, str]]:
        try:
            held = json.loads(self.file.read() or "{}")
        except ValueError:
            return {}
        return {k: v for k, v in held.items() if isinstance(v, dict) and isinstance(v.get("text"), str)} if isinstance(held, dict) else {}

    def put(self, job_id: str, text: str) -> None:
        with self.lock:
            self.file.write(json.dumps(self.all() | {job_id: {"text": text}}))

    def remove(self, job_id: str) -> None:
        with self.lock:
            held = self.all()
            if held.pop(job_id, None):
                self.file.write(json.dumps(held))


@dataclass
class Run:
    status: JobStatus
    thread: threading.Thread | None
    cancelled: threading.Event
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        """A node's rows or a memory table."""
        return visible(self.tables[name])


class Engine:
    """Runs jobs and knows what became of them. ``home`` is a folder that driver and executors share: a path, or a URL that Spark reads.

    ``count_rows_in`` counts what sources give; counting there keeps filters from reaching the scan, so it is off.
    """

    def __init__(self, spark: SparkSession, home: str | os.PathLike[str] = "spillway-home", capacity: int = 64, count_rows_in: bool = False):
        self.spark, self.home, self.count_rows_in = spark, whole_path(str(home)), count_rows_in
        self.history = History(f"{self.home}/history.ndjson", spark)
        self.registry = Registry(capacity, self.history)
        self.restartable = Restartable(f"{self.home}/restartable.json", spark)
        self.runs: dict[str, Run] = {}

    def submit(self, job: spec.Job | str, job_id: str | None = None, views: Mapping[str, DataFrame] | None = None, wait: bool = False) -> Run:
        job = spec.parse(job) if isinstance(job, str) else job
        status = JobStatus(job, job_id)
        run = Run(status, None, threading.Event())
        self.registry.put(status)
        self.runs[status.job_id] = run
        if job.restartable:
            self.restartable.put(status.job_id, job.text or job.to_yaml())
        if wait:
            self._run(run, views)
            return run
        run.thread = threading.Thread(target=self._run, args=(run, views), name=f"spillway-{status.job_id[:8]}", daemon=True)
        run.thread.start()
        return run

    def run(self, job: spec.Job | str, **given: Any) -> Run:
        """Submits and waits."""
        return self.submit(job, wait=True, **given)

    def run_bundled(self, name: str, **given: Any) -> Run:
        return self.run(self.bundled_text(name), **given)

    def _run(self, run: Run, views: Mapping[str, DataFrame] | None) -> None:
        status = run.status
        status.state = "RUNNING"
        try:
            status.ranked(dag.ranks(status.job))
            context = dag.run_job(status.job, self.spark, status, run.cancelled, self.home, views, self.count_rows_in)
            run.tables = context.tables
            failed = [n for n in status.nodes.values() if n.state == "FAILED"]
            status.state = "FAILED" if failed else "CANCELLED" if run.cancelled.is_set() else "SUCCEEDED"
            status.error = failed[0].error if failed else None
        except Exception as e:
            status.state, status.error = "FAILED", f"{type(e).__name__}: {e}"
            status.event(None, status.error)
        finally:
            status.ended = time.time()
            self.registry.ended(status)
            if status.job.restartable:
                self.restartable.remove(status.job_id)

    def cancel(self, job_id: str) -> bool:
        """May be called again; False if no such job is known."""
        run = self.runs.get(job_id)
        if run is None:
            return self.registry.get(job_id) is not None
        if run.status.state in ("PENDING", "RUNNING"):
            run.cancelled.set()
            self.spark.sparkContext.cancelJobsWithTag(f"spillway-{job_id}")
        return True

    def resume(self) -> list[Run]:
        """Starts the restartable jobs again that an earlier engine left running, by their ids; one that can't be read is skipped."""
        out = []
        for job_id, held in self.restartable.all().items():
            try:
                job = spec.parse(held["text"])
            except spec.SpecError:
                continue
            out.append(self.submit(job, job_id=job_id))
        return out

    def jobs(self) -> list[dict[str, Any]]:
        return self.registry.all()

    def job(self, job_id: str) -> dict[str, Any] | None:
        return self.registry.get(job_id)

    def events(self, job_id: str) -> list[dict[str, Any]]:
        run = self.runs.get(job_id)
        return list(run.status.events) if run else []

    def past(self, limit: int = 200) -> list[dict[str, Any]]:
        return self.history.tail(limit)

    @staticmethod
    def bundled() -> list[str]:
        return sorted(p.stem for p in EXAMPLES.glob("*.yaml"))

    @staticmethod
    def bundled_text(name: str) -> str:
        path = EXAMPLES / f"{name}.yaml"
        if path.parent != EXAMPLES or not path.is_file():
            raise KeyError(f"no bundled job '{name}'; there are {', '.join(Engine.bundled())}")
        return path.read_text()

    def places(self) -> dict[str, str]:
        """Where named sinks lie: one shared home, whatever machine asks."""
        folders = (("kvstore", "kv"), ("lucene", "index"))
        return {f"{kind}:{name}": f"{self.home}/{folder}/{name}" for kind, folder in folders for name in names_in(self.spark, f"{self.home}/{folder}")}
