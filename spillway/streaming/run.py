"""A node whose source is a stream: micro-batches fan out to its sinks, from a checkpoint."""

from __future__ import annotations

import threading
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame

from spillway.functions.semantics import ordered, visible
from spillway.sinks.write import WHOLE


def run_stream(node: Any, df: DataFrame, writers: list[tuple[Any, Callable[..., None]]], context: Any, status: Any, cancelled: threading.Event) -> DataFrame:
    """Runs until the stream ends (a file stream: until what is there is read) or the job is cancelled.

    With a reduction each batch holds all groups so far and takes the place of the one before. Without one, each batch holds its own rows: a
    folder of parts gets a folder with the batch's number, so that a batch that is run again replaces itself; a keyed store takes
    the rows up; a single file or an index is written from all batches when the stream has ended.
    """
    totals = {"in": 0, "out": 0}
    labels = [str(s["label"]) for s in node.sinks if s.kind == "counting"]
    tables = [str(s["name"]) for s in node.sinks if s.kind == "memory-table"]
    parts = context.home(f"streams/{status.job_id}/{node.id}")
    at_the_end = [] if node.reduce else [(s, w) for s, w in writers if s.kind in WHOLE and not str(s.args.get("url", "")).endswith("/")]

    def batch(rows: DataFrame, number: int) -> None:
        rows = ordered(rows).persist()
        try:
            n = rows.count()
            totals["out"] = n if node.reduce else totals["out"] + n
            if tables or at_the_end or not writers:
                visible(rows).write.mode("overwrite").parquet(f"{parts}/rows/{'batch=0' if node.reduce else f'batch={number}'}")
            for sink, write in writers:
                if (sink, write) in at_the_end:
                    continue
                args = dict(sink.args)
                if "url" in args and args["url"].endswith("/") and not node.reduce:
                    args["url"] = f"{args['url']}batch-{number}/"
                write(rows, args, context)
            status.counts(node.id, None, totals["out"], {label: totals["out"] for label in labels})
        finally:
            rows.unpersist()

    out = df.writeStream.foreachBatch(batch).option("checkpointLocation", f"{parts}/checkpoint").outputMode("complete" if node.reduce else "append")
    out = out.trigger(availableNow=True) if node.source.kind == "file-stream" else out.trigger(processingTime="0 seconds")
    query = out.start()
    while query.isActive:
        if cancelled.is_set():
            query.stop()
            break
        query.awaitTermination(0.2)
    if query.exception() is not None and not cancelled.is_set():
        raise query.exception()
    made = context.spark.createDataFrame([], visible(df).schema)
    try:
        made = context.spark.read.schema(visible(df).schema).parquet(f"{parts}/rows/*")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    made = ordered(made)
    for sink, write in at_the_end:
        write(made, sink.args, context)
    for name in (node.id, *tables):
        context.put(name, made)
        if name in tables:
            context.register(name, made)
    return made
