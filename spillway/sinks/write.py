"""The sinks. Files are written in parts by all tasks; a URL that doesn't end in a slash gets them joined to one file."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spillway import plugins
from spillway.functions.semantics import NUMERIC, ORDER, split_path, visible
from spillway.plans.spec import Part
from spillway.sources.read import place
from spillway.sources.stores import current, hadoop, publish, write_table


def _one_file(df: DataFrame, url: str, write: Callable[[DataFrame, str], None], head: str = "", tail: str = "", between: str = "") -> None:
    """Parts go to a folder beside the target, are copied one after the other into a new file, and that takes the target's place.

    ``between`` is what ends each row of a part but must not end the last one.
    """
    path = place(url)
    beside = f"{path}.parts-{uuid.uuid4().hex}"
    write(df, beside)
    jvm, files, target = hadoop(df.sparkSession, path)
    parts = jvm.org.apache.hadoop.fs.Path(beside)
    whole = jvm.org.apache.hadoop.fs.Path(f"{beside}.whole")
    try:
        out = files.create(whole, True)
        if head:
            out.write(bytearray(head.encode()))
        found = sorted(((s.getPath().toString(), s.getLen()) for s in files.listStatus(parts)))
        found = [(name, size) for name, size in found if "/part-" in name and size]
        for k, (name, size) in enumerate(found):
            given = files.open(jvm.org.apache.hadoop.fs.Path(name))
            jvm.org.apache.commons.io.IOUtils.copyLarge(given, out, 0, size - (len(between.encode()) if k == len(found) - 1 else 0))
            given.close()
        if tail:
            out.write(bytearray(tail.encode()))
        out.close()
        files.delete(target, False)
        files.rename(whole, target)
    finally:
        files.delete(parts, True)


def ndjson(df: DataFrame, args: Mapping[str, Any], context: Any) -> None:
    rows, url = visible(df), args["url"]

    def write(rows: DataFrame, path: str) -> None:
        writer = rows.write.mode("overwrite").option("ignoreNullFields", False)
        (writer.option("compression", "gzip") if url.endswith(".gz") else writer).json(path)

    if url.endswith("/"):
        write(rows, place(url))
    else:
        _one_file(rows, url, write)
    if args.get("registerAsTable"):
        context.register(args["registerAsTable"], df)


def csv(df: DataFrame, args: Mapping[str, Any], context: Any) -> None:
    names = list(args["cols"])
    own = {f.name: f.dataType for f in df.schema.fields}
    cells = [(F.to_json(f"`{c}`") if isinstance(own[c], (T.StructType, T.ArrayType, T.MapType, T.VariantType)) else F.col(f"`{c}`").cast("string")).alias(c) if c in own else F.lit(None).cast("string").alias(c) for c in names]
    rows = df.select(*cells)
    options = {"escape": '"', "emptyValue": "", "nullValue": ""}
    quoted = lambda c: '"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\n') else c
    if args["url"].endswith("/"):
        rows.write.mode("overwrite").options(header=True, **options).csv(place(args["url"]))
    else:
        _one_file(rows, args["url"], lambda r, path: r.write.options(**options).csv(path), ",".join(map(quoted, names)) + "\n")


def json_array(df: DataFrame, args: Mapping[str, Any], context: Any) -> None:
    """One array."""
    row = F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns if c != ORDER)), {"ignoreNullFields": "false", "pretty": str(bool(args["pretty"])).lower()})
    _one_file(df.select(row.alias("value")), args["url"], lambda r, path: r.write.option("lineSep", ",\n").text(path), "[\n", "\n]\n", ",\n")


def _alike(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with texts where a column's types differ so that Spark finds no common one."""
    kinds = {f.name: f.dataType for f in new.schema.fields}
    odd = [f.name for f in old.schema.fields if f.name in kinds and f.dataType != kinds[f.name] and not (isinstance(f.dataType, NUMERIC) and isinstance(kinds[f.name], NUMERIC))]
    texts = lambda df: df.withColumns({c: F.to_json(f"`{c}`") if isinstance(df.schema[c].dataType, (T.StructType, T.ArrayType, T.MapType)) else F.col(f"`{c}`").cast("string") for c in odd}) if odd else df
    return texts(old), texts(new)


def kvstore(df: DataFrame, args: Mapping[str, Any], context: Any) -> None:
    """The last row of each key wins, over earlier writes, too; rows without a key are not kept. The store is one table, sorted by key, so that a key's range prunes."""
    spark, base = df.sparkSession, context.home(f"kv/{args['name']}")
    key = split_path(args["keyExpr"], df.schema).text()
    names = [c for c in df.columns if c != ORDER]
    order = F.col(ORDER) if ORDER in df.columns else F.monotonically_increasing_id()
    rows = df.select(key.alias("_key"), order.alias("__o"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("__row")).where("_key is not null")
    last = rows.groupBy("_key").agg(F.max_by("__row", "__o").alias("__row")).select("_key", "__row.*")
    if (found := current(spark, base)) is not None:
        old, new = _alike(spark.read.parquet(found), last)
        both = old.withColumn("__new", F.lit(False)).unionByName(new.withColumn("__new", F.lit(True)), allowMissingColumns=True)
        cells = [F.col(f"`{c}`") for c in both.columns if c not in ("_key", "__new")]
        last = both.groupBy("_key").agg(F.max_by(F.struct(*cells), "__new").alias("__row")).select("_key", "__row.*")
    fresh = publish(spark, base, write_table(last.sortWithinPartitions("_key")))
    if args.get("registerAsTable"):
        context.register(args["registerAsTable"], spark.read.parquet(fresh).drop("_key"))


#: What one task indexes at most: characters of its documents, each cell counting one more, so that it has at most half as many postings.
INDEX_CHARS = 1 << 22
#: Rows of a file of numbered documents: files are read 32 to a task at most, however small they are.
INDEX_ROWS = 1 << 16


def is_mls(kind: T.DataType) -> bool:
    """A text in several languages: a struct of ``mls``, a list of structs with a language and a text."""
    inner = kind["mls"].dataType if isinstance(kind, T.StructType) and "mls" in kind.names else None
    return isinstance(inner, T.ArrayType) and isinstance(inner.elementType, T.StructType) and {"lang", "text"} <= set(inner.elementType.names)


def index(df: DataFrame, args: Mapping[str, Any], context: Any, by_language: bool = False) -> None:
    """A term index: documents by number, and postings (term, field, doc, count) sorted by term. A write replaces the index.

    Documents are dealt by their characters before they are cut into terms, so a task's memory has a bound however well the input's files are packed;
    a document's postings are all in one task and need no shuffle.
    """
    spark = df.sparkSession
    names = [c for c in df.columns if c != ORDER]
    numbered = df.select(F.monotonically_increasing_id().alias("doc"), *(F.col(f"`{c}`") for c in names))
    terms_of = lambda text: F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\w+"), 0)

    def language(f: T.StructField) -> Callable[[Any], Any]:
        clean = "clean" in f.dataType["mls"].dataType.elementType.names

        def one(x: Any) -> Any:
            name = F.concat(F.lit(f"{f.name}."), F.coalesce(x["lang"], F.lit("und")))
            return F.struct(name.alias("field"), terms_of(F.coalesce(x["clean"], x["text"]) if clean else x["text"]).alias("terms"))

        return one

    def write(home: str) -> None:
        numbered.write.option("maxRecordsPerFile", INDEX_ROWS).parquet(f"{home}/all")
        kept = spark.read.parquet(f"{home}/all")
        cells, chars = [], F.lit(0).cast("long")
        for f in kept.schema.fields:
            if f.name == "doc":
                continue
            column = F.col(f"`{f.name}`")
            text = F.to_json(column) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else column.cast("string")
            chars = chars + F.coalesce(F.length(text), F.lit(0)) + 1
            if by_language and is_mls(f.dataType):
                cells.append(F.coalesce(F.transform(column["mls"], language(f)), F.array().cast("array<struct<field: string, terms: array<string>>>")))
            else:
                cells.append(F.array(F.struct(F.lit(f.name).alias("field"), terms_of(text).alias("terms"))))
        tasks = -(-(kept.agg(F.sum(chars)).first()[0] or 1) // INDEX_CHARS)
        terms = kept.repartition(tasks, "doc").select("doc", F.explode(F.concat(*cells)).alias("c")).select("doc", "c.field", F.explode("c.terms").alias("term"))
        terms.groupBy("term", "field", "doc").agg(F.count(F.lit(1)).alias("count")).sortWithinPartitions("term").write.parquet(f"{home}/postings")
        (kept if args["storeSource"] else kept.select("doc", *[f"`{c}`" for c in names if c in ("id", "_id")])).write.parquet(f"{home}/documents")
        if by_language:
            spark.createDataFrame([(visible(df).schema.json(),)], "value string").coalesce(1).write.text(f"{home}/types")

    publish(spark, context.home(f"index/{args['name']}"), write)


def typed_index(df: DataFrame, args: Mapping[str, Any], context: Any) -> None:
    """A term index in which a text in several languages has a field for each, ``title.en``; the rows' types are kept beside it."""
    index(df, args, context, by_language=True)


def parquet(df: DataFrame, args: Mapping[str, Any], context: Any) -> None:
    visible(df).write.mode("overwrite").parquet(args["url"])


def kafka(df: DataFrame, args: Mapping[str, Any], context: Any) -> None:
    from spillway.streaming.sources import kafka_ready

    kafka_ready(df.sparkSession)
    value = F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns if c != ORDER))).alias("value")
    key = [split_path(args["keyExpr"], df.schema).text().alias("key")] if args.get("keyExpr") else []
    df.select(*key, value).write.format("kafka").option("kafka.bootstrap.servers", args["bootstrap"]).option("topic", args["topic"]).save()


def nats(df: DataFrame, args: Mapping[str, Any], context: Any) -> None:
    from spillway.streaming.nats import publisher

    body = F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns if c != ORDER)))
    df.select(body.alias("value")).mapInArrow(publisher(args["subject"], args.get("servers")), "n long").write.format("noop").mode("overwrite").save()


#: Sinks that hold one whole: a stream's rows get there when it ends, unless the URL is a folder of parts.
WHOLE = ("ndjson-file", "csv-file", "json-file", "parquet", "lucene", "jvs-lucene")
#: memory-table and counting are no writers: the run itself sees to them.
LAZY = ("memory-table", "counting")
SINKS: dict[str, Callable[[DataFrame, Mapping[str, Any], Any], None]] = {
    "ndjson-file": ndjson, "csv-file": csv, "json-file": json_array, "kvstore": kvstore, "lucene": index, "jvs-lucene": typed_index, "nats": nats, "kafka": kafka, "parquet": parquet,
}


def writer(sink: Part) -> Callable[[DataFrame, Mapping[str, Any], Any], None]:
    found = plugins.SINKS.get(sink.kind) or SINKS.get(sink.kind)
    if found is None:
        raise ValueError(f"unknown sink kind '{sink.kind}'")
    return found
