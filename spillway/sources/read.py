"""The sources: each gives a lazy DataFrame with the hidden order column."""

from __future__ import annotations

import base64
import re
import sqlite3
from collections.abc import Callable, Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spillway import plugins
from spillway.functions.semantics import ORDER, ordered, visible
from spillway.plans.spec import Part
from spillway.sources.stores import current

RESOURCES = Path(__file__).resolve().parent.parent / "examples"
CSV_CELL = r'((?:[^",]++|"(?:[^"]++|"")*+")*+),'


def place(url: str) -> str:
    """A path as Spark's readers take it; ``classpath:`` names what this package brings along."""
    if url.startswith("classpath:"):
        return f"file://{RESOURCES}/{url.removeprefix('classpath:').lstrip('/').removeprefix('examples/')}"
    if re.match(r"\w[\w+.-]*:", url):
        return url
    return f"file://{Path(url).expanduser().resolve()}"


def _folder(url: str) -> dict[str, str]:
    """A folder's files lie at any depth: a stream's batches have folders of their own."""
    return {"recursiveFileLookup": str(url.endswith("/")).lower()}


def _lines(spark: SparkSession, url: str) -> DataFrame:
    rows = spark.read.options(**_folder(url)).text(place(url)).withColumn(ORDER, F.monotonically_increasing_id())
    return rows.where(F.trim("value") != "")


def _shape(lines: DataFrame) -> T.StructType | None:
    """The types of JSON objects, found in one pass; VARIANT where a field has values of several types. None unless all are objects."""
    shape = lines.agg(F.schema_of_variant_agg(F.parse_json("value"))).first()[0] or ""
    if not shape.startswith("OBJECT<"):
        return None
    return T._parse_datatype_string(re.sub(r"\bOBJECT<", "STRUCT<", shape))


def ndjson(context: Any, args: Mapping[str, Any]) -> DataFrame:
    """Lines of JSON; blank lines are skipped, a malformed one fails. Without a ``schema`` (DDL) one pass over the lines finds the types; fields of several types become VARIANT."""
    spark, url = context.spark, args["url"]
    read = spark.read.options(mode="FAILFAST", **_folder(url))
    if args.get("schema"):
        return read.schema(args["schema"]).json(place(url))
    lines = _lines(spark, url)
    kinds = _shape(lines)
    if kinds is None:
        return read.json(place(url))
    mixed = [f.name for f in kinds if isinstance(f.dataType, T.VariantType)]
    typed = T.StructType([T.StructField(f.name, _plain(f.dataType)) for f in kinds if f.name not in mixed])
    if not mixed:
        return read.schema(typed).json(place(url))
    rows = lines.select(F.from_json("value", typed, {"mode": "FAILFAST"}).alias("r"), F.parse_json("value").alias("v"), ORDER)
    cells = [F.try_variant_get("v", f"$['{f.name}']", "variant").alias(f.name) if f.name in mixed else F.col("r").getField(f.name).alias(f.name) for f in kinds]
    return rows.select(*cells, ORDER)


def json_array(context: Any, args: Mapping[str, Any]) -> DataFrame:
    head = _lines(context.spark, args["url"]).select(F.ltrim("value")).first()
    if head is None or not head[0].startswith("["):
        raise ValueError(f"expected a top-level array in {args['url']}")
    read = context.spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (read.schema(args["schema"]) if args.get("schema") else read).json(place(args["url"]))


def csv(context: Any, args: Mapping[str, Any]) -> DataFrame:
    """Header and texts; each file of a folder has a header line, the first one's names hold for all. An empty cell is an empty text, a cell that a short row lacks is null, one too many is dropped; quotes hold commas, doubled ones stand for one."""
    place_in_file = F.struct(F.col("_metadata.file_block_start").alias("block"), F.col(ORDER).alias("row"))
    lines = _lines(context.spark, args["url"]).select("value", ORDER, F.col("_metadata.file_path").alias("__file"), place_in_file.alias("__at"))
    heads = lines.groupBy("__file").agg(F.min("__at").alias("__at"), F.min_by("value", "__at").alias("value"))
    head = heads.orderBy("__file").first()
    if head is None:
        return context.spark.createDataFrame([], T.StructType([]))
    closed = F.when((F.length("value") - F.length(F.replace("value", F.lit('"')))) % 2 == 1, F.concat("value", F.lit('",'))).otherwise(F.concat("value", F.lit(",")))
    plain = lambda c: F.replace(F.regexp_replace(c, '"((?:[^"]|"")*)"', "$1"), F.lit('""'), F.lit('"'))
    cells = F.transform(F.regexp_extract_all(closed, F.lit(CSV_CELL), 1), plain).alias("cells")
    names = context.spark.createDataFrame([(head["value"],)], "value string").select(cells).first()["cells"]
    last = {name: i for i, name in enumerate(names)}
    rows = lines.join(heads.select("__file", "__at"), ["__file", "__at"], "left_anti").select(ORDER, cells)
    return rows.select(*(F.get("cells", i).alias(name) for name, i in last.items()), ORDER)


def inline(context: Any, args: Mapping[str, Any]) -> DataFrame:
    """Rows of the job itself; they are few, so their types are found here."""
    import json

    rows = [dict(r) for r in args["rows"]]
    spark: SparkSession = context.spark
    if not rows:
        return spark.createDataFrame([], T.StructType([]))
    names = list(dict.fromkeys(k for r in rows for k in r))

    def sort(v: Any) -> str:
        return "bool" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "text" if isinstance(v, str) else "list" if isinstance(v, (list, tuple)) else "map" if isinstance(v, Mapping) else "text"

    mixed = {n for n in names if len({sort(r[n]) for r in rows if r.get(n) is not None}) > 1}
    text = [(i, json.dumps(r, default=str)) for i, r in enumerate(rows)]
    lines = spark.createDataFrame(text, f"{ORDER} long, value string")
    kinds = _shape(lines) or T.StructType([])
    typed = T.StructType([T.StructField(n, _plain(kinds[n].dataType)) for n in names if n not in mixed and n in kinds.names])
    parsed = lines.select(ORDER, F.from_json("value", typed).alias("r"), F.parse_json("value").alias("v"))
    cells = [F.try_variant_get("v", f"$['{n}']", "variant").alias(n) if n in mixed else F.col("r").getField(n).alias(n) if n in typed.names else F.lit(None).cast("string").alias(n) for n in names]
    return parsed.select(*cells, ORDER)


def _plain(kind: T.DataType) -> T.DataType:
    """Exact numbers that JSON writes with a point are doubles, an unknown type is a text."""
    if isinstance(kind, T.DecimalType):
        return T.DoubleType()
    if isinstance(kind, (T.NullType, T.VariantType)):
        return T.StringType()
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_plain(kind.elementType))
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _plain(f.dataType)) for f in kind.fields])
    return kind


def ref(context: Any, args: Mapping[str, Any]) -> DataFrame:
    """Another node's rows, or a memory table; one that nobody made is empty."""
    found = context.table(args["node"])
    return context.spark.createDataFrame([], T.StructType([])) if found is None else found


def sql(context: Any, args: Mapping[str, Any]) -> DataFrame:
    return context.sql(args["sql"])


def parquet(context: Any, args: Mapping[str, Any]) -> DataFrame:
    """A table in files; ``order`` names columns that say in which order rows were met, by default file and place."""
    df = context.spark.read.parquet(args["url"])
    if not args.get(ORDER, True):  # dropped again, the place in the file would stay in the scan
        return df
    order = args.get("order")
    keys = [order] if isinstance(order, str) else list(order or ())
    return df.withColumn(ORDER, F.struct(*keys) if keys else F.struct("_metadata.file_path", "_metadata.row_index"))


def sqlite(context: Any, args: Mapping[str, Any]) -> DataFrame:
    """Read-only, by one task that hands on batches; the file must be where that task runs. BLOBs become base64."""
    path, query, params = str(Path(args["path"]).expanduser()), args["query"], tuple(args["params"] or ())
    uri = f"file:{path}?mode=ro"

    def plain(v: Any) -> Any:
        return base64.b64encode(v).decode() if isinstance(v, bytes) else v

    with sqlite3.connect(uri, uri=True) as db:
        cursor = db.execute(query, params)
        names = [d[0] for d in cursor.description]
        seen: list[set[type]] = [set() for _ in names]
        while rows := cursor.fetchmany(10_000):  # types are per cell there: all rows are looked at, none is kept
            for row in rows:
                for kinds, v in zip(seen, row):
                    if v is not None:
                        kinds.add(type(v))
    ddl = [T.LongType() if k == {int} else T.DoubleType() if k and k <= {int, float} else T.StringType() for k in seen]
    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, ddl)])
    text = [isinstance(t, T.StringType) for t in ddl]

    def run(batches: Any) -> Any:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for _ in batches:
            with sqlite3.connect(uri, uri=True) as db:
                cursor = db.execute(query, params)
                while rows := cursor.fetchmany(10_000):
                    cells = [[(None if v is None else str(plain(v))) if t else v for v in column] for t, column in zip(text, zip(*rows))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, arrow)], schema=arrow)

    return context.spark.range(1, numPartitions=1).mapInArrow(run, schema)


def kvstore(context: Any, args: Mapping[str, Any]) -> DataFrame:
    """The last row of each key, as the newest whole version of the store has it."""
    found = current(context.spark, context.home(f"kv/{args['name']}"))
    if found is None:
        raise ValueError(f"there is no kvstore '{args['name']}'")
    return context.spark.read.parquet(found).drop("_key")


def index(context: Any, args: Mapping[str, Any]) -> DataFrame:
    """The documents of a term index that a query finds: words are alternatives, ``+word`` must and ``-word`` must not be there, ``field:word`` looks in one field."""
    spark, home = context.spark, current(context.spark, context.home(f"index/{args['name']}"))
    if home is None:
        raise ValueError(f"there is no index '{args['name']}'")
    docs = spark.read.parquet(f"{home}/documents")
    query = (args.get("query") or "").strip()
    if query not in ("", "*", "*:*"):
        postings = spark.read.parquet(f"{home}/postings")
        wanted = [(m[1], m[2], m[3].lower()) for m in re.finditer(r"([+-]?)(?:([\w.]+):)?(\w+)", query) if m[3] not in ("AND", "OR", "NOT")]
        if " AND " in query:
            wanted = [(sign or "+", field, word) for sign, field, word in wanted]
        hit = lambda field, word: (F.col("term") == word) & ((F.col("field") == field) if field else F.lit(True))
        every = postings.where(F.col("term").isin(*{w for _, _, w in wanted})).groupBy("doc").agg(*(F.max(hit(f, w)).alias(f"h{k}") for k, (_, f, w) in enumerate(wanted)))
        must = [F.col(f"h{k}") for k, (s, _, _) in enumerate(wanted) if s == "+"]
        never = [~F.col(f"h{k}") for k, (s, _, _) in enumerate(wanted) if s == "-"]
        may = [F.col(f"h{k}") for k, (s, _, _) in enumerate(wanted) if not s]
        found = F.lit(True)
        for c in must + never:
            found = found & c
        if may and not must:
            some = F.lit(False)
            for c in may:
                some = some | c
            found = found & some
        if must or may:
            docs = docs.join(every.where(found).select("doc"), "doc", "left_semi")
        else:
            docs = docs.join(every.where(~found).select("doc"), "doc", "left_anti")
    return docs.withColumn(ORDER, F.col("doc")).drop("doc")


def kafka(context: Any, args: Mapping[str, Any]) -> DataFrame:
    from spillway.streaming.sources import kafka as read

    return read(context, args)


def nats(context: Any, args: Mapping[str, Any]) -> DataFrame:
    from spillway.streaming.sources import nats as read

    return read(context, args)


def file_stream(context: Any, args: Mapping[str, Any]) -> DataFrame:
    read = context.spark.readStream.format(args["format"]).schema(args["schema"])
    return (read.option("maxFilesPerTrigger", args["maxFilesPerTrigger"]) if args.get("maxFilesPerTrigger") else read).load(args["url"])


SOURCES: dict[str, Callable[[Any, Mapping[str, Any]], DataFrame]] = {
    "ndjson-file": ndjson, "json-file": json_array, "csv-file": csv, "inline": inline, "ref": ref, "sql": sql, "parquet": parquet, "sqlite": sqlite, "kvstore": kvstore, "lucene": index,
    "kafka": kafka, "nats": nats, "file-stream": file_stream,
}


def open_source(context: Any, source: Part, order: bool = True) -> DataFrame:
    """A source's rows, with the hidden order column if ``order`` asks for it."""
    function = plugins.SOURCES.get(source.kind) or SOURCES.get(source.kind)
    if function is None:
        raise ValueError(f"unknown source kind '{source.kind}'")
    rows = function(context, source.args if order else {**source.args, ORDER: False})
    return ordered(rows) if order else visible(rows)
