"""The steps of a pipeline: each takes a DataFrame to a DataFrame, lazily."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spillway import plugins
from spillway.functions.semantics import ORDER, SEQUENCE, coerced, filter_condition, numbered, ordered, split_path, top_level, visible, with_generators
from spillway.plans.spec import Part


def names_of(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ORDER]


def _hidden(df: DataFrame) -> list[Column]:
    return [F.col(ORDER)] if ORDER in df.columns else []


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def apply_filter(df: DataFrame, args: Mapping[str, Any], context: Any) -> DataFrame:
    return df.where(filter_condition(args["expr"], df.schema))


def project(df: DataFrame, args: Mapping[str, Any], context: Any) -> DataFrame:
    own = set(df.columns)
    return df.select(*(_col(c) for c in dict.fromkeys(args["cols"]) if c in own), *_hidden(df))


def rename(df: DataFrame, args: Mapping[str, Any], context: Any) -> DataFrame:
    old, new = args["from"], args["to"]
    if old not in df.columns:
        return df
    rest = [_col(c) for c in names_of(df) if c not in (old, new)]
    return df.select(*rest, _col(old).alias(new), *_hidden(df))


def literal(spark: SparkSession, value: Any) -> Column:
    """A constant of any JSON type."""
    if isinstance(value, (Mapping, list, tuple)):
        import json

        return F.from_json(F.lit(json.dumps(value)), json_type(value))
    return F.lit(value)


def json_type(value: Any) -> T.DataType:
    """The type of a JSON value; a list has the type that its items share, or is one of texts."""
    if isinstance(value, Mapping):
        return T.StructType([T.StructField(str(k), json_type(v)) for k, v in value.items()])
    if isinstance(value, (list, tuple)):
        kinds = [json_type(v) for v in value if v is not None]
        if kinds and all(isinstance(k, (T.LongType, T.DoubleType)) for k in kinds):
            return T.ArrayType(T.DoubleType() if any(isinstance(k, T.DoubleType) for k in kinds) else T.LongType())
        return T.ArrayType(kinds[0] if kinds and all(k == kinds[0] for k in kinds) else T.StringType())
    return T.BooleanType() if isinstance(value, bool) else T.LongType() if isinstance(value, int) else T.DoubleType() if isinstance(value, float) else T.StringType()


def set_field(df: DataFrame, args: Mapping[str, Any], context: Any) -> DataFrame:
    return _with(df, {args["name"]: literal(df.sparkSession, args["value"])})


def _with(df: DataFrame, made: Mapping[str, Column]) -> DataFrame:
    """Fields set or added by literal name, even one with dots."""
    own = names_of(df)
    kept = [(made[c].alias(c) if c in made else _col(c)) for c in own]
    return df.select(*kept, *(v.alias(k) for k, v in made.items() if k not in own), *_hidden(df))


def to_typed(df: DataFrame, args: Mapping[str, Any], context: Any) -> DataFrame:
    schema = df.schema
    paths: dict[str, Column] = {}
    stays = F.lit(True)
    roles: dict[str, str] = {}
    for f in args["fields"]:
        name, kind = f["name"], f.get("type")
        value = split_path(name, schema)
        if kind is None:
            raise ValueError(f"field '{name}' has no type")
        made, ok = coerced(value, kind)
        stays = stays & ok
        paths[name] = made
        if f.get("role"):
            roles[name] = f["role"]
    out: dict[str, Column] = {c: _col(c) for c in names_of(df)} if args["passthrough"] else {}
    for path, made in paths.items():
        top, *below = path.split(".")
        if not below:
            out[top] = made.alias(top, metadata={"role": roles[path]}) if path in roles else made
        elif top in out and isinstance(schema[top].dataType if top in schema.names else None, T.StructType):
            out[top] = out[top].withField(".".join(f"`{x}`" for x in below), made)
        else:
            for name in reversed(below):
                made = F.struct(made.alias(name))
            out[top] = made if top not in out else _merged(out[top], made, df, top)
    filtered = df.where(stays)
    return filtered.select(*((v if k in roles else v.alias(k)) for k, v in out.items()), *_hidden(df))


def _merged(old: Column, new: Column, df: DataFrame, top: str) -> Column:
    """Two structs of one name that a dotted list of fields made one after the other."""
    fields = {f.name for f in df.select(old.alias("x")).schema["x"].dataType.fields}
    added = [f.name for f in df.select(new.alias("x")).schema["x"].dataType.fields]
    return F.struct(*(old.getField(f).alias(f) for f in sorted(fields - set(added))), *(new.getField(f).alias(f) for f in added))


#: A lookup table up to this many bytes, as Catalyst estimates it, is broadcast; a larger one is left to the planner.
BROADCAST_BYTES = 64 << 20


def lookup(df: DataFrame, args: Mapping[str, Any], context: Any) -> DataFrame:
    """Left join on text with the first row of each key; a match overwrites, even by null."""
    table = context.table(args["from"])
    adds = list(args["adds"])
    if table is None or args["onField"] not in table.columns:
        return df
    table = ordered(table)
    key = top_level(args["onField"], table.schema).text()
    present = [c for c in adds if c in table.columns]
    firsts = table.where(key.isNotNull()).groupBy(key.alias("__key")).agg(F.min_by(F.struct(F.lit(True).alias("__hit"), *(_col(c) for c in present)), ORDER).alias("__found"))
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    firsts = F.broadcast(firsts) if size <= BROADCAST_BYTES else firsts
    given = split_path(args["withKey"], df.schema).text()
    joined = df.withColumn("__given", given).join(firsts, F.col("__given") == F.col("__key"), "left")
    hit = F.col("__found.__hit").isNotNull()
    made = {}
    for c in present:
        found = F.col("__found").getField(c)
        if c not in df.columns:
            made[c] = found
        elif df.schema[c].dataType == table.schema[c].dataType:
            made[c] = F.when(hit, found).otherwise(_col(c))
        else:
            made[c] = F.when(hit, found.cast("string")).otherwise(_col(c).cast("string"))
    return _with(joined.select(*(_col(c) for c in df.columns), "__found"), made).drop("__found")


def expr_map(df: DataFrame, args: Mapping[str, Any], context: Any) -> DataFrame:
    """New rows from SQL expressions by field; ``keep`` keeps the other fields, ``where`` drops rows."""
    fields = {k: with_generators(str(v)) for k, v in args["fields"].items()}
    where = with_generators(str(args["where"])) if args.get("where") else None
    if SEQUENCE in " ".join([*fields.values(), where or ""]):
        df = numbered(df)
    if where:
        df = df.where(F.expr(where))
    made = {k: F.expr(v) for k, v in fields.items()}
    if args.get("keep"):
        return _with(df, made).drop(SEQUENCE)
    return df.select(*(v.alias(k) for k, v in made.items()), *_hidden(df))


def function_map(df: DataFrame, args: Mapping[str, Any], context: Any) -> DataFrame:
    """A script is not evaluated: it names a registered Python function, which runs on Arrow batches of rows.

    What the function returns replaces the row, None drops it. Its fields keep the types they came with; new ones
    are named by the function's ``schema`` attribute (DDL).
    """
    import pyarrow as pa

    name = args["script"].strip()
    if name not in plugins.FUNCTIONS:
        raise ValueError(f"scripts are not evaluated: '{name[:60]}' is no registered function; use expr-map, or register_function")
    function = plugins.FUNCTIONS[name]
    ddl = getattr(function, "schema", None)
    kind = T._parse_datatype_string(ddl) if ddl else visible(df).schema
    order = ORDER in df.columns
    out = T.StructType([*kind.fields, *([df.schema[ORDER]] if order else [])])

    def run(batches: Any) -> Any:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        for b in batches:
            rows = []
            for row in b.to_pylist():
                at = row.pop(ORDER, None)
                made = function(row)
                if isinstance(made, Mapping):
                    rows.append({**made, ORDER: at})
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in arrow.names} for r in rows], arrow)

    return df.mapInArrow(run, out)


def sql_step(df: DataFrame, args: Mapping[str, Any], context: Any) -> DataFrame:
    """SQL over the rows so far, known as ``input``, and the tables of the run."""
    return ordered(context.sql(args["sql"], {"input": visible(df)}))


STEPS: dict[str, Callable[[DataFrame, Mapping[str, Any], Any], DataFrame]] = {
    "filter": apply_filter, "project": project, "rename": rename, "set-field": set_field, "to-typed": to_typed, "lookup": lookup, "expr-map": expr_map,
    "groovy-map": function_map, "jvssql": sql_step,
}


def apply_step(df: DataFrame, step: Part, context: Any) -> DataFrame:
    from spillway.operators import typed

    function = plugins.STEPS.get(step.kind) or STEPS.get(step.kind) or typed.STEPS.get(step.kind)
    if function is None:
        raise ValueError(f"unknown step kind '{step.kind}'")
    return function(df, step.args, context)
