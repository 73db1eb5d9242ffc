"""Steps over typed rows: declared transformations, and texts in several languages that are enriched and translated.

A text in several languages is a struct with ``mls``, a list of structs with at least ``lang`` and ``text``.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

import pyarrow as pa
import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spillway import plugins
from spillway.functions.semantics import SEQUENCE, numbered, split_path, with_generators
from spillway.operators.steps import _col, _hidden, _with, function_map, names_of, to_typed
from spillway.sinks.write import is_mls

#: What a declared transformation may hold.
PARTS = ("copyAll", "copy", "set", "mls", "append", "loop", "times", "when", "where")


def transform(df: DataFrame, args: Mapping[str, Any], context: Any) -> DataFrame:
    """A declared transformation of each row; its expressions are SQL over the row as it came, ``gen.name()`` included.

    ``copyAll`` keeps all fields, ``copy`` (new: path) some; ``set`` (field: expression) makes fields; ``mls`` (field: {lang, text}) makes texts in
    several languages or adds to them; ``append`` (field: expression) adds to a list; ``loop`` (field: {over, as, each}) makes a list from another
    one, ``times`` (field: {n, as, each}) from the numbers from 0; ``when`` is a list of {if, set}, of which the first that holds counts;
    ``where`` drops rows. ``typeJson`` ({fields: [{name, type}]}) coerces the result as to-typed does. A script that is the name of
    a registered function runs that, as groovy-map does; no code is evaluated.
    """
    script = args["script"]
    if isinstance(script, str):
        if script.strip() in plugins.FUNCTIONS:
            return function_map(df, args, context)
        script = yaml.safe_load(script)
    if not isinstance(script, Mapping) or not set(script) <= set(PARTS):
        raise ValueError(f"a jvs-groovy script is a mapping of {', '.join(PARTS)}, or the name of a registered function; scripts are not evaluated")
    if "gen.next(" in yaml.safe_dump(dict(script)):
        df = numbered(df)
    sql = lambda x: F.expr(with_generators(str(x)))
    if script.get("where"):
        df = df.where(sql(script["where"]))
    made: dict[str, Column] = {c: _col(c) for c in names_of(df) if c != SEQUENCE} if script.get("copyAll") else {}
    made |= {new: split_path(str(path), df.schema).column for new, path in (script.get("copy") or {}).items()}
    made |= {name: sql(x) for name, x in (script.get("set") or {}).items()}
    for name, given in (script.get("mls") or {}).items():
        given = [given] if isinstance(given, Mapping) else given
        new = F.array(*(F.struct(F.lit(g.get("lang", "en")).alias("lang"), sql(g["text"]).alias("text")) for g in given))
        made[name] = F.struct((F.concat(F.coalesce(made[name].getField("mls"), F.array().cast("array<struct<lang: string, text: string>>")), new) if name in made else new).alias("mls"))
    for name, x in (script.get("append") or {}).items():
        made[name] = F.concat(F.coalesce(made[name], F.array()), F.array(sql(x))) if name in made else F.array(sql(x))
    for name, x in (script.get("loop") or {}).items():
        made[name] = sql(f"transform({x['over']}, {x.get('as', 'it')} -> {x['each']})")
    for name, x in (script.get("times") or {}).items():
        made[name] = sql(f"transform(filter(sequence(0, greatest(0, cast({x['n']} as int))), {x.get('as', 'it')}_ -> {x.get('as', 'it')}_ < {x['n']}), {x.get('as', 'it')} -> {x['each']})")
    cases: dict[str, Column] = {}
    earlier = F.lit(False)
    for case in script.get("when") or ():
        holds = F.coalesce(sql(case["if"]), F.lit(False)) & ~earlier
        for name, x in case["set"].items():
            cases[name] = F.when(holds, sql(x)) if name not in cases else cases[name].when(holds, sql(x))
        earlier = earlier | holds
    made |= {name: c.otherwise(made[name]) if name in made else c for name, c in cases.items()}
    out = df.select(*(c.alias(name) for name, c in made.items()), *_hidden(df))
    if args.get("typeJson"):
        spec = args["typeJson"] if isinstance(args["typeJson"], Mapping) else yaml.safe_load(args["typeJson"])
        out = to_typed(out, {"fields": spec["fields"], "passthrough": True}, context)
    return out


def _mls_fields(df: DataFrame, wanted: Any = ()) -> list[str]:
    return [f.name for f in df.schema.fields if is_mls(f.dataType) and (not wanted or f.name in wanted)]


def clean(text: Column) -> Column:
    """Lower case, words between single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)[\W_]+", " "))


def segmented(text: Column) -> Column:
    """Sentences."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), F.trim), lambda s: s != "")


#: The tag of an enrichment and the field it fills.
BUILT_IN = {"basic": ("clean", clean), "segmented": ("segmented", segmented)}


def enrich(df: DataFrame, args: Mapping[str, Any], context: Any) -> DataFrame:
    """Fields added to each language's text: ``clean`` (tag basic), ``segmented``, and what ``register_enricher(tag, field)`` knows.

    Without tags all run. A tag's function takes a Column of one text to a Column; it runs inside the engine, for each element.
    """
    known = BUILT_IN | plugins.ENRICHERS
    tags = list(args.get("tags") or known)
    if unknown := [t for t in tags if t not in known]:
        raise ValueError(f"unknown enrichment {', '.join(unknown)}; known: {', '.join(known)}; others: register_enricher(tag, field)")

    def one(x: Column) -> Column:
        for field, function in (known[t] for t in tags):
            x = x.withField(field, function(x["text"]))
        return x

    return _with(df, {name: _col(name).withField("mls", F.transform(_col(name)["mls"], one)) for name in _mls_fields(df)})


def translate(df: DataFrame, args: Mapping[str, Any], context: Any) -> DataFrame:
    """Translations added to texts in several languages, for target languages that a text doesn't have.

    ``register_translator(model)`` names a function (texts, source, target) -> texts, called with batches of different texts in Arrow
    batches on the executors; ``model`` None is the first registered. The text translated is that of ``sourceLang``, or the first.
    """
    model = args.get("model") or next(iter(plugins.TRANSLATORS), None)
    if model not in plugins.TRANSLATORS:
        raise ValueError(f"no translator '{model}': register_translator(model)")
    function, source = plugins.TRANSLATORS[model], args.get("sourceLang")

    def translator(target: str) -> Any:
        @F.arrow_udf("string")
        def translated(text: pa.Array) -> pa.Array:
            given = [t for t in text.unique().to_pylist() if t is not None]
            made = dict(zip(given, function(given, source, target))) if given else {}
            return pa.array([made.get(t) for t in text.to_pylist()], pa.string())

        return translated

    out = df
    for name in _mls_fields(df, args.get("mlsFields")):
        item = df.schema[name].dataType["mls"].dataType.elementType
        for target in args.get("targetLangs") or ():
            mls = _col(name)["mls"]
            own = F.filter(mls, lambda x: (x["lang"] == source) if source else F.lit(True))
            there = F.coalesce(F.array_contains(F.transform(mls, lambda x: x["lang"]), target), F.lit(False))
            helper = f"__to_{name}_{target}"
            out = out.withColumn(helper, translator(target)(F.when(~there, F.get(own, 0)["text"])))
            cells = [F.lit(target).alias(f.name) if f.name == "lang" else _col(helper).alias(f.name) if f.name == "text" else F.lit(None).cast(f.dataType).alias(f.name) for f in item.fields]
            more = F.when(_col(helper).isNotNull(), F.concat(mls, F.array(F.struct(*cells)))).otherwise(mls)
            out = _with(out, {name: _col(name).withField("mls", more)}).drop(helper)
    return out


STEPS = {"jvs-groovy": transform, "jvs-enrich": enrich, "jvs-translate": translate}
