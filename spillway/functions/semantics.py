"""Comparing, coercing and grouping values as a schemaless engine does, as Column expressions that Catalyst can push down.

A field may be missing from the schema; it then is null. A column whose JSON values have several types is a VARIANT;
its numbers stay numbers and its texts stay texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The hidden column of the order in which rows were met.
ORDER = "__ord"

#: Fixed value: the grammar of a filter.
FILTER = re.compile(r"\s*([\w.]+)\s*(==|!=|>=|<=|>|<|LIKE)\s*(.+?)\s*$", re.IGNORECASE | re.ASCII)
#: What a text may say for a boolean.
TRUE_WORDS, FALSE_WORDS = ("true", "yes", "y", "1"), ("false", "no", "n", "0")
#: Fixed value: the text of a null in a group key.
NULL_KEY = "<null>"
INSTANT = r"^[+-]?\d{4,10}-\d{2}-\d{2}[Tt]\d{2}:\d{2}(:\d{2}([.]\d{0,9})?)?([Zz]|[+-]\d{2}:\d{2}(:\d{2})?)$"
NUMBER = r"^[\x00-\x20]*[+-]?(NaN|Infinity|((\d+[.]?\d*|[.]\d+)([eE][+-]?\d+)?)[fFdD]?)[\x00-\x20]*$"
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


@dataclass(frozen=True)
class Value:
    """A column with its type, or None where the field is missing."""

    column: Column
    type: T.DataType | None

    @property
    def is_number(self) -> bool:
        return isinstance(self.type, NUMERIC)

    @property
    def is_variant(self) -> bool:
        return isinstance(self.type, T.VariantType)

    def _variant_number(self) -> Column:
        return F.schema_of_variant(self.column).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")

    def null(self) -> Column:
        if self.type is None:
            return F.lit(True)
        return (self.column.isNull() | F.is_variant_null(self.column)) if self.is_variant else self.column.isNull()

    def number(self) -> Column:
        """The value as a double if it is a number, else null."""
        if self.is_number:
            return self.column.cast("double")
        if self.is_variant:
            return F.when(self._variant_number(), F.try_variant_get(self.column, "$", "double"))
        return F.lit(None).cast("double")

    def text(self) -> Column:
        """The value as text; null for null."""
        if self.type is None or isinstance(self.type, T.NullType):
            return F.lit(None).cast("string")
        if self.is_variant:
            return F.when(~self.null(), F.try_variant_get(self.column, "$", "string"))
        if isinstance(self.type, (T.ArrayType, T.StructType, T.MapType)):
            return F.when(self.column.isNotNull(), F.lit(""))  # containers have no text
        return self.column.cast("string")

    def loose_number(self) -> Column:
        """The value as a double; a text that is no number, or a boolean, comes to what Java makes of it."""
        if isinstance(self.type, T.BooleanType):
            return self.column.cast("int").cast("double")
        if self.is_number:
            return self.number()
        return F.when(~self.null(), F.coalesce(self.number(), parsed_double(self.text()), F.lit(0.0)))


def parsed_double(text: Column) -> Column:
    """Null if the text is no number as Java writes one."""
    return F.when(text.rlike(NUMBER), F.regexp_replace(F.trim(text), "(?<=[0-9.])[fFdD]$", "").try_cast("double"))


def split_path(path: str, schema: T.StructType) -> Value:
    """A dotted path; missing anywhere on the way is missing."""
    names, column, kind = path.split("."), None, schema
    for name in names:
        if isinstance(kind, T.VariantType):
            column = F.try_variant_get(column, f"$['{name}']" if not name.isidentifier() else f"$.{name}", "variant")
            continue
        if not isinstance(kind, T.StructType) or name not in kind.names:
            return Value(F.lit(None), None)
        column = F.col(f"`{name}`") if column is None else column.getField(name)
        kind = kind[name].dataType
    return Value(column, kind)


def top_level(name: str, schema: T.StructType) -> Value:
    return Value(F.col(f"`{name}`"), schema[name].dataType) if name in schema.names else Value(F.lit(None), None)


def as_double(literal: str) -> float | None:
    text = literal.strip()
    if not re.match(NUMBER, text):
        return None
    text = re.sub(r"(?<=[0-9.])[fFdD]$", "", text)
    return float(text.replace("Infinity", "inf"))


def filter_condition(expr: str, schema: T.StructType) -> Column:
    """``column operator literal`` as a condition; where it is null, the row goes."""
    m = FILTER.fullmatch(expr)
    if not m:
        raise ValueError(f"a filter is '<column> <operator> <literal>', not: {expr}")
    path, op, literal = m[1], m[2].upper(), m[3]
    if len(literal) > 1 and literal[0] == literal[-1] and literal[0] in "'\"":
        literal = literal[1:-1]
    number, value = as_double(literal), split_path(path, schema)
    if op in ("==", "!="):
        same = value.text() == literal
        if number is not None and value.is_number:
            same = value.number() == number
        elif number is not None and value.is_variant:
            same = F.coalesce(value.number() == number, same)
        equal = F.when(value.null(), F.lit(literal == "null")).otherwise(F.coalesce(same, F.lit(False)))
        if op == "==" and literal != "null" and value.type is not None:
            return same  # null doesn't pass either way, and this form reaches the scan
        return equal if op == "==" else ~equal
    if op == "LIKE":
        pattern = literal.replace(".", r"\.").replace("%", ".*").replace("_", ".")
        return F.coalesce(value.text().rlike(rf"(?i)\A(?:{pattern})\z"), F.lit(False))
    if number is None or value.type is None:
        return F.lit(op in ("<", "<="))  # what can't be compared counts as less
    x = value.loose_number()
    held = {">": x > number, ">=": x >= number, "<": x < number, "<=": x <= number}[op]
    return held if op in (">", ">=") else value.null() | held


def coerced(value: Value, kind: str) -> tuple[Column, Column]:
    """The value as ``kind``, and whether the row stays; null stays null and stays."""
    m = re.fullmatch(r"array<(.*)>", kind)
    if m and isinstance(value.type, T.ArrayType):
        inner = value.type.elementType
        return F.transform(value.column, lambda x: coerced(Value(x, inner), m[1])[0]), F.lit(True)
    if m and isinstance(value.type, T.StringType):
        pieces = F.split(F.regexp_replace(value.column, ",+$", ""), ",")
        pieces = F.when(value.column.rlike("^,+$"), F.array().cast("array<string>")).otherwise(pieces)
        return F.transform(pieces, lambda x: coerced(Value(F.trim(x), T.StringType()), m[1])[0]), F.lit(True)
    if m:
        return F.lit(None).cast("array<string>"), value.null()
    text, number = value.text(), value.number()
    whole = F.when(number.isNotNull(), number.cast("decimal(38,0)")) if value.is_variant else None
    if kind == "core_string":
        out = text
    elif kind == "core_long":
        if value.is_number:
            out = F.least(F.greatest(value.column.cast("double"), F.lit(-(2.0**63))), F.lit(2.0**63)).try_cast("long") if isinstance(value.type, (T.FloatType, T.DoubleType)) else value.column.cast("long")
        else:
            parsed = F.when(F.trim(text).rlike(r"^[+-]?\d+$"), F.trim(text).try_cast("long"))
            out = F.coalesce(F.try_variant_get(value.column, "$", "bigint"), whole.try_cast("long"), parsed) if value.is_variant else parsed
    elif kind == "core_double":
        out = number if value.is_number else F.coalesce(number, parsed_double(text))
    elif kind == "core_boolean":
        if isinstance(value.type, T.BooleanType):
            out = value.column
        else:
            word = F.lower(F.trim(text))
            out = F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))
    elif kind == "core_timestamp":
        if value.is_number:
            out = value.column.cast("long")
        elif isinstance(value.type, (T.TimestampType, T.TimestampNTZType)):
            out = F.unix_millis(value.column.cast("timestamp"))
        else:
            instant = F.trim(text)
            parsed = F.when(instant.rlike(INSTANT), F.unix_millis(F.try_to_timestamp(F.upper(instant))))
            out = F.coalesce(F.try_variant_get(value.column, "$", "bigint"), parsed) if value.is_variant else parsed
    else:
        return (F.lit(None) if value.type is None else value.column), F.lit(True)  # a type that nothing knows changes nothing
    return out, value.null() | out.isNotNull()


def group_key(name: str, schema: T.StructType) -> Column:
    """A group key is a text; 1 and '1' are one group, and null has a name."""
    return F.coalesce(top_level(name, schema).text(), F.lit(NULL_KEY))


def ordered(df: DataFrame, order: Column | None = None) -> DataFrame:
    """``df`` with the hidden order column, unless it has one."""
    if ORDER in df.columns or df.isStreaming:
        return df
    return df.withColumn(ORDER, F.monotonically_increasing_id() if order is None else order)


def visible(df: DataFrame) -> DataFrame:
    return df.drop(ORDER)


#: The hidden column that gen.next() reads.
SEQUENCE = "__seq"


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with the numbers from 1 in SEQUENCE: each partition's rows are counted first, so that nothing is sorted or gathered."""
    marked = df.withColumn("__id", F.monotonically_increasing_id()).withColumn("__p", F.shiftright("__id", 33))
    counts = marked.groupBy("__p").agg(F.count(F.lit(1)).alias("n"))  # a row for each partition: small enough for one window, and to broadcast
    before = counts.select("__p", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    placed = marked.join(F.broadcast(before), "__p")
    return placed.withColumn(SEQUENCE, F.col("__before") + F.col("__id").bitwiseAND((1 << 33) - 1) + 1).drop("__id", "__p", "__before")


# Generators for expr-map, by name; arguments are SQL expressions.
GENERATORS = {
    "uuid": lambda: "uuid()",
    "now": lambda: "date_format(current_timestamp(), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")",
    "nowMillis": lambda: "unix_millis(current_timestamp())",
    "random": lambda: "rand()",
    "randomInt": lambda low, high: f"(cast(floor(rand() * (({high}) - ({low}))) as int) + ({low}))",
    "pick": lambda items: f"element_at({items}, cast(floor(rand() * size({items})) as int) + 1)",
    "next": lambda name="'default'": SEQUENCE,
}
_CALL = re.compile(r"\bgen\.(\w+)\(")


def with_generators(expr: str) -> str:
    """``gen.name(arguments)`` written out as SQL."""
    while m := _CALL.search(expr):
        depth, i, args, start, quote = 1, m.end(), [], m.end(), ""
        while depth:
            if i >= len(expr):
                raise ValueError(f"a bracket is missing: {expr}")
            c = expr[i]
            if quote:
                quote = "" if c == quote else quote
            elif c in "'\"":
                quote = c
            elif c in "([":
                depth += 1
            elif c in ")]":
                depth -= 1
            if (c == "," and depth == 1 and not quote) or not depth:
                args.append(expr[start:i].strip())
                start = i + 1
            i += 1
        if m[1] not in GENERATORS:
            raise ValueError(f"unknown generator gen.{m[1]}; known: {', '.join(GENERATORS)}")
        expr = expr[: m.start()] + GENERATORS[m[1]](*[a for a in args if a]) + expr[i:]
    return expr
