"""Row-local compilation: an expression over typed values becomes a Spark Column of built-in functions.

A value is a Column with its type. `many` marks a stream of matches held in an array column: `.[]` makes one, `[ ]`
closes it, and operators in between become higher-order functions, so that nothing leaves the JVM. What has no common
type (mixed arrays, `..` over unlike shapes) raises Unsupported; documents of that kind go to arborq.operators.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborq.lang import Expr, parse
from arborq.operators import values as V


class Unsupported(TypeError):
    """The expression has no form over these types."""


@dataclass(frozen=True)
class Typed:
    """col is None for a whole table row, whose fields are the table's columns."""

    col: Column | None
    kind: T.DataType
    many: bool = False

    @property
    def value(self) -> Column:
        return self.col if self.col is not None else F.struct(*[F.col(quoted(f.name)) for f in self.kind.fields])


Env = dict[str, Typed]
LONG, DOUBLE, TEXT, BOOL, NULL = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.NullType()
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTION = (T.FloatType, T.DoubleType, T.DecimalType)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def is_whole(t) -> bool:
    return isinstance(t, WHOLE)


def is_number(t) -> bool:
    return isinstance(t, WHOLE + FRACTION)


def is_text(t) -> bool:
    return isinstance(t, T.StringType)


def array(element: T.DataType) -> T.ArrayType:
    return T.ArrayType(element, True)


def literal(v) -> Typed:
    if v is None:
        return Typed(F.lit(None), NULL)
    kind = BOOL if isinstance(v, bool) else LONG if isinstance(v, int) else DOUBLE if isinstance(v, float) else TEXT
    return Typed(F.lit(v).cast(kind), kind)


def common(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds values of both."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if is_number(a) and is_number(b):
        return LONG if is_whole(a) and is_whole(b) else DOUBLE
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return array(common(a.elementType, b.elementType))
    raise Unsupported(f"{a.simpleString()} and {b.simpleString()} have no common type")


def to(t: Typed, kind: T.DataType) -> Column:
    return t.value if t.kind == kind else t.value.cast(kind)


def truthy(t: Typed) -> Column:
    if isinstance(t.kind, T.BooleanType):
        return F.coalesce(t.value, F.lit(False))
    return t.value.isNotNull()


def number_text(t: Typed) -> Column:
    v = t.value
    if isinstance(t.kind, FRACTION):
        d = v.cast("double")
        return F.when(F.isnan(d), "NaN").when(d == float("inf"), "+Inf").when(d == float("-inf"), "-Inf").otherwise(d.cast("string"))
    return v.cast("string")


def text(t: Typed) -> Column:
    """A scalar's text; null is "null"."""
    if isinstance(t.kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.lit(tag(t.kind))
    if isinstance(t.kind, T.VariantType):
        return F.coalesce(F.try_variant_get(t.value, "$", "string"), F.lit("null"))
    return F.coalesce(number_text(t) if is_number(t.kind) else t.value.cast("string"), F.lit("null"))


def tag(kind: T.DataType) -> str:
    for types, name in (((T.BooleanType,), "!!bool"), (WHOLE, "!!int"), (FRACTION, "!!float"), ((T.ArrayType,), "!!seq"), ((T.StructType, T.MapType), "!!map"), ((T.NullType,), "!!null"), ((T.TimestampType, T.TimestampNTZType, T.DateType), "!!timestamp")):
        if isinstance(kind, types):
            return name
    return "!!str"


def glob_regex(pattern: str) -> str:
    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else java_quote(c) for c in pattern) + "$"


def java_quote(s: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", s)


def java_regex(p: str) -> str:
    """The pattern in Java's dialect: names of groups are written differently."""
    return p.replace("(?P<", "(?<")


# arithmetic and comparison on single values


def whole_or_double(a: Typed, b: Typed, f: Callable, g: Callable) -> Typed:
    """Whole numbers by f, null on overflow; where one is a fraction, by g."""
    if is_whole(a.kind) and is_whole(b.kind):
        return Typed(f(to(a, LONG), to(b, LONG)), LONG)
    return Typed(g(to(a, DOUBLE), to(b, DOUBLE)), DOUBLE)


def null_passes(a: Typed, b: Typed, out: Typed) -> Typed:
    """null combined with x is x."""
    if isinstance(a.kind, T.NullType):
        return b
    if isinstance(b.kind, T.NullType):
        return a
    try:
        left, right = to(a, out.kind), to(b, out.kind)
    except Unsupported:
        return out
    if out.kind != common(a.kind, b.kind):
        return out
    return Typed(F.when(a.value.isNull(), right).when(b.value.isNull(), left).otherwise(out.value), out.kind)


def add(a: Typed, b: Typed) -> Typed:
    if isinstance(a.kind, T.NullType) or isinstance(b.kind, T.NullType):
        return null_passes(a, b, a)
    if is_number(a.kind) and is_number(b.kind):
        return null_passes(a, b, whole_or_double(a, b, F.try_add, lambda x, y: x + y))
    if isinstance(a.kind, T.ArrayType):
        kind = a.kind if isinstance(b.kind, T.ArrayType) else array(b.kind)
        kind = common(a.kind, kind)
        right = to(b, kind) if isinstance(b.kind, T.ArrayType) else F.array(to(b, kind.elementType))
        return Typed(F.concat(to(a, kind), right), kind)
    if isinstance(a.kind, (T.StructType, T.MapType)) and isinstance(b.kind, (T.StructType, T.MapType)):
        return merge(a, b)
    if is_text(a.kind) or is_text(b.kind):
        both = F.concat(text(a), text(b))
        return Typed(F.when(a.value.isNull(), text(b)).when(b.value.isNull(), text(a)).otherwise(both), TEXT)
    raise Unsupported(f"{a.kind.simpleString()} + {b.kind.simpleString()}")


def merge(a: Typed, b: Typed) -> Typed:
    """Shallow; the right side's values win, keys keep the left side's order first."""
    if isinstance(a.kind, T.StructType) and isinstance(b.kind, T.StructType):
        names = list(dict.fromkeys([*a.kind.names, *b.kind.names]))
        fields = [(n, get(b if n in b.kind.names else a, n)) for n in names]
        return struct(fields)
    if isinstance(a.kind, T.MapType) and isinstance(b.kind, T.MapType):
        kept = F.map_filter(a.value, lambda k, _: ~F.map_contains_key(b.value, k))
        return Typed(F.map_concat(kept, b.value), a.kind)
    raise Unsupported("a struct and a map cannot be merged")


def subtract(a: Typed, b: Typed) -> Typed:
    if is_number(a.kind) and is_number(b.kind):
        return null_passes(a, b, whole_or_double(a, b, F.try_subtract, lambda x, y: x - y))
    if isinstance(a.kind, T.ArrayType):
        gone = b.value if isinstance(b.kind, T.ArrayType) else F.array(b.value)
        return Typed(F.filter(a.value, lambda x: ~F.exists(gone, lambda y: x.eqNullSafe(y))), a.kind)
    if isinstance(a.kind, T.NullType) or isinstance(b.kind, T.NullType):
        return null_passes(a, b, a)
    raise Unsupported(f"{a.kind.simpleString()} - {b.kind.simpleString()}")


def multiply(a: Typed, b: Typed) -> Typed:
    if is_number(a.kind) and is_number(b.kind):
        return null_passes(a, b, whole_or_double(a, b, F.try_multiply, lambda x, y: x * y))
    if is_text(b.kind) and is_whole(a.kind):
        a, b = b, a
    if is_text(a.kind) and is_whole(b.kind):
        return Typed(F.repeat(a.value, to(b, T.IntegerType())), TEXT)
    if isinstance(a.kind, T.ArrayType) and isinstance(b.kind, T.ArrayType):
        return add(a, b)
    if isinstance(a.kind, (T.StructType, T.MapType)):
        return merge(a, b)
    return null_passes(a, b, a)


def divide(a: Typed, b: Typed) -> Typed:
    """By zero null. Whole numbers give doubles, as a column has one type."""
    if is_text(a.kind) and is_text(b.kind):
        return split(a, b)
    if not (is_number(a.kind) and is_number(b.kind)):
        raise Unsupported(f"{a.kind.simpleString()} / {b.kind.simpleString()}")
    return Typed(F.try_divide(to(a, DOUBLE), to(b, DOUBLE)), DOUBLE)


def modulo(a: Typed, b: Typed) -> Typed:
    if not (is_number(a.kind) and is_number(b.kind)):
        raise Unsupported(f"{a.kind.simpleString()} % {b.kind.simpleString()}")
    return whole_or_double(a, b, *[lambda x, y: F.when(y != 0, F.try_mod(x, y))] * 2)


def split(a: Typed, b: Typed) -> Typed:
    parts = F.split(a.value, F.concat(F.lit("\\Q"), b.value, F.lit("\\E")), -1)
    letters = F.when(a.value == "", F.array().cast("array<string>")).otherwise(F.regexp_extract_all(a.value, F.lit("(?s)."), F.lit(0)))
    return Typed(F.when(a.value == "", F.array().cast("array<string>")).when(b.value == "", letters).otherwise(parts), array(TEXT))


def equal(a: Typed, b: Typed, glob: str | None = None) -> Column:
    if glob is not None and ("*" in glob or "?" in glob) and is_text(a.kind):
        return F.coalesce(a.value.rlike(glob_regex(glob)), F.lit(False))
    if isinstance(a.kind, T.NullType) or isinstance(b.kind, T.NullType):
        return (b if isinstance(a.kind, T.NullType) else a).value.isNull()
    if isinstance(a.kind, T.VariantType):
        a = as_kind(a, b.kind)
    if isinstance(a.kind, T.MapType) and isinstance(b.kind, T.MapType):
        return F.array_sort(F.map_entries(a.value)).eqNullSafe(F.array_sort(F.map_entries(b.value)))
    try:
        kind = common(a.kind, b.kind)
    except Unsupported:
        if isinstance(a.kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) and is_text(b.kind):
            return a.value.eqNullSafe(b.value.cast(a.kind))
        return F.lit(False)
    return to(a, kind).eqNullSafe(to(b, kind))


def as_kind(a: Typed, kind: T.DataType) -> Typed:
    """A value of schemaless JSON as the type that it is compared with; null if it is not of that type."""
    return Typed(F.try_variant_get(a.value, "$", kind.simpleString()), kind)


def related(op: str, a: Typed, b: Typed) -> Column:
    if isinstance(a.kind, T.VariantType) and not isinstance(b.kind, T.VariantType):
        a = as_kind(a, b.kind)
    if not (is_number(a.kind) and is_number(b.kind) or a.kind == b.kind or isinstance(a.kind, T.NullType) or isinstance(b.kind, T.NullType)):
        if isinstance(a.kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) and is_text(b.kind):
            b = Typed(b.value.cast(a.kind), a.kind)
        else:
            raise Unsupported(f"{a.kind.simpleString()} and {b.kind.simpleString()} have no order")
    x, y = a.value, b.value
    out = {"<": lambda: x < y, "<=": lambda: x <= y, ">": lambda: x > y, ">=": lambda: x >= y}[op]()
    return F.coalesce(out, x.isNull() & y.isNull() if op in ("<=", ">=") else F.lit(False))


# containers


def get(t: Typed, name: str) -> Typed:
    """A field; one that a struct does not have is null."""
    if isinstance(t.kind, T.StructType):
        if name not in t.kind.names:
            return literal(None)
        kind = t.kind[name].dataType
        return Typed(F.col(quoted(name)) if t.col is None else t.value.getField(name), kind)
    if isinstance(t.kind, T.MapType):
        return Typed(F.try_element_at(t.value, F.lit(name)), t.kind.valueType)
    if isinstance(t.kind, T.ArrayType) and re.fullmatch(r"\d+", name):
        return Typed(F.get(t.value, F.lit(int(name))), t.kind.elementType)
    if isinstance(t.kind, T.VariantType):
        return Typed(F.try_variant_get(t.value, variant_path(name), "variant"), t.kind)
    if isinstance(t.kind, T.NullType):
        return t
    raise Unsupported(f"{t.kind.simpleString()} has no field {name!r}")


def variant_path(key: str | int) -> str:
    return f"$[{key}]" if isinstance(key, int) else "$['" + key.replace("'", "\\'") + "']"


def struct(fields: list[tuple[str, Typed]]) -> Typed:
    kind = T.StructType([T.StructField(n, T.StringType() if isinstance(f.kind, T.NullType) else f.kind, True) for n, f in fields])
    if not fields:
        raise Unsupported("a struct without fields")
    return Typed(F.struct(*[to(f, x.dataType).alias(n) for (n, f), x in zip(fields, kind.fields, strict=True)]), kind)


def element(t: Typed, at: Column, known: int | None) -> Typed:
    if known is not None and known < 0:
        return Typed(F.try_element_at(t.value, F.lit(known)), t.kind.elementType)
    if known is None:
        at = F.when(at < 0, at + F.size(t.value)).otherwise(at)
    return Typed(F.get(t.value, at.cast("int")), t.kind.elementType)


def slice_of(t: Typed, low: Column, high: Column | None) -> Typed:
    n = F.size(t.value)
    place = lambda c: F.least(F.greatest(F.when(c < 0, c + n).otherwise(c), F.lit(0)), n).cast("int")
    a = place(low)
    b = place(high) if high is not None else n
    return Typed(F.slice(t.value, a + 1, F.greatest(b - a, F.lit(0))), t.kind)


def sort_key(t: Typed) -> Column:
    """Null first; false before true; numbers; texts by bytes."""
    return t.value


def sorted_by(t: Typed, keys: Callable[[Column], list[Column]] | None) -> Typed:
    """A stable sort of an array: elements go with their keys and places. Nulls come first, as in sort_array."""
    if keys is None:
        return Typed(F.sort_array(t.value), t.kind)
    placed = F.transform(t.value, lambda x, i: F.struct(*[k.alias(f"k{n}") for n, k in enumerate(keys(x))], i.alias("at"), x.alias("x")))
    return Typed(F.transform(F.sort_array(placed), lambda s: s.getField("x")), t.kind)


def first_places(t: Typed, key: Callable[[Column], Column]) -> Column:
    """The elements that are the first with their key, in order."""
    keys = F.transform(t.value, key)
    return F.filter(t.value, lambda x, i: F.array_position(F.transform(keys, lambda k: k.cast("string")), key(x).cast("string")) == i + 1)


def contains(a: Typed, b: Typed) -> Column:
    if is_text(a.kind) and is_text(b.kind):
        return F.coalesce(F.contains(a.value, b.value), F.lit(False))
    if isinstance(a.kind, T.ArrayType):
        want = b if isinstance(b.kind, T.ArrayType) else Typed(F.array(b.value), array(b.kind))
        return F.forall(want.value, lambda y: F.exists(a.value, lambda x: contains(Typed(x, a.kind.elementType), Typed(y, want.kind.elementType))))
    if isinstance(b.kind, T.StructType):
        out = F.lit(True)
        for f in b.kind.fields:
            out = out & contains(get(a, f.name), get(b, f.name))
        return out
    return equal(a, b)


def compacted(t: Typed) -> Typed:
    """Without zero values. A struct's fields are its type's, so there zero values become null."""
    if isinstance(t.kind, T.ArrayType):
        inner = Typed(F.transform(t.value, lambda x: compacted(Typed(x, t.kind.elementType)).value), t.kind)
        return Typed(F.filter(inner.value, lambda x: ~zero(Typed(x, t.kind.elementType))), t.kind)
    if isinstance(t.kind, T.MapType):
        return Typed(F.map_filter(t.value, lambda k, v: ~zero(Typed(v, t.kind.valueType))), t.kind)
    if isinstance(t.kind, T.StructType):
        return struct([(f.name, Typed(F.when(~zero(x), x.value), f.dataType)) for f in t.kind.fields for x in [compacted(get(t, f.name))]])
    return t


def zero(t: Typed) -> Column:
    v, k = t.value, t.kind
    if isinstance(k, T.BooleanType):
        return F.coalesce(~v, F.lit(True))
    if is_number(k):
        return F.coalesce(v == 0, F.lit(True))
    if is_text(k):
        return F.coalesce(v == "", F.lit(True))
    if isinstance(k, (T.ArrayType, T.MapType)):
        return F.coalesce(F.size(v) == 0, F.lit(True))
    return v.isNull()


def update_at(t: Typed, path: list, f: Callable[[Typed], Typed]) -> Typed:
    """t with f applied at a path of field names, indexes, "[]" for every element, or ("select", predicate)."""
    if not path:
        return f(t)
    step, rest = path[0], path[1:]
    if isinstance(step, tuple):
        new = update_at(t, rest, f)
        return Typed(F.when(step[1](t), to(new, new.kind)).otherwise(to(t, new.kind)), new.kind)
    if step == "[]" and isinstance(t.kind, T.ArrayType):
        sample = update_at(Typed(F.lit(None).cast(t.kind.elementType), t.kind.elementType), rest, f)
        return Typed(F.transform(t.value, lambda x: update_at(Typed(x, t.kind.elementType), rest, f).value), array(sample.kind))
    if step == "[]" and isinstance(t.kind, T.MapType):
        sample = update_at(Typed(F.lit(None).cast(t.kind.valueType), t.kind.valueType), rest, f)
        return Typed(F.transform_values(t.value, lambda k, v: update_at(Typed(v, t.kind.valueType), rest, f).value), T.MapType(t.kind.keyType, sample.kind))
    if isinstance(step, int) and isinstance(t.kind, T.ArrayType):
        return Typed(F.transform(t.value, lambda x, i: F.when(i == step, to(update_at(Typed(x, t.kind.elementType), rest, f), t.kind.elementType)).otherwise(x)), t.kind)
    if isinstance(t.kind, T.StructType) and isinstance(step, str):
        new = update_at(get(t, step), rest, f)
        names = t.kind.names if step in t.kind.names else [*t.kind.names, step]
        return struct([(n, new if n == step else get(t, n)) for n in names])
    if isinstance(t.kind, T.MapType) and isinstance(step, str):
        new = update_at(get(t, step), rest, f)
        kept = F.map_filter(t.value, lambda k, _: k != step)
        return Typed(F.map_concat(kept, F.create_map(F.lit(step), to(new, t.kind.valueType))), t.kind)
    if isinstance(t.kind, T.NullType) and isinstance(step, str):
        return struct([(step, update_at(t, rest, f))])
    raise Unsupported(f"no update of {step!r} in {t.kind.simpleString()}")


class Compiler:
    """One method a family; variables are bound in env."""

    def __init__(self, env: Env | None = None):
        self.env = env or {}

    def run(self, e: Expr, t: Typed) -> Typed:
        f = getattr(self, METHODS.get(e.op, ""), None)
        if f is None:
            raise Unsupported(f"{e.op} over typed columns")
        return f(e, t)

    def single(self, e: Expr, t: Typed) -> Typed:
        r = self.run(e, t)
        if r.many:
            raise Unsupported(f"{e.op} gives several results where one is needed")
        return r

    def bound(self, name: str, t: Typed) -> "Compiler":
        return Compiler({**self.env, name: t})

    # streams
    def each(self, t: Typed, f: Callable[[Typed], Typed]) -> Typed:
        """f over a single value, or over each match of a stream; streams that f makes are flattened."""
        if not t.many:
            return f(t)
        sample = f(Typed(F.lit(None).cast(t.kind), t.kind))
        out = F.transform(t.value, lambda x: f(Typed(x, t.kind)).value)
        return Typed(F.flatten(out) if sample.many else out, sample.kind, True)

    def stream(self, t: Typed) -> Typed:
        return t if t.many else Typed(F.array(t.value), t.kind, True)

    # composition
    def self_(self, e, t):
        return t

    def pipe(self, e, t):
        left = self.run(e.args[0], t)
        if e.args[1].op == "select":
            return self.select(e.args[1], left)
        return self.each(left, lambda x: self.run(e.args[1], x))

    def union(self, e, t):
        a, b = (self.stream(self.run(x, t)) for x in e.args)
        kind = common(a.kind, b.kind)
        return Typed(F.concat(a.value.cast(array(kind)), b.value.cast(array(kind))), kind, True)

    def block(self, e, t):
        return self.run(e.args[1], t)

    def lit(self, e, t):
        return literal(e.value)

    def empty(self, e, t):
        return Typed(F.array().cast("array<string>"), NULL, True)

    def var(self, e, t):
        if e.value not in self.env:
            raise Unsupported(f"unknown variable ${e.value}")
        return self.env[e.value]

    def as_(self, e, t):
        return self.each(self.run(e.args[0], t), lambda x: self.bound(e.value, x).run(e.args[1], t))

    # traversal
    def field(self, e, t):
        def pick(x: Typed) -> Typed:
            if "*" in e.value or "?" in e.value:
                if isinstance(x.kind, T.StructType):
                    names = [n for n in x.kind.names if V.globbed(e.value, n)]
                    return self.fields_stream(x, names)
                if isinstance(x.kind, T.MapType):
                    return Typed(F.map_values(F.map_filter(x.value, lambda k, _: k.rlike(glob_regex(e.value)))), x.kind.valueType, True)
            return get(x, e.value)

        return self.each(self.run(e.args[0], t), pick)

    def fields_stream(self, x: Typed, names: list[str]) -> Typed:
        if not names:
            return Typed(F.array().cast("array<string>"), TEXT, True)
        parts = [get(x, n) for n in names]
        kind = parts[0].kind
        for p in parts[1:]:
            kind = common(kind, p.kind)
        return Typed(F.array(*[to(p, kind) for p in parts]), kind, True)

    def optional(self, e, t):
        """Columns have one type: a field or element that the type has none of gives no results."""
        try:
            return self.run(e.args[0], t)
        except Unsupported:
            return Typed(F.array().cast("array<string>"), TEXT, True)

    def splat(self, e, t):
        def out(x: Typed) -> Typed:
            if isinstance(x.kind, T.ArrayType):
                return Typed(F.coalesce(x.value, F.array().cast(x.kind)), x.kind.elementType, True)
            if isinstance(x.kind, T.MapType):
                return Typed(F.map_values(x.value), x.kind.valueType, True)
            if isinstance(x.kind, T.StructType):
                return self.fields_stream(x, x.kind.names)
            raise Unsupported(f"no elements in {x.kind.simpleString()}")

        return self.each(self.run(e.args[0], t), out)

    def index(self, e, t):
        key = e.args[1]

        def pick(x: Typed) -> Typed:
            if key.op == ",":
                return self.union(Expr(",", [Expr("index", [Expr("self"), k]) for k in key.args]), x)
            k = self.single(key, t)
            if isinstance(x.kind, T.ArrayType) and is_whole(k.kind):
                return element(x, k.value, key.value if key.op == "lit" else None)
            if isinstance(x.kind, T.MapType):
                return Typed(F.try_element_at(x.value, text(k)), x.kind.valueType)
            if isinstance(x.kind, T.VariantType) and key.op == "lit" and isinstance(key.value, int):
                return Typed(F.try_variant_get(x.value, variant_path(key.value), "variant"), x.kind)
            if key.op == "lit":
                return get(x, V.text(key.value))
            raise Unsupported("a computed key needs a map")

        return self.each(self.run(e.args[0], t), pick)

    def slice(self, e, t):
        ends = [self.single(a, t).value for a in e.args[1:]]
        return self.each(self.run(e.args[0], t), lambda x: slice_of(x, ends[0], ends[1] if len(ends) > 1 else None))

    def keys(self, e, t):
        if isinstance(t.kind, T.StructType):
            return Typed(F.array(*map(F.lit, t.kind.names)), array(TEXT))
        if isinstance(t.kind, T.MapType):
            return Typed(F.map_keys(t.value), array(t.kind.keyType))
        places = F.when(F.size(t.value) > 0, F.sequence(F.lit(0).cast("long"), F.size(t.value).cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))
        return Typed(places, array(LONG))

    def delete(self, e, t):
        if e.args[0].op == ",":
            for part in reversed(spread(e.args[0])):
                t = self.delete(Expr("del", [part]), t)
            return t
        path = self.path_of(e.args[0])
        if len(path) == 1 and isinstance(path[0], str) and isinstance(t.kind, T.StructType):
            return struct([(n, get(t, n)) for n in t.kind.names if n != path[0]])
        head, last = path[:-1], path[-1]

        def gone(x: Typed) -> Typed:
            if isinstance(x.kind, T.StructType):
                return struct([(n, get(x, n)) for n in x.kind.names if n != last])
            if isinstance(x.kind, T.MapType):
                return Typed(F.map_filter(x.value, lambda k, _: k != last), x.kind)
            if isinstance(last, int):
                at = F.lit(last) if last >= 0 else F.size(x.value) + last
                return Typed(F.filter(x.value, lambda _, i: i != at), x.kind)
            raise Unsupported("no such deletion")

        return update_at(t, head, gone)

    # predicates
    def select(self, e, t):
        def test(x: Typed) -> Column:
            return self.any_true(self.run(e.args[0], x))

        if t.many:
            return Typed(F.filter(t.value, lambda x: test(Typed(x, t.kind))), t.kind, True)
        return Typed(F.when(test(t), F.array(t.value)).otherwise(F.array().cast(array(t.kind))), t.kind, True)

    def any_true(self, r: Typed) -> Column:
        return F.exists(r.value, lambda x: truthy(Typed(x, r.kind))) if r.many else truthy(r)

    def condition(self, e: Expr, t: Typed) -> Column:
        """A predicate for keeping rows: null counts as false there, so comparisons need no coalesce and reach the scan."""
        if e.op in ("and", "or"):
            a, b = (self.condition(x, t) for x in e.args)
            return a & b if e.op == "and" else a | b
        if e.op in ("==", "<", "<=", ">", ">=") and e.args[1].op == "lit" and e.args[1].value is not None:
            a, b = self.run(e.args[0], t), literal(e.args[1].value)
            glob = is_text(b.kind) and ("*" in e.args[1].value or "?" in e.args[1].value)
            if not a.many and not glob and (is_number(a.kind) and is_number(b.kind) or a.kind == b.kind):
                x, y = a.value, b.value
                return {"==": lambda: x == y, "<": lambda: x < y, "<=": lambda: x <= y, ">": lambda: x > y, ">=": lambda: x >= y}[e.op]()
        return self.any_true(self.run(e, t))

    def filter(self, e, t):
        return Typed(self.select(e, self.splat(Expr("splat", [Expr("self")]), t)).value, array(t.kind.elementType))

    def binary(self, e, t):
        a, b = self.run(e.args[0], t), self.run(e.args[1], t)
        glob = e.args[1].value if e.args[1].op == "lit" and isinstance(e.args[1].value, str) else None

        def both(x: Typed, y: Typed) -> Typed:
            if e.op in ARITHMETIC:
                return ARITHMETIC[e.op](x, y)
            if e.op in ("==", "!="):
                same = equal(x, y, glob)
                return Typed(same if e.op == "==" else ~same, BOOL)
            return Typed(related(e.op, x, y), BOOL)

        return self.each(b, lambda y: self.each(a, lambda x: both(x, y)))

    def logic(self, e, t):
        a, b = (truthy(self.single(x, t)) for x in e.args)
        return Typed(a & b if e.op == "and" else a | b, BOOL)

    def not_(self, e, t):
        return self.each(self.run(e.args[0], t) if e.args else t, lambda x: Typed(~truthy(x), BOOL))

    def quantifier(self, e, t):
        s = self.splat(Expr("splat", [Expr("self")]), t)
        test = lambda x: self.any_true(self.run(e.args[0], Typed(x, s.kind))) if e.args else truthy(Typed(x, s.kind))
        return Typed((F.exists if e.op == "any" else F.forall)(s.value, test), BOOL)

    def alternative(self, e, t):
        a, b = self.single(e.args[0], t), self.single(e.args[1], t)
        kind = common(a.kind, b.kind)
        return Typed(F.when(truthy(a), to(a, kind)).otherwise(to(b, kind)), kind)

    def has(self, e, t):
        k = self.single(e.args[0], t)
        if isinstance(t.kind, T.StructType):
            return Typed(F.lit(e.args[0].value in t.kind.names), BOOL)
        if isinstance(t.kind, T.MapType):
            return Typed(F.coalesce(F.map_contains_key(t.value, text(k)), F.lit(False)), BOOL)
        return Typed(F.coalesce((k.value >= 0) & (F.size(t.value) > k.value), F.lit(False)), BOOL)

    def contains(self, e, t):
        return Typed(F.coalesce(contains(t, self.single(e.args[0], t)), F.lit(False)), BOOL)

    # updates
    def path_of(self, e: Expr) -> list:
        """The static path that an expression names, for updates."""
        if e.op == "self":
            return []
        if e.op == "field":
            return [*self.path_of(e.args[0]), e.value]
        if e.op == "index" and e.args[1].op == "lit":
            return [*self.path_of(e.args[0]), e.args[1].value]
        if e.op == "splat":
            return [*self.path_of(e.args[0]), "[]"]
        if e.op == "|":
            return [*self.path_of(e.args[0]), *self.path_of(e.args[1])]
        if e.op == "select":
            return [("select", lambda t: self.any_true(self.run(e.args[0], t)))]
        raise Unsupported(f"{e.op} names no path")

    def assign(self, e, t):
        new = self.single(e.args[1], t)
        return update_at(t, self.path_of(e.args[0]), lambda _: new)

    def update(self, e, t):
        return update_at(t, self.path_of(e.args[0]), lambda x: self.single(e.args[1], x))

    def compound(self, e, t):
        new = self.single(e.args[1], t)
        return update_at(t, self.path_of(e.args[0]), lambda x: ARITHMETIC[e.op[0]](x, new))

    def setpath(self, e, t):
        return update_at(t, static_list(e.args[0]), lambda _: self.single(e.args[1], t))

    def delpaths(self, e, t):
        for p in e.args[0].args[0].args if e.args[0].args[0].op == "," else [e.args[0].args[0]]:
            steps = static_list(p)
            tree = Expr("self")
            for s in steps:
                tree = Expr("field", [tree], s) if isinstance(s, str) else Expr("index", [tree, Expr("lit", value=s)])
            t = self.delete(Expr("del", [tree]), t)
        return t

    # construction
    def collect(self, e, t):
        s = self.stream(self.run(e.args[0], t))
        return Typed(s.value, array(s.kind))

    def object(self, e, t):
        fields, many = [], None
        for k, v in zip(e.args[::2], e.args[1::2], strict=True):
            if k.op != "lit":
                raise Unsupported("computed keys need create_map")
            r = self.run(v, t)
            if r.many and many is not None:
                raise Unsupported("two fields with several results")
            many = len(fields) if r.many else many
            fields.append((V.text(k.value), r))
        if many is None:
            return struct(fields)
        name, r = fields[many]
        return self.each(r, lambda x: struct([*fields[:many], (name, x), *fields[many + 1 :]]))

    def map(self, e, t):
        s = self.splat(Expr("splat", [Expr("self")]), t)
        if e.args[0].op == "select":
            return Typed(self.select(e.args[0], s).value, array(s.kind))
        out = self.each(s, lambda x: self.run(e.args[0], x))
        return Typed(out.value, array(out.kind))

    def map_values(self, e, t):
        if isinstance(t.kind, T.MapType):
            new = lambda v: self.single(e.args[0], Typed(v, t.kind.valueType))
            return Typed(F.transform_values(t.value, lambda k, v: new(v).value), T.MapType(t.kind.keyType, new(F.lit(None).cast(t.kind.valueType)).kind))
        if isinstance(t.kind, T.StructType):
            return struct([(n, self.single(e.args[0], get(t, n))) for n in t.kind.names])
        return self.map(e, t)

    def pick(self, e, t):
        names = static_list(e.args[0])
        if isinstance(t.kind, T.StructType):
            return struct([(n, get(t, n)) for n in names if n in t.kind.names])
        if isinstance(t.kind, T.MapType):
            kept = [F.struct(F.lit(n).alias("key"), F.try_element_at(t.value, F.lit(n)).alias("value")) for n in names]
            return Typed(F.map_from_entries(F.filter(F.array(*kept), lambda x: F.map_contains_key(t.value, x.getField("key")))), t.kind)
        return Typed(F.array(*[element(t, F.lit(n), n).value for n in names]), t.kind)

    def omit(self, e, t):
        names = static_list(e.args[0])
        if isinstance(t.kind, T.StructType):
            return struct([(n, get(t, n)) for n in t.kind.names if n not in names])
        if isinstance(t.kind, T.MapType):
            return Typed(F.map_filter(t.value, lambda k, _: ~k.isin(names)), t.kind)
        return Typed(F.filter(t.value, lambda _, i: ~i.isin(names) & ~(i - F.size(t.value)).isin(names)), t.kind)

    def compact(self, e, t):
        return compacted(t)

    def flatten(self, e, t):
        depth = e.args[0].value if e.args else -1
        while depth and isinstance(t.kind, T.ArrayType) and isinstance(t.kind.elementType, T.ArrayType):
            t, depth = Typed(F.flatten(t.value), t.kind.elementType), depth - 1
        return t

    def reverse(self, e, t):
        return Typed(F.reverse(t.value), t.kind)

    def unique(self, e, t):
        return Typed(F.array_distinct(t.value), t.kind)

    def unique_by(self, e, t):
        key = lambda x: F.to_json(F.struct(self.single(e.args[0], Typed(x, t.kind.elementType)).value.alias("k")))
        return Typed(first_places(t, key), t.kind)

    def group_by(self, e, t):
        key = lambda x: F.to_json(F.struct(self.single(e.args[0], Typed(x, t.kind.elementType)).value.alias("k")))
        kinds = F.array_distinct(F.transform(t.value, key))
        return Typed(F.transform(kinds, lambda k: F.filter(t.value, lambda x: key(x) == k)), array(t.kind))

    def to_entries(self, e, t):
        if isinstance(t.kind, T.MapType):
            return Typed(F.map_entries(t.value), array(T.StructType([T.StructField("key", t.kind.keyType), T.StructField("value", t.kind.valueType)])))
        if isinstance(t.kind, T.StructType):
            s = self.fields_stream(t, t.kind.names)
            pairs = [F.struct(F.lit(n).alias("key"), to(get(t, n), s.kind).alias("value")) for n in t.kind.names]
            return Typed(F.array(*pairs), array(T.StructType([T.StructField("key", TEXT), T.StructField("value", s.kind)])))
        pairs = F.transform(t.value, lambda x, i: F.struct(i.cast("long").alias("key"), x.alias("value")))
        return Typed(pairs, array(T.StructType([T.StructField("key", LONG), T.StructField("value", t.kind.elementType)])))

    def from_entries(self, e, t):
        s = t.kind.elementType
        entries = F.transform(t.value, lambda x: F.struct(x.getField("key").cast("string").alias("key"), x.getField("value").alias("value")))
        return Typed(F.map_from_entries(entries), T.MapType(TEXT, s["value"].dataType))

    def with_entries(self, e, t):
        return self.from_entries(e, self.map(e, self.to_entries(e, t)))

    def array_to_map(self, e, t):
        kept = F.filter(F.transform(t.value, lambda x, i: F.struct(i.cast("string").alias("key"), x.alias("value"))), lambda p: p.getField("value").isNotNull())
        return Typed(F.map_from_entries(kept), T.MapType(TEXT, t.kind.elementType))

    def first(self, e, t):
        """Null where an array has none, as a column has a value in every row."""
        s = self.splat(Expr("splat", [Expr("self")]), t)
        if e.args:
            s = self.select(e, s)
        return Typed(F.get(s.value, F.lit(0)), s.kind)

    def length(self, e, t):
        if isinstance(t.kind, T.StructType):
            return literal(len(t.kind.names))
        if isinstance(t.kind, (T.ArrayType, T.MapType)):
            return Typed(F.coalesce(F.size(t.value), F.lit(0)).cast("long"), LONG)
        return Typed(F.when(t.value.isNull(), 0).otherwise(F.length(text(t))).cast("long"), LONG)

    # folds and order
    def extreme(self, e, t):
        """Null comes before all else, as in sorts."""
        if e.op == "max":
            return Typed(F.array_max(t.value), t.kind.elementType)
        return Typed(F.when(~F.exists(t.value, lambda x: x.isNull()), F.array_min(t.value)), t.kind.elementType)

    def reduce(self, e, t):
        s = self.stream(self.run(e.args[0], t))
        init = self.single(e.args[1], t)
        step = lambda acc, x, kind: self.bound(e.value, Typed(x, s.kind)).single(e.args[2], Typed(acc, kind))
        kind = step(init.value, F.lit(None).cast(s.kind), init.kind).kind
        return Typed(F.aggregate(s.value, init.value.cast(kind), lambda acc, x: step(acc, x, kind).value.cast(kind)), kind)

    def sort(self, e, t):
        return sorted_by(t, None)

    def sort_by(self, e, t):
        keys = spread(e.args[0])
        return sorted_by(t, lambda x: [self.single(k, Typed(x, t.kind.elementType)).value for k in keys])

    def sort_keys(self, e, t):
        def by_key(x: Typed) -> Typed:
            if isinstance(x.kind, T.StructType):
                return struct([(n, get(x, n)) for n in sorted(x.kind.names, key=str.encode)])
            return Typed(F.map_from_entries(F.sort_array(F.map_entries(x.value))), x.kind) if isinstance(x.kind, T.MapType) else x

        return update_at(t, self.path_of(e.args[0]), by_key)

    def shuffle(self, e, t):
        return Typed(F.shuffle(t.value), t.kind)

    # texts
    def join(self, e, t):
        sep = self.single(e.args[0], t).value
        parts = F.transform(t.value, lambda x: F.when(x.isNull(), "").otherwise(text(Typed(x, t.kind.elementType))))
        return Typed(F.array_join(parts, e.args[0].value) if e.args[0].op == "lit" else F.call_function("array_join", parts, sep), TEXT)

    def split(self, e, t):
        return split(t, self.single(e.args[0], t))

    def case(self, e, t):
        return Typed((F.upper if e.op == "upcase" else F.lower)(t.value), TEXT)

    def trim(self, e, t):
        return Typed(F.btrim(t.value, F.lit(" \t\r\n")), TEXT)

    def to_string(self, e, t):
        return Typed(text(t), TEXT)

    def to_number(self, e, t):
        if is_number(t.kind):
            return t
        if isinstance(t.kind, T.VariantType):
            return as_kind(t, DOUBLE)
        text_ = F.btrim(t.value, F.lit(" \t\r\n"))
        wrong = F.raise_error(F.concat(F.lit("not a number: "), t.value)).cast("double")
        return Typed(F.when(t.value.isNull(), None).otherwise(F.coalesce(text_.try_cast("double"), wrong)), DOUBLE)

    def test(self, e, t):
        return Typed(F.coalesce(t.value.rlike(java_regex(e.args[0].value)), F.lit(False)), BOOL)

    def sub(self, e, t):
        repl = e.args[1].value.replace("\\", "\\\\")
        repl = re.sub(r"\$(.?)", lambda m: "$0" if m[1] == "0" else "\\$" if m[1] == "$" else "\\$" + m[1], repl)
        return Typed(F.regexp_replace(t.value, java_regex(e.args[0].value), repl), TEXT)

    def flags(self, e) -> bool:
        """Whether a match is global; the only flag is g, as in documents."""
        if len(e.args) < 2:
            return False
        flags = e.args[1].value if e.args[1].op == "lit" else "?"
        if flags not in (None, "", "g"):
            raise Unsupported(f"unknown flags {flags!r}; write (?i) in the pattern")
        return flags == "g"

    def groups(self, e, t: Typed, names: Callable) -> Typed:
        """A value by `names(groups, offsets)` for each match. The k-th match's groups are the k-th of regexp_extract_all()
        by group; its place is the length of what regexp_replace() with a mark leaves before it."""
        if not is_text(t.kind) or e.args[0].op != "lit":
            raise Unsupported(f"{e.op} needs a text and a literal pattern")
        pattern, p = re.compile(e.args[0].value), java_regex(e.args[0].value)
        whole = F.coalesce(F.regexp_extract_all(t.value, F.lit(f"({p})"), F.lit(1)), F.array().cast("array<string>"))
        whole = whole if self.flags(e) else F.slice(whole, 1, 1)
        text_ = F.coalesce(t.value, F.lit(""))
        parts = [whole, *[F.regexp_extract_all(t.value, F.lit(f"({p})"), F.lit(k + 1)) for k in range(1, pattern.groups + 1)]]
        mark = "\ue000"  # of as many bytes as what stands for it in a text that has it
        pieces = F.split(F.regexp_replace(F.replace(text_, F.lit(mark), F.lit("\ue001")), p, f"{mark}$0{mark}"), mark, -1)
        starts = F.transform(whole, lambda _, k: F.aggregate(F.slice(pieces, 1, k * 2 + 1), F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x)))
        rows = F.transform(whole, lambda x, k: F.struct(x.alias("w"), F.get(starts, k).alias("at"), k.alias("k")))
        out = names(parts)
        sample = out(F.struct(F.lit("").alias("w"), F.lit(0).cast("long").alias("at"), F.lit(0).alias("k")))
        return Typed(F.transform(rows, lambda r: out(r).value), sample.kind, True)

    def capture(self, e, t):
        pattern = re.compile(e.args[0].value)
        names = [(str(k), k) for k in range(pattern.groups + 1)] + list(pattern.groupindex.items())

        def made(parts: list[Column]):
            return lambda r: Typed(F.create_map(*[x for n, k in names for x in (F.lit(n), F.get(parts[k], r.getField("k")))]), T.MapType(TEXT, TEXT))

        return self.groups(e, t, made)

    def match(self, e, t):
        """The matched text with its place in bytes, and the groups with their names. A group's text alone does not tell
        where it lies, so its offset is that of its first place within the match, and -1 for one that is empty (documents
        tell such cases apart)."""
        pattern = re.compile(e.args[0].value)
        labels = {k: n for n, k in pattern.groupindex.items()}
        group = T.StructType([T.StructField("string", TEXT), T.StructField("offset", LONG), T.StructField("length", LONG), T.StructField("name", TEXT)])

        def made(parts: list[Column]):
            def one(r: Column) -> Typed:
                def place(k: int) -> Column:
                    g = F.get(parts[k], r.getField("k"))
                    near = F.octet_length(F.call_function("substring_index", r.getField("w"), g, F.lit(1))).cast("long")
                    at = F.when(F.coalesce(g, F.lit("")) == "", F.lit(-1).cast("long")).otherwise(r.getField("at") + near)
                    return F.struct(F.when(F.coalesce(g, F.lit("")) != "", g).alias("string"), at.alias("offset"), F.octet_length(F.coalesce(g, F.lit(""))).cast("long").alias("length"), F.lit(labels.get(k)).cast("string").alias("name"))

                captures = F.array(*[place(k) for k in range(1, pattern.groups + 1)]) if pattern.groups else F.array().cast(T.ArrayType(group))
                return struct([("string", Typed(r.getField("w"), TEXT)), ("offset", Typed(r.getField("at"), LONG)), ("length", Typed(F.octet_length(r.getField("w")).cast("long"), LONG)), ("captures", Typed(captures, array(group)))])

            return one

        return self.groups(e, t, made)

    def concat(self, e, t):
        parts = [Typed(F.lit(a.value), TEXT) if a.op == "lit" else self.single(a, t) for a in e.args]
        return Typed(F.concat(*[text(p) for p in parts]), TEXT)

    # metadata and codecs
    def tag(self, e, t):
        return Typed(F.when(t.value.isNull(), "!!null").otherwise(tag(t.kind)), TEXT)

    def kind_(self, e, t):
        return literal("seq" if isinstance(t.kind, T.ArrayType) else "map" if isinstance(t.kind, (T.StructType, T.MapType)) else "scalar")

    def to_json(self, e, t):
        if isinstance(t.kind, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
            return Typed(F.to_json(t.value, {"ignoreNullFields": "false"}), TEXT)
        if is_text(t.kind):
            wrapped = F.to_json(F.array(t.value))
            return Typed(wrapped.substr(F.lit(2), F.length(wrapped) - 2), TEXT)
        return Typed(text(t), TEXT)

    def to_csv(self, e, t):
        parts = t if isinstance(t.kind, T.ArrayType) else Typed(F.array(*[text(get(t, n)) for n in t.kind.names]), array(TEXT))

        def cell(x: Column) -> Column:
            s = F.when(x.isNull(), "").otherwise(text(Typed(x, parts.kind.elementType)))
            return F.when(s.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)

        return Typed(F.array_join(F.transform(parts.value, cell), ","), TEXT)

    def from_json(self, e, t):
        return Typed(F.try_parse_json(t.value), T.VariantType())

    def base64(self, e, t):
        return Typed(F.base64(text(t).cast("binary")) if e.op == "@base64" else F.unbase64(t.value).cast("string"), TEXT)

    def uri(self, e, t):
        return Typed(F.replace(F.replace(F.url_encode(text(t)), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), TEXT)


def spread(e: Expr) -> list[Expr]:
    """The sides of a union, in order."""
    return [x for a in e.args for x in spread(a)] if e.op == "," else [e]


def static_list(e: Expr) -> list:
    """The literals of `["a", 0]` or of `"a", 0`."""
    e = e.args[0] if e.op == "collect" else e
    parts = spread(e)
    if not all(p.op == "lit" for p in parts):
        raise Unsupported("names must be literals")
    return [p.value for p in parts]


ARITHMETIC = {"+": add, "-": subtract, "*": multiply, "/": divide, "%": modulo}
METHODS = {
    **{x: x for x in "lit empty block var field optional splat index slice keys select filter has contains collect object map map_values pick omit compact flatten reverse unique unique_by group_by to_entries from_entries with_entries array_to_map first length reduce sort sort_by sort_keys shuffle join split trim to_string to_number test sub capture match concat tag to_json to_csv from_json setpath delpaths".split()},
    **dict.fromkeys(["+", "-", "*", "/", "%", "==", "!=", "<", "<=", ">", ">="], "binary"),
    **dict.fromkeys(["and", "or"], "logic"),
    **dict.fromkeys(["any", "all"], "quantifier"),
    **dict.fromkeys(["min", "max"], "extreme"),
    **dict.fromkeys(["upcase", "downcase"], "case"),
    **dict.fromkeys(["+=", "-=", "*="], "compound"),
    **dict.fromkeys(["@base64", "@base64d"], "base64"),
    **{"self": "self_", "|": "pipe", ",": "union", "not": "not_", "//": "alternative", "=": "assign", "=c": "assign", "|=": "update", "with": "update", "as": "as_", "del": "delete", "kind": "kind_", "@uri": "uri"},
}


def column(expression: str | Expr, schema: T.StructType) -> Column:
    """The expression over a table's row as a Column; a stream of matches comes as an array."""
    e = parse(expression) if isinstance(expression, str) else expression
    return Compiler().run(e, Typed(None, schema)).value


__all__ = ["Compiler", "Typed", "Unsupported", "column"]
