"""Relational compilation: a table is the sequence of its rows, and an expression over it becomes a DataFrame.

The expression's pipeline is read stage by stage. `.[]` and `map()` go over rows (filter, select, withColumn); stages on
the sequence itself become sorts, windows, aggregates and limits. Order is carried by columns of a unique key, so that
"first" and slices mean the same however the data are split; a stage that does not need the order never sorts.

Rules: `sort_by | .[0:k]` is orderBy().limit(); `group_by(k) | map(f)` is groupBy().agg() wherever f is made of
aggregates; `length`, `min`, `max`, `any`, `all` and sums by `reduce` are aggregates without collecting anything.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborq.lang import Expr, parse
from arborq.plans.columns import ARITHMETIC, BOOL, LONG, Compiler, Typed, Unsupported, add, quoted, spread, to, truthy

VALUE, ROW = "value", "__row"


@dataclass(frozen=True)
class Frame:
    """df has the visible columns and the order's. rows: whether a stage sees each row or the whole sequence.
    bare: rows are single values in the column `value`, not structs. groups: the key columns after group_by."""

    df: DataFrame
    order: tuple[tuple[str, bool], ...]  # hidden column, descending
    rows: bool = False
    bare: bool = False
    one: bool = False  # a single value rather than a sequence
    groups: tuple[Column, ...] | None = None

    @property
    def names(self) -> list[str]:
        hidden = {n for n, _ in self.order}
        return [n for n in self.df.columns if n not in hidden]

    @property
    def typed(self) -> Typed:
        if self.bare:
            return Typed(F.col(VALUE), self.df.schema[VALUE].dataType)
        return Typed(None, T.StructType([self.df.schema[n] for n in self.names]))

    @property
    def keys(self) -> list[Column]:
        return [F.col(n).desc_nulls_last() if down else F.col(n).asc_nulls_first() for n, down in self.order]

    def result(self) -> DataFrame:
        return self.df.select(*[quoted(n) for n in self.names])


def hidden(f: Frame) -> list[Column]:
    return [F.col(n) for n, _ in f.order]


def put(f: Frame, t: Typed) -> Frame:
    """f with each row's value replaced by t."""
    if t.many:
        deep = f"__o{len(f.order)}"
        at = F.posexplode(t.value).alias(deep, VALUE)
        df = f.df.select(*hidden(f), at)
        out = replace(f, df=df, order=(*f.order, (deep, False)), bare=True)
        return unwrapped(out) if isinstance(t.kind, T.StructType) else out
    if isinstance(t.kind, T.StructType):
        if t.col is None:
            return f
        fields = struct_fields(t)
        return replace(f, df=f.df.select(*hidden(f), *fields), bare=False)
    return replace(f, df=f.df.select(*hidden(f), t.value.alias(VALUE)), bare=True)


def struct_fields(t: Typed) -> list[Column]:
    return [t.value.getField(n).alias(n) for n in t.kind.names]


def unwrapped(f: Frame) -> Frame:
    names = f.df.schema[VALUE].dataType.names
    return replace(f, df=f.df.select(*hidden(f), *[F.col(VALUE).getField(n).alias(n) for n in names]), bare=False)


def built(e: Expr, t: Typed, compiler: Compiler) -> list[tuple[str, Typed]] | None:
    """The fields of an object expression, one by one, so that Spark sees plain columns instead of a struct."""
    if e.op != "object" or not all(k.op == "lit" for k in e.args[::2]):
        return None
    fields = [(str(k.value), compiler.run(v, t)) for k, v in zip(e.args[::2], e.args[1::2], strict=True)]
    return None if any(x.many for _, x in fields) else fields


class Tables:
    def __init__(self, env: dict | None = None):
        self.env = env or {}

    @property
    def compiler(self) -> Compiler:
        return Compiler(self.env)

    def run(self, e: Expr, f: Frame) -> Frame:
        if e.op == "|":
            left, right = e.args
            if left.op in ("sort_by", "sort") and right.op == "|" and right.args[0].op == "reverse":
                return self.run(right.args[1], self.run(Expr("reverse"), self.run(left, f)))
            return self.run(right, self.run(left, f))
        if e.op == "as" and not f.rows and f.groups is None:
            return self.with_variable(e, f)
        if f.groups is not None and not f.rows:
            return self.on_groups(e, f)
        if f.one and not f.rows:
            return put(f, self.compiler.run(e, f.typed))
        return self.on_rows(e, f) if f.rows else self.on_sequence(e, f)

    # each row
    def on_rows(self, e: Expr, f: Frame) -> Frame:
        if f.groups is not None:
            return self.per_group(e, f)
        if e.op == "self":
            return f
        if e.op == "select":
            return replace(f, df=f.df.where(self.compiler.condition(e.args[0], f.typed)))
        if e.op == "empty":
            return replace(f, df=f.df.limit(0))
        if e.op == ",":
            return self.union(e, f)
        if e.op in ("=", "|=", "=c", "+=", "-=", "*=") and (path := self.plain_path(e.args[0])) and not f.bare:
            return self.set_column(e, f, path)
        if e.op == "del" and not f.bare:
            gone = [p.value for p in spread(e.args[0]) if p.op == "field" and p.args[0].op == "self"]
            if len(gone) == len(spread(e.args[0])):
                return replace(f, df=f.df.drop(*gone))
        if (fields := built(e, f.typed, self.compiler)) is not None:
            return replace(f, df=f.df.select(*hidden(f), *[to(x, T.StringType() if isinstance(x.kind, T.NullType) else x.kind).alias(n) for n, x in fields]), bare=False)
        return put(f, self.compiler.run(e, f.typed))

    def plain_path(self, e: Expr) -> str | None:
        return e.value if e.op == "field" and e.args[0].op == "self" and "*" not in e.value else None

    def set_column(self, e: Expr, f: Frame, name: str) -> Frame:
        old = self.compiler.run(Expr("field", [Expr("self")], name), f.typed)
        if e.op == "|=":
            new = self.compiler.single(e.args[1], old)
        else:
            new = self.compiler.single(e.args[1], f.typed)
            new = ARITHMETIC[e.op[0]](old, new) if e.op[0] in "+-*" else new
        return replace(f, df=f.df.withColumn(name, new.value))

    def union(self, e: Expr, f: Frame) -> Frame:
        """Each row's results of the left side before those of the right."""
        sides = [self.run(a, f) for a in spread(e)]
        if not all(s.bare for s in sides):
            raise Unsupported("a union of rows with several columns")
        side = f"__o{len(f.order)}"
        parts = []
        for k, s in enumerate(sides):
            parts.append(s.df.select(*hidden(f), F.lit(k).alias(side), VALUE))
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return replace(f, df=out, order=(*f.order, (side, False)), bare=True)

    # the sequence
    def on_sequence(self, e: Expr, f: Frame) -> Frame:
        handler = getattr(self, SEQUENCE.get(e.op, ""), None)
        if handler is not None:
            return handler(e, f)
        raise Unsupported(f"{e.op} over a whole table")

    def self_(self, e, f):
        return f

    def optional(self, e, f):
        return self.run(e.args[0], f)

    def splat(self, e, f):
        return replace(self.run(e.args[0], f), rows=True)

    def map(self, e, f):
        return replace(self.on_rows(e.args[0], replace(f, rows=True)), rows=False)

    def filter(self, e, f):
        return self.map(Expr("map", [Expr("select", e.args)]), f)

    def with_(self, e, f):
        """with(.[]; update): the update on each row. with(.[] | .f; update): on that field."""
        target, update = e.args
        steps = chain(target)
        if steps and steps[0].op == "splat":
            rest = steps[1:]
            if not rest:
                return self.map(Expr("map", [update]), f)
            return self.map(Expr("map", [Expr("|=", [pipeline(rest), update])]), f)
        raise Unsupported("with() over a table begins with .[]")

    def selective(self, e, f):
        """(.[] | select(p) | .f) |= e and its like: every row stays, those that fit change."""
        steps = flat(e.args[0])
        if not steps or steps[0].op != "splat":
            raise Unsupported("an update of a table begins with .[]")
        tests = [s for s in steps[1:] if s.op == "select"]
        path = [s for s in steps[1:] if s.op != "select"]
        name = self.plain_path(path[0]) if len(path) == 1 else None
        if name is None:
            raise Unsupported("an update of a table names one field")
        old = Typed(F.col(quoted(name)), f.df.schema[name].dataType)
        if e.op == "|=":
            value = self.compiler.single(e.args[1], old)
        else:
            value = self.compiler.single(e.args[1], f.typed)
            value = ARITHMETIC[e.op[0]](old, value) if e.op[0] in "+-*" else value
        fits = F.lit(True)
        for t in tests:
            fits = fits & self.compiler.any_true(self.compiler.run(t.args[0], f.typed))
        return replace(f, df=f.df.withColumn(name, F.when(fits, value.value).otherwise(old.value.cast(value.kind))))

    def sort_by(self, e, f):
        keys = [self.compiler.single(k, f.typed) for k in spread(e.args[0])] if e.args else [f.typed]
        names = [f"__k{len(f.order)}_{n}" for n in range(len(keys))]
        df = f.df.withColumns({n: k.value for n, k in zip(names, keys, strict=True)})
        return replace(f, df=df, order=(*[(n, False) for n in names], *f.order))

    def reverse(self, e, f):
        return replace(f, order=tuple((n, not down) for n, down in f.order))

    def slice(self, e, f):
        """Ends that count from the back are places from the front once the rows are counted, or limits of the reversed order."""
        ends = [a.value if a.op == "lit" else None for a in e.args[1:]]
        if not all(isinstance(x, int) for x in ends):
            raise Unsupported("the ends of a table's slice are whole numbers")
        low, high = ends[0], ends[1] if len(ends) > 1 else None
        if low < 0 and high is None:  # the last ones
            out = self.reverse(e, f)
            return self.reverse(e, replace(out, df=out.df.orderBy(*out.keys).limit(-low)))
        if low < 0 or high is not None and high < 0:
            n = f.df.count()
            low, high = (max(0, x + n) if x is not None and x < 0 else x for x in (low, high))
        out = f.df.orderBy(*f.keys)
        out = out.offset(low) if low else out
        return replace(f, df=out if high is None else out.limit(max(0, high - low)))

    def index(self, e, f):
        k = e.args[1].value if e.args[1].op == "lit" else None
        if not isinstance(k, int):
            raise Unsupported("a table is indexed by number")
        g, k = (f, k) if k >= 0 else (self.reverse(e, f), -1 - k)
        out = g.df.orderBy(*g.keys)
        return replace(f, df=(out.offset(k) if k else out).limit(1), one=True)

    def first(self, e, f):
        kept = self.filter(Expr("filter", e.args), f) if e.args else f
        return replace(kept, df=kept.df.orderBy(*kept.keys).limit(1), one=True)

    def unique_by(self, e, f):
        """The first row of each key, by a partial aggregate; nulls are one key."""
        if not e.args:
            return self.unique(e, f)
        keys = [self.compiler.single(k, f.typed).value.alias(f"__u{n}") for n, k in enumerate(spread(e.args[0]))]
        names = [*[n for n, _ in f.order], *f.names]
        order = F.struct(*[F.col(n) for n, _ in f.order]) if not any(down for _, down in f.order) else None
        if order is None:
            place = F.row_number().over(Window.partitionBy(*keys).orderBy(*f.keys))
            return replace(f, df=f.df.withColumn("__n", place).where("__n = 1").drop("__n"))
        row = F.min_by(F.struct(*[F.col(quoted(n)) for n in names]), order).alias("__row")
        return replace(f, df=f.df.groupBy(*keys).agg(row).select(*[F.col("__row").getField(n).alias(n) for n in names]))

    def unique(self, e, f):
        """Distinct rows in first-seen order: a partial aggregate, not a window over whole rows."""
        least = [F.min(F.struct(*hidden(f))).alias("__first")]
        out = f.df.groupBy(*[F.col(quoted(n)) for n in f.names]).agg(*least)
        names = [n for n, _ in f.order]
        return replace(f, df=out.select(*[F.col("__first").getField(n).alias(n) for n in names], *[quoted(n) for n in f.names]))

    def whole_key(self, f: Frame) -> list[Column]:
        return [F.col(quoted(n)) for n in f.names]

    def group_by(self, e, f):
        return replace(f, groups=tuple(self.compiler.single(k, f.typed).value for k in spread(e.args[0])))

    def length(self, e, f):
        return self.single_row(f, {VALUE: F.count(F.lit(1)).cast("long")})

    def single_row(self, f: Frame, columns: dict[str, Column]) -> Frame:
        return Frame(f.df.agg(*[c.alias(n) for n, c in columns.items()]), (), bare=True, one=True)

    def extreme(self, e, f):
        if not f.bare:
            raise Unsupported("min and max need single values")
        return self.single_row(f, {VALUE: least(VALUE) if e.op == "min" else F.max(VALUE)})

    def quantifier(self, e, f):
        test = self.compiler.any_true(self.compiler.run(e.args[0], f.typed)) if e.args else truthy(f.typed)
        out = F.coalesce((F.bool_or if e.op == "any" else F.bool_and)(test), F.lit(e.op == "all"))
        return self.single_row(f, {VALUE: out})

    def reduce(self, e, f):
        """Sums become aggregates; any other body folds the ordered sequence in one row."""
        source = self.run(e.args[0], f)
        if (added := summand(e)) is not None:
            x = Compiler({**self.env, e.value: source.typed}).single(added, source.typed)
            total = Typed(F.sum(x.value), LONG if isinstance(x.kind, (T.IntegerType, T.LongType)) else x.kind)
            init = self.compiler.single(e.args[1], Typed(F.lit(None), T.NullType()))
            return self.single_row(f, {VALUE: add(init, total).value})
        row = source.typed
        items = F.sort_array(F.collect_list(F.struct(*hidden(source), row.value.alias(ROW))))
        held = source.df.agg(items.alias("__all")).select(F.transform("__all", lambda s: s.getField(ROW)).alias("__all"))
        env = {**self.env, "__all": Typed(F.col("__all"), row.kind, True)}
        folded = Compiler(env).reduce(Expr("reduce", [Expr("var", value="__all"), *e.args[1:]], e.value), Typed(F.lit(None), T.NullType()))
        return Frame(held.select(folded.value.alias(VALUE)), (), bare=True, one=True)

    def collect(self, e, f):
        return replace(self.run(e.args[0], f), rows=False)

    def to_entries(self, e, f):
        place = F.row_number().over(Window.orderBy(*f.keys)) - 1  # a total order: the places of a whole table are global
        return replace(f, df=f.df.select(*hidden(f), place.cast("long").alias("key"), f.typed.value.alias("value")), bare=False)

    def shuffle(self, e, f):
        return replace(f, df=f.df.select(*[quoted(n) for n in f.names], F.rand().alias("__random")), order=(("__random", False),))

    def flatten(self, e, f):
        if not f.bare or not isinstance(f.typed.kind, T.ArrayType):
            return f
        depth = e.args[0].value if e.args else -1
        t = self.compiler.flatten(Expr("flatten", [Expr("lit", value=depth - 1)] if depth > 0 else []), f.typed)
        return put(f, Typed(t.value, t.kind.elementType, True))

    def join(self, e, f):
        items = F.sort_array(F.collect_list(F.struct(*hidden(f), F.coalesce(f.typed.value.cast("string"), F.lit("")).alias("v"))))
        joined = F.array_join(F.transform(items, lambda s: s.getField("v")), e.args[0].value)
        return self.single_row(f, {VALUE: joined})

    def with_variable(self, e, f):
        """`e as $x | body` over a table: the left side's matches times the body's, as a join."""
        left = self.run(pipeline(flat(e.args[0])), f)
        if left.bare and left.one:
            held = left.df.select(F.col(VALUE).alias(f"__{e.value}"))
            joined = f.df.crossJoin(F.broadcast(held))  # an aggregate's single row
            env = {**self.env, e.value: Typed(F.col(f"__{e.value}"), left.typed.kind)}
            out = Tables(env).run(e.args[1], replace(f, df=joined))
            return replace(out, df=out.df.drop(f"__{e.value}"))
        if left.rows and left.bare:  # each value in turn: rows of all values, the values' order first
            held = left.df.select(*[F.col(n).alias(f"__v{k}") for k, (n, _) in enumerate(left.order)], F.col(VALUE).alias(f"__{e.value}"))
            joined = f.df.crossJoin(held)
            env = {**self.env, e.value: Typed(F.col(f"__{e.value}"), left.typed.kind)}
            order = (*[(f"__v{k}", down) for k, (_, down) in enumerate(left.order)], *f.order)
            body = e.args[1]
            steps = flat(body)
            if not steps or steps[0].op != "splat":
                raise Unsupported("the body for several values of a variable goes over rows")
            out = Tables(env).run(body, Frame(joined, (*order, (f"__{e.value}", False)), rows=False))
            return out
        raise Unsupported("a variable over a table holds single values")

    # groups
    def on_groups(self, e: Expr, f: Frame) -> Frame:
        if e.op == "splat":
            return replace(f, rows=True)
        if e.op == "map":
            return replace(self.per_group(e.args[0], replace(f, rows=True)), rows=False)
        if e.op == "length":
            return self.single_row(f, {VALUE: F.count_distinct(F.struct(*f.groups)).cast("long")})
        if e.op == "self":
            return f
        raise Unsupported(f"{e.op} on groups")

    def per_group(self, e: Expr, f: Frame) -> Frame:
        """One row a group, ordered by where the group was first seen."""
        keys = [k.alias(f"__g{n}") for n, k in enumerate(f.groups)]
        seen = F.min(F.struct(*hidden(f))).alias("__first")
        fields = [(str(k.value), v) for k, v in zip(e.args[::2], e.args[1::2], strict=True)] if e.op == "object" else [(VALUE, e)]
        columns = {n: self.aggregate(x, f) for n, x in fields}
        grouped = f.df.groupBy(*keys)
        if all(c is not None for c in columns.values()):
            out = grouped.agg(seen, *[c.value.alias(n) for n, c in columns.items()])
        else:
            members = F.transform(F.sort_array(F.collect_list(F.struct(*hidden(f), f.typed.value.alias(ROW)))), lambda s: s.getField(ROW))
            held = grouped.agg(seen, members.alias("__members"), *[c.value.alias(f"__c_{n}") for n, c in columns.items() if c is not None])
            group = Typed(F.col("__members"), T.ArrayType(f.typed.kind))
            values = {n: F.col(f"__c_{n}") if columns[n] is not None else self.compiler.single(x, group).value for n, x in fields}
            out = held.select("__first", *[v.alias(n) for n, v in values.items()])
        names = [n for n, _ in f.order]
        out = out.select(*[F.col("__first").getField(n).alias(n) for n in names], *[quoted(n) for n in columns])
        return replace(f, df=out, groups=None, bare=e.op != "object")

    def aggregate(self, e: Expr, f: Frame) -> Typed | None:
        """An expression over a group as an aggregate function; None if it needs the members themselves."""
        steps = flat(e)
        inner = None
        test = None
        while steps and steps[0].op in ("splat", "map", "select", "field") or steps and is_member(steps[0]):
            s = steps[0]
            if is_member(s):  # .[0] | .x
                rest = pipeline([*field_chain(s), *steps[1:]])
                v = self.compiler.run(rest, f.typed)
                return None if v.many else Typed((F.min_by)(v.value, F.struct(*hidden(f))), v.kind)
            if s.op == "map" and inner is None:
                inner, steps = s.args[0], steps[1:]
                if inner.op == "select":
                    test, inner = inner.args[0], Expr("self")
                continue
            break
        if len(steps) == 1 and steps[0].op == "reduce" and inner is None and (added := summand(steps[0])) is not None:
            source = flat(steps[0].args[0])
            if source and source[0].op == "splat" and source[0].args[0].op == "self":
                x = self.compiler.single(pipeline(source[1:]), f.typed)
                x = Compiler({**self.env, steps[0].value: x}).single(added, x)
                init = self.compiler.single(steps[0].args[1], f.typed)
                total = Typed(F.sum(x.value), LONG if isinstance(x.kind, (T.IntegerType, T.LongType)) else x.kind)
                return add(init, total)
            return None
        if len(steps) == 1 and steps[0].op in ("any", "all") and steps[0].args and inner is None:
            c = self.compiler.any_true(self.compiler.run(steps[0].args[0], f.typed))
            return Typed((F.bool_or if steps[0].op == "any" else F.bool_and)(c), BOOL)
        names = [s.op for s in steps]
        if names == ["length"]:
            if test is not None:
                return Typed(F.count(F.when(self.compiler.any_true(self.compiler.run(test, f.typed)), 1)).cast("long"), LONG)
            return Typed(F.count(F.lit(1)).cast("long"), LONG) if inner is None or not self.compiler.run(inner, f.typed).many else None
        if inner is None or test is not None:
            return None
        x = self.compiler.run(inner, f.typed)
        if x.many:
            return None
        if names in (["min"], ["max"]):
            return Typed(least(x.value) if names == ["min"] else F.max(x.value), x.kind)
        if names == ["unique", "length"]:
            return Typed((F.count_distinct(x.value) + F.max(x.value.isNull().cast("int"))).cast("long"), LONG)
        if not names:
            items = F.sort_array(F.collect_list(F.struct(*hidden(f), x.value.alias("v"))))
            return Typed(F.transform(items, lambda s: s.getField("v")), T.ArrayType(x.kind))
        return None


def least(c: Column | str) -> Column:
    """min() in which null comes before all else, as in sorts."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.count(F.lit(1)) == F.count(c), F.min(c))


def is_member(e: Expr) -> bool:
    """`.[0]`, or a field of it."""
    while e.op == "field":
        e = e.args[0]
    return e.op == "index" and e.args[0].op == "self" and e.args[1].op == "lit" and e.args[1].value == 0


def field_chain(e: Expr) -> list[Expr]:
    out = []
    while e.op == "field":
        out.append(Expr("field", [Expr("self")], e.value))
        e = e.args[0]
    return out[::-1]


def summand(e: Expr) -> Expr | None:
    """x in `reduce (init; . + x)` where x does not use the accumulator."""
    body = e.args[2]
    if body.op != "+" or body.args[0].op != "self":
        return None

    def uses_self(x: Expr) -> bool:
        return x.op == "self" or any(map(uses_self, x.args))

    return None if uses_self(body.args[1]) else body.args[1]


def flat(e: Expr) -> list[Expr]:
    return [*flat(e.args[0]), *flat(e.args[1])] if e.op == "|" else chain(e)


def chain(e: Expr) -> list[Expr]:
    """`.[].a` as the steps `.[]` and `.a`."""
    if e.op == "|":
        return flat(e)
    if e.op == "field" and e.args[0].op != "self" and not is_member(e):
        return [*chain(e.args[0]), Expr("field", [Expr("self")], e.value)]
    return [] if e.op == "self" else [e]


def pipeline(steps: Sequence[Expr]) -> Expr:
    if not steps:
        return Expr("self")
    return steps[0] if len(steps) == 1 else Expr("|", [steps[0], pipeline(steps[1:])])


SEQUENCE = {
    **{x: x for x in "splat optional map filter sort_by reverse slice index first unique_by unique group_by length reduce collect to_entries shuffle flatten join".split()},
    **dict.fromkeys(["min", "max"], "extreme"),
    **dict.fromkeys(["any", "all"], "quantifier"),
    **dict.fromkeys(["|=", "+=", "-=", "*=", "="], "selective"),
    "self": "self_",
    "sort": "sort_by",
    "with": "with_",
}


def query(df: DataFrame, expression: str | Expr, order: Sequence[str] = (), ordered: bool = False) -> DataFrame:
    """The expression over df as the sequence of its rows.

    order: columns that together are unique; they define the sequence. Rows of single values come in the column `value`.
    ordered: whether the result is sorted as the sequence is (a slice always is); else its rows come in any order.
    Rows equal in all of order have no order among themselves.
    """
    e = parse(expression) if isinstance(expression, str) else expression
    keys = order or df.columns
    names = [f"__o{n}" for n in range(len(keys))]
    f = Frame(df.withColumns({n: F.col(quoted(k)) for n, k in zip(names, keys, strict=True)}), tuple((n, False) for n in names))
    steps = flat(e)
    out = Tables().run(pipeline(steps), f)
    return replace(out, df=out.df.orderBy(*out.keys)).result() if ordered and out.order else out.result()
