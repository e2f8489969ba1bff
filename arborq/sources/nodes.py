"""The node table: one row for each node of each document, and what can be read from it.

preorder and subtree_end make "is below" a range: b.preorder BETWEEN a.preorder AND a.subtree_end. JSON texts also have
each node's place in bytes. A document is decoded in one task; everything after is joins and filters by doc_id.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborq.operators import values as V
from arborq.sources import codecs, documents
from arborq.sources.push import Parser, step_text

DDL = "doc_id long, node_id int, parent_id int, ordinal int, key string, seq_index int, kind string, tag string, value string, path array<struct<k:string,i:int>>, path_text string, depth int, preorder int, subtree_end int, start_byte int, end_byte int"
STEP = pa.struct([("k", pa.string()), ("i", pa.int32())])
SCHEMA = pa.schema([("doc_id", pa.int64()), *[(n, pa.int32()) for n in ("node_id", "parent_id", "ordinal")], ("key", pa.string()), ("seq_index", pa.int32()), *[(n, pa.string()) for n in ("kind", "tag", "value")], ("path", pa.list_(STEP)), ("path_text", pa.string()), *[(n, pa.int32()) for n in ("depth", "preorder", "subtree_end", "start_byte", "end_byte")]])


NAMES = SCHEMA.names


class Rows:
    """Nodes by column, as Arrow takes them."""

    def __init__(self):
        self.lists: dict[str, list] = {n: [] for n in NAMES}

    def __len__(self) -> int:
        return len(self.lists["doc_id"])

    def add(self, *values) -> None:
        for column, v in zip(self.lists.values(), values, strict=True):
            column.append(v)

    def batch(self) -> pa.RecordBatch:
        paths = self.lists["path"]
        ends = [0, *itertools.accumulate(map(len, paths))]
        flat = list(itertools.chain.from_iterable(paths))
        parts = pa.StructArray.from_arrays([pa.array([None if type(k) is int else k for k in flat], pa.string()), pa.array([k if type(k) is int else None for k in flat], pa.int32())], fields=list(STEP))
        columns = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts) if n == "path" else pa.array(self.lists[n], SCHEMA.field(n).type) for n in NAMES]
        return pa.RecordBatch.from_arrays(columns, schema=SCHEMA)


def json_rows(out: Rows, doc_id, text: str) -> None:
    """Nodes with their places in bytes."""
    parser, rows = Parser(), {}
    for what, n in parser.feed(text.encode(), close=True):
        if what == "start":
            above = rows[n.parent] if n.parent >= 0 else None
            step = n.key if n.key is not None else n.index
            path, shown = ((*above[9], step), above[10] + step_text(step)) if above else ((), "$")
            rows[n.number] = [doc_id, n.number, n.parent if n.parent >= 0 else None, n.ordinal, n.key, n.index, n.kind, n.tag, n.value, path, shown, n.depth, n.number, n.number, n.start, None]
        else:
            rows[n.number][13], rows[n.number][15] = n.last, n.end
    for r in rows.values():
        out.add(*r)


class Pairs(list):
    """An object's members, repeated keys among them."""


class Whole(str):
    """A whole number as written."""


class Fraction(str):
    """A fraction as written."""


def not_json(name: str):
    raise ValueError(f"{name} is not JSON")


PLAIN = json.JSONDecoder(object_pairs_hook=Pairs, parse_int=Whole, parse_float=Fraction, parse_constant=not_json)


def plain_json(text: str):
    return PLAIN.decode(text.removeprefix("\ufeff"))


KINDS = {Pairs: ("map", "!!map"), dict: ("map", "!!map"), list: ("seq", "!!seq"), Whole: ("scalar", "!!int"), Fraction: ("scalar", "!!float"), str: ("scalar", "!!str"), bool: ("scalar", "!!bool"), type(None): ("scalar", "!!null")}


def value_rows(out: Rows, doc_id, v) -> None:
    """Nodes of a value, without places. No recursion: a value may be nested as deeply as its decoder reads."""
    lists = out.lists
    base = len(out)
    todo = [(v, None, 0, None, "", "$", 0)]
    open_: list[tuple[int, int]] = []  # number and depth of the containers on the way
    add = [c.append for c in lists.values()]
    last = lists["subtree_end"]
    paths = lists["path"]
    while todo:
        x, parent, ordinal, step, _, shown, depth = todo.pop()
        k = len(last) - base
        while open_ and open_[-1][1] >= depth:
            last[base + open_.pop()[0]] = k - 1
        kind = type(x)
        about = KINDS.get(kind) or (V.kind(x), V.tag(x))
        inner = about[0] != "scalar"
        path = () if parent is None else (*paths[base + parent], step)
        value = None if inner else "null" if x is None else ("true" if x else "false") if kind is bool else str(x) if kind in (Whole, Fraction, str) else V.text(x)
        named = type(step) is not int
        for put, item in zip(add, (doc_id, k, parent, ordinal, step if named else None, None if named else step, *about, value, path, shown, depth, k, k, None, None), strict=True):
            put(item)
        if inner and x:
            open_.append((k, depth))
            members = enumerate(x) if kind is list else x if kind is Pairs else x.items()
            todo += [(y, k, n, key, None, shown + step_text(key), depth + 1) for n, (key, y) in reversed(list(enumerate(members)))]
    for k, _ in open_:
        last[base + k] = len(last) - base - 1


def node_table(df: DataFrame, source: str = "json", places: bool = True) -> DataFrame:
    """df (doc_id, text) to its node table. places: whether JSON nodes have start_byte and end_byte, which takes a slower
    parser. Texts that do not decode give no rows (documents.evaluate reports them)."""
    name = codecs.format_named(source)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text is None:
                    continue
                try:
                    if name == "json" and places:
                        json_rows(rows, doc_id, text)
                    else:
                        value_rows(rows, doc_id, plain_json(text) if name == "json" else codecs.decode(text, name))
                except (ValueError, RecursionError):
                    continue
                if len(rows) >= 10_000:
                    yield rows.batch()
                    rows = Rows()
        if len(rows):
            yield rows.batch()

    return documents.spread(df.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(build, DDL)


def typed_nodes(df: DataFrame, doc_id: str, names: list[str]) -> DataFrame:
    """The node table of flat rows, each a mapping of the named columns: no decoding, one native explode."""
    fields = [F.struct(F.lit(n).alias("key"), F.lit(k).alias("ordinal"), F.col(n).cast("string").alias("value"), F.lit(df.schema[n].dataType.simpleString()).alias("t")) for k, n in enumerate(names)]
    root = F.struct(F.lit(None).cast("string").alias("key"), F.lit(-1).alias("ordinal"), F.lit(None).cast("string").alias("value"), F.lit("map").alias("t"))
    x = F.col("x")
    t = x["t"]
    tag = F.when(t == "map", "!!map").when(x["value"].isNull(), "!!null").when(t.isin("int", "bigint", "smallint", "tinyint"), "!!int").when(t.isin("double", "float"), "!!float").when(t == "boolean", "!!bool").when(t.startswith("timestamp") | (t == "date"), "!!timestamp").otherwise("!!str")
    top = x["ordinal"] < 0
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.explode(F.array(root, *fields)).alias("x")).select(
        "doc_id",
        (x["ordinal"] + 1).alias("node_id"),
        F.when(~top, 0).alias("parent_id"),
        F.greatest(x["ordinal"], F.lit(0)).alias("ordinal"),
        x["key"].alias("key"),
        F.when(top, "map").otherwise("scalar").alias("kind"),
        tag.alias("tag"),
        x["value"].alias("value"),
        F.when(top, "$").otherwise(F.concat(F.lit("$."), x["key"])).alias("path_text"),
        F.when(top, 0).otherwise(1).alias("depth"),
        (x["ordinal"] + 1).alias("preorder"),
        F.when(top, len(names)).otherwise(x["ordinal"] + 1).alias("subtree_end"),
    )


# reads


def at_path(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.where(F.col("path_text") == path)


def anchors(nodes: DataFrame, path: str) -> DataFrame:
    """Where a path lies in its text."""
    return at_path(nodes, path).select("doc_id", "path_text", "start_byte", "end_byte")


def resolve(nodes: DataFrame, start: int, end: int | None = None) -> DataFrame:
    """Each document's deepest path whose node spans the given bytes."""
    end = start if end is None else end
    hit = nodes.where((F.col("start_byte") <= start) & (F.col("end_byte") >= end))
    return hit.groupBy("doc_id").agg(F.max_by("path_text", "depth").alias("path_text"))


def root_kinds(nodes: DataFrame) -> DataFrame:
    return nodes.where("parent_id IS NULL").select("doc_id", "kind", "tag")


def preview(nodes: DataFrame, path: str) -> DataFrame:
    return at_path(nodes, path).select("doc_id", "kind", "tag", "value", (F.col("kind") == "scalar").alias("is_scalar"))


def direct_children(nodes: DataFrame, path: str) -> DataFrame:
    parents = at_path(nodes, path).select("doc_id", F.col("node_id").alias("parent_id"))
    return nodes.join(parents, ["doc_id", "parent_id"]).select("doc_id", "ordinal", F.coalesce("key", F.col("seq_index").cast("string") if "seq_index" in nodes.columns else F.lit(None)).alias("label"), "kind", "tag", "value", (F.col("kind") != "scalar").alias("is_container"))


def descendants(nodes: DataFrame, path: str) -> DataFrame:
    """The node at a path and all below it, by the interval."""
    top = at_path(nodes, path).select("doc_id", F.col("preorder").alias("__a"), F.col("subtree_end").alias("__b"))
    return nodes.join(top, "doc_id").where("preorder BETWEEN __a AND __b").drop("__a", "__b")


def ancestors(nodes: DataFrame, path: str) -> DataFrame:
    low = at_path(nodes, path).select("doc_id", F.col("preorder").alias("__p"))
    return nodes.join(low, "doc_id").where("preorder < __p AND subtree_end >= __p").drop("__p")


def field_labels(nodes: DataFrame) -> DataFrame:
    return nodes.where("key IS NOT NULL").select("key").distinct()


def search_index(nodes: DataFrame, needle: str | None = None) -> DataFrame:
    """Path, label and value of every node; with a needle those whose label or value has it, in any case."""
    label = F.coalesce("key", F.col("seq_index").cast("string")) if "seq_index" in nodes.columns else F.col("key")
    out = nodes.select("doc_id", "path_text", label.alias("label"), "key", "value")
    if needle is None:
        return out
    low = needle.lower()
    return out.where(F.lower(F.coalesce("label", F.lit(""))).contains(low) | F.lower(F.coalesce("value", F.lit(""))).contains(low))


# comparison


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two node tables by document and path: rows inserted, deleted or changed. Order of keys does not matter; elements of
    sequences are aligned (diff_sequences), so paths of deleted rows are those in old and of inserted ones those in new.
    Tables of flat rows, which have no sequences, are joined by path."""
    if "seq_index" in old.columns and "seq_index" in new.columns:
        return diff_sequences(old, new)
    side = lambda df, s: df.select("doc_id", "path_text", F.col("tag").alias(f"tag_{s}"), F.col("value").alias(f"value_{s}"))
    both = side(old, "old").join(side(new, "new"), ["doc_id", "path_text"], "full")
    op = F.when(F.col("tag_old").isNull(), "insert").when(F.col("tag_new").isNull(), "delete").when(~(F.col("tag_old").eqNullSafe(F.col("tag_new")) & F.col("value_old").eqNullSafe(F.col("value_new"))), "change")
    return both.withColumn("op", op).where("op IS NOT NULL").select("doc_id", "path_text", "op", "value_old", "value_new")


def shortest_edits(a: list, b: list, most: int | None = None) -> list[tuple[str, int, int]] | None:
    """The fewest insertions and deletions from a to b, as (keep, delete or insert, place in a, place in b); None if more
    than `most`. Greedy furthest-reaching paths by diagonal; work and memory grow with the square of the edits."""
    n, m, reach, trail = len(a), len(b), {1: 0}, []
    for d in range((n + m if most is None else min(n + m, most)) + 1):
        trail.append(dict(reach))
        for k in range(-d, d + 1, 2):
            down = k == -d or k != d and reach[k - 1] < reach[k + 1]
            x = reach[k + 1] if down else reach[k - 1] + 1
            while x < n and x - k < m and a[x] == b[x - k]:
                x += 1
            reach[k] = x
            if x >= n and x - k >= m:
                return walked(trail, n, m)
    return None


def walked(trail: list[dict], x: int, y: int) -> list[tuple[str, int, int]]:
    out = []
    for d in range(len(trail) - 1, -1, -1):
        reach, k = trail[d], x - y
        down = k == -d or k != d and reach[k - 1] < reach[k + 1]
        px = (reach[k + 1] if down else reach[k - 1]) if d else 0
        py = px - (k + 1 if down else k - 1) if d else 0
        while x > px and y > py and (d == 0 or x - y == k) and not (d and (x, y) == (px + (not down), py + down)):
            x, y = x - 1, y - 1
            out.append(("keep", x, y))
        if d:
            out.append(("insert", x, y - 1) if down else ("delete", x - 1, y))
            x, y = px, py
    return out[::-1]


def numbered(*sides: list) -> list[list[int]]:
    """Elements as small numbers, equal where they are equal."""
    numbers: dict = {}
    return [[numbers.setdefault(x, len(numbers)) for x in side] for side in sides]


def aligned(a: list, b: list, most: int | None = None) -> tuple[list[int], list[int], bool]:
    """The places of a to delete and of b to insert, and whether that is exact: beyond `most` edits it is not, and all
    between the equal ends is deleted and inserted. What is equal at both ends, and what only one side has at all, is left
    out of the search."""
    a, b = numbered(a, b)
    front = 0
    while front < min(len(a), len(b)) and a[front] == b[front]:
        front += 1
    back = 0
    while back < min(len(a), len(b)) - front and a[-1 - back] == b[-1 - back]:
        back += 1
    left, right = range(front, len(a) - back), range(front, len(b) - back)
    both = {a[i] for i in left} & {b[j] for j in right}
    x, y = [i for i in left if a[i] in both], [j for j in right if b[j] in both]
    edits = shortest_edits([a[i] for i in x], [b[j] for j in y], most)
    if edits is None:
        return list(left), list(right), False
    kept = {x[i]: y[j] for op, i, j in edits if op == "keep"}
    stay = set(kept.values())
    return [i for i in left if i not in kept], [j for j in right if j not in stay], True


NODE = ["node_id", "parent_id", "ordinal", "key", "kind", "tag", "value", "path_text"]
DIFF_DDL = "doc_id long, path_text string, op string, value_old string, value_new string"
DIFF = pa.schema([("doc_id", pa.int64()), *[(n, pa.string()) for n in ("path_text", "op", "value_old", "value_new")]])


class Side:
    """One document's nodes. same: a number by node, equal for nodes of equal content in any document of `numbers`."""

    def __init__(self, table: pa.Table, numbers: dict):
        rows = sorted((r for r in zip(*(table.column(n).to_pylist() for n in NODE), strict=True)), key=lambda r: r[0])
        self.rows = {r[0]: r for r in rows}
        self.roots = [r[0] for r in rows if r[1] is None]
        self.inner: dict[int, list[int]] = {r[0]: [] for r in rows}
        for r in rows:
            if r[1] is not None:
                self.inner[r[1]].append(r[0])
        self.same: dict[int, int] = {}
        for n, _, _, _, kind, tag, value, _ in reversed(rows):  # nodes are numbered from above
            self.inner[n].sort(key=lambda k: self.rows[k][2])
            below = [(self.rows[k][3] or "", self.same[k]) if kind == "map" else self.same[k] for k in self.inner[n]]
            self.same[n] = numbers.setdefault((kind, tag, value, tuple(sorted(below) if kind == "map" else below)), len(numbers))

    def keyed(self, n: int) -> dict:
        """Children of a mapping by key; a repeated key counts on."""
        out: dict = {}
        for k in self.inner[n]:
            key, again = self.rows[k][3], 0
            while (key, again) in out:
                again += 1
            out[key, again] = k
        return out

    def below(self, n: int) -> Iterator[tuple]:
        todo = [n]
        while todo:
            k = todo.pop()
            yield self.rows[k]
            todo += self.inner[k]


def diff_trees(a: Side, b: Side) -> Iterator[tuple]:
    """(path, op, old value, new value) from one document to its other version. Of a sequence's elements to delete and to
    insert, the k-th ones that stand at one place are compared in turn."""
    todo: list[tuple[int | None, int | None]] = list(itertools.zip_longest(a.roots, b.roots))
    while todo:
        x, y = todo.pop()
        if x is None or y is None:
            if x is not None:
                yield from ((r[7], "delete", r[6], None) for r in a.below(x))
            if y is not None:
                yield from ((r[7], "insert", None, r[6]) for r in b.below(y))
            continue
        if a.same[x] == b.same[y]:
            continue
        old, new = a.rows[x], b.rows[y]
        if old[5:7] != new[5:7]:
            yield new[7], "change", old[6], new[6]
        if old[4] == new[4] == "map":
            left, right = a.keyed(x), b.keyed(y)
            todo += [(left.get(k), right.get(k)) for k in {**left, **right}]
        elif old[4] == new[4] == "seq":
            gone, come, _ = aligned([a.same[k] for k in a.inner[x]], [b.same[k] for k in b.inner[y]])
            for i, j in itertools.zip_longest(gone, come):
                if i is not None and i == j:
                    todo.append((a.inner[x][i], b.inner[y][j]))
                    continue
                if i is not None:
                    todo.append((a.inner[x][i], None))
                if j is not None:
                    todo.append((None, b.inner[y][j]))
        else:
            todo += [(k, None) for k in a.inner[x]] + [(None, k) for k in b.inner[y]]


def diff_sequences(old: DataFrame, new: DataFrame) -> DataFrame:
    """diff() of node tables with sequences: a document's two versions meet in one task and are compared from the root
    down, mappings by key, sequences by the fewest edits over the content of their elements. doc_ids are unique; documents
    with a null doc_id have no other version."""

    def compare(key, left: pa.Table, right: pa.Table) -> pa.Table:
        numbers: dict = {}
        doc_id = key[0].as_py()
        if doc_id is None:
            rows = [(r["path_text"], "delete", r["value"], None) for r in left.to_pylist()] + [(r["path_text"], "insert", None, r["value"]) for r in right.to_pylist()]
        else:
            rows = list(diff_trees(Side(left, numbers), Side(right, numbers)))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        return pa.Table.from_arrays([pa.array([doc_id] * len(rows), pa.int64()), *[pa.array(list(c), pa.string()) for c in columns]], schema=DIFF)

    a, b = (df.select("doc_id", *NODE).groupBy("doc_id") for df in (old, new))
    return a.cogroup(b).applyInArrow(compare, DIFF_DDL)


class NOTHING:
    """Stands itself for a value that one version lacks: a class is the same one in every process."""


def members(x) -> list[tuple]:
    """A container's steps and values."""
    return list(enumerate(x)) if type(x) is list else x if type(x) is Pairs else list(x.items())


def about(x) -> tuple[str, str, str | None]:
    """Kind, tag and value as a node table has them."""
    kind = type(x)
    named, tag = KINDS.get(kind) or (V.kind(x), V.tag(x))
    if named != "scalar":
        return named, tag, None
    return named, tag, "null" if x is None else ("true" if x else "false") if kind is bool else str(x) if kind in (Whole, Fraction, str) else V.text(x)


def holds(x) -> bool:
    kind = type(x)
    return kind is Pairs or kind is list or (KINDS.get(kind) or (V.kind(x),))[0] != "scalar"


def key_of(step) -> str | None:
    return None if type(step) is int else step


class Numbers(dict):
    """Numbers of contents, equal for equal ones; of containers kept by their objects, which must stay."""

    def __init__(self):
        self.own: dict[int, int] = {}

    def of(self, x) -> int:
        k = self.own.get(id(x))
        if k is not None:
            return k
        kind = type(x)
        return self.setdefault((kind, x) if kind in (str, Whole, Fraction) else about(x), len(self))

    def add(self, root) -> None:
        inner = [root] if holds(root) else []
        for x in inner:  # what is below comes behind
            inner += [y for y in (x if type(x) is list else [y for _, y in members(x)]) if holds(y)]
        for x in reversed(inner):
            what = about(x)
            below = sorted((key_of(k) or "", self.of(y)) for k, y in members(x)) if what[0] == "map" else [self.of(y) for y in x]
            self.own[id(x)] = self.setdefault((*what, tuple(below)), len(self))


def keyed_members(x) -> dict:
    """Members of a mapping by key, as Side.keyed()."""
    out: dict = {}
    for step, y in members(x):
        again = 0
        while (key_of(step), again) in out:
            again += 1
        out[key_of(step), again] = (y, step_text(step))
    return out


def all_below(x, shown: str) -> Iterator[tuple[str, str | None]]:
    todo = [(x, shown)]
    while todo:
        x, shown = todo.pop()
        what = about(x)
        yield shown, what[2]
        if what[0] != "scalar":
            todo += [(y, shown + step_text(k)) for k, y in members(x)]


def diff_values(a, b) -> Iterator[tuple]:
    """diff_trees() of two decoded values, either of which may be NOTHING. No recursion."""
    numbers = Numbers()
    for x in (a, b):
        if x is not NOTHING:
            numbers.add(x)
    todo = [(a, b, "$", "$")]
    while todo:
        x, y, p, q = todo.pop()
        if x is NOTHING or y is NOTHING:
            if x is not NOTHING:
                yield from ((path, "delete", v, None) for path, v in all_below(x, p))
            if y is not NOTHING:
                yield from ((path, "insert", None, v) for path, v in all_below(y, q))
            continue
        if numbers.of(x) == numbers.of(y):
            continue
        old, new = about(x), about(y)
        if old[1:] != new[1:]:
            yield q, "change", old[2], new[2]
        if old[0] == new[0] == "map":
            left, right = keyed_members(x), keyed_members(y)
            for k in {**left, **right}:
                (u, s), (v, t) = left.get(k, (NOTHING, "")), right.get(k, (NOTHING, ""))
                todo.append((u, v, p + s, q + t))
        elif old[0] == new[0] == "seq":
            gone, come, _ = aligned([numbers.of(u) for u in x], [numbers.of(v) for v in y])
            for i, j in itertools.zip_longest(gone, come):
                if i is not None and i == j:
                    todo.append((x[i], y[j], f"{p}[{i}]", f"{q}[{j}]"))
                    continue
                if i is not None:
                    todo.append((x[i], NOTHING, f"{p}[{i}]", ""))
                if j is not None:
                    todo.append((NOTHING, y[j], "", f"{q}[{j}]"))
        else:
            todo += [(u, NOTHING, p + step_text(k), "") for k, u in (members(x) if old[0] != "scalar" else ())]
            todo += [(NOTHING, v, "", q + step_text(k)) for k, v in (members(y) if new[0] != "scalar" else ())]


def diff_texts(old: DataFrame, new: DataFrame, source: str = "json") -> DataFrame:
    """diff() of the node tables (without places) of two tables (doc_id, text), straight from the texts: these are joined,
    and both versions decoded and compared where they meet. What travels is a row a document, not one a node, and Python
    gets documents by the batch, not one by one. Texts that do not decode count as missing; repeated doc_ids meet each with
    each."""
    name = codecs.format_named(source)

    def decoded(text: str | None):
        try:
            return NOTHING if text is None else plain_json(text) if name == "json" else codecs.decode(text, name)
        except (ValueError, RecursionError):
            return NOTHING

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, *r) for d, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True) if a != b for r in diff_values(decoded(a), decoded(b))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), DIFF, strict=True)], schema=DIFF)

    side = lambda df, n: df.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias(n))
    return side(old, "a").join(side(new, "b"), "doc_id", "full").mapInArrow(compare, DIFF_DDL)


def same_structure(old: DataFrame, new: DataFrame) -> DataFrame:
    """Each document that both have, and whether it is equal in both."""
    ids = old.select("doc_id").distinct().join(new.select("doc_id").distinct(), "doc_id")
    return ids.join(diff(old, new).groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left").select("doc_id", F.col("n").isNull().alias("same"))


LINES_DDL = "doc_id long, op string, line int, text string, exact boolean"


def diff_lines(old: DataFrame, new: DataFrame, method: str = "myers", most: int | None = None) -> DataFrame:
    """Texts (doc_id, text) line by line: the lines inserted and deleted, with their numbers from 0. A line's end, \\n or
    \\r\\n, is no part of it, so that texts which differ in those alone have no rows.

    method: "myers", the fewest edits; or "histogram", which splits at the lines that are rarest in both texts, as people
    would, and may take more. most: a bound of edits for either; where one text's search goes beyond it, all lines between
    the equal ends are deleted and inserted, and `exact` says so. Without a bound every row is exact. A null text has no
    lines; repeated doc_ids meet each with each.
    """
    both = old.select(F.col("doc_id").cast("long"), F.col("text").alias("a")).join(new.select(F.col("doc_id").cast("long"), F.col("text").alias("b")), "doc_id", "full")
    schema = pa.schema([("doc_id", pa.int64()), ("op", pa.string()), ("line", pa.int32()), ("text", pa.string()), ("exact", pa.bool_())])
    compare_ = {"myers": aligned, "histogram": by_histogram}[method]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = lines_of(a), lines_of(b)
                gone, come, exact = compare_(x, y, most)
                rows += [(d, "delete", k, x[k], exact) for k in gone] + [(d, "insert", k, y[k], exact) for k in come]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return both.mapInArrow(compare, LINES_DDL)


def lines_of(text: str | None) -> list[str]:
    return [] if text is None else text.replace("\r\n", "\n").split("\n")


#: A line that comes more often than this in the first text is no place to split at.
COMMON_LINE = 64


def by_histogram(a: list, b: list, most: int | None = None) -> tuple[list[int], list[int], bool]:
    """aligned() by splitting at the longest run of equal lines around the rarest line, and again on both sides of it;
    regions whose lines are all frequent, or that share none, go to the fewest edits."""
    a, b = numbered(a, b)
    gone, come, exact = [], [], True
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
        if a0 == a1 or b0 == b1:
            gone += range(a0, a1)
            come += range(b0, b1)
            continue
        where: dict[int, list[int]] = {}
        for i in range(a0, a1):
            where.setdefault(a[i], []).append(i)
        best = None
        j = b0
        while j < b1:
            after = j + 1
            for i in where.get(b[j], ()) if len(where.get(b[j], ())) <= COMMON_LINE else ():
                low, high = 0, 1
                rare = len(where[b[j]])
                while i - low > a0 and j - low > b0 and a[i - low - 1] == b[j - low - 1]:
                    low += 1
                    rare = min(rare, len(where[a[i - low]]))
                while i + high < a1 and j + high < b1 and a[i + high] == b[j + high]:
                    rare = min(rare, len(where[a[i + high]]))
                    high += 1
                after = max(after, j + high)
                key = (rare, -(low + high))
                if best is None or key < best[0]:
                    best = (key, i - low, i + high, j - low, j + high)
            j = after
        if best is None:
            x, y, good = aligned(a[a0:a1], b[b0:b1], most)
            gone += [a0 + k for k in x]
            come += [b0 + k for k in y]
            exact = exact and good
            continue
        _, i0, i1, j0, j1 = best
        todo += [(a0, i0, b0, j0), (i1, a1, j1, b1)]
    return sorted(gone), sorted(come), exact


#: Fixed value: beyond so many edits of characters a changed value is marked whole.
INLINE_EDITS = 100


def inline_edits(old: str, new: str, most: int | None = INLINE_EDITS) -> list[tuple[str, int, int]]:
    """(op, offset, length) in code points for runs of characters deleted from old and inserted in new; of more than
    `most` edits the whole texts (most None: never)."""
    gone, come, _ = aligned(list(old), list(new), most)
    out = []
    for op, places in (("delete", gone), ("insert", come)):
        for _, run in itertools.groupby(enumerate(places), key=lambda x: x[1] - x[0]):
            found = [k for _, k in run]
            out.append((op, found[0], len(found)))
    return out


def with_inline(changes: DataFrame, most: int | None = INLINE_EDITS) -> DataFrame:
    """diff() with a row for each run of characters that a changed value lost or got: (doc_id, path_text, op, offset,
    length). Rows of inserted and deleted values stand for themselves and are left out."""

    def one(doc_id, path, old, new):
        return [(doc_id, path, *x) for x in inline_edits(old or "", new or "", most)]

    changed = changes.where("op = 'change'").select("doc_id", "path_text", "value_old", "value_new")
    return documents.mapped(changed, one, "doc_id long, path_text string, op string, offset int, length int", ["doc_id", "path_text", "op", "offset", "length"], [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()])


# graph and tables


def shape_of(nodes: DataFrame) -> DataFrame:
    """nodes with `shape`: a mapping that is not empty is an object, such a sequence a table, all else a scalar."""
    full = F.col("subtree_end") > F.col("preorder")
    return nodes.withColumn("shape", F.when(full & (F.col("kind") == "map"), "object").when(full & (F.col("kind") == "seq"), "table").otherwise("scalar"))


def stable_id(kind: Column, path: Column) -> Column:
    return F.xxhash64(kind, path)


def source_path(nodes: DataFrame) -> Column:
    """The path of a node's container: path_text without its last step, as step_text() writes it. A key in brackets is JSON
    text, where some characters take two places or six; no plain key ends in a quotation mark and a bracket."""
    quoted = F.length(F.regexp_replace(F.regexp_replace("key", r"[\x00-\x07\x0B\x0E-\x1F]", "000000"), r'["\\\x08-\x0A\x0C\x0D]', "00")) + 4
    named = F.when(F.endswith(F.col("path_text"), F.lit('"]')), quoted).otherwise(F.length("key") + 1)
    step = F.coalesce(named, F.length(F.col("seq_index").cast("string")) + 2) if "seq_index" in nodes.columns else named
    return F.left("path_text", F.length("path_text") - step)


def graph(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graph nodes (containers that are not empty, and roots) and edges from a container to those within it. An edge is read
    off its target's row: a join with the containers would be as large as they are, on the driver if it were broadcast."""
    shaped = shape_of(nodes)
    kept = shaped.where("shape <> 'scalar' OR parent_id IS NULL")
    out = kept.select("doc_id", "node_id", "shape", "path_text", stable_id(F.col("shape"), F.col("path_text")).alias("graph_id"), "depth")
    label = F.coalesce("key", F.col("seq_index").cast("string") if "seq_index" in nodes.columns else F.lit(None))
    edges = kept.where("parent_id IS NOT NULL").select("doc_id", source_path(nodes).alias("source"), F.col("path_text").alias("target"), label.alias("label"))
    return out, edges


def header_tables(nodes: DataFrame) -> DataFrame:
    """Each table and whether it has a header: its first element is a mapping without containers in it."""
    shaped = shape_of(nodes)
    tables = shaped.where("shape = 'table'").select("doc_id", F.col("node_id").alias("table_id"), "path_text")
    firsts = shaped.where("ordinal = 0").select("doc_id", F.col("parent_id").alias("table_id"), F.col("node_id").alias("first_id"), F.col("kind").alias("first_kind"))
    deep = shaped.where("kind <> 'scalar'").select("doc_id", F.col("parent_id").alias("first_id")).distinct().withColumn("deep", F.lit(True))
    joined = tables.join(firsts, ["doc_id", "table_id"]).join(deep, ["doc_id", "first_id"], "left")
    return joined.select("doc_id", "table_id", "path_text", ((F.col("first_kind") == "map") & F.col("deep").isNull()).alias("has_header"))


def table_cells(nodes: DataFrame) -> DataFrame:
    """The cells of header tables: row, column and value for every column of the table; cells that a row lacks are missing."""
    tables = header_tables(nodes).where("has_header").select("doc_id", "table_id", F.col("path_text").alias("table_path"))
    rows = nodes.select("doc_id", F.col("parent_id").alias("table_id"), F.col("node_id").alias("row_id"), F.col("seq_index").alias("row")).join(tables, ["doc_id", "table_id"])
    cells = nodes.select("doc_id", F.col("parent_id").alias("row_id"), F.col("key").alias("column"), "value", "kind", F.col("ordinal").alias("place")).join(rows, ["doc_id", "row_id"]).where("column IS NOT NULL")
    first = Window.partitionBy("doc_id", "table_id", "column")
    columns = cells.withColumn("seen", F.min(F.struct("row", "place")).over(first)).select("doc_id", "table_id", "column", "seen").distinct()
    grid = rows.join(columns, ["doc_id", "table_id"])
    own = cells.select("doc_id", "row_id", "column", "value", F.lit(False).alias("missing"))
    return grid.join(own, ["doc_id", "row_id", "column"], "left").select("doc_id", "table_path", "row", "column", "value", F.coalesce("missing", F.lit(True)).alias("missing"))


def graph_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """Graph nodes added, removed and updated (their own scalars changed) between two node tables."""

    def marked(nodes: DataFrame) -> DataFrame:
        own = nodes.where("kind = 'scalar' AND parent_id IS NOT NULL").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.hash(F.sort_array(F.collect_list(F.struct("path_text", "tag", "value")))).alias("content"))
        return graph(nodes)[0].join(own, ["doc_id", "node_id"], "left").select("doc_id", "path_text", "shape", F.coalesce("content", F.lit(0)).alias("content"))

    a = marked(old).withColumnsRenamed({"content": "content_old"}).withColumn("old", F.lit(True))
    b = marked(new).withColumnsRenamed({"content": "content_new"}).withColumn("new", F.lit(True))
    both = a.join(b, ["doc_id", "path_text", "shape"], "full")
    op = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("content_old") != F.col("content_new"), "updated")
    return both.withColumn("op", op).where("op IS NOT NULL").select("doc_id", "path_text", "shape", "op")
