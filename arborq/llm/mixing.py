"""Mixing sources to target weights by hierarchical budgeting (operator 10).

The budget flows down a tree of domain, language and source by weight. What a node cannot use is offered to its
siblings, by weight, before its parent hands anything back to its own siblings. A leaf's target is then met from seeded
epochs: whole ones first, and of the last one the documents in front by a seeded order, up to the one that reaches it.

All but the tree is DataFrame operations. The tree has the leaves that the weights name (others fall to "*"), so its
size is that of the weights and not of the data. A leaf's order is dealt into 4096 buckets whose sums tell in which
bucket the target is reached, and only that bucket is ordered exactly: no leaf, however large, goes through one task.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborq.llm import common

REST = "*"


@dataclass
class Node:
    """weight: among siblings. children: by name; REST stands for all names that are not listed."""

    weight: int
    children: dict[str, "Node"] = field(default_factory=dict)


#: Production weights: sources by domain, then languages, then sources; src0 is a crawl that would otherwise swamp the rest.
DOMAINS = {f"src{k}": "web" if k < 10 else "library" for k in range(20)}


def production_tree() -> Node:
    def languages(sources: dict[str, int]) -> dict[str, Node]:
        weights = {"en": 50, "de": 15, "fr": 15, "es": 10, REST: 10}
        return {lang: Node(w, {s: Node(x) for s, x in sources.items()}) for lang, w in weights.items()}

    web, library = {f"src{k}": 2 if k == 0 else 1 for k in range(10)}, {f"src{k}": 1 for k in range(10, 20)}
    return Node(1, {"web": Node(60, languages(web | {REST: 1})), "library": Node(35, languages(library | {REST: 1})), REST: Node(5, languages({REST: 1}))})


def leaves(tree: Node) -> list[tuple[str, ...]]:
    if not tree.children:
        return [()]
    return [(name, *path) for name, child in tree.children.items() for path in leaves(child)]


def share(amount: int, weights: list[int], capacities: list[int]) -> list[int]:
    """amount over the children by weight, none above its capacity: water-filling in whole numbers.

    What full children cannot take goes to the others by weight, round after round. Fractions of a token go to the
    largest remainders, the first of equals. Children of weight 0 get nothing.
    """
    given = [0] * len(weights)
    open_ = [k for k, (w, c) in enumerate(zip(weights, capacities, strict=True)) if w > 0 and c > 0]
    left = amount
    while left > 0 and open_:
        total = sum(weights[k] for k in open_)
        full = [k for k in open_ if Fraction(left * weights[k], total) >= capacities[k] - given[k]]
        if full:
            for k in full:
                left -= capacities[k] - given[k]
                given[k] = capacities[k]
            open_ = [k for k in open_ if k not in full]
            continue
        parts = [(left * weights[k] // total, left * weights[k] % total) for k in open_]
        rest = left - sum(p for p, _ in parts)
        order = sorted(range(len(open_)), key=lambda i: (-parts[i][1], i))
        for n, i in enumerate(order):
            given[open_[i]] += parts[i][0] + (n < rest)
        left = 0
    return given


def budget(tree: Node, supply: dict[tuple[str, ...], int], amount: int, epochs: int) -> dict[tuple[str, ...], int]:
    """Each leaf's target. A leaf can give its supply `epochs` times; a node, what its leaves can give together."""

    def capacity(node: Node, path: tuple[str, ...]) -> int:
        if not node.children:
            return supply.get(path, 0) * epochs
        return sum(capacity(child, (*path, name)) for name, child in node.children.items())

    out: dict[tuple[str, ...], int] = {}

    def give(node: Node, path: tuple[str, ...], n: int) -> None:
        if not node.children:
            out[path] = n
            return
        names = list(node.children)
        parts = share(n, [node.children[x].weight for x in names], [capacity(node.children[x], (*path, x)) for x in names])
        for name, part in zip(names, parts, strict=True):
            give(node.children[name], (*path, name), part)

    give(tree, (), min(amount, capacity(tree, ())))
    return out


def estimated_tokens(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up; null and empty texts have none."""
    return F.coalesce(F.floor((F.octet_length(text) + 3) / 4), F.lit(0)).cast("long")


def leaf_of(tree: Node, names: list[Column]) -> Column:
    """The number of a row's leaf in leaves(tree), at each level by name or else under REST; null where there is neither.

    The tree goes into the plan as one literal map from path to number.
    """
    every = leaves(tree)
    found = {p: k for k, p in enumerate(every)}
    nodes = {p[:n] for p in every for n in range(1, len(p) + 1)}
    path: Column = F.lit("")
    inner = F.create_map(*[F.lit(x) for p in sorted(nodes) for x in ("".join(f"{len(s)}:{s}/" for s in p), True)])
    for c in names:
        name = F.coalesce(c.cast("string"), F.lit(REST))
        own = F.concat(path, F.length(name).cast("string"), F.lit(":"), name, F.lit("/"))
        path = F.when(F.coalesce(F.try_element_at(inner, own), F.lit(False)), own).otherwise(F.concat(path, F.lit(f"{len(REST)}:{REST}/")))
    ends = F.create_map(*[F.lit(x) for p, k in found.items() for x in ("".join(f"{len(s)}:{s}/" for s in p), k)])
    return F.try_element_at(ends, path)


def named(mapping: dict[str, str], c: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), c), F.lit(REST)) if mapping else F.lit(REST)


def mix(docs: DataFrame, tree: Node, levels: list[Column], amount: int | None = None, fraction: float = 0.5, epochs: int = 2, seed: int = 17, tokens: Column | None = None) -> DataFrame:
    """docs (doc_id and text among its columns) as the mixture has them, with __leaf, __tokens and __copies.

    levels: a row's name at each level of the tree. amount: tokens in all, or else `fraction` of what docs have. A
    document in c epochs has __copies = c; documents in none are left out. Rows with a null level count under REST;
    rows with no leaf in the tree are left out, as their weight is 0. Null and empty texts have no tokens: they come in
    whole epochs only. Equal rows have one place in the order and come or go together. Empty tables give empty results.
    """
    tokens = tokens if tokens is not None else estimated_tokens(F.col("text"))
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.withColumns({"__leaf": leaf_of(tree, levels), "__tokens": tokens}).where("__leaf IS NOT NULL")
    every = leaves(tree)
    supply = {every[r[0]]: r[1] for r in rows.groupBy("__leaf").agg(F.sum("__tokens")).collect()}  # a row a leaf of the tree
    target = budget(tree, supply, int(sum(supply.values()) * fraction) if amount is None else amount, epochs)
    plan = []
    for k, path in enumerate(every):
        whole, rest = divmod(target.get(path, 0), supply[path]) if supply.get(path) else (0, 0)
        plan.append((k, whole, rest))
    planned = F.broadcast(docs.sparkSession.createDataFrame(plan, "__leaf int, __whole int, __rest long"))  # a row a leaf of the tree
    rows = rows.join(planned, "__leaf")
    # the seeded order of the epoch that is taken in part: 32 hexadecimal digits, the first three of them the bucket
    rows = rows.withColumn("__order", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("__whole").cast("string"), ident)))
    part = rows.where("__rest > 0").select("__leaf", "__rest", "__tokens", "__order", F.substring("__order", 1, 3).alias("__bucket"))
    before = Window.partitionBy("__leaf").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = part.groupBy("__leaf", "__rest", "__bucket").agg(F.sum("__tokens").alias("__n"))  # at most 4096 rows a leaf
    reached = sums.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).where("__before < __rest AND __before + __n >= __rest")
    edge = reached.select("__leaf", "__bucket", "__before")
    within = Window.partitionBy("__leaf").orderBy("__order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = (
        part.join(F.broadcast(edge), ["__leaf", "__bucket"])  # a row a leaf of the tree
        .groupBy("__leaf", "__rest", "__before", "__order")  # equal rows are one step of the order
        .agg(F.sum("__tokens").alias("__tokens"))
        .withColumn("__through", F.col("__before") + F.sum("__tokens").over(within))
        .where("__through >= __rest")
        .groupBy("__leaf")
        .agg(F.min("__order").alias("__last"))
    )
    out = rows.join(F.broadcast(last), "__leaf", "left")
    copies = F.col("__whole") + F.when((F.col("__rest") > 0) & (F.col("__order") <= F.col("__last")), 1).otherwise(0)
    return out.withColumn("__copies", copies).where("__copies > 0").drop("__whole", "__rest", "__order", "__last")


def mixture(docs: DataFrame, **settings) -> DataFrame:
    """mix() with the production tree over the columns source and lang."""
    levels = [named(DOMAINS, F.col("source")), F.col("lang"), F.col("source")]
    return mix(docs, production_tree(), levels, **settings)


def op10_hierarchical_mix(spark, sf_dir: str) -> DataFrame:
    """All of documents at half their tokens: each document of the mixture, its leaf, tokens and copies."""
    every = leaves(production_tree())
    names = F.array(*[F.lit("/".join(p)) for p in every])
    mixed = mixture(common.table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", F.element_at(names, F.col("__leaf") + 1).alias("leaf"), F.col("__tokens").alias("n_tokens"), F.col("__copies").alias("copies"))
