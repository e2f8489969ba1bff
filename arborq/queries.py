"""The queries of the engine's own operators: an expression over a table, with SQL that says the same."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborq.functions import previews
from arborq.plans import query
from arborq.sources import documents, nodes
from arborq.streaming import chunks

ORDERS, LINES, PARTS, EVENTS, NATIONS, REGIONS, CUSTOMERS = (
    ("orders", ("o_orderkey",)),
    ("lineitem", ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")),
    ("part", ("p_partkey",)),
    ("events", ("event_id",)),
    ("nation", ("n_nationkey",)),
    ("region", ("r_regionkey",)),
    ("customer", ("c_custkey",)),
)


@dataclass(frozen=True)
class Query:
    table: tuple[str, tuple[str, ...]]
    expression: str
    sql: str | None
    digits: dict[str, int] = field(default_factory=dict)
    ordered: bool = False

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        name, order = self.table
        out = query(spark.read.parquet(f"{sf_dir}/{name}.parquet"), self.expression, order, self.ordered)
        return out.withColumns({c: F.round(c, n) for c, n in self.digits.items()}) if self.digits else out


EXPRESSIONS: dict[str, Query] = {
    # composition
    "pipe": Query(ORDERS, ".[] | .o_orderkey | {k: ., twice: . * 2}", "SELECT o_orderkey AS k, o_orderkey * 2 AS twice FROM orders"),
    "self_reference": Query(REGIONS, ".", "SELECT * FROM region"),
    "literal_value": Query(REGIONS, '.[] | {k: .r_regionkey, one: 1, half: 0.5, word: "w", yes: true}', "SELECT r_regionkey AS k, 1::BIGINT AS one, 0.5::DOUBLE AS half, 'w' AS word, true AS yes FROM region"),
    "union_matches": Query(ORDERS, ".[] | (.o_orderkey, .o_custkey)", "SELECT o_orderkey AS value FROM orders UNION ALL SELECT o_custkey FROM orders"),
    "block": Query(ORDERS, ".[] | {k: .o_orderkey, v: (.o_custkey; .o_totalprice)}", "SELECT o_orderkey AS k, o_totalprice AS v FROM orders"),
    "empty": Query(ORDERS, ".[] | {k: .o_orderkey, e: ([] | length)}", "SELECT o_orderkey AS k, 0::BIGINT AS e FROM orders"),
    "empty_rows": Query(REGIONS, ".[] | select(.r_regionkey > 1) | empty | .r_name", "SELECT r_name AS value FROM region WHERE false"),
    "comments_and_groups": Query(ORDERS, ".[] # rows\n | {v: (.o_orderkey + 1) * 2}", "SELECT (o_orderkey + 1) * 2 AS v FROM orders"),
    # traversal
    "traverse_path": Query(LINES, ".[] | .l_orderkey", "SELECT l_orderkey AS value FROM lineitem"),
    "traverse_optional": Query(NATIONS, ".[] | {k: .n_nationkey, none: .absent? // \"none\"}", "SELECT n_nationkey AS k, 'none' AS none FROM nation"),
    "glob_keys": Query(NATIONS, '.[] | {k: .n_nationkey, n: ([.n_*key] | length), s: ([.n_*key] | .[1])}', "SELECT n_nationkey AS k, 2::BIGINT AS n, n_regionkey AS s FROM nation"),
    "splat": Query(PARTS, '.[] | (.p_name / " ") | .[]', "SELECT unnest(string_split(p_name, ' ')) AS value FROM part"),
    "splat_mapping": Query(NATIONS, ".[] | pick(\"n_nationkey\", \"n_regionkey\") | .[]", "SELECT n_nationkey AS value FROM nation UNION ALL SELECT n_regionkey FROM nation"),
    "index": Query(ORDERS, ".[3] | .o_orderkey", "SELECT o_orderkey AS value FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET 3"),
    "index_last": Query(ORDERS, ".[-1] | .o_orderkey", "SELECT o_orderkey AS value FROM orders ORDER BY o_orderkey DESC LIMIT 1"),
    "index_in_array": Query(PARTS, '.[] | {k: .p_partkey, a: (.p_name / " ")[0], z: (.p_name / " ")[-1], o: ((.p_name / " ")[9] // "out")}', "SELECT p_partkey AS k, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[-1] AS z, coalesce(string_split(p_name, ' ')[10], 'out') AS o FROM part"),
    "computed_key": Query(NATIONS, '.[] | .["n_name"]', "SELECT n_name AS value FROM nation"),
    "slice": Query(ORDERS, "sort_by(.o_totalprice) | .[10:20] | map({k: .o_orderkey})", "SELECT o_orderkey AS k FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10 OFFSET 10"),
    "slice_negative": Query(ORDERS, "sort_by(.o_totalprice) | .[-10:-5] | map({k: .o_orderkey})", "SELECT o_orderkey AS k FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey DESC) AS n FROM orders) WHERE n BETWEEN 6 AND 10"),
    "slice_last": Query(ORDERS, "sort_by(.o_totalprice) | .[-3:] | map({k: .o_orderkey})", "SELECT o_orderkey AS k FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 3"),
    "slice_in_array": Query(PARTS, '.[] | {k: .p_partkey, s: (.p_name / " " | .[0:1] | join("-"))}', "SELECT p_partkey AS k, string_split(p_name, ' ')[1] AS s FROM part"),
    "keys": Query(REGIONS, '.[] | {k: .r_regionkey, names: (keys | join(","))}', "SELECT r_regionkey AS k, 'r_regionkey,r_name' AS names FROM region"),
    "delete": Query(ORDERS, ".[] | del(.o_orderdate, .o_totalprice)", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders"),
    "delpaths": Query(REGIONS, '.[] | delpaths([["r_name"]])', "SELECT r_regionkey FROM region"),
    "setpath": Query(REGIONS, '.[] | setpath(["extra", "deep"]; .r_regionkey) | {k: .r_regionkey, d: .extra.deep}', "SELECT r_regionkey AS k, r_regionkey AS d FROM region"),
    # predicates
    "select_filter": Query(LINES, ".[] | select(.l_quantity > 45) | {k: .l_orderkey, q: .l_quantity}", "SELECT l_orderkey AS k, l_quantity AS q FROM lineitem WHERE l_quantity > 45"),
    "select_flagship": Query(LINES, '.[] | select(.l_quantity > 45 and .l_returnflag == "R") | {k: .l_orderkey, p: .l_extendedprice}', "SELECT l_orderkey AS k, l_extendedprice AS p FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'"),
    "filter": Query(ORDERS, "filter(.o_totalprice > 400000) | map(.o_orderkey)", "SELECT o_orderkey AS value FROM orders WHERE o_totalprice > 400000"),
    "filter_in_array": Query(PARTS, '.[] | {k: .p_partkey, n: (.p_name / " " | filter(. == "*e*") | length)}', "SELECT p_partkey AS k, len([x FOR x IN string_split(p_name, ' ') IF contains(x, 'e')])::BIGINT AS n FROM part"),
    "and_or_not": Query(ORDERS, '.[] | select((.o_orderstatus == "F" or .o_totalprice > 200000) and (.o_orderpriority == "1-URGENT" | not)) | .o_orderkey', "SELECT o_orderkey AS value FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 200000) AND NOT o_orderpriority = '1-URGENT'"),
    "not_prefix": Query(ORDERS, '.[] | select(not (.o_orderstatus == "F")) | .o_orderkey', "SELECT o_orderkey AS value FROM orders WHERE o_orderstatus <> 'F'"),
    "equals": Query(ORDERS, '.[] | select(.o_orderstatus == "O") | .o_orderkey', "SELECT o_orderkey AS value FROM orders WHERE o_orderstatus = 'O'"),
    "not_equals": Query(ORDERS, '.[] | select(.o_orderstatus != "O") | .o_orderkey', "SELECT o_orderkey AS value FROM orders WHERE o_orderstatus <> 'O'"),
    "equals_glob": Query(PARTS, '.[] | select(.p_name == "*e? *") | .p_partkey', "SELECT p_partkey AS value FROM part WHERE p_name LIKE '%e_ %'"),
    "equals_null": Query(ORDERS, ".[] | {k: .o_orderkey, n: (.absent == null)}", "SELECT o_orderkey AS k, true AS n FROM orders"),
    "relational": Query(ORDERS, '.[] | {k: .o_orderkey, a: .o_totalprice < 1e5, b: .o_custkey <= 50, c: .o_orderpriority > "3", d: .o_orderkey >= .o_custkey}', "SELECT o_orderkey AS k, o_totalprice < 1e5 AS a, o_custkey <= 50 AS b, o_orderpriority > '3' AS c, o_orderkey >= o_custkey AS d FROM orders"),
    "any_all": Query(PARTS, '.[] | {k: .p_partkey, y: ([.p_size > 10, .p_size > 40] | any), z: ([.p_size > 10, .p_size > 40] | all)}', "SELECT p_partkey AS k, p_size > 10 AS y, p_size > 40 AS z FROM part"),
    "any_c": Query(ORDERS, "any_c(.o_totalprice > 499000)", "SELECT coalesce(bool_or(o_totalprice > 499000), false) AS value FROM orders"),
    "all_c": Query(ORDERS, "all_c(.o_totalprice > 1000)", "SELECT coalesce(bool_and(o_totalprice > 1000), true) AS value FROM orders"),
    "alternative": Query(ORDERS, '.[] | {k: .o_orderkey, v: (.absent // .o_orderstatus), w: (.o_custkey // 0)}', "SELECT o_orderkey AS k, o_orderstatus AS v, o_custkey AS w FROM orders"),
    "has": Query(NATIONS, '.[] | {k: .n_nationkey, a: has("n_name"), b: has("no"), c: ([1, 2] | has(1)), d: ([1, 2] | has(2))}', "SELECT n_nationkey AS k, true AS a, false AS b, true AS c, false AS d FROM nation"),
    "contains": Query(PARTS, '.[] | {k: .p_partkey, a: (.p_name | contains("e")), b: (.p_name / " " | contains(["large"]))}', "SELECT p_partkey AS k, contains(p_name, 'e') AS a, len([x FOR x IN string_split(p_name, ' ') IF contains(x, 'large')]) > 0 AS b FROM part"),
    # arithmetic
    "add": Query(LINES, ".[] | .l_linenumber + .l_quantity", "SELECT l_linenumber + l_quantity AS value FROM lineitem"),
    "add_null": Query(ORDERS, ".[] | .absent + .o_orderkey", "SELECT o_orderkey AS value FROM orders"),
    "add_text": Query(NATIONS, '.[] | .n_name + "-" + .n_nationkey', "SELECT n_name || '-' || n_nationkey AS value FROM nation"),
    "add_arrays": Query(PARTS, '.[] | {k: .p_partkey, v: ((.p_name / " ") + ["x", "y"] | join(","))}', "SELECT p_partkey AS k, replace(p_name, ' ', ',') || ',x,y' AS v FROM part"),
    "subtract": Query(ORDERS, ".[] | .o_orderkey - .o_custkey - 1", "SELECT o_orderkey - o_custkey - 1 AS value FROM orders"),
    "array_minus": Query(PARTS, '.[] | {k: .p_partkey, v: ((.p_name / " ") - ["large"] | join(" "))}', "SELECT p_partkey AS k, array_to_string([x FOR x IN string_split(p_name, ' ') IF x <> 'large'], ' ') AS v FROM part"),
    "multiply": Query(LINES, ".[] | .l_extendedprice * (1 - .l_discount)", "SELECT l_extendedprice * (1 - l_discount) AS value FROM lineitem"),
    "str_repeat": Query(PARTS, '.[] | "ab" * (.p_size % 3)', "SELECT repeat('ab', p_size % 3) AS value FROM part"),
    "merge_mappings": Query(REGIONS, '.[] | {a: .r_regionkey, b: 1} * {b: .r_name, c: 2}', "SELECT r_regionkey AS a, r_name AS b, 2::BIGINT AS c FROM region"),
    "divide": Query(LINES, ".[] | .l_extendedprice / .l_quantity", "SELECT l_extendedprice / l_quantity AS value FROM lineitem"),
    "divide_by_zero": Query(ORDERS, ".[] | {k: .o_orderkey, v: (1 / (.o_custkey - .o_custkey) // -1)}", "SELECT o_orderkey AS k, -1::DOUBLE AS v FROM orders"),
    "str_split_div": Query(PARTS, '.[] | {k: .p_partkey, n: (.p_name / " " | length)}', "SELECT p_partkey AS k, len(string_split(p_name, ' '))::BIGINT AS n FROM part"),
    "modulo": Query(ORDERS, ".[] | (.o_custkey - 70) % 7", "SELECT (o_custkey - 70) % 7 AS value FROM orders"),
    # updates
    "assign": Query(ORDERS, '.[] | .o_totalprice = 0 | .flag = "new" | pick("o_orderkey", "o_totalprice", "flag")', "SELECT o_orderkey, 0::BIGINT AS o_totalprice, 'new' AS flag FROM orders"),
    "update_assign": Query(LINES, ".[] | .l_quantity |= . + 1 | pick(\"l_orderkey\", \"l_quantity\")", "SELECT l_orderkey, l_quantity + 1 AS l_quantity FROM lineitem"),
    "add_assign": Query(ORDERS, ".[] | .o_custkey += 10 | pick(\"o_orderkey\", \"o_custkey\")", "SELECT o_orderkey, o_custkey + 10 AS o_custkey FROM orders"),
    "subtract_assign": Query(ORDERS, ".[] | .o_custkey -= .o_orderkey | pick(\"o_orderkey\", \"o_custkey\")", "SELECT o_orderkey, o_custkey - o_orderkey AS o_custkey FROM orders"),
    "multiply_assign": Query(ORDERS, ".[] | .o_custkey *= 3 | pick(\"o_orderkey\", \"o_custkey\")", "SELECT o_orderkey, o_custkey * 3 AS o_custkey FROM orders"),
    "selective_update": Query(ORDERS, '(.[] | select(.o_orderstatus == "F") | .o_totalprice) |= . * 2 | map(pick("o_orderkey", "o_totalprice"))', "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders"),
    "with_update": Query(ORDERS, 'with(.[]; .o_custkey = .o_custkey + .o_orderkey) | map(pick("o_orderkey", "o_custkey"))', "SELECT o_orderkey, o_custkey + o_orderkey AS o_custkey FROM orders"),
    "nested_update": Query(REGIONS, '.[] | {k: .r_regionkey, a: {b: {c: 1}}} | .a.b.c |= . + 1 | {k: .k, v: .a.b.c}', "SELECT r_regionkey AS k, 2::BIGINT AS v FROM region"),
    # construction
    "object_construct": Query(LINES, ".[] | {k: .l_orderkey, q: .l_quantity}", "SELECT l_orderkey AS k, l_quantity AS q FROM lineitem"),
    "object_cartesian": Query(REGIONS, ".[] | {k: .r_regionkey, v: (1, 2)}", "SELECT r_regionkey AS k, v::BIGINT AS v FROM region, (VALUES (1), (2)) t(v)"),
    "collect_array": Query(ORDERS, "group_by(.o_custkey) | map({c: .[0].o_custkey, keys: (map(.o_orderkey) | join(\",\"))})", "SELECT o_custkey AS c, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS keys FROM orders GROUP BY o_custkey"),
    "map": Query(PARTS, '.[] | {k: .p_partkey, v: (.p_name / " " | map(. + "!") | join(" "))}', "SELECT p_partkey AS k, replace(p_name, ' ', '! ') || '!' AS v FROM part"),
    "map_fused": Query(ORDERS, "map(.o_orderkey) | map(. + 1) | map(. * 2)", "SELECT (o_orderkey + 1) * 2 AS value FROM orders"),
    "map_values": Query(NATIONS, '.[] | pick("n_nationkey", "n_regionkey") | map_values(. + 1)', "SELECT n_nationkey::BIGINT + 1 AS n_nationkey, n_regionkey::BIGINT + 1 AS n_regionkey FROM nation"),
    "pick": Query(PARTS, '.[] | pick("p_brand", "p_partkey")', "SELECT p_brand, p_partkey FROM part"),
    "omit": Query(REGIONS, '.[] | omit("r_name")', "SELECT r_regionkey FROM region"),
    "compact": Query(ORDERS, '.[] | {k: .o_orderkey, v: (["", .o_orderstatus, null, "x"] | compact | join(","))}', "SELECT o_orderkey AS k, o_orderstatus || ',x' AS v FROM orders"),
    "flatten": Query(PARTS, '.[] | {k: .p_partkey, v: ([[.p_name], [.p_brand, "z"]] | flatten | join("/"))}', "SELECT p_partkey AS k, p_name || '/' || p_brand || '/z' AS v FROM part"),
    "flatten_depth": Query(PARTS, '.[] | {k: .p_partkey, n: ([[[1, 2]], [[.p_size]]] | flatten(1) | length), m: ([[[1, 2]], [[.p_size]]] | flatten | length)}', "SELECT p_partkey AS k, 2::BIGINT AS n, 3::BIGINT AS m FROM part"),
    "unique": Query(ORDERS, "map(.o_orderstatus) | unique", "SELECT DISTINCT o_orderstatus AS value FROM orders"),
    "unique_in_array": Query(PARTS, '.[] | {k: .p_partkey, v: ([.p_size % 3, .p_size % 2, .p_size % 3] | unique | length)}', "SELECT p_partkey AS k, CASE WHEN p_size % 3 = p_size % 2 THEN 1 ELSE 2 END::BIGINT AS v FROM part"),
    "unique_by": Query(ORDERS, "unique_by(.o_custkey) | map({c: .o_custkey, k: .o_orderkey})", "SELECT o_custkey AS c, min(o_orderkey) AS k FROM orders GROUP BY o_custkey"),
    "group_by": Query(ORDERS, "group_by(.o_orderpriority) | map({p: .[0].o_orderpriority, n: length, s: (.[] as $x reduce (0; . + $x.o_totalprice)), lo: (map(.o_totalprice) | min), hi: (map(.o_totalprice) | max)})", "SELECT o_orderpriority AS p, count(*) AS n, round(sum(o_totalprice), 2) AS s, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY o_orderpriority", {"s": 2}),
    "group_by_members": Query(ORDERS, "group_by(.o_orderpriority) | map({p: .[0].o_orderpriority, k: (map(.o_orderkey) | .[0:3] | join(\",\"))})", "SELECT o_orderpriority AS p, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS k FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS n FROM orders) WHERE n <= 3 GROUP BY o_orderpriority"),
    "group_by_distinct": Query(ORDERS, "group_by(.o_orderstatus) | map({s: .[0].o_orderstatus, n: (map(.o_custkey) | unique | length), big: (map(select(.o_totalprice > 300000)) | length), some: any_c(.o_totalprice > 490000)})", "SELECT o_orderstatus AS s, count(DISTINCT o_custkey) AS n, count(*) FILTER (o_totalprice > 300000) AS big, bool_or(o_totalprice > 490000) AS some FROM orders GROUP BY o_orderstatus"),
    "group_count": Query(ORDERS, "group_by(.o_custkey) | length", "SELECT count(DISTINCT o_custkey) AS value FROM orders"),
    "group_in_array": Query(PARTS, '.[] | {k: .p_partkey, n: ([1, 2, 1, .p_size % 2] | group_by(.) | length)}', "SELECT p_partkey AS k, CASE WHEN p_size % 2 = 1 THEN 2 ELSE 3 END::BIGINT AS n FROM part"),
    "to_entries": Query(NATIONS, '.[] | pick("n_nationkey", "n_regionkey") | to_entries | .[]', "SELECT 'n_nationkey' AS key, n_nationkey AS value FROM nation UNION ALL SELECT 'n_regionkey', n_regionkey FROM nation"),
    "to_entries_sequence": Query(PARTS, '.[] | (.p_name / " ") | to_entries | .[]', "SELECT (i - 1)::BIGINT AS key, string_split(p_name, ' ')[i] AS value FROM part, unnest(range(1, len(string_split(p_name, ' ')) + 1)) t(i)"),
    "from_entries": Query(PARTS, '.[] | {k: .p_partkey, v: ([{key: "n", value: .p_name}, {key: "b", value: .p_brand}] | from_entries | .b)}', "SELECT p_partkey AS k, p_brand AS v FROM part"),
    "with_entries": Query(NATIONS, '.[] | {k: .n_nationkey, v: (pick("n_nationkey", "n_regionkey") | with_entries({key: ("x_" + .key), value: (.value + 1)}) | .x_n_regionkey)}', "SELECT n_nationkey AS k, n_regionkey::BIGINT + 1 AS v FROM nation"),
    "array_to_map": Query(PARTS, '.[] | {k: .p_partkey, v: (.p_name / " " | array_to_map | .["1"])}', "SELECT p_partkey AS k, string_split(p_name, ' ')[2] AS v FROM part"),
    "first": Query(ORDERS, "sort_by(.o_totalprice) | first | .o_orderkey", "SELECT o_orderkey AS value FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1"),
    "first_pred": Query(ORDERS, "first(.o_totalprice > 300000) | .o_orderkey", "SELECT o_orderkey AS value FROM orders WHERE o_totalprice > 300000 ORDER BY o_orderkey LIMIT 1"),
    "length": Query(ORDERS, "length", "SELECT count(*) AS value FROM orders"),
    "length_fused": Query(LINES, "[.[] | select(.l_discount > 0.05)] | length", "SELECT count(*) AS value FROM lineitem WHERE l_discount > 0.05"),
    "length_text": Query(PARTS, ".[] | {k: .p_partkey, n: (.p_name | length), m: (.absent | length)}", "SELECT p_partkey AS k, length(p_name) AS n, 0::BIGINT AS m FROM part"),
    "reverse": Query(ORDERS, "reverse | map(.o_orderkey)", "SELECT o_orderkey AS value FROM orders ORDER BY o_orderkey DESC", ordered=True),
    "reverse_array": Query(PARTS, '.[] | {k: .p_partkey, v: (.p_name / " " | reverse | join(" "))}', "SELECT p_partkey AS k, array_to_string(list_reverse(string_split(p_name, ' ')), ' ') AS v FROM part"),
    # folds
    "min": Query(ORDERS, "map(.o_totalprice) | min", "SELECT min(o_totalprice) AS value FROM orders"),
    "max": Query(ORDERS, "map(.o_orderpriority) | max", "SELECT max(o_orderpriority) AS value FROM orders"),
    "min_max_array": Query(PARTS, ".[] | {k: .p_partkey, a: ([.p_size, 20] | min), b: ([.p_size, 20] | max)}", "SELECT p_partkey AS k, least(p_size, 20)::BIGINT AS a, greatest(p_size, 20)::BIGINT AS b FROM part"),
    "min_with_nulls": Query(PARTS, ".[] | {k: .p_partkey, a: ([.p_size, 20, null] | min), b: ([.p_size, 20, null] | max)}", "SELECT p_partkey AS k, NULL::BIGINT AS a, greatest(p_size, 20)::BIGINT AS b FROM part"),
    "reduce_sum": Query(EVENTS, ".[] as $x reduce (0; . + $x.value)", "SELECT round(sum(value), 4) AS value FROM events", {"value": 4}),
    "reduce_fold": Query(PARTS, '.[] | {k: .p_partkey, v: ((.p_name / " ") | .[] as $w reduce (""; . + ($w | length) + ","))}', "SELECT p_partkey AS k, array_to_string([length(x)::VARCHAR || ',' FOR x IN string_split(p_name, ' ')], '') AS v FROM part"),
    "reduce_ordered": Query(EVENTS, ".[] as $x reduce (1; . * 3 % 1000003 + $x.event_id)", "SELECT list_reduce(list_prepend(1::BIGINT, list(event_id::BIGINT ORDER BY event_id)), lambda a, x: a * 3 % 1000003 + x) AS value FROM events"),
    # order
    "sort": Query(ORDERS, "map(.o_totalprice) | sort", "SELECT o_totalprice AS value FROM orders ORDER BY o_totalprice", ordered=True),
    "sort_array": Query(PARTS, '.[] | {k: .p_partkey, v: (.p_name / " " | sort | join(" "))}', "SELECT p_partkey AS k, array_to_string(list_sort(string_split(p_name, ' ')), ' ') AS v FROM part"),
    "sort_by": Query(ORDERS, "sort_by(.o_orderpriority) | map(.o_orderkey)", "SELECT o_orderkey AS value FROM orders ORDER BY o_orderpriority, o_orderkey", ordered=True),
    "sort_by_multi": Query(ORDERS, "sort_by(.o_orderstatus, .o_totalprice) | map(.o_orderkey)", "SELECT o_orderkey AS value FROM orders ORDER BY o_orderstatus, o_totalprice, o_orderkey", ordered=True),
    "sort_by_places": Query(NATIONS, "sort_by(.n_name) | to_entries | map({i: .key, k: .value.n_nationkey})", "SELECT row_number() OVER (ORDER BY n_name, n_nationkey) - 1 AS i, n_nationkey AS k FROM nation"),
    "sort_by_array": Query(PARTS, '.[] | {k: .p_partkey, v: ([{a: 2, b: .p_name}, {a: 1, b: .p_brand}] | sort_by(.a) | map(.b) | join(","))}', "SELECT p_partkey AS k, p_brand || ',' || p_name AS v FROM part"),
    "topk": Query(LINES, "sort_by(.l_extendedprice) | reverse | .[0:10] | map(.l_extendedprice)", "SELECT l_extendedprice AS value FROM lineitem ORDER BY l_extendedprice DESC LIMIT 10"),
    "sort_keys": Query(NATIONS, '.[] | {b: .n_name, a: .n_nationkey} | sort_keys(.) | keys | join(",")', "SELECT 'a,b' AS value FROM nation"),
    "shuffle": Query(REGIONS, "shuffle", "SELECT * FROM region"),
    # texts
    "join": Query(REGIONS, 'map(.r_name) | join(";")', "SELECT string_agg(r_name, ';' ORDER BY r_regionkey) AS value FROM region"),
    "split": Query(PARTS, '.[] | {k: .p_partkey, v: (.p_brand | split("#") | .[1])}', "SELECT p_partkey AS k, string_split(p_brand, '#')[2] AS v FROM part"),
    "sub": Query(PARTS, '.[] | {k: .p_partkey, v: (.p_name | sub("[aeiou]"; "<$0>"))}', "SELECT p_partkey AS k, regexp_replace(p_name, '([aeiou])', '<\\1>', 'g') AS v FROM part"),
    "match_string": Query(PARTS, '.[] | .p_name | match("[aeiou](.)") | {s: .string, o: .offset, n: .length, c: .captures[0].string}', "SELECT m AS s, (instr(p_name, m) - 1)::BIGINT AS o, 2::BIGINT AS n, m[2] AS c FROM (SELECT p_name, regexp_extract(p_name, '[aeiou].') AS m FROM part) WHERE m <> ''"),
    "match_global": Query(PARTS, '.[] | .p_name | match("[aeiou](?P<next>.)"; "g") | {s: .string, o: .offset, n: .length, c: .captures[0].string, co: .captures[0].offset, cn: .captures[0].name}', "SELECT s, o, 2::BIGINT AS n, s[2] AS c, CASE WHEN s[1] = s[2] THEN o ELSE o + 1 END AS co, 'next' AS cn FROM (SELECT string_split(part, chr(2))[1] AS s, no, sum(length(replace(part, chr(2), ''))) OVER (PARTITION BY p_partkey ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::BIGINT AS o FROM (SELECT p_partkey, unnest(parts) AS part, generate_subscripts(parts, 1) AS no FROM (SELECT p_partkey, string_split(regexp_replace(p_name, '([aeiou].)', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS parts FROM part))) WHERE no > 1"),
    "capture": Query(PARTS, '.[] | .p_name | capture("(?P<first>[a-z]+) (?P<second>[a-z]+)") | {a: .first, b: .second, z: .["0"]}', "SELECT regexp_extract(p_name, '([a-z]+) ([a-z]+)', 1) AS a, regexp_extract(p_name, '([a-z]+) ([a-z]+)', 2) AS b, regexp_extract(p_name, '([a-z]+) ([a-z]+)') AS z FROM part WHERE regexp_matches(p_name, '([a-z]+) ([a-z]+)')"),
    "capture_global": Query(PARTS, '.[] | .p_name | capture("(?P<a>[a-z])(?P<b>[a-z]+)"; "g") | {a: .a, b: .b}', "SELECT w[1] AS a, w[2:] AS b FROM (SELECT unnest(regexp_extract_all(p_name, '[a-z][a-z]+')) AS w FROM part)"),
    "test": Query(PARTS, '.[] | select(.p_name | test("^[a-l]+ ")) | .p_partkey', "SELECT p_partkey AS value FROM part WHERE regexp_matches(p_name, '^[a-l]+ ')"),
    "upcase": Query(PARTS, ".[] | .p_name | upcase", "SELECT upper(p_name) AS value FROM part"),
    "downcase": Query(PARTS, ".[] | .p_brand | downcase", "SELECT lower(p_brand) AS value FROM part"),
    "trim": Query(PARTS, '.[] | ("  " + .p_name + " \\t\\n") | trim', "SELECT p_name AS value FROM part"),
    "to_string": Query(ORDERS, ".[] | .o_orderkey | to_string", "SELECT o_orderkey::VARCHAR AS value FROM orders"),
    "to_number": Query(PARTS, '.[] | .p_brand | sub("[^0-9]"; "") | to_number', "SELECT regexp_replace(p_brand, '[^0-9]', '', 'g')::DOUBLE AS value FROM part"),
    "interpolation": Query(NATIONS, '.[] | "\\(.n_name) is \\(.n_nationkey + 1)"', "SELECT n_name || ' is ' || (n_nationkey + 1) AS value FROM nation"),
    # metadata, variables, codecs
    "tag": Query(ORDERS, ".[] | {k: .o_orderkey, a: (.o_orderkey | tag), b: (.o_totalprice | tag), c: (.o_orderstatus | type), d: (.absent | tag)}", "SELECT o_orderkey AS k, '!!int' AS a, '!!float' AS b, '!!str' AS c, '!!null' AS d FROM orders"),
    "kind": Query(ORDERS, ".[] | {k: .o_orderkey, a: kind, b: (.o_orderkey | kind), c: ([1] | kind)}", "SELECT o_orderkey AS k, 'map' AS a, 'scalar' AS b, 'seq' AS c FROM orders"),
    "variables_bind": Query(NATIONS, ".[] | .n_regionkey as $r | {k: .n_nationkey, v: ($r * 100 + .n_nationkey)}", "SELECT n_nationkey AS k, n_regionkey::BIGINT * 100 + n_nationkey AS v FROM nation"),
    "variables_rows": Query(REGIONS, ".[].r_regionkey as $r | .[] | {name: .r_name, r: $r}", "SELECT b.r_name AS name, a.r_regionkey AS r FROM region a, region b"),
    "variables_loop": Query(PARTS, '.[] | (.p_name / " ") as $w | {k: .p_partkey, n: ($w | length)}', "SELECT p_partkey AS k, len(string_split(p_name, ' '))::BIGINT AS n FROM part"),
    "table_variable": Query(ORDERS, "(map(.o_totalprice) | max) as $m | map(select(.o_totalprice * 2 > $m * 1.99)) | map(.o_orderkey)", "SELECT o_orderkey AS value FROM orders WHERE o_totalprice * 2 > (SELECT max(o_totalprice) FROM orders) * 1.99"),
    "cross_product": Query(REGIONS, ".[] | (.r_regionkey, 10) + (1, 2)", "SELECT a + b AS value FROM (SELECT r_regionkey::BIGINT AS a FROM region UNION ALL SELECT 10 FROM region) , (VALUES (1::BIGINT), (2::BIGINT)) t(b)"),
    "decode_json": Query(EVENTS, ".[] | {id: .event_id, k: (.props | from_json | .k | to_number)}", "SELECT event_id AS id, json_extract(props, '$.k')::DOUBLE AS k FROM events"),
    "encode_json": Query(NATIONS, '.[] | pick("n_nationkey", "n_name") | to_json', "SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS value FROM nation"),
    "encode_csv": Query(NATIONS, '.[] | pick("n_nationkey", "n_name") | @csv', "SELECT n_nationkey || ',' || n_name AS value FROM nation"),
    "round_trip_json": Query(NATIONS, '.[] | {k: .n_nationkey, v: (pick("n_name") | to_json | from_json | .n_name | to_string)}', "SELECT n_nationkey AS k, n_name AS v FROM nation"),
    "encode_base64": Query(NATIONS, ".[] | {a: (.n_name | @base64), b: (.n_name | @base64 | @base64d)}", "SELECT base64(n_name::BLOB) AS a, n_name AS b FROM nation"),
    "encode_uri": Query(PARTS, ".[] | .p_name | @uri", "SELECT url_encode(p_name) AS value FROM part"),
}


def nation_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return nodes.typed_nodes(df, "n_nationkey", ["n_nationkey", "n_name", "n_regionkey"])


def prop_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties as documents {"id": …, "tags": ["a", <type>], "props": {…}}."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    doc = F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "tags": ["a", "'), F.col("event_type"), F.lit('"], "props": '), F.col("props"), F.lit("}"))
    return events.select(F.col("event_id").alias("doc_id"), doc.alias("text"))


NATION_SCALARS = "SELECT n_nationkey::BIGINT AS doc_id, 'n_nationkey' AS key, n_nationkey::VARCHAR AS value, '!!int' AS tag FROM nation UNION ALL SELECT n_nationkey, 'n_name', n_name, '!!str' FROM nation UNION ALL SELECT n_nationkey, 'n_regionkey', n_regionkey::VARCHAR, '!!int' FROM nation"
TREE = "SELECT event_id AS doc_id, event_type AS t, json_extract_string(props, '$.k') AS k FROM events"


def node_query(f, places: bool = False):
    return lambda spark, sf_dir: f(nodes.node_table(prop_texts(spark, sf_dir), places=places))


def evaluated(expression: str, *columns: str):
    return lambda spark, sf_dir: documents.evaluate(prop_texts(spark, sf_dir), expression).select(*(columns or ("doc_id", "value")))


def converted(target: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        there = documents.convert(prop_texts(spark, sf_dir), "json", target)
        back = documents.convert(there.select("doc_id", "text"), target, "json", indent=0)
        return documents.evaluate(back, "[.id, .props.k]").select("doc_id", "value")

    return run


def csv_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    text = F.concat(F.lit("id,name,region\n"), F.col("n_nationkey").cast("string"), F.lit(',"'), F.col("n_name"), F.lit(', x",'), F.col("n_regionkey").cast("string"))
    return documents.evaluate(n.select(F.col("n_nationkey").cast("long").alias("doc_id"), text.alias("text")), ".[0] | [.id, .name]", source="csv").select("doc_id", "value")


def orders_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), "o_orderkey", "o_custkey", "o_orderstatus")
    new = o.where("o_orderkey % 10 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")))
    names = ["o_orderkey", "o_custkey", "o_orderstatus"]
    return nodes.typed_nodes(o, "id", names), nodes.typed_nodes(new, "id", names)


def diff_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.diff(*orders_versions(spark, sf_dir)).select("doc_id", "path_text", "op")


def diff_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequence with an element put in front, one changed inside and one at the end taken away."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("doc_id"), F.col("o_orderkey").cast("string").alias("k"))
    element = lambda x: F.concat(F.lit('{"k":'), F.col("k"), F.lit(f',"n":{x}}}'))
    old = F.concat(F.lit('{"a":['), *[p for x in range(4) for p in (element(x), F.lit(","))], F.lit('"end"],"b":[1,2]}'))
    new = F.concat(F.lit('{"b":[1,3],"a":["front",'), *[p for x in range(4) for p in (element(x), F.lit("," if x < 3 else "]}"))])
    return nodes.diff_texts(o.select("doc_id", old.alias("text")), o.select("doc_id", new.alias("text")))


def same_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.same_structure(*orders_versions(spark, sf_dir))


def delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.graph_delta(*orders_versions(spark, sf_dir)).select("doc_id", "op")


def inline_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.with_inline(nodes.diff(*orders_versions(spark, sf_dir)))


def line_diff(spark: SparkSession, sf_dir: str, method: str = "myers") -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("doc_id"), "p_name", "p_brand")
    old = p.select("doc_id", F.concat_ws("\n", F.lit("a"), F.col("p_name"), F.lit("z")).alias("text"))
    new = p.select("doc_id", F.concat_ws("\n", F.lit("a"), F.col("p_brand"), F.lit("z"), F.lit("end")).alias("text"))
    return nodes.diff_lines(old, new, method)


def histogram_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_diff(spark, sf_dir, "histogram")


def preview_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text of every kind for each nation."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    name = F.lower(F.regexp_replace("n_name", "[^A-Za-z]", "-"))
    texts = [F.concat(F.lit("https://a.b/"), name, F.lit(".png")), F.concat(F.lit("https://a.b/"), name, F.lit("?d=1")), F.lit("#ff00aa"), F.lit("eyJhbGciOiJub25lIn0.eyJhIjoxfQ."), F.concat(name, F.lit("%20b")), F.concat(name, F.lit("\\u0041")), F.lit("2024-01-02T03:04:05Z"), F.lit("two words")]
    rows = n.select("n_nationkey", F.posexplode(F.array(*texts)).alias("no", "t"))
    return rows.select("n_nationkey", "no", F.coalesce(previews.preview_kind(F.col("t")), F.lit("none")).alias("kind"))


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as documents, cut into chunks of 5 bytes, through the streaming operator: a file source, state by document,
    a file sink, and the latest snapshots of what came out."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    text = F.concat(F.lit('{"id": '), F.col("n_nationkey").cast("string"), F.lit(', "tags": ["a", "'), F.col("n_name"), F.lit('"]}'))
    rows = chunks.split_chunks(n, F.col("n_nationkey"), text, size=5)
    base = f"{(spark.conf.get('spark.checkpoint.dir', None) or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/chunks-{uuid.uuid4().hex}"
    rows.write.parquet(f"{base}/in")
    out = chunks.patches(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(f"{base}/in"))
    out.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start(f"{base}/out").awaitTermination()
    snapshot = chunks.latest_snapshots(spark.read.parquet(f"{base}/out"))
    return snapshot.where("kind = 'scalar'").select(F.col("document_key").cast("long").alias("doc_id"), "path_text", "value")


def tables_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document a region: its nations as a table with a header (every second one lacks `even`), and one without."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    row = F.concat(F.lit('{"id":'), F.col("n_nationkey").cast("string"), F.when(F.col("n_nationkey") % 2 == 0, ',"even":true').otherwise(""), F.lit("}"))
    grouped = n.groupBy(F.col("n_regionkey").cast("long").alias("doc_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", row.alias("r")))), lambda s: s.getField("r")), ",").alias("rows"))
    return grouped.select("doc_id", F.concat(F.lit('{"rows":['), F.col("rows"), F.lit('],"plain":[[1],[2]]}')).alias("text"))


def header_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.header_tables(nodes.node_table(tables_text(spark, sf_dir), places=False)).select("doc_id", "path_text", "has_header")


def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = nodes.table_cells(nodes.node_table(tables_text(spark, sf_dir), places=False))
    return cells.groupBy("doc_id", "column").agg(F.count("*").alias("n"), F.sum(F.col("missing").cast("long")).alias("n_missing"))


def guessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.guess(prop_texts(spark, sf_dir))


def preview_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", previews.preview_kind(F.col("url")).alias("kind"), *[c.alias(n) for n, c in previews.url_parts(F.col("url")).items()])


def preview_query_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", F.explode(previews.query_table(F.col("url"))).alias("q")).select("page_id", "q.name", "q.value")


def preview_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (F.lit(1_000_000_000) + F.col("o_orderkey") * 1000).cast("string").alias("t"))
    return o.select("o_orderkey", previews.preview_kind(F.col("t")).alias("kind"), F.date_format(previews.epoch(F.col("t")), "yyyy-MM-dd HH:mm:ss").alias("at"))


def preview_base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.base64(F.concat("n_name", F.lit(" and more")).cast("binary")).alias("t"))
    return n.select("n_nationkey", previews.base64_text(F.col("t")).alias("decoded"))


def chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut into chunks of 7 bytes and put through the stream's state machine as a batch."""
    rows = chunks.split_chunks(prop_texts(spark, sf_dir), F.col("doc_id"), F.col("text"), size=7)
    snapshot = chunks.latest_snapshots(chunks.batch_patches(rows))
    return snapshot.where("kind = 'scalar'").select(F.col("document_key").cast("long").alias("doc_id"), "path_text", "value")


LINE_DIFF = "SELECT p_partkey AS doc_id, 'delete' AS op, 1::INT AS line, p_name AS text, true AS exact FROM part UNION ALL SELECT p_partkey, 'insert', 1, p_brand, true FROM part UNION ALL SELECT p_partkey, 'insert', 3, 'end', true FROM part"
PATHS = f"SELECT doc_id, p.path AS path_text, p.value AS value FROM ({TREE}) d, LATERAL (VALUES ('$.id', d.doc_id::VARCHAR), ('$.tags[0]', 'a'), ('$.tags[1]', d.t), ('$.props.k', d.k)) p(path, value)"
NODES = {
    "recursive_descent": (node_query(lambda n: n.select("doc_id", "path_text", "kind")), f"SELECT doc_id, p.path AS path_text, p.kind AS kind FROM ({TREE}) d, LATERAL (VALUES ('$', 'map'), ('$.id', 'scalar'), ('$.tags', 'seq'), ('$.tags[0]', 'scalar'), ('$.tags[1]', 'scalar'), ('$.props', 'map'), ('$.props.k', 'scalar')) p(path, kind)"),
    "path_value": (node_query(lambda n: n.where("kind = 'scalar'").select("doc_id", "path_text", "value")), PATHS),
    "descend_expression": (evaluated('.. | select(tag == "!!str")'), f"SELECT doc_id, '\"a\"' AS value FROM ({TREE}) UNION ALL SELECT doc_id, '\"' || t || '\"' FROM ({TREE})"),
    "descend_with_keys": (evaluated("[... | select(is_key)] | length"), f"SELECT doc_id, '4' AS value FROM ({TREE})"),
    "path_expression": (evaluated(".props.k | path"), f"SELECT doc_id, '[\"props\",\"k\"]' AS value FROM ({TREE})"),
    "parent": (evaluated(".props.k | parent | keys"), f"SELECT doc_id, '[\"k\"]' AS value FROM ({TREE})"),
    "parent_levels": (evaluated(".props.k | parent(2) | .id"), f"SELECT doc_id, doc_id::VARCHAR AS value FROM ({TREE})"),
    "parents": (evaluated(".props.k | parents | length"), f"SELECT doc_id, '2' AS value FROM ({TREE})"),
    "root": (evaluated(".tags[1] | root | .id"), f"SELECT doc_id, doc_id::VARCHAR AS value FROM ({TREE})"),
    "key": (evaluated(".tags[1] | key"), f"SELECT doc_id, '1' AS value FROM ({TREE})"),
    "document_delete": (evaluated("del(.tags[0], .props) | .tags"), f"SELECT doc_id, '[\"' || t || '\"]' AS value FROM ({TREE})"),
    "document_assign": (evaluated(".props.k += 1 | .new.deep = .id | [.props.k, .new.deep]"), f"SELECT doc_id, '[' || (k::BIGINT + 1) || ',' || doc_id || ']' AS value FROM ({TREE})"),
    "document_match_all": (evaluated('.tags[1] | [match("[aeiou]"; "g") | .offset] | length'), f"SELECT doc_id, len(regexp_extract_all(t, '[aeiou]'))::VARCHAR AS value FROM ({TREE})"),
    "mixed_sort": (evaluated('[.tags[1], .id, null, true, 2.5, false] | sort | .[0:3]'), f"SELECT doc_id, '[null,false,true]' AS value FROM ({TREE})"),
    "ancestors": (node_query(lambda n: nodes.ancestors(n, "$.tags[1]").select("doc_id", "path_text")), f"SELECT doc_id, p.path AS path_text FROM ({TREE}) d, (VALUES ('$'), ('$.tags')) p(path)"),
    "descendants": (node_query(lambda n: nodes.descendants(n, "$.tags").select("doc_id", "path_text")), f"SELECT doc_id, p.path AS path_text FROM ({TREE}) d, (VALUES ('$.tags'), ('$.tags[0]'), ('$.tags[1]')) p(path)"),
    "find_anchors": (node_query(lambda n: nodes.anchors(n, "$.id"), places=True), f"SELECT doc_id, '$.id' AS path_text, 7::INT AS start_byte, (7 + length(doc_id::VARCHAR))::INT AS end_byte FROM ({TREE})"),
    "resolve_path": (node_query(lambda n: nodes.resolve(n, 7), places=True), f"SELECT doc_id, '$.id' AS path_text FROM ({TREE})"),
    "root_value_kind": (node_query(nodes.root_kinds), f"SELECT doc_id, 'map' AS kind, '!!map' AS tag FROM ({TREE})"),
    "node_preview": (node_query(lambda n: nodes.preview(n, "$.tags[1]")), f"SELECT doc_id, 'scalar' AS kind, '!!str' AS tag, t AS value, true AS is_scalar FROM ({TREE})"),
    "direct_children": (lambda spark, sf_dir: nodes.direct_children(nation_nodes(spark, sf_dir), "$").select("doc_id", "label", "value", "is_container"), f"SELECT doc_id, key AS label, value, false AS is_container FROM ({NATION_SCALARS})"),
    "field_labels": (node_query(nodes.field_labels), "SELECT unnest(['id', 'tags', 'props', 'k']) AS key"),
    "search_index": (lambda spark, sf_dir: nodes.search_index(nation_nodes(spark, sf_dir), "N_NAME").select("doc_id", "path_text", "value"), "SELECT n_nationkey::BIGINT AS doc_id, '$.n_name' AS path_text, n_name AS value FROM nation"),
    "graph_nodes": (node_query(lambda n: nodes.graph(n)[0].select("doc_id", "path_text", "shape", "depth")), f"SELECT doc_id, p.path AS path_text, p.shape AS shape, p.depth::INT AS depth FROM ({TREE}) d, (VALUES ('$', 'object', 0), ('$.tags', 'table', 1), ('$.props', 'object', 1)) p(path, shape, depth)"),
    "graph_edges": (node_query(lambda n: nodes.graph(n)[1]), f"SELECT doc_id, '$' AS source, p.path AS target, p.label AS label FROM ({TREE}) d, (VALUES ('$.tags', 'tags'), ('$.props', 'props')) p(path, label)"),
    "header_table": (header_tables, "SELECT DISTINCT n_regionkey::BIGINT AS doc_id, p.path AS path_text, p.h AS has_header FROM nation, (VALUES ('$.rows', true), ('$.plain', false), ('$.plain[0]', false), ('$.plain[1]', false)) p(path, h)"),
    "table_cells": (table_cells, "SELECT n_regionkey::BIGINT AS doc_id, 'id' AS \"column\", count(*) AS n, 0::BIGINT AS n_missing FROM nation GROUP BY 1 UNION ALL SELECT n_regionkey, 'even', count(*), sum(n_nationkey % 2)::BIGINT FROM nation GROUP BY 1 HAVING bool_or(n_nationkey % 2 = 0)"),
    "diff_versions": (diff_versions, "SELECT o_orderkey AS doc_id, p.path AS path_text, 'delete' AS op FROM orders, (VALUES ('$'), ('$.o_orderkey'), ('$.o_custkey'), ('$.o_orderstatus')) p(path) WHERE o_orderkey % 10 = 0 UNION ALL SELECT o_orderkey, '$.o_orderstatus', 'change' FROM orders WHERE o_orderkey % 10 <> 0 AND o_orderkey % 7 = 0"),
    "diff_sequences": (diff_sequences, "SELECT o_orderkey::BIGINT AS doc_id, p.path AS path_text, p.op AS op, p.a AS value_old, p.b AS value_new FROM orders, (VALUES ('$.a[0]', 'insert', NULL, 'front'), ('$.a[4]', 'delete', 'end', NULL), ('$.b[1]', 'change', '2', '3')) p(path, op, a, b)"),
    "structured_equality": (same_structure, "SELECT o_orderkey AS doc_id, o_orderkey % 7 <> 0 AS same FROM orders WHERE o_orderkey % 10 <> 0"),
    "graph_delta": (delta, "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 10 = 0 THEN 'removed' ELSE 'updated' END AS op FROM orders WHERE o_orderkey % 10 = 0 OR o_orderkey % 7 = 0"),
    "line_diff": (line_diff, LINE_DIFF),
    "line_diff_histogram": (histogram_diff, LINE_DIFF),
    "inline_diff": (inline_diff, "SELECT o_orderkey AS doc_id, '$.o_orderstatus' AS path_text, p.op AS op, 0::INT AS offset, 1::INT AS length FROM orders, (VALUES ('delete'), ('insert')) p(op) WHERE o_orderkey % 10 <> 0 AND o_orderkey % 7 = 0 AND o_orderstatus <> 'X'"),
    "graph_stable_id": (node_query(lambda n: nodes.graph(n)[0].groupBy("shape", "path_text").agg(F.count_distinct("graph_id").alias("ids"), F.count("*").alias("n"))), "SELECT p.shape AS shape, p.path AS path_text, 1::BIGINT AS ids, count(*) AS n FROM events, (VALUES ('object', '$'), ('table', '$.tags'), ('object', '$.props')) p(shape, path) GROUP BY 1, 2"),
    "optional_field": (evaluated("[.id.x?, .props.k?, (.tags | .[]? )] | length"), f"SELECT doc_id, '3' AS value FROM ({TREE})"),
    "preview_kinds": (preview_kinds, "SELECT n_nationkey, p.no::INT AS no, p.kind AS kind FROM nation, (VALUES (0, 'image'), (1, 'url'), (2, 'colour'), (3, 'jwt'), (4, 'percent'), (5, 'escapes'), (6, 'date'), (7, 'none')) p(no, kind)"),
    "streamed_chunks": (streamed, "SELECT n_nationkey::BIGINT AS doc_id, p.path AS path_text, p.value AS value FROM nation, LATERAL (VALUES ('$.id', n_nationkey::VARCHAR), ('$.tags[0]', 'a'), ('$.tags[1]', n_name)) p(path, value)"),
    "yaml_round_trip": (converted("yaml"), f"SELECT doc_id, '[' || doc_id || ',' || k || ']' AS value FROM ({TREE})"),
    "toml_round_trip": (converted("toml"), f"SELECT doc_id, '[' || doc_id || ',' || k || ']' AS value FROM ({TREE})"),
    "python_round_trip": (converted("python"), f"SELECT doc_id, '[' || doc_id || ',' || k || ']' AS value FROM ({TREE})"),
    "javascript_round_trip": (converted("javascript"), f"SELECT doc_id, '[' || doc_id || ',' || k || ']' AS value FROM ({TREE})"),
    "csv_decode": (csv_documents, "SELECT n_nationkey::BIGINT AS doc_id, '[' || n_nationkey || ',\"' || n_name || ', x\"]' AS value FROM nation"),
    "guess_format": (guessed, f"SELECT doc_id, 'json' AS format FROM ({TREE})"),
    "preview_url": (preview_url, "SELECT page_id, 'url' AS kind, regexp_extract(url, '^([A-Za-z]+)://', 1) AS scheme, regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS query, regexp_extract(url, '#(.*)$', 1) AS fragment FROM pages"),
    "preview_query_table": (preview_query_table, "SELECT page_id, string_split(q, '=')[1] AS name, string_split(q, '=')[2] AS value FROM (SELECT page_id, unnest(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&')) AS q FROM pages WHERE contains(url, '?'))"),
    "preview_epoch": (preview_epoch, "SELECT o_orderkey, 'date' AS kind, strftime(to_timestamp(1000000000 + o_orderkey * 1000) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS \"at\" FROM orders"),
    "preview_base64": (preview_base64, "SELECT n_nationkey, n_name || ' and more' AS decoded FROM nation"),
    "chunked_stream": (chunked, PATHS),
}
QUERIES = {**EXPRESSIONS, **{name: f for name, (f, _) in NODES.items()}}
ORACLE_SQL = {**{name: q.sql for name, q in EXPRESSIONS.items() if q.sql}, **{name: sql for name, (_, sql) in NODES.items()}}
