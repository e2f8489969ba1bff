"""The compilers against the document evaluator, the queries against their SQL, and the tables made from documents."""

import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from arborq import queries
from arborq.functions import previews
from arborq.operators import evaluate
from arborq.plans import query
from arborq.plans.columns import Unsupported
from arborq.sources import documents, nodes
from arborq.streaming import batch_patches, latest_snapshots, patches, split_chunks

ROWS = [(1, "a", 2.0, ["x", "y"], None), (2, "b", 1.5, [], 7), (3, "a", 9.25, ["y", None], 0), (4, None, None, ["z"], -7)]
SCHEMA = "id long, name string, n double, tags array<string>, m long"
SAME = [
    "map(.id)", "map(select(.n > 1.6) | .id)", "map(.name) | unique", "unique_by(.name) | map(.id)", "sort_by(.name) | map(.id)", "sort_by(.name, .n) | reverse | map(.id)",
    "map(.m) | sort", "reverse | map(.id)", ".[1:3] | map(.id)", "map(.tags | length)", "map(.tags) | flatten", "map(.m + 1)", "map(.n * 2)", "map(.id % 3)", 'map(.name // "none")', "map(.m // 5)",
    'map(.tags | contains(["y"]))', 'map(.tags | join("+"))', "map(.tags | reverse)", 'map(.tags - ["y"])', 'map(.tags + "w")', "map(.tags | map(tag))", "map(.name | tag)", "map(.name == null)", 'map(.name == "a*")', "map(.n < 2, .n >= 2)".replace(", .n >= 2", ""),
    "map([.id, .m] | max)", "map(.id as $x | $x * $x)", "map({id, k: (.id + 1)} | .k)", "map(.tags[0])", "map(.tags[-1])", "map(.tags | to_entries | map(.key))", "group_by(.name) | map(length)", "group_by(.name) | map(map(.id))",
    'map("\\(.id)-\\(.name)")', "map(.tags | any)", "map(has(\"id\"), has(\"no\"))".replace(", has(\"no\")", ""), "map(keys)", "map(.absent)", "map(del(.n, .tags) | keys)", "map(.tags | unique | length)", "map([.tags[] | select(. == \"y\")])", "map(.m |= . + 1 | .m)", "map(.id += .m | .id)", "map(.tags |= map(. + \"!\") | .tags)".replace(" + \"!\"", ""), "length", "map(.n) | max", "any_c(.id > 3)", "all_c(.id > 3)", ".[] as $x reduce (0; . + $x.id)", "map(.tags | .[] as $t reduce (0; . + ($t | length)))",
    ".[-2:] | map(.id)", ".[-3:-1] | map(.id)", ".[:-1] | map(.id)", "map(.m) | min", "map(.m) | max", "map([.id, .m] | min)", "map(.id?)", "map([.name | match(\"a\"; \"g\") | .offset])".replace(".name", "(.name // \"xay\")"),
    'map(["banana" | match("a"; "g") | .offset])', 'map(["banana" | match("a(n)?(?P<z>a)?"; "g") | .string])', 'map(["bénana" | match("n(a)"; "g") | .captures[0].offset])', 'map(["xyz" | match("a")] | length)', 'map(["banana" | capture("(?P<l>.)a"; "g") | .l])', 'map(["banana" | match("a") | .length])',
    '.[].id as $r | .[] | .id * 10 + $r',
]


def values(rows):
    return [dict(zip(["id", "name", "n", "tags", "m"], r, strict=True)) for r in rows]


@pytest.mark.parametrize("expression", SAME)
def test_columns_agree_with_documents(spark, expression):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = [r.asDict(recursive=True)["value"] for r in query(df, expression, ["id"], ordered=True).collect()]
    found = evaluate(expression, values(ROWS))
    want = found if expression.startswith(".[].") else found[0]
    assert got == (want if isinstance(want, list) else [want])


def test_what_has_no_type_is_refused(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for bad in ["map([.id, .name])", "map(.name - 1)", "..", "map({(.name): 1})", "map($x)", 'map("x" | match("a"; "i"))']:
        with pytest.raises(Unsupported):
            query(df, bad, ["id"])


def test_an_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert query(df, "map(.id) | sort | .[0:3]", ["id"]).count() == 0
    assert query(df, "length", ["id"]).first().value == 0
    assert query(df, "any_c(.id > 1)", ["id"]).first().value is False
    assert query(df, "group_by(.name) | map({n: length})", ["id"]).count() == 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_are_the_ones_wanted(spark, sf):
    lines, orders = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("lineitem", "orders"))
    p = plan(query(lines, ".[] | select(.l_quantity > 45) | {k: .l_orderkey}", ["l_orderkey"]))
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,45.0)]" in p and "Exchange" not in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in p
    p = plan(query(orders, "sort_by(.o_totalprice) | .[0:5]", ["o_orderkey"]))
    assert "TakeOrderedAndProject" in p
    p = plan(query(orders, "group_by(.o_orderstatus) | map({s: .[0].o_orderstatus, n: length})", ["o_orderkey"]))
    assert "partial_count" in p and "collect_list" not in p and "Python" not in p


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents pages labels".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_agree_with_their_sql(spark, sf, duck, name):
    df = queries.QUERIES[name](spark, sf)
    found = duck.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(repr([v for _, v in sorted(zip(columns, r, strict=True))]) for r in found.fetchall())
    assert sorted(repr([r[c] for c in sorted(df.columns)]) for r in df.collect()) == want


@pytest.mark.parametrize("name", [k for k, q in queries.EXPRESSIONS.items() if q.ordered])
def test_sorted_queries_are_sorted(spark, sf, duck, name):
    assert [r.value for r in queries.QUERIES[name](spark, sf).collect()] == [r[0] for r in duck.execute(queries.ORACLE_SQL[name]).fetchall()]


def test_node_tables_without_places(spark, sf):
    texts = queries.prop_texts(spark, sf).limit(50).union(spark.createDataFrame([(-1, '{"d":1,"d":[2.50,{}],"e":{"f":[]},"g":null,"1":"x y"}'), (-2, "7"), (-3, "[NaN]")], "doc_id long, text string"))
    both = [sorted(map(str, nodes.node_table(texts, places=p).drop("start_byte", "end_byte").collect())) for p in (True, False)]
    assert both[0] == both[1] and len(both[0]) > 50


def test_line_ends_are_no_change(spark):
    old, new = (spark.createDataFrame([(1, a), (2, "x\ny")], "doc_id long, text string") for a in ("{\r\n a\r\n}", "{\n a\n}"))
    assert nodes.diff_lines(old, new).count() == 0 and nodes.diff_lines(old, new, "histogram").count() == 0


def test_entry_points(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_bad_documents_are_rows_with_errors(spark):
    df = spark.createDataFrame([(1, '{"a": 1}'), (2, "{bad"), (3, None), (4, '{"a": "x"}'), (5, ""), (6, "[" * 100_000)], "doc_id long, text string")
    got = {r.doc_id: (r.value, r.error is not None) for r in documents.evaluate(df, ".a - 1").collect()}
    assert got == {1: ("0", False), 2: (None, True), 4: (None, True), 5: (None, True), 6: (None, True)}
    assert nodes.node_table(df).groupBy("doc_id").count().count() == 2
    assert nodes.node_table(df, places=False).groupBy("doc_id").count().count() == 2
    assert {r.doc_id for r in documents.convert(df, "json", "yaml").where("error IS NOT NULL").collect()} == {2, 5, 6}
    assert documents.evaluate(spark.createDataFrame([(1, 'a,b\n"x')], "doc_id long, text string"), ".", source="csv").first().error
    assert documents.evaluate(documents.null_input(spark), "1 + 2").first().value == "3"
    assert documents.typed(documents.evaluate(df.limit(1), "."), "a long").first().a == 1


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.yaml").write_text("a: [1, 2]\n")
    files = documents.read_files(spark, str(tmp_path / "in")).select(F.lit(1).alias("doc_id"), "text")
    out = documents.evaluate(files, ".a[]", source="yaml")
    documents.write_text(out, str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["1", "2"]
    assert documents.convert(files, None, "toml").first().text == "a = [1, 2]"


def test_a_stream_of_chunks(spark, tmp_path):
    df = spark.createDataFrame([("a", '{"x": [1, "é漢"], "y": null}'), ("b", "[1, 2"), ("c", "{}")], "k string, t string")
    chunks = split_chunks(df, F.col("k"), F.col("t"), size=3)
    newer = split_chunks(df.where("k = 'c'"), F.col("k"), F.lit("[7]"), size=2, request_seq=1)
    every = chunks.unionByName(newer)
    source = str(tmp_path / "in")
    for part in range(3):  # three files, so that a document's chunks come in several triggers
        every.where(F.col("chunk_no") % 3 == part).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = patches(stream).writeStream.format("memory").queryName("patched").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("patched")
    assert {r.document_key: r.op for r in got.where("op IN ('ended', 'failed')").orderBy("patch_seq").collect()} == {"a": "ended", "b": "failed", "c": "ended"}
    key = lambda df: sorted((r.document_key, r.snapshot, r.path_text, r.value or "") for r in latest_snapshots(df).collect())
    assert key(got) == key(batch_patches(every)) and ("a", 0, "$.x[1]", "é漢") in key(got) and ("c", 1, "$[0]", "7") in key(got)


def test_node_tables_of_other_formats(spark):
    df = spark.createDataFrame([(1, "a: &k [1, x]\nb: *k\n")], "doc_id long, text string")
    got = {r.path_text: (r.tag, r.value) for r in nodes.node_table(df, "yaml").collect()}
    assert got["$.b[1]"] == ("!!str", "x") and got["$.a"] == ("!!seq", None) and len(got) == 7


def test_previews(spark):
    texts = {"https://a.b/c.png": "image", "https://a.b/c?d=1": "url", "1700000000": "date", "2024-01-02T03:04:05Z": "date", "#ff00aa": "colour", "eyJhbGciOiJub25lIn0.eyJhIjoxfQ.": "jwt", "aGVsbG8gd29ybGQh": "base64", "a%20b": "percent", "x\\u0041": "escapes", "plain": None, "": None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.k for r in df.select("t", previews.preview_kind(F.col("t")).alias("k")).collect()} == texts


def test_command_line(tmp_path, capsys):
    from arborq.cli import main

    f = tmp_path / "x.yaml"
    f.write_text("a: 1\nb: text\n")
    assert main([".b", str(f), "-r"]) == 0 and capsys.readouterr().out == "text\n"
    assert main([".", str(f), "--to", "json", "-I", "0"]) == 0 and capsys.readouterr().out == '{"a":1,"b":"text"}\n'
    capsys.readouterr()
    assert main([".a += 1", str(f), "-i"]) == 0 and f.read_text() == "a: 2\nb: text\n"
    assert main([".nope(", str(f)]) == 2


def test_diff_aligns_sequences(spark):
    versions = [
        ("[1,2,3]", "[0,1,2,3]", {("$[0]", "insert")}), ("[1,2,3]", "[1,2,3,4]", {("$[3]", "insert")}), ("[1,2,3]", "[2,3]", {("$[0]", "delete")}), ("[1,2]", "[1,3]", {("$[1]", "change")}), ("[]", "[]", set()),
        ('{"a":[{"x":1,"y":[1,2]},5]}', '{"a":[{"y":[0,1,2],"x":1},5]}', {("$.a[0].y[0]", "insert")}), ('[{"x":1,"y":2}]', '[{"y":2,"x":1}]', set()), ("[[1],2]", '[{"k":1},2]', {("$[0]", "change"), ("$[0][0]", "delete"), ("$[0].k", "insert")}),
        ('{"a":1}', '{"b":[7]}', {("$.a", "delete"), ("$.b", "insert"), ("$.b[0]", "insert")}), ("[1]", None, {("$", "delete"), ("$[0]", "delete")}), ('["1"]', "[1]", {("$[0]", "change")}),
        (str([*range(3000)]), str([-1, *range(3000)]), {("$[0]", "insert")}), (str([*range(1500)]), str([*range(9000, 10500)]), {(f"$[{k}]", "change") for k in range(1500)}),
    ]
    old, new = (nodes.node_table(spark.createDataFrame([(k, v[side]) for k, v in enumerate(versions) if v[side] is not None], "doc_id long, text string")) for side in (0, 1))
    got = [set() for _ in versions]
    for r in nodes.diff(old, new).collect():
        got[r.doc_id].add((r.path_text, r.op))
    assert got == [v[2] for v in versions]
    assert {r.doc_id for r in nodes.same_structure(old, new).where("same").collect()} == {4, 6}


ODD_KEYS = ["a", "b c", "", ".", "x.y", '"]', '.a"]', "tab\there", "\u0001\u001f", "\u007f", "back\\slash", "[0]", "né", "😀", "q\"uote", "/"]


def test_edges_come_from_their_targets_alone(spark):
    """At every depth, under any key, also for null doc_ids; no join, whose one side a small file would send to the driver."""
    value = [1, {}, []]
    for key in ODD_KEYS:
        value = {key: [0, value, {key: {key: 1}}]}
    df = spark.createDataFrame([(1, json.dumps(value)), (None, json.dumps({"a": [[1]]})), (2, "[]")], "doc_id long, text string")
    for places in (False, True):
        table = nodes.node_table(df, places=places)
        _, edges = nodes.graph(table)
        rows = table.collect()
        by_id = {(r["doc_id"], r["node_id"]): r for r in rows}
        want = [(r["doc_id"], by_id[r["doc_id"], r["parent_id"]]["path_text"], r["path_text"], r["key"] if r["key"] is not None else str(r["seq_index"])) for r in rows if r["parent_id"] is not None and r["kind"] != "scalar" and r["subtree_end"] > r["preorder"]]
        assert len(want) > 4 * len(ODD_KEYS)
        assert sorted(map(tuple, edges.collect()), key=str) == sorted(want, key=str)
        assert "Join" not in edges._jdf.queryExecution().optimizedPlan().toString()


def random_value(rng, depth):
    kind = rng.randrange(8 if depth else 6)
    if kind > 5:
        inner = [random_value(rng, depth - 1) for _ in range(rng.randrange(4))]
        return inner if kind == 6 else {rng.choice("ab.") * rng.randrange(3): v for v in inner}
    return rng.choice([None, True, 1, 1.5, "1", "x", "true", "", [], {}])


def test_texts_differ_as_their_node_tables_do(spark):
    rng = random.Random(7)
    texts = [[json.dumps(random_value(rng, 4)) for _ in range(2)] for _ in range(400)]
    texts += [['{"a":1,"a":[2]}', '{"a":[2],"a":1}'], ["[1", "[1]"], [None, "{}"], ["[" * 900 + "]" * 900, "[" * 901 + "]" * 901], ["1", " 1"]]
    old, new = (spark.createDataFrame([(k, v[side]) for k, v in enumerate(texts) if k % 9 != 3 + side], "doc_id long, text string") for side in (0, 1))
    nulls = spark.createDataFrame([(None, "[5]")], old.schema)
    old, new = old.union(nulls), new.union(nulls)
    for source in ("json", "yaml"):
        if source == "yaml":
            old, new = (df.where("doc_id < 60 OR doc_id IS NULL") for df in (old, new))
        want = sorted(map(str, nodes.diff(nodes.node_table(old, source, places=False), nodes.node_table(new, source, places=False)).collect()))
        assert sorted(map(str, nodes.diff_texts(old, new, source).collect())) == want and len(want) > 50


def test_many_small_documents_are_compared_by_the_batch(spark):
    """A call of Python for each document took most of the time."""
    df = spark.range(100_000).select(F.col("id").alias("doc_id"), F.format_string('{"a":[%d,{"b":1}]}', "id").alias("text"))
    out = nodes.diff_texts(df, df.select("doc_id", F.regexp_replace("text", '"b":1', '"b":2').alias("text")))
    assert "CoGroups" not in out._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in out.groupBy("path_text", "op", "value_old", "value_new").count().collect()] == [("$.a[1].b", "change", "1", "2", 100_000)]


def test_the_query_of_differing_sequences_compares_by_the_batch(spark, sf):
    assert "CoGroups" not in queries.QUERIES["diff_sequences"](spark, sf)._jdf.queryExecution().executedPlan().toString()
