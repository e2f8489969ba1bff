import json
import random
import tomllib

import pytest

from arborq.operators import values as V
from arborq.sources import codecs
from arborq.sources.nodes import aligned, by_histogram, inline_edits, shortest_edits
from arborq.sources.push import Parser, PushError, parse_path, path_text

VALUE = {"s": "a\"b\n'é", "i": -3, "f": 1.0, "t": True, "o": {"x": [1, [2.5, "y"]], "e": {}}, "rows": [{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]}


@pytest.mark.parametrize("name", ["json", "yaml", "toml", "python", "javascript"])
@pytest.mark.parametrize("indent", [0, 2])
def test_round_trips(name, indent):
    got = codecs.decode(codecs.encode(VALUE, name, indent=indent), name)
    assert got == VALUE and isinstance(got["f"], float) and list(got["o"]) == ["x", "e"]


def test_nulls_round_trip_where_they_can():
    for name in ("json", "yaml", "python", "javascript"):
        assert codecs.decode(codecs.encode({"a": None, "b": [None]}, name), name) == {"a": None, "b": [None]}
    with pytest.raises(codecs.FormatError):
        codecs.encode({"a": None}, "toml")


@pytest.mark.parametrize("name,bad", [("json", "{} {}"), ("json", "{a: 1}"), ("json", "[NaN]"), ("json", ""), ("yaml", "a: [1"), ("toml", "a = 1\na = 2"), ("python", "f(x)"), ("python", "1 +"), ("javascript", "{a: b}"), ("javascript", "[1 2]"), ("xml", "<a/>")])
def test_malformed_texts(name, bad):
    with pytest.raises(ValueError):
        codecs.decode_all(bad, name)


def test_yaml_documents_aliases_tags_and_dates():
    assert codecs.decode_all("a: 1\n---\n- x\n", "yaml") == [{"a": 1}, ["x"]]
    assert codecs.decode("a: &k {x: 1}\nb: *k\nc:\n  <<: 2\n", "yaml") == {"a": {"x": 1}, "b": {"x": 1}, "c": {"<<": 2}}
    v = codecs.decode("d: 2020-01-02\n1: one\nc: !own z\n", "yaml")
    assert v == {"d": "2020-01-02", "1": "one", "c": "z"} and V.tag(v["d"]) == "!!timestamp" and V.tag(v["c"]) == "!own"


def test_toml_dates_tables_and_dotted_keys():
    v = codecs.decode('a.b = 1\nd = 1979-05-27T07:32:00Z\n[[t]]\nx = 1\n[[t]]\nx = 2\n[t.u]\ny = "z"\n', "toml")
    assert v["a"] == {"b": 1} and V.tag(v["d"]) == "!!timestamp" and v["t"] == [{"x": 1}, {"x": 2, "u": {"y": "z"}}]
    assert codecs.decode(codecs.encode(v, "toml"), "toml") == v
    assert tomllib.loads(codecs.encode([{"a": 1}, {"a": 2}], "toml")) == {"rows": [{"a": 1}, {"a": 2}]}


def test_csv_types_and_shapes():
    text = '﻿a,b,c\n1,"x,y",true\n2.5,#note,\n007,z\n'
    assert codecs.decode(text, "csv") == [{"a": 1, "b": "x,y", "c": True}, {"a": 2.5, "b": None, "c": None}, {"a": "007", "b": "z", "c": None}]
    assert codecs.encode([{"a": 1, "b": None}, {"b": "x,y", "a": 2}], "csv") == 'a,b\n1,\n2,"x,y"'
    assert codecs.encode([[1, 2], ["a"]], "csv") == "1,2\na" and codecs.encode([1, None, "x"], "csv") == "1,,x"
    for bad in ([{"a": [1]}], {"a": 1}):
        with pytest.raises(codecs.FormatError):
            codecs.encode(bad, "csv")


def test_texts_that_cannot_be_read_are_format_errors():
    deep = 100_000
    for name, text in (("json", "[" * deep), ("csv", 'a,b\n"x'), ("yaml", "[" * 3000), ("python", "(" * 3000), ("javascript", "[" * deep), ("toml", "a = " + "[" * deep)):
        with pytest.raises(codecs.FormatError):
            codecs.decode_all(text, name)
    long = "x" * 200_000
    assert codecs.decode(f"a,b\n{long},", "csv") == [{"a": long, "b": None}]
    value = None
    for _ in range(50_000):
        value = [value]
    with pytest.raises(codecs.FormatError):
        codecs.encode(value, "json")


def test_python_and_javascript_literals():
    assert codecs.decode_all("{'a': (1, 2), b: None}\n{3}", "python") == [{"a": [1, 2], "b": None}, [3]]
    js = "// head\nexport default {a: 'x\\u0041', 'b-c': [1, .5, 0x1F, -Infinity,], /* y */ d: undefined, e: `q\nr`};"
    assert codecs.decode(js, "javascript") == {"a": "xA", "b-c": [1, 0.5, 31, float("-inf")], "d": None, "e": "q\nr"}
    assert codecs.decode("module.exports = [true]", "javascript") == [True]


def test_formats_are_told_apart():
    for name, text in {"json": '{"a": [1, 2]}', "yaml": "a: 1\nb:\n  - x\n", "toml": '[t]\na = 1\nb = "x"\n', "csv": "a,b\n1,2\n", "python": "{'a': None, 'b': True}", "javascript": "export default {a: 1,}"}.items():
        assert codecs.guess_format(text) == name
    assert codecs.format_of(None, "x.yml", "{}") == "yaml" and codecs.format_of(None, "x.unknown", "a: 1\n") == "yaml"
    assert codecs.format_of("toml", "x.json") == "toml" and codecs.format_of() == "json"


def test_conversion_of_several_documents():
    assert json.loads(codecs.convert("a: 1\n---\nb: 2\n", "yaml", "json")) == [{"a": 1}, {"b": 2}]
    assert codecs.decode_all(codecs.convert("{'a': 1}\n[2]", "python", "yaml"), "yaml") == [{"a": 1}, [2]]


def tree_of(text: bytes, cuts: list[int]):
    parser, nodes, at = Parser(), [], 0
    for c in [*cuts, len(text)]:
        nodes += [n for what, n in parser.feed(text[at:c], close=c == len(text)) if what == "start"]
        at = c
    return nodes


def test_the_push_parser_does_not_care_how_bytes_are_cut():
    r = random.Random(1)
    text = json.dumps(VALUE | {"n": None, "big": 1.5e300, "é": "漢\\"}, ensure_ascii=False).encode()
    whole = [(n.number, n.parent, n.key, n.index, n.kind, n.tag, n.value, n.start, n.end, n.last) for n in tree_of(text, [])]
    for _ in range(200):
        cuts = sorted(r.sample(range(1, len(text)), r.randrange(1, 12)))
        assert [(n.number, n.parent, n.key, n.index, n.kind, n.tag, n.value, n.start, n.end, n.last) for n in tree_of(text, cuts)] == whole
    assert [(n.number, n.parent, n.key, n.index, n.kind, n.tag, n.value, n.start, n.end, n.last) for n in tree_of(text, list(range(1, len(text))))] == whole
    assert all(json.loads(text[n.start : n.end]) is not None or n.tag == "!!null" for n in tree_of(text, []))


@pytest.mark.parametrize("bad", ["", "{", "[1,]", '{"a"}', "1 2", "{,}", "[1 2]", "tru", '{"a":1,}', "]", "01", '"\x01"', "nul", "-"])
def test_the_push_parser_refuses(bad):
    with pytest.raises(PushError):
        tree_of(bad.encode(), [1] if len(bad) > 1 else [])


def test_paths_as_text():
    path = ("a", 0, "x y", 'q"')
    assert path_text(path) == '$.a[0]["x y"]["q\\""]' and parse_path(path_text(path)) == path


def test_edits_are_shortest_and_right():
    r = random.Random(2)
    for _ in range(400):
        a, b = ([r.choice("abc") for _ in range(r.randrange(8))] for _ in range(2))
        edits = shortest_edits(a, b)
        assert [b[j] if op != "keep" else a[i] for op, i, j in edits if op != "delete"] == b
        assert [a[i] for op, i, j in edits if op != "insert"] == a
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                rows[i][j] = i + j if not i or not j else rows[i - 1][j - 1] if a[i - 1] == b[j - 1] else 1 + min(rows[i - 1][j], rows[i][j - 1])
        assert sum(op != "keep" for op, _, _ in edits) == rows[-1][-1]


def test_line_diffs_and_inline_diffs():
    r = random.Random(4)
    for _ in range(300):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(14))] for _ in range(2))
        for f in (aligned, by_histogram):
            gone, come, exact = f(a, b)
            assert exact and [x for i, x in enumerate(a) if i not in gone] == [x for j, x in enumerate(b) if j not in come]
        assert sum(map(len, aligned(a, b)[:2])) == sum(op != "keep" for op, _, _ in shortest_edits(a, b))
    a, b = list("xxyyxxyyxx"), list("yxyxyxyxy")
    assert aligned(a, b, most=1) == (list(range(10)), list(range(9)), False)
    left, right = [f"l{k}" for k in range(3000)] + ["same"], [f"r{k}" for k in range(3000)] + ["same"]
    assert aligned(left, right)[2] and len(aligned(left, right)[0]) == 3000
    assert by_histogram("header old-1 old-2 footer".split(), "header new-1 new-2 footer".split()) == ([1, 2], [1, 2], True)
    assert inline_edits("8080", "9090") == [("delete", 0, 1), ("delete", 2, 1), ("insert", 0, 1), ("insert", 2, 1)]
    assert inline_edits("a" * 200, "b" * 200) == [("delete", 0, 200), ("insert", 0, 200)]
