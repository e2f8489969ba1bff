"""Codecs between text and values: json, yaml, toml, csv, python, javascript.

Values are null, booleans, whole numbers, floats, texts, lists and dicts in their order. decode_all() gives every
document of a text. These run inside Arrow batches (documents.py); typed columns use Spark's own JSON and CSV instead.
"""

from __future__ import annotations

import ast
import csv
import functools
import io
import json
import math
import re
import sys
import tomllib
from collections.abc import Callable

from arborq.operators.values import EvalError, Tagged, is_number, number_text, tag, text

FORMATS = ("json", "yaml", "toml", "csv", "python", "javascript")
#: Other names and file endings of the formats.
ALIASES = {"yml": "yaml", "py": "python", "js": "javascript", "jsonc": "json", "geojson": "json", "tml": "toml", "j": "json", "y": "yaml", "c": "csv", "mjs": "javascript", "cjs": "javascript"}


class FormatError(EvalError):
    """The text is not of the format, or the value has no form in it."""


def format_named(name: str) -> str:
    name = name.lower().lstrip(".")
    name = ALIASES.get(name, name)
    if name not in FORMATS:
        raise FormatError(f"unknown format {name!r}")
    return name


# json


def no_repeats(pairs: list[tuple[str, object]]) -> dict:
    return dict(pairs)


def decode_json(s: str) -> list:
    def strange(name: str):
        raise FormatError(f"{name} is not JSON")

    try:
        return [json.loads(s.removeprefix("\ufeff"), object_pairs_hook=no_repeats, parse_constant=strange)]
    except json.JSONDecodeError as x:
        raise FormatError(str(x)) from None
    except RecursionError:
        raise FormatError("the text is nested too deeply") from None


def encode_json(v, indent: int = 2, **_) -> str:
    """indent 0 is one line without spaces. NaN and infinities have no JSON and become null."""

    def plain(x):
        if isinstance(x, float) and not math.isfinite(x):
            return None
        if isinstance(x, dict):
            return {str(k): plain(y) for k, y in x.items()}
        return [plain(y) for y in x] if isinstance(x, list) else x

    return json.dumps(plain(v), ensure_ascii=False, indent=indent or None, separators=(",", ":") if not indent else None)


# yaml


@functools.lru_cache(maxsize=1)
def yaml_loader():
    import yaml

    class Loader(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
        """Mappings in order; `<<` is a plain key; dates stay texts with a tag of their own; texts as keys."""

    Loader.yaml_implicit_resolvers = {k: [(t, r) for t, r in v if t != "tag:yaml.org,2002:merge"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}

    def mapping(loader, node):
        return {text(loader.construct_object(k, deep=True)): loader.construct_object(v, deep=True) for k, v in node.value}

    Loader.add_constructor("tag:yaml.org,2002:map", mapping)
    Loader.add_constructor("tag:yaml.org,2002:timestamp", lambda loader, node: Tagged(node.value, "!!timestamp"))
    Loader.add_constructor(None, lambda loader, node: Tagged(node.value, node.tag) if isinstance(node, yaml.ScalarNode) else mapping(loader, node) if isinstance(node, yaml.MappingNode) else loader.construct_sequence(node, deep=True))
    return Loader


def decode_yaml(s: str) -> list:
    import yaml

    try:
        return list(yaml.load_all(s.removeprefix("\ufeff"), yaml_loader())) or [None]
    except (yaml.YAMLError, ValueError, RecursionError) as x:
        raise FormatError(str(x)) from None


@functools.lru_cache(maxsize=1)
def yaml_dumper():
    import yaml

    class Dumper(getattr(yaml, "CSafeDumper", yaml.SafeDumper)):
        def ignore_aliases(self, data):
            return True

    Dumper.add_representer(Tagged, lambda d, x: d.represent_scalar("tag:yaml.org,2002:timestamp" if x.tag == "!!timestamp" else x.tag, str(x)))
    return Dumper


def encode_yaml(v, indent: int = 2, **_) -> str:
    import yaml

    out = yaml.dump(v, Dumper=yaml_dumper(), sort_keys=False, allow_unicode=True, default_flow_style=indent == 0, indent=indent or 2, width=1 << 20)
    return out.removesuffix("...\n").rstrip("\n")


# toml


def decode_toml(s: str) -> list:
    def plain(x):
        if isinstance(x, dict):
            return {k: plain(y) for k, y in x.items()}
        if isinstance(x, list):
            return [plain(y) for y in x]
        return x if isinstance(x, (str, int, float)) else Tagged(x.isoformat(), "!!timestamp")

    try:
        return [plain(tomllib.loads(s.removeprefix("\ufeff")))]
    except (tomllib.TOMLDecodeError, RecursionError) as x:
        raise FormatError(str(x)) from None


def toml_key(k: str) -> str:
    return k if re.fullmatch(r"[A-Za-z0-9_-]+", k) else json.dumps(k, ensure_ascii=False)


def toml_value(v) -> str:
    if v is None:
        raise FormatError("null has no TOML")
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, Tagged) and v.tag == "!!timestamp":
        return str(v)
    if isinstance(v, float):
        return {"NaN": "nan", "+Inf": "inf", "-Inf": "-inf"}.get(number_text(v), number_text(v))
    if isinstance(v, int):
        return str(v)
    if isinstance(v, str):
        return json.dumps(v, ensure_ascii=False).replace("\x7f", "\\u007f")
    if isinstance(v, list):
        return "[" + ", ".join(map(toml_value, v)) + "]"
    return "{" + ", ".join(f"{toml_key(k)} = {toml_value(x)}" for k, x in v.items()) + "}"


def encode_toml(v, **_) -> str:
    """Scalars of a table before its tables; lists of mappings as arrays of tables. A list at the top is wrapped as rows."""
    if isinstance(v, list):
        v = {"rows": v}
    if not isinstance(v, dict):
        raise FormatError(f"{tag(v)} cannot be a TOML document")
    out: list[str] = []

    def tables(x) -> bool:
        return isinstance(x, list) and len(x) > 0 and all(isinstance(y, dict) for y in x)

    def write(t: dict, path: tuple[str, ...], head: str | None) -> None:
        plain = {k: x for k, x in t.items() if not isinstance(x, dict) and not tables(x)}
        if head and (plain or not t or head.startswith("[[")):
            out.extend([""] * bool(out) + [head])
        out.extend(f"{toml_key(k)} = {toml_value(x)}" for k, x in plain.items())
        for k, x in t.items():
            inner = ".".join(map(toml_key, (*path, k)))
            if isinstance(x, dict):
                write(x, (*path, k), f"[{inner}]")
            elif tables(x):
                for y in x:
                    write(y, (*path, k), f"[[{inner}]]")

    write(v, (), None)
    return "\n".join(out)


# csv

#: A cell may be as long as a text.
csv.field_size_limit(sys.maxsize)


def cell(s: str):
    """Typed as far as it can be told; an empty cell is null, and one that begins with #, a comment, as well."""
    if not s or s.startswith("#"):
        return None
    low = s.lower()
    if low in ("true", "false", "y", "n", "yes", "no"):
        return low in ("true", "y", "yes")
    if low in ("null", "~"):
        return None
    if re.fullmatch(r"[+-]?(0|[1-9][0-9]*)", s):
        return int(s)
    if re.fullmatch(r"[+-]?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)([eE][+-]?[0-9]+)?", s) and not re.fullmatch(r"[+-]?0[0-9].*", s):
        return float(s)
    return s


def decode_csv(s: str) -> list:
    """The first row names the fields; a row that is too short has nulls, further cells of a long one are dropped."""
    try:
        rows = [r for r in csv.reader(io.StringIO(s.removeprefix("\ufeff"), newline=""), strict=True) if r]
    except csv.Error as x:
        raise FormatError(str(x)) from None
    if not rows:
        return [[]]
    return [[{k: cell(r[n]) if n < len(r) else None for n, k in enumerate(rows[0])} for r in rows[1:]]]


def encode_csv(v, **_) -> str:
    """Scalars as one row; lists of lists as rows; lists of flat mappings with a header, the first one's keys."""
    if not isinstance(v, list):
        raise FormatError(f"{tag(v)} cannot be CSV")

    def flat(x) -> str:
        if isinstance(x, (list, dict)):
            raise FormatError("nested values have no CSV")
        return "" if x is None else text(x)

    if v and all(isinstance(x, dict) for x in v):
        header = list(v[0])
        rows = [header, *([flat(x.get(k)) for k in header] for x in v)]
    elif v and all(isinstance(x, list) for x in v):
        rows = [[flat(y) for y in x] for x in v]
    else:
        rows = [[flat(x) for x in v]]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(rows)
    return out.getvalue().rstrip("\n")


# python and javascript literals


def decode_python(s: str) -> list:
    """Literals only, several top-level ones as several documents; tuples and sets are lists, bare names of keys are texts."""
    try:
        tree = ast.parse(s.strip() or "None")
        return [python_value(node.value) for node in tree.body if isinstance(node, ast.Expr)]
    except (SyntaxError, RecursionError, MemoryError, AttributeError, TypeError, ValueError) as x:
        raise FormatError(str(x)) from None


def python_value(n: ast.expr):
    if isinstance(n, ast.Constant):
        if isinstance(n.value, bytes):
            return n.value.decode("latin-1")
        if n.value is Ellipsis or isinstance(n.value, complex):
            raise FormatError("not a literal")
        return n.value
    if isinstance(n, (ast.List, ast.Tuple, ast.Set)):
        return [python_value(x) for x in n.elts]
    if isinstance(n, ast.Dict):
        return {k.id if isinstance(k, ast.Name) else text(python_value(k)): python_value(v) for k, v in zip(n.keys, n.values, strict=True)}
    if isinstance(n, ast.UnaryOp) and isinstance(n.op, (ast.USub, ast.UAdd)) and is_number(v := python_value(n.operand)):
        return -v if isinstance(n.op, ast.USub) else v
    if isinstance(n, ast.JoinedStr) and all(isinstance(x, ast.Constant) for x in n.values):
        return "".join(x.value for x in n.values)
    if isinstance(n, ast.Name) and n.id.lower() in ("nan", "inf"):
        return float(n.id)
    raise FormatError("not a literal")


def encode_python(v, indent: int = 4, **_) -> str:
    return laid_out(v, indent, lambda x: "None" if x is None else str(x) if isinstance(x, bool) else number(x, "float('nan')", "float('inf')") if is_number(x) else repr(str(x)), repr)


def number(x, nan: str, inf: str) -> str:
    t = number_text(x)
    return {"NaN": nan, "+Inf": inf, "-Inf": "-" + inf}.get(t, t)


def laid_out(v, indent: int, scalar: Callable, key: Callable, depth: int = 0) -> str:
    if not isinstance(v, (list, dict)):
        return scalar(v)
    left, right = "[]" if isinstance(v, list) else "{}"
    parts = [laid_out(x, indent, scalar, key, depth + 1) for x in v] if isinstance(v, list) else [f"{key(k)}: {laid_out(x, indent, scalar, key, depth + 1)}" for k, x in v.items()]
    if not parts or not indent:
        return left + ", ".join(parts) + right
    pad = "\n" + " " * indent * (depth + 1)
    return left + pad + ("," + pad).join(parts) + "\n" + " " * indent * depth + right


JS = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)
      | (?P<num>[+-]?(?:0[xX][0-9a-fA-F]+|0[oO][0-7]+|0[bB][01]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|Infinity|NaN))(?![\w$])
      | (?P<name>[A-Za-z_$][\w$]*)
      | (?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\$]|\\.|\$(?!\{))*`)
      | (?P<op>[{}\[\]():,;=])""",
    re.X | re.S,
)
JS_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": ""}


def js_text(raw: str) -> str:
    def one(m: re.Match) -> str:
        e = m[1]
        if e[0] in "xu" and len(e) > 1:
            return chr(int(e[1:].strip("{}"), 16))
        return JS_ESCAPES.get(e, e)

    return re.sub(r"\\(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|u\{[0-9a-fA-F]+\}|.)", one, raw[1:-1], flags=re.S)


class JavaScript:
    """Object and array literals, comments, bare keys, trailing commas; `export default`, `module.exports =` and
    `const x =` before a literal are passed over."""

    def __init__(self, s: str):
        self.tokens, at = [], 0
        while at < len(s):
            m = JS.match(s, at)
            if not m:
                if s[at] == "." and self.tokens and self.tokens[-1][0] == "name":
                    at += 1
                    continue
                raise FormatError(f"unexpected {s[at]!r} at {at}")
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.tokens.append(("end", ""))
        self.at = 0

    def take(self) -> tuple[str, str]:
        self.at += 1
        return self.tokens[self.at - 1]

    def now(self) -> str:
        return self.tokens[self.at][1]

    def documents(self) -> list:
        out = []
        while self.tokens[self.at][0] != "end":
            if self.now() == ";":
                self.take()
                continue
            while self.now() in ("export", "default", "module", "exports", "const", "let", "var"):
                named = self.take()[1] in ("const", "let", "var")
                if named:
                    self.take()
            if self.now() == "=":
                self.take()
            out.append(self.value())
        return out

    def value(self):
        kind, raw = self.take()
        if kind == "str":
            return js_text(raw)
        if kind == "num":
            sign, digits = (-1, raw[1:]) if raw[0] == "-" else (1, raw.lstrip("+"))
            if digits[:2].lower() in ("0x", "0o", "0b"):
                return sign * int(digits, 0)
            if digits in ("Infinity", "NaN"):
                return sign * float(digits.replace("Infinity", "inf"))
            return sign * (float(digits) if re.search(r"[.eE]", digits) else int(digits))
        if kind == "name" and raw in ("true", "false", "null", "undefined"):
            return {"true": True, "false": False}.get(raw)
        if raw == "(":
            v = self.value()
            self.close(")")
            return v
        if raw == "[":
            return self.items("]", self.value)
        if raw == "{":
            return dict(self.items("}", self.pair))
        raise FormatError(f"unexpected {raw or 'end'!r}")

    def pair(self) -> tuple[str, object]:
        kind, raw = self.take()
        key = js_text(raw) if kind == "str" else raw
        if kind not in ("str", "name", "num"):
            raise FormatError(f"{raw!r} is not a key")
        self.close(":")
        return key, self.value()

    def items(self, end: str, one: Callable) -> list:
        out = []
        while self.now() != end:
            out.append(one())
            if self.now() != end:
                self.close(",")
        self.take()
        return out

    def close(self, raw: str) -> None:
        if self.take()[1] != raw:
            raise FormatError(f"expected {raw!r}")


def encode_javascript(v, indent: int = 2, **_) -> str:
    def key(k: str) -> str:
        return k if re.fullmatch(r"[A-Za-z_$][\w$]*", k) else json.dumps(k, ensure_ascii=False)

    return laid_out(v, indent, lambda x: "null" if x is None else ("true" if x else "false") if isinstance(x, bool) else number(x, "NaN", "Infinity") if is_number(x) else json.dumps(x, ensure_ascii=False), key)


DECODERS = {"json": decode_json, "yaml": decode_yaml, "toml": decode_toml, "csv": decode_csv, "python": decode_python, "javascript": lambda s: JavaScript(s).documents()}
ENCODERS = {"json": encode_json, "yaml": encode_yaml, "toml": encode_toml, "csv": encode_csv, "python": encode_python, "javascript": encode_javascript}


def decode_all(s: str, name: str) -> list:
    """The documents of a text; what is not of the format, or is nested too deeply to be read, raises FormatError."""
    try:
        return DECODERS[format_named(name)](s)
    except (RecursionError, OverflowError, IndexError) as x:
        raise FormatError(str(x)) from None


def decode(s: str, name: str):
    """The text's only document, or its first."""
    found = decode_all(s, name)
    return found[0] if found else None


def encode(v, name: str, **options) -> str:
    """indent: columns of indentation; 0 asks for one line where the format has it."""
    try:
        return ENCODERS[format_named(name)](v, **options)
    except RecursionError:
        raise FormatError("the value is nested too deeply") from None


def convert(s: str, source: str, target: str, **options) -> str:
    """Several documents become several YAML documents, or a list in formats that have one document."""
    found = decode_all(s, source)
    if len(found) > 1 and format_named(target) == "yaml":
        return "\n---\n".join(encode(v, target, **options) for v in found)
    return encode(found[0] if len(found) == 1 else found, target, **options)


# which format a text has

#: Signs of the formats in the first characters of a text.
SIGNS = {
    "json": (r'\A\s*[\[{]', r'"[^"\n]*"\s*:\s*', r'\A\s*(?:true|false|null|-?\d[\d.]*|"[^"\n]*")\s*\Z', r'[\]}]\s*\Z'),
    "yaml": (r"^---(?:\s|$)", r"^[ ]*[\w.-]+:(?:\s|$)", r"^[ ]*- \S", r"^[ ]*[\w.-]+:\s*[|>][+-]?$", r"(?:^|\s)[&*]\w+"),
    "toml": (r"^\s*\[{1,2}[\w.\"'-]+\]{1,2}\s*$", r"^\s*[\w.\"-]+\s*=\s*\S", r"^\s*[\w.-]+\s*=\s*\d{4}-\d\d-\d\d"),
    "csv": (r"^[^,\n{}\[\]:=]+(?:,[^,\n{}\[\]:=]*)+$\n^[^,\n]*(?:,[^,\n]*)+$", r'^"[^"]*"(?:,"[^"]*")+$'),
    "python": (r"\b(?:True|False|None)\b", r"^\s*[\[{(].*'[^'\n]*'\s*[:,]", r"'[^'\n]*'\s*:", r"\([^()\n]*,[^()\n]*\)"),
    "javascript": (r"^\s*(?:export default|module\.exports|const |let |var )", r"[{,]\s*[A-Za-z_$][\w$]*\s*:", r"//[^\n]*$|/\*", r",\s*[\]}]", r"\bundefined\b"),
}
LOOKED_AT, PER_HIT, PER_RIVAL = 1024, 15, 5


def guess_format(s: str) -> str:
    """By signs in the first LOOKED_AT characters, less for signs that several formats have; json where nothing speaks, and
    last of equals. A text's beginning is what tells its format; decoding reads all of it."""
    head = s[:LOOKED_AT]
    hits = {name: sum(re.search(p, head, re.M) is not None for p in signs) for name, signs in SIGNS.items()}
    rivals = sum(n > 0 for n in hits.values()) - 1
    best = max(FORMATS, key=lambda n: (hits[n] * PER_HIT - rivals * PER_RIVAL * (hits[n] > 0), n != "json", -FORMATS.index(n)))
    return best if hits[best] else "json"


def format_of(explicit: str | None = None, path: str | None = None, content: str | None = None) -> str:
    """The explicit name, else the file's ending, else what the content looks like, else json."""
    if explicit:
        return format_named(explicit)
    ending = path.rpartition(".")[2].lower() if path and "." in path else ""
    if ALIASES.get(ending, ending) in FORMATS:
        return ALIASES.get(ending, ending)
    return guess_format(content) if content else "json"
