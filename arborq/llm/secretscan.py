"""Secret scans by one combined deterministic automaton over all rules (operator 5).

scan() reads each byte of a text once, through the transition arrays of all rules together, and notes where some rule's
match ends. Only there, and for that rule alone, a reversed automaton runs back to the match's leftmost start and a
forward one runs on to its longest end. Per rule the spans are leftmost, longest and do not overlap. Where the text of a
match begins within the one before, the rule's own automaton goes on from there, so that no byte is read again for every
end: a text takes time in proportion to its length, and memory for its spans alone.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborq.llm import common
from arborq.llm.automaton import Dfa, Parser, build, reverse


@dataclass(frozen=True)
class Rule:
    """A kind of secret. keep: a narrower pattern that a match must also fit, or it is dropped; it still uses its text up.
    lead: what every match begins with and what is one itself; the pass over all bytes looks for it alone, so that a long
    rest does not multiply the states of the combined automaton.

    A match must not contain a later-starting match of its own rule that ends before its own first possible end.
    """

    kind: str
    pattern: str
    keep: str | None = None
    lead: str | None = None


#: The contract's three kinds. Bounds on lengths stand in keep, so that the automaton counts no further than
#: it must; only hex counts, since each letter from a to f would end a match of it.
KEY = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
BASE = (
    Rule("assign", KEY + "[A-Za-z0-9+/_.=-]+", KEY + "[A-Za-z0-9+/_.=-]{6,}"),
    Rule("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
)
#: A private key runs from its header to its footer over anything without five dashes in a row; without a footer (a text
#: cut off), over the header's long base64 lines and the shorter line behind them; else it is the header alone.
NAME = "(?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"
BODY = r"(?:-{0,4}(?:[^-]|[\x80-\xFF]))*"
BREAK = r"(?:[\x20\t\r\n]|\\[nr])+"
CUT = f"(?:{BREAK}[A-Za-z0-9+/=]{{32,}})+(?:{BREAK}[A-Za-z0-9+/=]+)?"
#: Further kinds by their public formats.
MORE = (
    Rule("private_key", f"-----BEGIN {NAME}(?:{BODY}-----END {NAME}|{CUT})?", lead=f"-----BEGIN {NAME}"),
    Rule("code_host", "gh[pousr]_[A-Za-z0-9]+", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]+", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        leads = [Parser(r.lead or r.pattern).parse() for r in rules]
        self.all = build(leads, anywhere=True)
        self.own = [build([t], anywhere=True) for t in leads]
        self.alone = [build([Parser(r.pattern).parse()], anywhere=False) for r in rules]
        self.back = [build([reverse(t)], anywhere=False) for t in leads]
        self.keep = [build([Parser(r.keep).parse()], anywhere=False) if r.keep else None for r in rules]

    def ends(self, data: bytes) -> Iterator[tuple[int, int]]:
        """(end, rule) for every byte at which a match of the rule ends: the one pass over all bytes."""
        dfa = self.all
        step, accepting, n, tags = dfa.step, dfa.accepting, dfa.n_kinds, dfa.accepts
        state = dfa.start
        for at, kind in enumerate(data.translate(dfa.kind_of), 1):
            state = step[state + kind]
            if state >= accepting:
                for rule in tags[state // n]:
                    yield at, rule

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, by start and then in the order of the rules."""
        found, used = [], [0] * len(self.rules)
        own: list[tuple[int, int] | None] = [None] * len(self.rules)  # of a rule's own automaton: place and state
        for end, k in self.ends(data):
            if end <= used[k]:
                continue
            if own[k] is not None:
                own[k] = end, advanced(self.own[k], data, *own[k], end)
                if own[k][1] < self.own[k].accepting:
                    continue
            start = longest(self.back[k], data, end, used[k], -1)
            if start is None:  # what ends here began within the match before
                own[k] = end, advanced(self.own[k], data, used[k], self.own[k].start, end)
                continue
            stop = longest(self.alone[k], data, start, len(data), 1)
            used[k], own[k] = stop, None
            if self.keep[k] is None or longest(self.keep[k], data, start, stop, 1) == stop:
                found.append((start, k, stop))
        return sorted(found)

    def scan(self, text: str) -> list[tuple[int, str, int]]:
        """(start, kind, end) in code points, end exclusive."""
        data = text.encode()
        found = self.spans(data)
        if len(data) == len(text):
            return [(a, self.rules[k].kind, b) for a, k, b in found]
        out, at, points = [], 0, 0
        for a, k, b in found:
            points, at = points + len(data[at:a].decode()) if a >= at else len(data[:a].decode()), a
            out.append((points, self.rules[k].kind, points + len(data[a:b].decode())))
        return out


def longest(dfa: Dfa, data: bytes, at: int, bound: int, way: int) -> int | None:
    """The furthest position from at, towards bound, up to which the automaton accepts; None if none does."""
    state, best = dfa.start, at if dfa.start >= dfa.accepting else None
    kind_of, step = dfa.kind_of, dfa.step
    while at != bound:
        state = step[state + kind_of[data[at - (way < 0)]]]
        if state == dfa.dead:
            break
        at += way
        if state >= dfa.accepting:
            best = at
    return best


def advanced(dfa: Dfa, data: bytes, at: int, state: int, end: int) -> int:
    step = dfa.step
    for kind in data[at:end].translate(dfa.kind_of):
        state = step[state + kind]
    return state


@functools.lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


SPANS = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Each document of docs (doc_id, text) with what the rules find in its whole text: counts of the base kinds, a digest
    of the base spans and all spans.

    Null texts count as empty; empty texts have no spans and the digest of the empty string. Repeated rows stay repeated,
    null doc_ids are kept, other columns are ignored, an empty table gives an empty result. No shuffle.
    """
    base = [r.kind for r in BASE]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.keeps("secrets", scanner.cache_clear)
        find = scanner(rules).scan

        def rows():
            for batch in batches:
                for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    spans = find(text) if text else []
                    own = [x for x in spans if x[1] in base]
                    yield d, *(sum(x[1] == k for x in own) for k in base), hashlib.sha256(joined(own).encode()).hexdigest(), joined(spans)

        yield from common.rows_out(rows(), SPANS)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """docs, all columns as they were, with each span (overlapping ones as one) in text replaced by mark.

    n_chars, where there is one, is counted again for texts that changed. Null and empty texts and null doc_ids stay as
    they are, repeated rows stay repeated, an empty table gives an empty result.
    """
    names, schema = docs.columns, docs.schema
    at, count = names.index("text"), names.index("n_chars") if "n_chars" in names else -1

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.keeps("secrets", scanner.cache_clear)
        find = scanner(rules).scan
        for batch in batches:
            columns = list(batch.columns)
            old = batch.column(at).to_pylist()
            new = [hide(t, find(t), mark) if t else t for t in old]
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if count >= 0:
                n = [c if a == b else len(b) for a, b, c in zip(old, new, batch.column(count).to_pylist(), strict=True)]
                columns[count] = pa.array(n, batch.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(clean, schema)


def hide(text: str, spans: list[tuple[int, str, int]], mark: str) -> str:
    out, at = [], 0
    merged: list[list[int]] = []
    for a, _, b in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    """All of documents under the base rules and the further ones."""
    return find_secrets(common.table(spark, sf_dir, "documents"))
