"""Token ids from the tokenizers library, with each frequent pre-token encoded once a worker.

A BPE model never merges over a pre-token's edge, so a text's ids are its pre-tokens' ids in a row. Pre-tokens are split
by the tokenizer's own pattern, encoded by the library's model and kept as bytes; what is kept is bounded. Whatever could
be split or normalised differently here than in the library (control characters, code points outside the Latin blocks,
strings of special tokens) goes to the library whole.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import unicodedata
from array import array

import regex
from tokenizers import Tokenizer

from arborq.llm import common

#: The pattern of byte-level pre-tokenizers, as the format defines it.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Anything but Latin letters without combining marks or the dotted capital I, common spaces and typographic marks.
NOT_PLAIN = re.compile(r"[^\t\n\r\x20-\x7e\xa0-\u012f\u0131-\u024f\u2010-\u2027]").search
#: What may stand in plain text.
PLAIN = "".join(map(chr, [9, 10, 13, *range(0x20, 0x7F), *range(0xA0, 0x130), *range(0x131, 0x250), *range(0x2010, 0x2028)]))
#: How many pre-tokens a worker keeps where other stages' memory stays with its executor, and where encoding is all there is.
KEPT_WORDS, MORE_WORDS, LONGEST = 150_000, 400_000, 64


def ranges(kind: str) -> str:
    """The plain characters of a Unicode category and their lower-case ones, as a regex has them between brackets."""
    at = sorted({ord(c) for c in PLAIN + PLAIN.lower() if unicodedata.category(c)[0] == kind})
    runs = [[x for _, x in g] for _, g in itertools.groupby(enumerate(at), key=lambda x: x[1] - x[0])]
    return "".join(re.escape(chr(r[0])) + (f"-{re.escape(chr(r[-1]))}" if len(r) > 1 else "") for r in runs)


def plain_finder(pattern: str):
    """findall of a pattern with \\p{L} and \\p{N} by the standard library's faster regexes, for plain texts; by the
    regex library where that could differ."""
    slow = regex.compile(pattern).findall
    letters, out, inside = {"L": ranges("L"), "N": ranges("N")}, "", False
    for part in re.split(r"(\\p\{[LN]\}|\\.|\[|\])", pattern):
        named = re.fullmatch(r"\\p\{([LN])\}", part)
        out += (letters[named[1]] if inside else f"[{letters[named[1]]}]") if named else part
        inside = part == "[" or inside and part != "]"
    try:
        fast = re.compile(out).findall
    except re.error:
        return slow
    probes = [x.join(y) for x in ("", " ", "a", "1 ", "'", "  x\n\n y's 'LL ") for y in (PLAIN, PLAIN.lower())]
    return fast if all(fast(x) == slow(x) for x in probes) else slow


#: Bytes as the characters that byte-level models have for them: printable ones as they are, the others from 256 on.
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
AS_SHOWN = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in SHOWN)}


class _Ids(dict):
    """Pre-token to the bytes of its ids (unsigned, little-endian, 32 bits); holds at most `kept` of them."""

    def __init__(self, tokenizer: Tokenizer, kept: int):
        super().__init__()
        self.kept = kept
        self.split = tokenizer.model.tokenize

    def __missing__(self, word: str) -> bytes:
        ids = le_bytes([t.id for t in self.split(word.encode().decode("latin-1").translate(AS_SHOWN))])
        if len(self) < self.kept and len(word) <= LONGEST:
            self[word] = ids
        return ids


def le_bytes(ids: list[int]) -> bytes:
    a = array("I", ids)
    assert a.itemsize == 4
    return a.tobytes()


class Encoder:
    def __init__(self, path: str, kept: int = KEPT_WORDS):
        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        spec = json.loads(self.tokenizer.to_str())
        added = [regex.escape(x["content"]) for x in spec.get("added_tokens") or []]
        self.special = regex.compile("|".join(added)) if added else None
        self.lower, self.find = self._splitter(spec)
        self.ids = _Ids(self.tokenizer, kept)

    @staticmethod
    def _splitter(spec: dict):
        """How plain text splits into pre-tokens, for the two layouts known here; None leaves all to the library."""
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
        if spec["model"]["type"] != "BPE":
            return False, None
        if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not norm:
            return False, plain_finder(BYTE_LEVEL)
        steps = pre.get("pretokenizers") or []
        kinds = [x.get("type") for x in norm.get("normalizers") or []]
        if kinds == ["NFC", "Replace", "Lowercase"] and len(steps) == 2 and steps[0].get("type") == "Split" and steps[0].get("invert") and steps[0].get("behavior") == "Removed" and steps[1].get("type") == "ByteLevel" and not steps[1].get("use_regex", True):
            return True, plain_finder(steps[0]["pattern"]["Regex"])
        return False, None

    def encode(self, text: str | None) -> bytes:
        """The ids of one text as little-endian unsigned 32-bit integers; null counts as empty."""
        if not text:
            return b""
        if self.find is None or NOT_PLAIN(text) or (self.special is not None and (self.special.search(text) or self.lower and self.special.search(text.lower()))):
            return le_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.ids.__getitem__, self.find(text.lower() if self.lower else text)))


@functools.lru_cache(maxsize=4)
def _encoder(path: str, kept: int) -> Encoder:
    return Encoder(path, kept)


def encoder(path: str, kept: int = KEPT_WORDS) -> Encoder:
    """One for each worker process, file and number of kept pre-tokens."""
    found = _encoder(path, kept)
    common.keeps(f"ids {path} {kept}", _encoder.cache_clear)
    return found


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
