"""Quality rules by distribution divergence (operator 1).

Two histograms of a text, of character classes and of its language's most common words, are compared to references for
its language by Jensen-Shannon distance (base 2, so from 0 to 1). The references are the summed histograms of all
documents of the language that are long enough; languages without a list of common words share one reference of
character classes. Guards: a text is compared only from a least length on, and only to a reference of enough weight.

Two passes over the texts, no shuffle of texts and no table in between: the first sums a few numbers a language, the
second computes everything else with those at hand.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborq.llm import common

#: Common words of each language.
COMMON = {
    "en": "the of and to a in is that it was for on are as with his they at be this from or had by he".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er so".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero".split(),
}
#: The language name of the shared reference, and characters that touch a word without being part of it.
OTHER, EDGES = "*", b".,;:!?\"'()"
SYMBOLS = b"#*$%&|<>"
#: Character classes of bytes; a code point counts by its first byte, bytes from 0x80 to 0xBF by none.
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "ascii", "latin", "wide", "control")
NO_CLASS = len(CLASSES)


def class_of(b: int) -> int:
    c = bytes([b])
    if 0x80 <= b < 0xC0:
        return NO_CLASS
    if b >= 0xC0:
        return CLASSES.index("latin" if b < 0xCA else "wide")
    for name, test in (("lower", c.islower()), ("upper", c.isupper()), ("digit", c.isdigit()), ("space", c in b" \t\n\v\f\r"), ("stop", c in EDGES), ("symbol", c in SYMBOLS), ("control", b < 32 or b == 127)):
        if test:
            return CLASSES.index(name)
    return CLASSES.index("ascii")


CLASS_OF = np.array([class_of(b) for b in range(256)], np.uint8)
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
WORD_BIN = {lang: {w.encode(): k for k, w in enumerate(words)} for lang, words in COMMON.items()}
N_WORDS = max(map(len, COMMON.values())) + 1

#: Settings. Distances above the limits reject; lengths below the guards are not compared. The limits lie above what documents
#: labelled good reach (0.24 by characters and 0.28 by words in a table of 10,000) and below most that are labelled bad.
LIMITS = {"class_limit": 0.3, "word_limit": 0.32, "least_chars": 200, "least_words": 80, "least_reference": 2000}


def histograms(data: bytes, words: list[bytes], lang: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Counts of character classes, and of the language's common words with the other words in the last place."""
    classes = np.bincount(CLASS_OF[np.frombuffer(data, np.uint8)], minlength=NO_CLASS + 1)[:NO_CLASS]
    bins = WORD_BIN.get(lang)
    common_words = np.zeros(N_WORDS, np.int64)
    if bins is not None:
        found = 0
        for w, n in Counter(data.translate(LOWER, EDGES).split()).items():
            k = bins.get(w)
            if k is not None:
                common_words[k] = n
                found += n
        common_words[-1] = max(0, len(words) - found)
    return classes.astype(np.int64), common_words


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms that are not empty."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return float(np.sqrt(max(0.0, parts.sum() / 2)))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words which the text has more than once."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    total, end = 0, 0
    for k, w in enumerate(windows):
        if counts[w] > 1:
            total += k + 3 - max(k, end)
            end = k + 3
    return total


def base(data: bytes, words: list[bytes], classes: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    lines = [x for x in data.split(b"\n") if x.strip()]
    n_symbols = len(data) - len(data.translate(None, SYMBOLS))
    return len(words), int(classes.sum() - classes[CLASSES.index("space")]), n_symbols, len(lines) - len(set(lines)), repeated_words(words)


def failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def reference_name(lang: str | None) -> str:
    return lang if lang in COMMON else OTHER


def references(docs: DataFrame, least_words: int = LIMITS["least_words"], **_) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Summed histograms of all documents of at least least_words words, for each listed language and the rest.

    Each task sums its own; what reaches the driver is at most a row a language and bin.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = (text or "").encode()
                words = data.split()
                if len(words) >= least_words:
                    name = reference_name(lang)
                    sums.setdefault(name, np.zeros(NO_CLASS + N_WORDS, np.int64))
                    sums[name] += np.concatenate(histograms(data, words, lang))
        schema = pa.schema([("lang", pa.string()), ("bin", pa.int32()), ("n", pa.int64())])
        yield from common.rows_out(((name, k, int(v)) for name, a in sums.items() for k, v in enumerate(a)), schema)

    rows = docs.select(F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(summed, "lang string, bin int, n long")
    out = {name: np.zeros(NO_CLASS + N_WORDS, np.int64) for name in (*COMMON, OTHER)}
    for name, k, n in rows.groupBy("lang", "bin").agg(F.sum("n")).collect():
        out[name][k] = n
    return {name: (a[:NO_CLASS], a[NO_CLASS:]) for name, a in out.items()}


def reason(data: bytes, words: list[bytes], lang: str | None, refs: dict, numbers: tuple, hist: tuple, *, class_limit: float, word_limit: float, least_chars: int, least_words: int, least_reference: int) -> tuple[str | None, float | None, float | None]:
    """Why a text is rejected (null: it is kept), and its distances (null: not compared)."""
    classes, common_words = hist
    ref_classes, ref_words = refs[reference_name(lang)]
    by_class = by_word = None
    if numbers[1] >= least_chars and ref_classes.sum() >= least_reference:
        by_class = distance(classes, ref_classes)
    if lang in COMMON and numbers[0] >= least_words and ref_words.sum() >= least_reference:
        by_word = distance(common_words, ref_words)
    if failed(numbers[0], numbers[4]):
        return "base", by_class, by_word
    if by_class is not None and by_class > class_limit:
        return "characters", by_class, by_word
    if by_word is not None and by_word > word_limit:
        return "words", by_class, by_word
    return None, by_class, by_word


SCORES = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("reason", pa.string()), ("class_distance", pa.float64()), ("word_distance", pa.float64())])


def judged(text: str | None, lang: str | None, refs: dict, limits: dict) -> tuple:
    data = (text or "").encode()
    words = data.split()
    hist = histograms(data, words, lang)
    numbers = base(data, words, hist[0])
    why, by_class, by_word = reason(data, words, lang, refs, numbers, hist, **limits)
    return *numbers, why == "base", why is None, why, by_class, by_word


def score(docs: DataFrame, refs: dict | None = None, **limits) -> DataFrame:
    """A row for each of docs (doc_id, text, lang) with its base numbers, distances and verdict.

    Null texts count as empty: no words, failed, not kept. A null or unlisted language uses the shared reference of
    character classes. Repeated rows stay repeated, null doc_ids are kept, other columns are ignored, an empty table
    gives an empty result; distances are null where a guard forbids comparing.
    """
    limits = LIMITS | limits
    refs = refs or references(docs, **limits)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.keeps("quality", dict)

        def rows():
            for batch in batches:
                for d, text, lang in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    yield d, *judged(text, lang, refs, limits)

        yield from common.rows_out(rows(), SCORES)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return rows.mapInArrow(scored, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, reason string, class_distance double, word_distance double")


def keep_good(docs: DataFrame, **limits) -> DataFrame:
    """The rows of docs, all columns as they were, that score() keeps: none with a null or an empty text, repeated rows
    and null doc_ids like any others, of an empty table none."""
    limits = LIMITS | limits
    refs, names = references(docs, **limits), docs.columns
    text_at, lang_at = names.index("text"), names.index("lang")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.keeps("quality", dict)
        for batch in batches:
            good = [judged(t, x, refs, limits)[6] for t, x in zip(batch.column(text_at).to_pylist(), batch.column(lang_at).to_pylist(), strict=True)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


def op1_divergence_quality(spark, sf_dir: str) -> DataFrame:
    """All of documents, with references from all of documents."""
    return score(common.table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")
