"""DuckDB SQL that says what some of this package's queries say, for checking them on small tables."""

from __future__ import annotations

from arborq.llm import jaccard, quality, secretscan

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"
#: The characters of each class, as quality.class_of tells them apart by first bytes.
CLASS_PATTERNS = {
    "lower": "[a-z]", "upper": "[A-Z]", "digit": "[0-9]", "space": r"[\x20\x09-\x0D]", "stop": """[.,;:!?"''()]""", "symbol": "[#*$%&|<>]",
    "ascii": r"[+/=@\\\[\]^_`{}~-]", "latin": r"[\x{80}-\x{27f}]", "wide": r"[\x{280}-\x{10ffff}]", "control": r"[\x00-\x08\x0e-\x1f\x7f]",
}


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def divergence(name: str, doc: str, ref: str, key: str) -> str:
    """Jensen-Shannon distance by document from two tables of (…, bin, n) with totals."""
    p, q = "(d.n::DOUBLE / d.total)", "(r.n::DOUBLE / r.total)"
    part = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({p} + {q}) / 2)) ELSE 0 END"
    return f"""{name} AS (SELECT d.rid, sqrt(greatest(0, sum({part(p)} + {part(q)}) / 2)) AS far, min(r.total) AS weight
  FROM (SELECT *, sum(n) OVER (PARTITION BY rid) AS total FROM {doc}) d
  JOIN (SELECT *, sum(n) OVER (PARTITION BY {key}) AS total FROM {ref}) r ON r.{key} = d.{key} AND r.bin = d.bin
  WHERE d.total > 0 AND r.total > 0 GROUP BY d.rid)"""


def op1() -> str:
    lim = quality.LIMITS
    langs = ", ".join(map(quote, quality.COMMON))
    classes = ", ".join(f"({quote(c)})" for c in CLASS_PATTERNS)
    count = " ".join(f"WHEN {quote(c)} THEN length(t) - length(regexp_replace(t, '{p}', '', 'g'))" for c, p in CLASS_PATTERNS.items())
    listed = ", ".join(f"({quote(lang)}, {quote(w)}, {k})" for lang, words in quality.COMMON.items() for k, w in enumerate(words))
    last = quality.N_WORDS - 1
    bins = ", ".join(f"({quote(lang)}, {k})" for lang in quality.COMMON for k in range(quality.N_WORDS))
    edges = quality.EDGES.decode().replace("'", "''")
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({langs}) THEN lang ELSE '*' END AS name FROM documents),
w AS (SELECT rid, name, unnest(list) AS word, generate_subscripts(list, 1) AS pos FROM (SELECT rid, name, regexp_extract_all(t, '{WORD}') AS list FROM d)),
nw AS (SELECT rid, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars FROM w GROUP BY rid),
win AS (SELECT rid, pos, word AS a, lead(word) OVER p AS b, lead(word, 2) OVER p AS c FROM w WINDOW p AS (PARTITION BY rid ORDER BY pos)),
twice AS (SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM win WHERE c IS NOT NULL) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT pos + k) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY rid),
dup AS (SELECT rid, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{WORD}') GROUP BY rid),
base AS (SELECT rid, doc_id, name, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, (length(t) - length(regexp_replace(t, '{CLASS_PATTERNS["symbol"]}', '', 'g')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN nw USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN dup USING (rid)),
cls AS (SELECT rid, name, c AS bin, CASE c {count} END AS n FROM d, (VALUES {classes}) v(c)),
listed AS (SELECT * FROM (VALUES {listed}) v(name, word, bin)),
hit AS (SELECT rid, bin, count(*) AS n FROM (SELECT rid, name, unnest(regexp_extract_all(translate(translate(t, '{edges}', ''), '{UPPER}', '{LOWER}'), '{WORD}')) AS word FROM d) JOIN listed USING (name, word) GROUP BY rid, bin),
other AS (SELECT b.rid, greatest(0, n_words - coalesce(sum(n), 0))::BIGINT AS n FROM base b LEFT JOIN hit USING (rid) WHERE name <> '*' GROUP BY b.rid, n_words),
wds AS (SELECT b.rid, b.name, v.bin, CASE WHEN v.bin = {last} THEN o.n ELSE coalesce(h.n, 0) END AS n FROM base b JOIN (VALUES {bins}) v(name, bin) USING (name) LEFT JOIN hit h ON h.rid = b.rid AND h.bin = v.bin JOIN other o ON o.rid = b.rid),
long AS (SELECT rid FROM base WHERE n_words >= {lim["least_words"]}),
rc AS (SELECT name, bin, sum(n)::BIGINT AS n FROM cls JOIN long USING (rid) GROUP BY name, bin),
rw AS (SELECT name, bin, sum(n)::BIGINT AS n FROM wds JOIN long USING (rid) GROUP BY name, bin),
{divergence("jc", "cls", "rc", "name")},
{divergence("jw", "wds", "rw", "name")},
scored AS (SELECT b.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  coalesce(word_chars >= {lim["least_chars"]} AND jc.weight >= {lim["least_reference"]} AND jc.far > {lim["class_limit"]}, false) AS odd_chars,
  coalesce(n_words >= {lim["least_words"]} AND jw.weight >= {lim["least_reference"]} AND jw.far > {lim["word_limit"]}, false) AS odd_words
  FROM base b LEFT JOIN jc USING (rid) LEFT JOIN jw USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR odd_chars OR odd_words) AS kept,
  CASE WHEN base_failed THEN 'base' WHEN odd_chars THEN 'characters' WHEN odd_words THEN 'words' END AS reason FROM scored"""


def op5() -> str:
    """Matches are marked with characters that the texts do not have, and their places are sums of lengths."""

    def found(k: int, rule: secretscan.Rule) -> str:
        p = rule.pattern.replace("'", "''")
        keep = f" AND regexp_full_match(m, '{rule.keep.replace(chr(39), chr(39) * 2)}')" if rule.keep else ""
        return f"""SELECT rid, {k} AS k, '{rule.kind}' AS kind, place, place + length(m) AS until FROM (
  SELECT rid, string_split(part, chr(57345))[1] AS m, no, coalesce(sum(length(replace(part, chr(57345), ''))) OVER (PARTITION BY rid ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place
  FROM (SELECT rid, unnest(parts) AS part, generate_subscripts(parts, 1) AS no FROM (SELECT rid, string_split(regexp_replace(t, '({p})', chr(57344) || '\\1' || chr(57345), 'g'), chr(57344)) AS parts FROM d)))
  WHERE no > 1{keep}"""

    every = " UNION ALL ".join(found(k, r) for k, r in enumerate(secretscan.RULES))
    n = len(secretscan.BASE)
    text = "string_agg(kind || ':' || place || ':' || until, ',' ORDER BY place, k)"
    counts = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secretscan.BASE)
    own = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secretscan.BASE)
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
hit AS ({every}),
s AS (SELECT rid, {own}, {text} FILTER (k < {n}) AS base, {text} AS spans FROM hit GROUP BY rid)
SELECT doc_id, {counts}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN s USING (rid)"""


def op9() -> str:
    n = jaccard.N
    return f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + {n - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {n - 1}, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM shared JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE {jaccard.DOWN} * c >= {jaccard.UP} * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT doc_id, doc_id FROM size UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b)
SELECT d.doc_id, coalesce(size.n, 0)::BIGINT AS n_shingles, coalesce(r.c, d.doc_id) AS component_id FROM d LEFT JOIN size USING (doc_id) LEFT JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = d.doc_id"""
