"""URL filters: host and path rules, and empirical-Bayes host reputation (operator 4).

Labelled page outcomes (good or bad) are counted per host, registered domain, suffix and overall. Rates shrink from the
top down: each level's rate is a beta-binomial posterior mean whose prior is centred on the level above and is worth as
many outcomes as the level's children agree on (moments). A host is blocked when the lower bound of its bad rate, mean
minus `z` posterior standard deviations, lies above `limit`.

Everything is DataFrame operations: partial aggregation before each shuffle, and a salted join back for hosts that hold
a large part of all pages.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborq.llm import common

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The contract's rules.
RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


def host_of(url: Column) -> Column:
    return F.coalesce(common.lower_ascii(F.regexp_extract(url, PARTS, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def pick(rules, host: Column, path: Column, field: str) -> Column:
    """The longest rule that fits (of equals, the first given): its text or its verdict; null where none fits."""
    out = None
    for rule in sorted(rules, key=lambda r: -len(r.text)):
        value = F.lit(getattr(rule, field))
        out = F.when(fits(rule, host, path), value) if out is None else out.when(fits(rule, host, path), value)
    return out if out is not None else F.lit(None).cast("string")


#: Second labels that registries under two-letter country codes sell names below, as in example.co.uk.
SECOND_LABELS = ("ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "ltd", "me", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
ADDRESS = r"^([0-9]+(\.[0-9]+){3}|\[.*)\z"


def name_of(host: Column) -> Column:
    """The host without user info, port and closing dots, as the levels above it are named."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*\z", ""), r"\.+\z", "")


def levels_of(host: Column) -> dict[str, Column]:
    """The registered domain and the suffix that a host is below.

    A suffix is the last label, or the last two where a country code of two letters follows one of SECOND_LABELS; a
    registered domain has one label more. A suffix by itself is its own domain; an IP address is its own domain and suffix,
    so that it shares nothing with its numeric neighbours.
    """
    name = name_of(host)
    labels = F.split(name, r"\.")
    last, second = F.try_element_at(labels, F.lit(-1)), F.try_element_at(labels, F.lit(-2))
    n = F.when(last.rlike(r"^[a-z]{2}\z") & F.coalesce(second.isin(*SECOND_LABELS), F.lit(False)), 2).otherwise(1)
    address = name.rlike(ADDRESS)

    def ending(k: Column) -> Column:
        k = F.least(k, F.size(labels))
        return F.when(address, name).otherwise(F.array_join(F.slice(labels, F.size(labels) - k + 1, k), "."))

    return {"domain": ending(n + 1), "suffix": ending(n)}


def strength(children: DataFrame, key: str, most: float) -> DataFrame:
    """For each parent, how many outcomes its prior is worth, by the method of moments over its children's rates.

    children has (key, n, bad). With pooled rate m, the children's rates scatter by s2 = sum n (r - m)^2 / sum n; the part
    that binomial noise explains is m (1 - m) * k / sum n. The rest, v, is the prior's variance: m (1 - m) / v - 1
    outcomes, held between 1 and `most` (also where no scatter is left to explain).
    """
    sums = children.groupBy(key).agg(F.sum("n").cast("double").alias("n"), F.sum("bad").cast("double").alias("bad"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("q"), F.count("*").cast("double").alias("k"))
    m = F.col("bad") / F.col("n")
    spread = F.col("q") / F.col("n") - m * m - m * (1 - m) * F.col("k") / F.col("n")
    worth = F.when((spread <= 0) | (m <= 0) | (m >= 1), F.lit(most)).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(most), m * (1 - m) / spread - 1)))
    return sums.select(key, worth.alias("worth"))


def reputation(pages: DataFrame, most: float = 50.0, limit: float = 0.5, z: float = 1.0) -> DataFrame:
    """pages (host, bad boolean or null where unlabelled) to one row for each host: rows, outcomes, bad rate, bound, block.

    Levels above the host are counted from host counts, so the pages are shuffled once, pre-aggregated; host and domain
    counts, each used on several branches, are cut once. The table of
    suffixes is joined by shuffle like the others; only the one-row total is broadcast.
    """
    labelled = F.col("bad").isNotNull()
    hosts = pages.groupBy("host").agg(F.count("*").alias("__rows"), F.sum(labelled.cast("long")).alias("n"), F.sum(F.coalesce(F.col("bad").cast("long"), F.lit(0))).alias("bad"))
    hosts = common.cut(hosts.withColumns(levels_of(F.col("host"))))
    known = hosts.where("n > 0")
    domains = common.cut(known.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("all", F.lit(0))
    total = suffixes.groupBy("all").agg(F.sum("n").alias("n_all"), F.sum("bad").alias("bad_all"))
    top = total.join(strength(suffixes, "all", most).withColumnRenamed("worth", "w_all"), "all")

    def shrunk(bad: str, n: str, prior: Column, worth: Column) -> Column:
        return (F.col(bad) + prior * worth) / (F.col(n) + worth)

    s = (
        suffixes.join(F.broadcast(top), "all")  # one row
        .join(strength(domains, "suffix", most).withColumnRenamed("worth", "w_suffix"), "suffix")
        .select("suffix", "w_suffix", shrunk("bad", "n", (F.col("bad_all") + 0.5) / (F.col("n_all") + 1), F.col("w_all")).alias("p_suffix"))
    )
    d = (
        domains.join(s, "suffix")
        .join(strength(known, "domain", most).withColumnRenamed("worth", "w_domain"), "domain")
        .select("domain", "w_domain", shrunk("bad", "n", F.col("p_suffix"), F.col("w_suffix")).alias("p_domain"))
    )
    floor = top.select(((F.col("bad_all") + 0.5) / (F.col("n_all") + 1)).alias("p_all"), F.col("w_all"))
    every = floor.agg(F.coalesce(F.max("p_all"), F.lit(0.0)).alias("p_all"), F.coalesce(F.max("w_all"), F.lit(most)).alias("w_all"))  # one row, also without labels
    out = (
        hosts.join(d, "domain", "left")
        .join(s.select("suffix", "p_suffix", "w_suffix"), "suffix", "left")
        .crossJoin(F.broadcast(every))
        .withColumns({"prior": F.coalesce("p_domain", "p_suffix", "p_all"), "worth": F.coalesce("w_domain", "w_suffix", "w_all")})
    )
    a = F.col("bad") + F.col("prior") * F.col("worth")
    ab = F.col("n") + F.col("worth")
    mean = a / ab
    bound = F.greatest(F.lit(0.0), mean - z * F.sqrt(mean * (1 - mean) / (ab + 1)))
    return out.select("host", "__rows", F.col("n").alias("n_labelled"), F.col("bad").alias("n_bad"), mean.alias("bad_rate"), bound.alias("bad_bound"), (bound > limit).alias("block"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, **settings) -> DataFrame:
    """Every page's host, path, rule and verdict; outcomes (page_id, bad) are the labels that reputations are learnt from.

    A null url or one without :// has an empty host and path; such pages share the empty host's reputation. Pages with
    equal urls get equal verdicts. Outcomes with a null page_id or a null bad count for nothing; of several for one page
    any bad one makes it bad. Repeated pages stay repeated, other columns are ignored, empty tables give an empty result.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    marks = outcomes.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy(F.col("page_id").cast("long").alias("page_id")).agg(F.max(F.col("bad").cast("boolean")).alias("bad"))
    hosts = common.cut(reputation(rows.join(marks, "page_id", "left"), **settings))
    known = hosts.select("host", "block")
    judged = common.join_hot(rows, known, "host", hosts.select("host", "__rows"), spread_by=F.xxhash64("page_id", "path"))
    host, path = F.col("host"), F.col("path")
    verdict = F.coalesce(pick(rules, host, path, "verdict"), F.when(F.col("block"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", pick(rules, host, path, "text").alias("rule"), verdict.alias("verdict"))


def op4_url_reputation(spark, sf_dir: str) -> DataFrame:
    """All of pages; a page's outcome is the label of the document with its number: bad if toxic or of low quality."""
    labels = common.table(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    return judge(common.table(spark, sf_dir, "pages"), outcomes)


def sql_strength(children: str, key: str, name: str, most: float) -> str:
    return f"""{name} AS (
  SELECT {key}, CASE WHEN spread <= 0 OR m <= 0 OR m >= 1 THEN {most}::DOUBLE ELSE greatest(1.0::DOUBLE, least({most}::DOUBLE, m * (1 - m) / spread - 1)) END AS worth
  FROM (SELECT {key}, m, q / n - m * m - m * (1 - m) * k / n AS spread FROM (
    SELECT {key}, n, q, k, bad / n AS m FROM (
      SELECT {key}, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad, sum(bad::DOUBLE * bad / n) AS q, count(*)::DOUBLE AS k FROM {children} GROUP BY {key}))))"""


def sql(most: float = 50.0, limit: float = 0.5, z: float = 1.0) -> str:
    def case(field: str) -> str:
        arms = " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{getattr(r, field)}'" for r in sorted(RULES, key=lambda r: -len(r.text)))
        return f"CASE {arms} END"

    seconds = ", ".join(f"'{x}'" for x in SECOND_LABELS)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""WITH page AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '{PARTS}', 1), ''), '{upper}', '{lower}') AS host, coalesce(regexp_extract(url, '{PARTS}', 2), '') AS path FROM pages),
mark AS (SELECT doc_id AS page_id, bool_or(toxic = 1 OR quality = 0) AS bad FROM labels GROUP BY doc_id),
counted AS (SELECT host, count(bad) AS n, coalesce(sum(bad::INT), 0)::BIGINT AS bad FROM page LEFT JOIN mark USING (page_id) GROUP BY host),
named AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*\\z', ''), '\\.+\\z', '') AS name FROM counted),
cut AS (SELECT *, regexp_matches(name, '{ADDRESS}') AS address, string_split(name, '.') AS labels FROM named),
sized AS (SELECT *, CASE WHEN regexp_matches(labels[-1], '^[a-z]{{2}}\\z') AND coalesce(labels[-2] IN ({seconds}), false) THEN 2 ELSE 1 END AS k FROM cut),
hosts AS (SELECT host, n, bad, CASE WHEN address THEN name ELSE array_to_string(labels[-k:], '.') END AS suffix, CASE WHEN address THEN name ELSE array_to_string(labels[-(k + 1):], '.') END AS domain FROM sized),
known AS (SELECT * FROM hosts WHERE n > 0),
domains AS (SELECT suffix, domain, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM known GROUP BY suffix, domain),
suffixes AS (SELECT suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad, 0 AS one FROM domains GROUP BY suffix),
{sql_strength('suffixes', 'one', 'w_all', most)},
{sql_strength('domains', 'suffix', 'w_suffix', most)},
{sql_strength('known', 'domain', 'w_domain', most)},
top AS (SELECT (sum(bad) + 0.5::DOUBLE) / (sum(n) + 1) AS p, max(worth) AS worth FROM suffixes, w_all),
s AS (SELECT x.suffix, w.worth, (x.bad + top.p * top.worth) / (x.n + top.worth) AS p FROM suffixes x JOIN w_suffix w USING (suffix), top),
d AS (SELECT x.domain, w.worth, (x.bad + s.p * s.worth) / (x.n + s.worth) AS p FROM domains x JOIN s USING (suffix) JOIN w_domain w USING (domain)),
post AS (SELECT h.host, h.bad + coalesce(d.p, s.p, top.p, 0) * coalesce(d.worth, s.worth, top.worth, {most}) AS a, h.n + coalesce(d.worth, s.worth, top.worth, {most}) AS ab FROM hosts h LEFT JOIN d USING (domain) LEFT JOIN s ON s.suffix = h.suffix, top),
judged AS (SELECT host, greatest(0, a / ab - {z}::DOUBLE * sqrt(a / ab * (1 - a / ab) / (ab + 1))) > {limit}::DOUBLE AS block FROM post)
SELECT page_id, host, path, {case('text')} AS rule, coalesce({case('verdict')}, CASE WHEN block THEN 'block' ELSE 'allow' END) AS verdict
FROM page LEFT JOIN judged USING (host)"""
