"""URL filter: rules first, then empirical-Bayes reputation of the host.

A url that a rule fits has the rule's verdict.  These pages are also the labelled outcomes (1 for block, 0 for allow)
from which the reputation of hosts is learnt; any other table of outcomes by host can be given.  Outcomes are counted by
host, registered domain and suffix.  Each level's rate of bad pages is shrunk towards the level above by a beta-binomial
prior: the suffix towards the overall rate, the domain towards the suffix's posterior mean, the host towards the
domain's.  The strength of a level's prior is estimated by the method of moments from how far the level's rates lie
apart.  A page without a rule is blocked only if a lower bound of its host's posterior rate of bad pages is above the
threshold, so hosts of which little is known stay.

The suffix of a host is its last label, or its last two where these are in the table of suffixes that registries sell
under, a parameter; the registered domain is the label before that and the suffix.  The bound is the posterior mean less
``z`` standard deviations of the beta posterior, which needs no quantile function.

All counts are sums that are combined before the shuffle.  A host with a third of all pages is one row of the
reputation table; the pages meet it in an outer join that adaptive execution can broadcast or split.  The counts by host
and the posteriors are written once each, so pages are read for the counts and for the verdicts only.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and counts as a host
without outcomes of its own; repeated rows are judged alike and count each; null ids stay null; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules of the contract: (verdict, host/path).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Suffixes of two labels.
SUFFIXES = ("ac.jp", "ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.hk", "com.mx", "com.sg", "com.tr", "com.tw", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")
#: Pages are blocked if the posterior rate, less Z standard deviations, is over THRESHOLD.  A prior is worth between 1 and 1,000 pages.
Z, THRESHOLD, LEAST, MOST = 1.645, 0.5, 1.0, 1000.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls.  ``rules`` is a short list of patterns, not a table."""
    rule = verdict = F.lit(None).cast("string")
    for said, pattern in sorted(rules, key=lambda x: len(x[1])):
        top, _, under = pattern.partition("/")
        fits = ((host == top) | F.endswith(host, F.lit(f".{top}"))) & F.startswith(path, F.lit(f"/{under}"))
        rule, verdict = F.when(fits, F.lit(pattern)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def suffix_of(host: Column, suffixes=SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes), two).otherwise(F.substring_index(host, ".", -1)) if suffixes else F.substring_index(host, ".", -1)


def registered_domain(host: Column, suffixes=SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes), F.substring_index(host, ".", -3)).otherwise(two) if suffixes else two


def reputation(outcomes: DataFrame, suffixes_of=SUFFIXES) -> DataFrame:
    """``outcomes``: ``host``, ``bad`` (0 or 1).  Posterior of each host's rate of bad pages, and of its parents' for hosts never seen.

    Rows: ``level`` (host, domain, suffix or all), ``name``, ``mean``, ``strength`` (pages that the posterior is worth).
    """
    hosts = outcomes.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("k"))
    hosts = cut(hosts.select(F.col("host").alias("name"), registered_domain(F.col("host"), suffixes_of).alias("parent"), "n", "k"))
    domains = hosts.groupBy(F.col("parent").alias("name")).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    domains = domains.select("name", suffix_of(F.col("name"), suffixes_of).alias("parent"), "n", "k")
    suffixes = domains.groupBy(F.col("parent").alias("name")).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = suffixes.select("name", F.lit("").alias("parent"), "n", "k")
    total = suffixes.agg((F.coalesce(F.sum("k"), F.lit(0)) + 1).alias("k"), (F.coalesce(F.sum("n"), F.lit(0)) + 2).alias("n"))
    out = top = total.select(F.lit("all").alias("level"), F.lit("").alias("name"), (F.col("k").cast("double") / F.col("n").cast("double")).alias("mean"), F.lit(2.0).alias("strength"))
    above = top
    for level, counts in (("suffix", suffixes), ("domain", domains), ("host", hosts)):
        prior = counts.crossJoin(F.broadcast(_strength(counts)))  # one row
        prior = prior.join(above.select(F.col("name").alias("parent"), F.col("mean").alias("m")), "parent")
        above = prior.select(
            F.lit(level).alias("level"),
            "name",
            ((F.col("s") * F.col("m") + F.col("k")) / (F.col("s") + F.col("n"))).alias("mean"),
            (F.col("s") + F.col("n")).alias("strength"),
        )
        out = out.unionByName(above)
    return out


def _strength(counts: DataFrame) -> DataFrame:
    """Prior strength ``s`` of a level, one row: from the between-group variance of the rates, in whole-number sums.

    With rate p of all pages and groups of n pages, the expected squared distance of a group's k from n p is
    n p (1-p) (1 + (n-1) / (s+1)); summing over groups and solving for s gives the estimate.
    """
    sums = counts.agg(*[F.coalesce(F.sum(x), F.lit(0)).cast("double").alias(a) for a, x in (("n", F.col("n")), ("k", F.col("k")), ("nn", F.col("n") * F.col("n")), ("nk", F.col("n") * F.col("k")), ("kk", F.col("k") * F.col("k")))])
    p = F.col("k") / F.when(F.col("n") > 0, F.col("n"))
    q = p * (1 - p)
    seen = F.col("kk") - 2 * p * F.col("nk") + p * p * F.col("nn")
    excess = (seen / F.when(q > 0, q) - F.col("n")) / F.when(F.col("nn") > F.col("n"), F.col("nn") - F.col("n"))
    s = F.when(excess > 0, 1 / excess - 1).otherwise(F.lit(MOST))
    return sums.select(F.least(F.greatest(F.coalesce(s, F.lit(MOST)), F.lit(LEAST)), F.lit(MOST)).alias("s"))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, outcomes: DataFrame | None = None, z: float = Z, threshold: float = THRESHOLD, suffixes=SUFFIXES) -> DataFrame:
    """One row for each page: id, ``host``, ``path``, ``rule``, ``verdict``, ``mean`` and ``bound`` (posterior rate of bad pages)."""
    host, path = host_and_path(F.col(url_col))
    judged = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = judged.select("*", rule.alias("rule"), verdict.alias("_said"))
    if outcomes is None:
        outcomes = judged.filter("rule IS NOT NULL").select("host", F.when(F.col("_said") == "block", 1).otherwise(0).alias("bad"))
    known = cut(reputation(outcomes, suffixes))
    levels = {x: known.filter(F.col("level") == x).select(F.col("name").alias(f"_{x}"), F.struct("mean", "strength").alias(f"_{x}_of")) for x in ("host", "domain", "suffix", "all")}
    hosts = judged.filter("rule IS NULL").select("host").distinct()
    hosts = hosts.select("host", F.col("host").alias("_host"), registered_domain(F.col("host"), suffixes).alias("_domain"), suffix_of(F.col("host"), suffixes).alias("_suffix"), F.lit("").alias("_all"))
    for x, of in levels.items():
        hosts = hosts.join(of, f"_{x}", "left")
    of = F.coalesce(*[F.col(f"_{x}_of") for x in levels])
    mean, strength = of["mean"], of["strength"]
    scored = hosts.select("host", mean.alias("mean"), (mean - F.lit(z) * F.sqrt(mean * (1 - mean) / (strength + 1))).alias("bound"))
    return judged.join(scored, "host", "left").select(
        F.col("_id").alias(id_col),
        "host",
        "path",
        "rule",
        F.coalesce("_said", F.when(F.col("bound") > threshold, "block").otherwise("allow")).alias("verdict"),
        "mean",
        "bound",
    )


_TWO = "array_to_string((string_split({0}, '.'))[-2:], '.')"
_IN = "(" + ", ".join(f"'{x}'" for x in SUFFIXES) + ")"
_DOMAIN = f"CASE WHEN {_TWO} IN {_IN} THEN array_to_string((string_split({{0}}, '.'))[-3:], '.') ELSE {_TWO} END"
_SUFFIX = f"CASE WHEN {_TWO} IN {_IN} THEN {_TWO} ELSE list_last(string_split({{0}}, '.')) END"
ORACLE = rf"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM h),
o AS (SELECT host, CASE WHEN rule IN ('example.org/es/', 'example.org/en/1', 'com/de/') THEN 1 ELSE 0 END AS bad FROM r WHERE rule IS NOT NULL),
hosts AS (SELECT host AS name, {_DOMAIN.format('host')} AS parent, count(*) AS n, sum(bad) AS k FROM o GROUP BY host),
domains AS (SELECT parent AS name, {_SUFFIX.format('parent')} AS parent, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY 1, 2),
suffixes AS (SELECT parent AS name, '' AS parent, sum(n) AS n, sum(k) AS k FROM domains GROUP BY 1, 2),
m0 AS (SELECT (coalesce(sum(k), 0) + 1)::DOUBLE / (coalesce(sum(n), 0) + 2) AS mean FROM suffixes),
sums AS (
  SELECT 1 AS l, sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k, sum(n * n)::DOUBLE AS nn, sum(n * k)::DOUBLE AS nk, sum(k * k)::DOUBLE AS kk FROM suffixes
  UNION ALL SELECT 2, sum(n), sum(k), sum(n * n), sum(n * k), sum(k * k) FROM domains
  UNION ALL SELECT 3, sum(n), sum(k), sum(n * n), sum(n * k), sum(k * k) FROM hosts),
ex AS (SELECT l, ((kk - 2 * (k / n) * nk + (k / n) * (k / n) * nn) / nullif((k / n) * (1 - k / n), 0) - n) / nullif(nn - n, 0) AS e FROM sums),
st AS (SELECT l, least(greatest(coalesce(CASE WHEN e > 0 THEN 1 / e - 1 ELSE 1000 END, 1000), 1.0), 1000.0) AS s FROM ex),
p1 AS (SELECT name, (s * (SELECT mean FROM m0) + k) / (s + n) AS mean, s + n AS strength FROM suffixes, st WHERE l = 1),
p2 AS (SELECT d.name, (s * p1.mean + k) / (s + n) AS mean, s + n AS strength FROM domains d JOIN p1 ON d.parent = p1.name, st WHERE l = 2),
p3 AS (SELECT x.name, (s * p2.mean + k) / (s + n) AS mean, s + n AS strength FROM hosts x JOIN p2 ON x.parent = p2.name, st WHERE l = 3),
j AS (SELECT r.*, coalesce(p3.mean, p2.mean, p1.mean, (SELECT mean FROM m0)) AS mean, coalesce(p3.strength, p2.strength, p1.strength, 2.0) AS strength
      FROM r LEFT JOIN p3 ON p3.name = r.host LEFT JOIN p2 ON p2.name = {_DOMAIN.format('r.host')}
      LEFT JOIN p1 ON p1.name = {_SUFFIX.format('r.host')})
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.org/es/', 'example.org/en/1', 'com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN mean - 1.645 * sqrt(mean * (1 - mean) / (strength + 1)) > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM j
"""
