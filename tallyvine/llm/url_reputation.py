"""URL filter: listed rules first, then an empirical-Bayes reputation of hosts. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvine.llm.common import staged

#: (host, path, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = ["co.uk", "org.uk", "ac.uk", "com.au", "com.br", "co.jp", "co.nz", "co.za"]
#: A host is blocked if its share of bad pages is above WORST with this many deviations to spare.
WORST, DEVIATIONS = 0.5, 1.645
#: A fitted prior counts as so many pages at least and at most.
WEAKEST, STRONGEST = 1.0, 1000.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty without ``://`` or for null."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, start, what in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        rule, verdict = F.when(fits, name + start).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _with_posterior(groups: DataFrame) -> DataFrame:
    """Adds ``rate`` and ``weight``, the posterior of ``bad`` of ``n`` under a beta prior around ``prior``.

    The prior's strength is one number per level, from the moments of the beta-binomial:
    ``E[n (bad/n - p)^2] = p (1 - p) (1 + (n - 1) rho)`` and ``strength = 1 / rho - 1``.
    """
    spread = F.col("prior") * (1 - F.col("prior"))
    row = groups.where("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("prior"), 2)).alias("seen"),
        F.sum(spread).alias("base"), F.sum(spread * (F.col("n") - 1)).alias("slope"),
    ).first()
    rho = (row["seen"] - row["base"]) / row["slope"] if row["slope"] else 1.0
    strength = min(STRONGEST, max(WEAKEST, 1.0 / rho - 1.0)) if rho > 0 else STRONGEST
    weight = F.col("n") + F.lit(strength)
    return groups.withColumns({"rate": (F.col("bad") + F.lit(strength) * F.col("prior")) / weight, "weight": weight})


def host_reputations(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``(host, rate, weight)`` of every host in ``pages(host, page_id)``.

    ``outcomes(page_id, bad)``: 1 for a bad page, 0 for a good one. All rows are counted;
    counts are partial aggregates, so a hot host costs one row a task. Every level takes
    the posterior rate of the level above as its prior mean; hosts without a labelled
    page thus have the rate of their domain.
    """
    known = outcomes.where("bad is not null").groupBy("page_id").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    counted = pages.join(known, "page_id", "left").groupBy("host").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")
    )
    labels = F.split("host", r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - (n - 1), F.lit(1)), F.lit(n)), ".")
    two = last(2).isin(TWO_LABEL_SUFFIXES)
    domain, suffix = F.when(two, last(3)).otherwise(last(2)), F.when(two, last(2)).otherwise(last(1))
    hosts = staged(counted.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "bad"), "url-hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    whole = suffixes.agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).first()
    mean = ((whole["bad"] or 0) + 1.0) / ((whole["n"] or 0) + 2.0)
    by_suffix = _with_posterior(suffixes.withColumn("prior", F.lit(mean)))
    by_domain = _with_posterior(domains.join(by_suffix.select("suffix", F.col("rate").alias("prior")), "suffix"))
    return _with_posterior(hosts.join(by_domain.select("domain", F.col("rate").alias("prior")), "domain")).select("host", "rate", "weight")


def judged(pages: DataFrame, outcomes: DataFrame, rules=RULES, worst: float = WORST, deviations: float = DEVIATIONS) -> DataFrame:
    """``page_id, host, path, rule, verdict, rate, bound`` of every row of ``pages(page_id, url)``.

    A rule that fits decides; else a page is blocked if the lower bound of its host's
    posterior share of bad pages is above ``worst``. Null or shapeless urls have the
    empty host, which is judged like any other. Null page ids are judged without an
    outcome; repeated rows are each counted and judged; other columns are not looked at.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = host_reputations(rows.select("page_id", "host"), outcomes)
    bound = F.col("rate") - deviations * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("weight") + 1))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("bound") > worst, "block").otherwise("allow")
    return rows.join(known, "host").withColumn("bound", bound).select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_method).alias("verdict"), "rate", "bound"
    )


_LEVEL = """
m_{name} AS (SELECT sum(n * pow(bad / n - prior, 2)) AS seen, sum(prior * (1 - prior)) AS base,
                    sum(prior * (1 - prior) * (n - 1)) AS slope FROM p_{name} WHERE n > 0),
s_{name} AS (SELECT CASE WHEN rho > 0 THEN least(1000.0, greatest(1.0, 1.0 / rho - 1.0)) ELSE 1000.0 END AS strength
             FROM (SELECT CASE WHEN coalesce(slope, 0) = 0 THEN 1.0 ELSE (seen - base) / slope END AS rho FROM m_{name})),
r_{name} AS (SELECT p.*, (bad + strength * prior) / (n + strength) AS rate, n + strength AS weight FROM p_{name} p, s_{name})"""

_UK = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)

SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
known AS (SELECT doc_id AS page_id, count(*) AS n, sum(1 - quality) AS bad FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
counted AS (
  SELECT host, coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad, string_split(host, '.') AS l
  FROM parts LEFT JOIN known USING (page_id) GROUP BY host),
hosts AS (
  SELECT host, n, bad, array_to_string(l[CASE WHEN two THEN -3 ELSE -2 END:], '.') AS domain, array_to_string(l[CASE WHEN two THEN -2 ELSE -1 END:], '.') AS suffix
  FROM (SELECT *, array_to_string(l[-2:], '.') IN (""" + _UK + r""") AS two FROM counted)),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
p_suffix AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (sum(bad) + 1.0) / (sum(n) + 2.0) FROM domains) AS prior FROM domains GROUP BY suffix),
""" + _LEVEL.format(name="suffix") + """,
p_domain AS (SELECT d.*, r.rate AS prior FROM domains d JOIN r_suffix r USING (suffix)),
""" + _LEVEL.format(name="domain") + """,
p_host AS (SELECT h.*, r.rate AS prior FROM hosts h JOIN r_domain r USING (domain)),
""" + _LEVEL.format(name="host") + """,
fits AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN rate - 1.645 * sqrt(rate * (1 - rate) / (weight + 1)) > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM fits JOIN r_host USING (host)
"""
