"""URL filter: rules first, then an empirical-Bayes reputation of the host.

Labelled outcomes of pages (good or bad) are counted per host.  A host's rate of good pages is
shrunk to that of its registered domain, the domain's to its public suffix, the suffix's to
the whole table, each by a beta-binomial prior whose strength is estimated from the
spread of the rates on that level (method of moments).  A page no rule decides is blocked where
the upper bound of its host's posterior rate is below what is asked for.

Defined results: a url that is null or has no ``://`` has empty host and path, fits no rule and
is judged by the rate of all pages; unlabelled hosts take their domain's posterior, and without
any label every page is allowed; an empty table gives no rows.  Equal page ids are judged each.
DataFrame functions only: rows are never moved by their host unless it is a rare one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placemetrics.llm.common import importable, stored
from placemetrics.operators.joins import scalar

#: Least posterior rate of good pages; a host is blocked if even the upper bound is below it.
LEAST_GOOD = 0.7
#: Standard deviations between the posterior's mean and its bound.
BOUND = 1.645
#: A host with at least this share of all pages is joined as one of at most 1 / HEAVY rows.
HEAVY = 1e-4
#: Second-level labels under which a two-letter country registers domains.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
#: Bounds of a prior's strength, in pages.
WEAKEST, STRONGEST = 1.0, 1000.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for the urls of a host and its subdomains whose path starts with ``path``."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


RULES = (Rule("allow", "com/"), Rule("block", "example.com/en/"), Rule("allow", "www.example.com/en/"),
         Rule("block", "net/es/"), Rule("block", "net/fr/"))


def with_parts(pages: DataFrame) -> DataFrame:
    """Host (A-Z lower-cased) and path of each ``url``, both empty where there is no ``://``."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.col("url").substr(at + 3, F.length("url")))
    return pages.withColumns({
        "host": F.coalesce(F.translate(F.regexp_extract(rest, "(?s)^[^/?#]*", 0), UPPER, LOWER), F.lit("")),
        "path": F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))})


def first_fit(rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as (rule, verdict); between equally long ones the longer host's."""
    fits = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.text), len(r.host))):
        meets = (((F.col("host") == rule.host) | F.col("host").endswith("." + rule.host))
                 & F.col("path").startswith(rule.path))
        fits = F.when(meets, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(fits)
    return fits


def name_levels(host: str) -> dict[str, Column]:
    """Registered domain and suffix of a host; user, port and a closing dot are not part of names."""
    bare = F.regexp_replace(F.regexp_replace(F.col(host), "^.*@", ""), r"\.?(:\d*)?$", "")
    labels = F.split(bare, r"\.")
    n = F.size(labels)
    last, second = F.get(labels, n - 1), F.get(labels, n - 2)
    taken = F.when((n > 2) & (F.length(last) == 2) & second.isin(*SECOND_LEVEL), 2).otherwise(1)
    address = bare.rlike(r"^(\d+\.){3}\d+$|^\[")

    def tail(k: Column) -> Column:
        return F.when(address, bare).otherwise(F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), k), "."))

    return {"domain": tail(taken + 1), "suffix": F.when(address, F.lit("")).otherwise(tail(taken))}


def prior_strength(parts: DataFrame) -> Column:
    """Strength of the beta prior on one level, as a scalar: pages that the parent's rate is worth.

    From units with n pages, rate p and parent's rate q: the spread of p about q beyond what
    n drawings from q would give, sum n (p - q)^2 against sum q (1 - q) and (n - 1) q (1 - q).
    """
    noise = F.sum(F.col("q") * (1 - F.col("q")))
    spread = F.sum((F.col("good") - F.col("n") * F.col("q")) ** 2 / F.col("n"))
    room = F.sum((F.col("n") - 1) * F.col("q") * (1 - F.col("q")))
    share = F.try_divide(spread - noise, room)
    strength = F.when(share <= 0, F.lit(STRONGEST)).otherwise(F.try_divide(1 - share, share))
    return scalar(parts, F.coalesce(F.greatest(F.lit(WEAKEST), F.least(F.lit(STRONGEST), strength)), F.lit(STRONGEST)))


def shrunk(counts: DataFrame) -> DataFrame:
    """Posterior per host from (host, n, good), one row per host, hosts without outcomes included.

    Columns: host, n, good, rate and upper, both null if the table has no outcome at all.
    """
    named = counts.withColumns(name_levels("host"))
    levels = {"suffix": ["suffix"], "domain": ["suffix", "domain"]}
    sums = {k: named.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("good").alias("good")) for k, by in levels.items()}
    overall = scalar(counts, F.try_divide(F.sum("good"), F.sum("n")))

    def posterior(df: DataFrame, into: str) -> DataFrame:
        kappa = prior_strength(df.filter("n > 0"))
        return df.withColumns({"kappa": kappa}).withColumns(
            {into: (F.col("kappa") * F.col("q") + F.col("good")) / (F.col("kappa") + F.col("n"))})

    suffixes = stored(posterior(sums["suffix"].withColumn("q", overall), "rate"), "suffixes").select("suffix", F.col("rate").alias("q"))
    domains = stored(posterior(sums["domain"].join(suffixes, "suffix"), "rate"), "domains").select("suffix", "domain", F.col("rate").alias("q"))
    hosts = posterior(named.join(domains, ["suffix", "domain"]), "rate")
    deviation = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("kappa") + F.col("n") + 1))
    return hosts.select("host", "n", "good", "rate", F.least(F.lit(1.0), F.col("rate") + BOUND * deviation).alias("upper"))


def host_counts(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Per host its pages, and its outcomes n and good, from pages with (host, item) and outcomes (item, n, good).

    Pages of one host that show one item are added up before they meet the item's outcomes.
    """
    shown = pages.groupBy("host", "item").agg(F.count(F.lit(1)).alias("pages"))
    met = shown.join(outcomes, "item", "left")
    return met.groupBy("host").agg(
        F.sum("pages").alias("pages"),
        *[F.coalesce(F.sum(F.col("pages") * F.col(c)), F.lit(0)).alias(c) for c in ("n", "good")])


def judged(pages: DataFrame, outcomes: DataFrame, item: Column, rules: Sequence[Rule] = RULES,
           least: float = LEAST_GOOD) -> DataFrame:
    """Pages with host, path, rule (its text or null), verdict, and the host's n, rate and upper.

    ``item`` is what a page shows, ``outcomes`` its labels: (item, n, good).  The reputation
    reads urls only.  Of hosts with HEAVY of all pages there are at most 1 / HEAVY: those are
    broadcast, so that no task gathers a large host; all others are joined by host.
    """
    parted = with_parts(pages.select("page_id", "url"))
    counts = stored(host_counts(parted.withColumn("item", item), outcomes), "hosts")
    known = stored(shrunk(counts.select("host", "n", "good")).join(counts.select("host", "pages"), "host"), "reputation")
    most = counts.agg(F.sum("pages")).first()[0] or 0
    heavy = known.filter(F.col("pages") >= HEAVY * most).select("host", F.struct("n", "rate", "upper").alias("heavy"))
    light = known.filter(F.col("pages") < HEAVY * most).select(F.col("host").alias("rare"), F.struct("n", "rate", "upper").alias("light"))
    rows = parted.join(F.broadcast(heavy), "host", "left")
    # pages that have their host's row already are dealt by id, under names that no host has
    spread_out = F.concat(F.lit("/"), F.col("page_id").cast("string"))
    rows = rows.join(light, F.when(F.col("heavy").isNull(), F.col("host")).otherwise(spread_out) == F.col("rare"), "left")
    reputation, fit = F.coalesce("heavy", "light"), first_fit(rules)
    verdict = F.when(reputation["upper"] < least, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", fit["rule"].alias("rule"), F.coalesce(fit["verdict"], verdict).alias("verdict"),
                       reputation["n"].alias("outcomes"), reputation["rate"].alias("rate"), reputation["upper"].alias("upper"))


def shown_document() -> Column:
    """The document that a page shows: the number in the last part of its path, if it is one."""
    return F.expr(r"try_cast(regexp_extract(path, '/([0-9]+)(\\.html|/)?$', 1) AS bigint)")


def quality_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Per labelled document how many quality labels it has and how many of them are good."""
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return labels.groupBy(F.col("doc_id").alias("item")).agg(
        F.count("quality").alias("n"), F.count_if(F.col("quality") == 1).alias("good")).filter("n > 0")


def op12_host_reputation(spark: SparkSession, folder: str) -> DataFrame:
    importable(spark)
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    return judged(pages, quality_outcomes(spark, folder), shown_document()).select("page_id", "host", "path", "rule", "verdict")


def _sql_rule(rule: Rule, found: str) -> str:
    return (f"WHEN (host = '{rule.host}' OR ends_with(host, '.{rule.host}')) AND starts_with(path, '{rule.path}') "
            f"THEN '{getattr(rule, found)}'")


def _sql_fit(found: str) -> str:
    ordered = sorted(RULES, key=lambda r: (len(r.text), len(r.host)), reverse=True)
    return f"CASE {' '.join(_sql_rule(r, found) for r in ordered)} END"


def _sql_strength(table: str) -> str:
    return f"""(SELECT coalesce(greatest({WEAKEST}, least({STRONGEST},
      CASE WHEN share <= 0 THEN {STRONGEST} ELSE (1 - share) / nullif(share, 0) END)), {STRONGEST})
    FROM (SELECT (sum((good - n * q) ** 2 / n) - sum(q * (1 - q))) / nullif(sum((n - 1) * q * (1 - q)), 0) AS share
          FROM {table} WHERE n > 0))"""


def _sql_level(table: str, by: str, above: str, on: str) -> str:
    return f"""{table}_q AS (SELECT a.*, b.rate AS q FROM
    (SELECT {by}, sum(n)::double AS n, sum(good)::double AS good FROM named GROUP BY {by}) a JOIN {above} b ON {on}),
  {table} AS (SELECT *, (kappa * q + good) / (kappa + n) AS rate FROM (SELECT *, {_sql_strength(table + '_q')} AS kappa FROM {table}_q))"""


OP12_SQL = f"""
WITH parted AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)),
  outcomes AS (SELECT doc_id AS item, count(quality) AS n, count(*) FILTER (quality = 1) AS good
    FROM labels GROUP BY doc_id HAVING count(quality) > 0),
  counts AS (SELECT host, coalesce(sum(n), 0) AS n, coalesce(sum(good), 0) AS good
    FROM (SELECT host, try_cast(regexp_extract(path, '/([0-9]+)(\\.html|/)?$', 1) AS bigint) AS item FROM parted)
    LEFT JOIN outcomes USING (item) GROUP BY host),
  split AS (SELECT *, string_split(bare, '.') AS labels, regexp_matches(bare, '^([0-9]+\\.){{3}}[0-9]+$|^\\[') AS address FROM
    (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), '\\.?(:[0-9]*)?$', '') AS bare FROM counts)),
  taken AS (SELECT *, CASE WHEN len(labels) > 2 AND length(labels[-1]) = 2
    AND labels[-2] IN {SECOND_LEVEL} THEN 2 ELSE 1 END AS k FROM split),
  named AS (SELECT host, n, good, CASE WHEN address THEN bare ELSE array_to_string(labels[-(k + 1):], '.') END AS domain,
    CASE WHEN address THEN '' ELSE array_to_string(labels[-k:], '.') END AS suffix FROM taken),
  everything AS (SELECT sum(good)::double / nullif(sum(n), 0) AS rate FROM named),
  {_sql_level('suffixes', 'suffix', 'everything', 'true')},
  {_sql_level('domains', 'suffix, domain', 'suffixes', 'a.suffix = b.suffix')},
  {_sql_level('hosts', 'suffix, domain, host', 'domains', 'a.suffix = b.suffix AND a.domain = b.domain')}
SELECT page_id, host, path, {_sql_fit('text')} AS rule, coalesce({_sql_fit('verdict')},
  CASE WHEN least(1.0, rate + {BOUND} * sqrt(rate * (1 - rate) / (kappa + n + 1))) < {LEAST_GOOD} THEN 'block' ELSE 'allow' END) AS verdict
FROM parted JOIN hosts USING (host)
"""
