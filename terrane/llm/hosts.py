"""URL filter: fixed rules, else the reputation of the host from labelled pages.

The share of bad pages of a host is estimated by empirical Bayes. Counts are beta-binomial, with
a prior at each level: a suffix starts from the corpus, a registered domain from its suffix, a
host from its domain. How strongly a level holds to its prior is estimated from how much its
groups differ beyond chance. A host is blocked if the lower bound of its posterior is above the
accepted share. Hosts without labelled pages have their domain's mean, domains their suffix's.

Everything is column functions; only hosts and counts are shuffled, and the pages meet their
host's row over a salted key, since one host may have a third of all pages.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.session import Workspace


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules in force.
RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)

MOST_BAD = 0.25
Z = 1.645  # one-sided 95 %
SALTS = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null url or one without `://`; only A-Z are put in lower case."""
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def registered_domain(host: Column) -> Column:
    """The last two labels, or the whole of a shorter host."""
    return F.substring_index(host, ".", -2)


def _strength(groups: DataFrame, prior: str) -> Column:
    """How many pages the prior counts for: by moments, from the groups' distance to their priors."""
    n, share = F.col("n"), F.col("bad") / F.col("n")
    chance = F.col(prior) * (1 - F.col(prior))
    sums = groups.where(f"n > 0 AND {prior} > 0 AND {prior} < 1").agg(
        F.sum(n * F.pow(share - F.col(prior), F.lit(2.0)) / chance).alias("spread"), F.count("*").alias("g"), F.sum(n).alias("all")
    )
    # E[spread] = g + rho * (all - g), and strength is (1 - rho) / rho.
    rho = F.when(F.col("all") > F.col("g"), (F.col("spread") - F.col("g")) / (F.col("all") - F.col("g"))).otherwise(F.lit(0.0))
    rho = F.least(F.greatest(F.coalesce(rho, F.lit(0.0)), F.lit(0.001)), F.lit(0.999))
    return sums.select((1 - rho) / rho).scalar()


def reputations(outcomes: DataFrame, ws: Workspace) -> DataFrame:
    """(host, n, bad, mean, low, high) for every host of `outcomes` (host, bad: 1, 0 or null).

    Counts per host are stored, so that the levels above are summed from them.

    Null outcomes are unlabelled pages. One good page is added to the corpus, so without any label
    every mean is 0.
    """
    domain, suffix = registered_domain(F.col("host")), F.substring_index("host", ".", -1)
    counts = [F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")]
    hosts = ws.save(outcomes.groupBy("host").agg(*counts).withColumns({"domain": domain, "suffix": suffix}), "hosts")
    again = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = hosts.groupBy("domain", "suffix").agg(*again)
    suffixes = domains.groupBy("suffix").agg(*again)
    corpus = suffixes.agg((F.coalesce(F.sum("bad"), F.lit(0)) / (F.coalesce(F.sum("n"), F.lit(0)) + 1)).alias("mean")).scalar()

    def shrunk(groups: DataFrame) -> DataFrame:
        strength = _strength(groups, "prior")
        groups = groups.withColumn("strength", strength)
        return groups.withColumn("mean", (F.col("bad") + F.col("strength") * F.col("prior")) / (F.col("n") + F.col("strength")))

    suffixes = shrunk(suffixes.withColumn("prior", corpus)).select("suffix", F.col("mean").alias("prior"))
    domains = shrunk(domains.join(suffixes, "suffix")).select("domain", "suffix", F.col("mean").alias("prior"))
    hosts = shrunk(hosts.join(domains, ["domain", "suffix"]))
    width = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.col("strength") + 1)) * Z
    return hosts.select("host", "n", "bad", "mean", F.greatest(F.col("mean") - width, F.lit(0.0)).alias("low"), F.least(F.col("mean") + width, F.lit(1.0)).alias("high"))


def judged(pages: DataFrame, outcomes: DataFrame, ws: Workspace, rules: tuple[Rule, ...] = RULES, most_bad: float = MOST_BAD) -> DataFrame:
    """(page_id, host, path, rule, verdict, mean, low) per row of `pages` (page_id, url).

    `outcomes` holds (host, bad) for labelled pages. Repeated pages are judged alike; a null id
    stays null; an empty table gives an empty one.
    """
    host, path = host_and_path(F.col("url"))
    found = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("_rule", matching_rule(F.col("host"), F.col("path"), rules))
    found = found.withColumn("_salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int"))
    known = reputations(outcomes.select("host", "bad").unionAll(found.select("host").distinct().select("host", F.lit(None).cast("int"))), ws)
    salted = known.select("host", "mean", "low", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("_salt"))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("low") > most_bad, F.lit("block")).otherwise(F.lit("allow")))
    return found.join(salted, ["host", "_salt"]).select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "mean", "low")


def labelled_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad) of the pages whose url names a labelled document by its number.

    A page shows the document whose number ends a path; a label of quality 0 makes it bad.
    """
    host, path = host_and_path(F.col("url"))
    number = F.regexp_extract(path, r"/([0-9]{1,18})(?:[./]|$)", 1)
    shown = pages.select(host.alias("host"), F.when(number != "", number.cast("long")).alias("_doc")).where("_doc IS NOT NULL")
    marked = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_doc")).agg((1 - F.max("quality")).cast("int").alias("bad"))
    return shown.join(marked, "_doc").select("host", "bad")
