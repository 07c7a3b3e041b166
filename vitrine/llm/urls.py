"""URL filters: explicit rules, and for the other pages an empirical-Bayes reputation of the host.

Labelled page outcomes are counted by host. The share of bad pages of a suffix is shrunk towards that of all
pages, that of a registered domain towards its suffix, that of a host towards its domain: each level has a
beta-binomial prior whose mean is the level above and whose strength is estimated from the spread of the groups
(method of moments). A host is blocked if the lower posterior bound of its share of bad pages is over `limit`. The bound is the
posterior mean less Cantelli's factor, sqrt(sure / (1 - sure)), times the standard deviation of the beta posterior: whatever its shape, few
outcomes included, the share is over the bound with a probability of `sure` at least. All of it is DataFrame operations.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged by the
prior alone. Rows that repeat are judged alike, each by itself; ids may be null. A very long url is parsed whole. Tables may be empty and may have further columns;
only the id and the url are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import ascii_lower, looked_up, written

#: (verdict, host, path)
Rule = tuple[str, str, str]


def url_host(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))).otherwise("")


def url_path(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise("")


def registered_domain(host: Column, suffixes: list[str]) -> Column:
    """The suffix and the label before it. suffixes: those of more than one label, such as co.uk; other suffixes are the last label."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")
    two = F.substring_index(name, ".", -2)
    return F.when(name.rlike(r"^[0-9.]+$"), name).when(two.isin(suffixes), F.substring_index(name, ".", -3)).otherwise(two) if suffixes else F.when(name.rlike(r"^[0-9.]+$"), name).otherwise(two)


def matched_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; both null if none fits. Of equally long rules the first in order of text wins."""
    rule = verdict = F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(rule_path))
        rule, verdict = F.when(fits, rule_host + rule_path).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _strength(groups: DataFrame, level: str) -> list[Column]:
    """Sums over the groups of one level, from which the strength of that level's prior follows."""
    return [F.count("*").alias(f"{level}_groups"), F.sum("labelled").alias(f"{level}_n"), F.sum("bad").alias(f"{level}_bad"), F.sum(F.col("labelled") * F.col("labelled")).alias(f"{level}_nn"), F.sum(F.col("bad") * F.col("bad") / F.col("labelled")).alias(f"{level}_bb")]


def prior_strength(groups: int, n: int, bad: int, nn: float, bb: float) -> float:
    """Pseudo-counts of a beta prior, from the spread of the groups' shares around the common share."""
    if not n or groups < 2 or bad in (0, n):
        return 10.0
    mean = bad / n
    within = mean * (1 - mean)
    spread = bb - 2 * mean * bad + mean * mean * n
    room = within * (n - nn / n - (groups - 1))
    rho = (spread - within * (groups - 1)) / room if room > 0 else 0.5
    return 1 / min(max(rho, 1 / 1001), 1 / 6) - 1


def _shrunk(groups: DataFrame, level: str, strength: float, above: Column, above_known: Column) -> DataFrame:
    """groups with the posterior mean of each, and how many outcomes it rests on. The level above can't count for more outcomes than it rests on itself."""
    weight = F.least(F.lit(strength), above_known)
    return groups.withColumn(f"{level}_known", F.col("labelled") + weight).withColumn(f"{level}_mean", (F.col("bad") + weight * above) / F.col(f"{level}_known"))


#: How sure it is that a blocked host's share of bad pages is over the limit, at least.
SURE = 0.9
#: Public suffixes of two labels, the most frequent ones; other suffixes are the last label.
SUFFIXES = ["co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "ac.jp", "co.kr", "com.br", "com.ar", "com.mx", "com.cn", "com.tw", "com.hk", "com.sg", "co.in", "co.za", "com.tr", "co.il", "github.io", "blogspot.com"]


def host_reputation(outcomes: DataFrame, suffixes: list[str] | None = None, sure: float = SURE, limit: float = 0.5) -> DataFrame:
    """outcomes: host, bad (boolean; null if unlabelled), a row per page. Returns a row per host: host, pages, labelled, bad_mean, bad_bound, blocked."""
    domain = registered_domain(F.col("host"), suffixes or [])
    hosts = written(
        outcomes.groupBy("host").agg(F.count("*").alias("pages"), F.count("bad").alias("labelled"), F.count_if("bad").alias("bad"))
        .withColumn("domain", domain).withColumn("suffix", F.regexp_replace("domain", r"^[^.]*\.", "")), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.count("*").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    tops = domains.groupBy("suffix").agg(F.count("*").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    found = {}
    for level, groups in (("host", hosts), ("domain", domains), ("suffix", tops)):
        s = groups.filter("labelled > 0").agg(*_strength(groups, level)).first()
        found[level] = prior_strength(*(s[f"{level}_{k}"] or 0 for k in ("groups", "n", "bad", "nn", "bb")))
        total_n, total_bad = s[f"{level}_n"] or 0, s[f"{level}_bad"] or 0
    # a suffix may have most domains, and a domain most hosts: n says how many
    tops = written(_shrunk(tops, "suffix", found["suffix"], F.lit((total_bad + 0.5) / (total_n + 1)), F.lit(total_n + 1.0)).select("suffix", "n", "suffix_known", "suffix_mean"), "suffixes")
    domains = _shrunk(looked_up(domains.withColumnRenamed("n", "hosts"), "suffix", tops), "domain", found["domain"], F.col("suffix_mean"), F.col("suffix_known"))
    domains = written(domains.select("domain", F.col("hosts").alias("n"), "domain_known", "domain_mean"), "domains")
    judged = _shrunk(looked_up(hosts, "domain", domains), "host", found["host"], F.col("domain_mean"), F.col("domain_known"))
    bound = F.col("host_mean") - math.sqrt(sure / (1 - sure)) * F.sqrt(F.col("host_mean") * (1 - F.col("host_mean")) / (F.col("host_known") + 1))
    return judged.withColumn("bad_bound", bound).select("host", "pages", "labelled", F.col("host_mean").alias("bad_mean"), "bad_bound", (F.col("bad_bound") > limit).alias("blocked"))


def url_filter(pages: DataFrame, rules: list[Rule], suffixes: list[str] | None = None, sure: float = SURE, limit: float = 0.5) -> DataFrame:
    """pages: page_id, url. The pages that a rule fits are the labelled outcomes; the reputations learnt from them judge the rest.

    Returns page_id, host, path, rule, verdict (allow or block)."""
    pages = pages.select("page_id", "url").select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")).fillna("", ["host", "path"])
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    pages = pages.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    known = written(host_reputation(pages.select("host", (F.col("ruled") == "block").alias("bad")), suffixes, sure, limit), "reputation")
    judged = looked_up(pages, "host", known.select("host", F.col("pages").alias("n"), "blocked"), F.col("ruled").isNotNull())
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"))
