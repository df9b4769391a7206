"""URL filters: literal rules, then empirical-Bayes reputation of hosts.

Labelled page outcomes (bad or not) are summed by host; hosts sum to registered domains,
domains to suffixes. Each level's beta-binomial prior is centred on the posterior mean of the
level above; its strength comes from the spread of that level's groups by the method of
moments. A host is blocked when the lower bound of its posterior bad rate passes a threshold,
so hosts with few labels follow their domain and suffix, and a host with none is judged by the
bound of its prior.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, saved, skew_join, table

#: (rule, verdict): host, then the start of the path.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
#: Second-level labels that count as part of the suffix under a two-letter country; others can be given.
SECOND = ("ac", "co", "com", "edu", "gov", "net", "org")
Z, THRESHOLD, LEAST, MOST = 1.645, 0.5, 2.0, 1000.0


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both '' for a null url or one without '://'."""
    url = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)


def domain_parts(host: Column, second: Sequence[str] = SECOND, suffixes: Sequence[str] = ()) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host; a port is dropped, a numeric address is its own domain without a suffix.

    ``suffixes``: public suffixes of two labels or more, such as 'pvt.k12.ma.us'; the longest
    that a host ends with goes before the rule for ``second`` labels under a country.
    """
    name = F.regexp_replace(host, r":[0-9]*$", "")
    labels = F.split(name, r"\.")
    n = F.size(labels)
    country = (n >= 2) & (F.length(F.element_at(labels, -1)) == 2) & F.element_at(labels, F.when(n >= 2, -2).otherwise(-1)).isin(*second)
    numeric = name.rlike(r"^[0-9.]+$")
    suffix = F.when(numeric, "").otherwise(F.when(country, F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1)))
    domain = F.when(numeric, name).otherwise(F.when(country, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2)))
    for own in sorted(suffixes, key=lambda x: (x.count("."), x)):  # the longest is asked first
        labels_of = own.count(".") + 1
        fits = ~numeric & ((name == own) | name.endswith("." + own))
        suffix, domain = F.when(fits, own).otherwise(suffix), F.when(fits, F.substring_index(name, ".", -(labels_of + 1))).otherwise(domain)
    return domain, suffix


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else null."""
    rule = verdict = None
    for text, says in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        cut = text.index("/")
        fits = ((host == text[:cut]) | host.endswith("." + text[:cut])) & path.startswith(text[cut:])
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    return rule, verdict


def strength(groups: DataFrame) -> Column:
    """Aggregate: prior strength of (n, bad) groups by moments, within LEAST and MOST."""
    n, bad = F.col("n").cast("double"), F.col("bad").cast("double")
    total, p = F.sum("n").cast("double"), F.sum("bad").cast("double") / F.sum("n").cast("double")
    k = F.count("*").cast("double")
    v = p * (1 - p)
    spread = F.sum(bad * bad / n) - 2 * p * F.sum("bad").cast("double") + p * p * total
    size = total - F.sum(n * n) / total - (k - 1)
    rho = F.when((v > 0) & (size > 0), (spread - v * (k - 1)) / (v * F.when(size > 0, size).otherwise(1)))
    kappa = F.when(rho > 0, 1 / F.when(rho > 0, rho).otherwise(1) - 1).otherwise(MOST)
    return F.least(F.greatest(kappa, F.lit(LEAST)), F.lit(MOST))


def host_reputation(outcomes: DataFrame, second: Sequence[str] = SECOND, suffixes: Sequence[str] = ()) -> DataFrame:
    """Of (host, bad 0/1): host, rows, n, bad, mean, lower. A null outcome is not counted, but its host is judged.

    A host with n = 0 has its domain's mean, a domain without labels its suffix's, a suffix
    without labels the overall one. Three sums, each on the sums before; only per-host rows are joined.
    """
    domain, suffix = domain_parts(F.col("host"), second, suffixes)
    hosts = outcomes.groupBy("host").agg(F.count("*").alias("rows"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
    hosts = saved(hosts.withColumns({"domain": domain, "suffix": suffix}))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    tops = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    overall = hosts.where("n > 0").agg(((F.sum("bad") + 1).cast("double") / (F.sum("n") + 2).cast("double")).alias("overall")).first()[0]
    if overall is None:
        return hosts.select("host", "rows", "n", "bad", F.lit(0.5).alias("mean"), F.lit(0.0).alias("lower"))
    kh, kd, ks = (F.lit(float(g.where("n > 0").agg(strength(g)).first()[0])) for g in (hosts, domains, tops))
    overall = F.lit(float(overall))
    tops = tops.select("suffix", ((F.col("bad") + ks * overall) / (F.col("n") + ks)).alias("ms"))
    domains = domains.join(tops, "suffix").select("domain", "suffix", ((F.col("bad") + kd * F.col("ms")) / (F.col("n") + kd)).alias("md"))
    a, b = F.col("bad") + kh * F.col("md"), F.col("n") - F.col("bad") + kh * (1 - F.col("md"))
    out = hosts.join(domains, ["domain", "suffix"]).select("host", "rows", "n", "bad", a.alias("a"), b.alias("b"))
    mean, s = F.col("a") / (F.col("a") + F.col("b")), F.col("a") + F.col("b")
    return out.select("host", "rows", "n", "bad", mean.alias("mean"), (mean - Z * F.sqrt(F.col("a") * F.col("b") / (s * s * (s + 1)))).alias("lower"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, threshold: float = THRESHOLD, page_id: str = "page_id", url: str = "url", second: Sequence[str] = SECOND, suffixes: Sequence[str] = ()) -> DataFrame:
    """(page_id, host, path, rule, verdict, lower). ``outcomes``: (page_id, bad).

    A rule's verdict stands; of rules that fit the longest, of equally long ones the first in
    code point order. Without one a page is blocked if its host's lower posterior bound is above
    ``threshold``, not if it equals it; a host without labels has the bound of its domain or
    suffix. Without any label at all every bound is 0. Null urls have an empty host, which is
    judged like any host; very long urls are judged whole. Repeated pages are judged each, their
    outcomes counted each; a page with several outcomes has the worst. Empty tables give no
    rows; other columns, whatever their names, are ignored. Pages of very common hosts are dealt
    over several tasks.
    """
    host, path = url_parts(F.col(url))
    parsed = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    known = outcomes.where("page_id is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    reputation = saved(host_reputation(parsed.join(known, "page_id", "left").select("host", "bad"), second, suffixes))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    out = skew_join(parsed, reputation.select("host", "lower", F.col("rows").alias("n")), ["host"], ["page_id", "path"]).drop("n")  # every host has a row
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("lower") > threshold, "block").otherwise("allow")).alias("verdict"), "lower")


def op6_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: the quality label that has the page's id; quality 0 is bad."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0).alias("bad"))
    return judge_urls(table(spark, sf_dir, "pages"), outcomes).drop("lower")


def _moments(level: str) -> str:
    return f"""SELECT least(greatest(CASE WHEN rho > 0 THEN 1 / rho - 1 ELSE {MOST} END, {LEAST}), {MOST}) AS kappa FROM (
      SELECT CASE WHEN v > 0 AND sz > 0 THEN (spread - v * (k - 1)) / (v * sz) END AS rho FROM (
        SELECT p * (1 - p) AS v, k, sb2 - 2 * p * b + p * p * t AS spread, t - n2 / t - (k - 1) AS sz FROM (
          SELECT CAST(sum(n) AS DOUBLE) AS t, CAST(sum(bad) AS DOUBLE) AS b, CAST(sum(bad) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS p, CAST(count(*) AS DOUBLE) AS k,
                 sum(CAST(bad AS DOUBLE) * bad / n) AS sb2, sum(CAST(n AS DOUBLE) * n) AS n2 FROM {level} WHERE n > 0)))"""


OP6_SQL = rf"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
k AS (SELECT doc_id AS page_id, max(CASE quality WHEN 0 THEN 1 WHEN 1 THEN 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
n AS (SELECT host, regexp_replace(host, ':[0-9]*$', '') AS name, count(bad) AS n, CAST(coalesce(sum(bad), 0) AS BIGINT) AS bad FROM p LEFT JOIN k USING (page_id) GROUP BY host),
l AS (SELECT *, string_split(name, '.') AS ls, regexp_matches(name, '^[0-9.]+$') AS numeric FROM n),
t AS (SELECT *, CASE WHEN len(ls) >= 2 AND length(ls[-1]) = 2 AND ls[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') THEN 2 ELSE 1 END AS take FROM l),
h AS (SELECT host, n, bad, CASE WHEN numeric THEN name ELSE array_to_string(ls[-least(len(ls), take + 1):], '.') END AS domain,
             CASE WHEN numeric THEN '' ELSE array_to_string(ls[-least(len(ls), take):], '.') END AS suffix FROM t),
d AS (SELECT domain, suffix, CAST(sum(n) AS BIGINT) AS n, CAST(sum(bad) AS BIGINT) AS bad FROM h GROUP BY ALL),
s AS (SELECT suffix, CAST(sum(n) AS BIGINT) AS n, CAST(sum(bad) AS BIGINT) AS bad FROM d GROUP BY ALL),
kh AS ({_moments("h")}), kd AS ({_moments("d")}), ks AS ({_moments("s")}),  -- of groups with labels
g AS (SELECT CAST(sum(bad) + 1 AS DOUBLE) / CAST(sum(n) + 2 AS DOUBLE) AS overall FROM h),
ms AS (SELECT suffix, (bad + ks.kappa * overall) / (n + ks.kappa) AS m FROM s, ks, g),
md AS (SELECT domain, d.suffix, (bad + kd.kappa * ms.m) / (n + kd.kappa) AS m FROM d JOIN ms USING (suffix), kd),
ab AS (SELECT host, bad + kh.kappa * md.m AS a, n - bad + kh.kappa * (1 - md.m) AS b FROM h JOIN md USING (domain, suffix), kh),
lo AS (SELECT host, a / (a + b) - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS lower FROM ab),
r AS (SELECT page_id, host, path, CASE
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN lower > {THRESHOLD} THEN 'block' ELSE 'allow' END AS verdict
FROM r LEFT JOIN lo USING (host)
"""
