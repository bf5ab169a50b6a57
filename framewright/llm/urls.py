"""URL filter on host reputation: labelled outcomes shrunk from host to registered domain to suffix.

Outcomes are counted per host; a suffix's rate is shrunk to the overall rate, a domain's to its
suffix's, a host's to its domain's, each as a beta-binomial posterior whose prior weight is fitted
from the spread between the units of that level. A page passes if the lower bound of its host's rate
of good outcomes reaches a share of the overall rate. Listed rules go before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import saved

#: (host, path, verdict): fixed rules; the longest that fits wins.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Suffixes of two labels that registered domains stand below; fixed values, others are the last label.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "or.jp", "com.br", "co.in", "com.cn")
#: Standard errors below the mean of the bound, the share of the overall rate that it must reach, bounds of a prior's weight.
Z, SHARE, WEIGHT = 1.645, 0.5, (1.0, 1000.0)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls; by length of the rule string, then first in code point order."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), [-ord(c) for c in r[0] + r[1]])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def suffix_and_domain(host: Column) -> tuple[Column, Column]:
    """Public suffix and registered domain of a host, its port left out; addresses and single labels are their own domain."""
    bare = F.regexp_replace(host, ":[0-9]*$", "")
    labels = F.split(bare, r"\.")
    n = F.size(labels)
    last = lambda m: F.concat_ws(".", F.slice(labels, F.greatest(F.lit(1), n - m + 1), F.least(n, F.lit(m))))
    address = bare.rlike(r"^[0-9.]+$")
    two = last(2).isin(*SUFFIXES)
    return F.when(address, "").when(two, last(2)).otherwise(last(1)), F.when(address, bare).when(two, last(3)).otherwise(last(2))


def _shrunk(units: DataFrame, prior: DataFrame, on: list[str], rate: str) -> DataFrame:
    """units (.., good, n) with mean and weight of their posterior around the prior's rate; the weight from the units' spread.

    Method of moments: between-unit variance v of the rates r of units with two outcomes or more around their prior p
    gives the prior weight p (1 - p) / v - 1, within bounds.
    """
    joined = units.join(prior, on) if on else units.crossJoin(F.broadcast(prior))  # one row of overall rate
    sampled = F.col(rate) * (1 - F.col(rate))
    spread = joined.where("n >= 2").agg(
        F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - F.col(rate), 2) - sampled).alias("extra"), F.sum(F.col("n") - 1).alias("freedom"), F.sum((F.col("n") - 1) * sampled).alias("most")
    )
    weight = F.when((F.col("freedom") > 0) & (F.col("extra") > 0), F.col("most") / F.col("extra") - 1).otherwise(WEIGHT[1])
    weight = F.greatest(F.lit(WEIGHT[0]), F.least(F.lit(WEIGHT[1]), F.coalesce(weight, F.lit(WEIGHT[1]))))
    return joined.crossJoin(F.broadcast(spread.select(weight.alias("weight")))).withColumn("mean", (F.col("good") + F.col("weight") * F.col(rate)) / (F.col("n") + F.col("weight")))  # one row


def reputations(hosts: DataFrame) -> DataFrame:
    """hosts (host, suffix, domain, good, n: one row per host) -> host, mean, bound, overall: the posterior and its lower bound.

    Without any outcome the overall rate is 1/2, so all hosts stand alike.
    """
    overall = hosts.agg(((F.coalesce(F.sum("good"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("overall"))
    per = lambda *keys: hosts.groupBy(*keys).agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    suffixes = _shrunk(per("suffix"), overall, [], "overall").select("suffix", F.col("mean").alias("suffix_rate"), "overall")
    domains = _shrunk(per("suffix", "domain"), suffixes, ["suffix"], "suffix_rate").select("suffix", "domain", F.col("mean").alias("domain_rate"), "overall")
    own = _shrunk(hosts, domains, ["suffix", "domain"], "domain_rate")
    total = F.col("n") + F.col("weight")
    return own.select("host", "mean", (F.col("mean") - Z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (total + 1))).alias("bound"), "overall")


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, share: float = SHARE) -> DataFrame:
    """(page_id, host, path, rule, verdict, bound) per row of pages (page_id, url; other columns are ignored).

    labels: (doc_id, quality, toxic); a label is a page's outcome if doc_id is its page_id, good if quality is 1 and toxic
    is not. Labels without quality are ignored; a page labelled again counts again. Hosts without labels get
    their domain's rate. Null urls and those without :// have host and path "" and are judged as the host "".
    """
    host, path = host_and_path(F.col("url"))
    rule, listed = matched_rule(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).select("page_id", "host", "path", rule.alias("rule"), listed.alias("listed"))
    outcomes = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) != 1)).cast("long").alias("good"))
    counted = rows.join(outcomes, "page_id", "left").groupBy("host").agg(F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.count("good").alias("n"))
    suffix, domain = suffix_and_domain(F.col("host"))
    counted = saved(counted.select("host", suffix.alias("suffix"), domain.alias("domain"), "good", "n"), "outcomes")
    known = reputations(counted)
    verdict = F.coalesce("listed", F.when(F.col("bound") >= share * F.col("overall"), "allow").otherwise("block"))
    return rows.join(known, "host").select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.round("bound", 6).alias("bound"))
