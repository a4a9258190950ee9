"""URL filters by empirical-Bayes host reputation, in DataFrame functions only.

A labelled page is good or bad.  Bad shares are beta-binomial: a suffix is drawn
around the share of all pages, a registered domain around its suffix, a host
around its domain.  The concentration of each level comes from the variance
between its groups (method of moments); posterior means are passed down as
prior means.  A host is blocked if the lower bound of its posterior bad share is
at or above ``LIFT`` times the share of all pages: it is worse than the average
page for all that is known.  The bound lies ``Z`` standard deviations below the
mean; Spark has no quantile of the beta distribution, and with Z = 0.5 this is about
where three tenths of it lie below.  Rules of an explicit list come before that; of those that fit a
url the longest wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialise

#: The rule list of the registered query, (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
LIFT, Z = 1.0, 0.5
#: Public suffixes of two labels under which domains are registered.
TWO_LABELS = ["ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.nz", "co.in", "co.jp", "ne.jp", "or.jp", "co.kr", "co.za", "com.ar", "com.br", "com.cn", "com.hk", "com.mx", "com.sg", "com.tr", "com.tw"]
#: Bounds of the concentration, in labelled pages: a host with far more of them speaks for itself, however alike hosts are.
LEAST, MOST = 1.0, 100.0

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(_rest(url), F.lit("")), "^[^/?#]*", 0), UPPER, LOWER)


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), "^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, like ``net/``, and its verdict; null without one.  For short lists."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, name + start).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _concentration(groups: DataFrame) -> Column:
    """From rows (n, bad, mean, parents): group counts, the parent's mean and 1 for one row of each parent."""
    p, q = F.col("mean"), F.col("mean") * (1 - F.col("mean"))
    spread = F.sum(F.when(q > 0, F.pow(F.col("bad") - F.col("n") * p, 2) / F.col("n") / q))
    free = F.count_if(q > 0)
    rho = F.try_divide(spread - free, F.sum(F.when(q > 0, F.col("n") - 1)))
    return F.coalesce(F.least(F.lit(MOST), F.greatest(F.lit(LEAST), F.try_divide(1 - F.greatest(rho, F.lit(1e-9)), F.greatest(rho, F.lit(1e-9))))), F.lit(MOST))


def _shrink(groups: DataFrame, key: str, above: DataFrame, link: str) -> DataFrame:
    """``groups`` (key, ..., n, bad) with the posterior mean, ``post``, around the means of ``above`` (link, mean), and ``k``.

    The join is written, as the strength of all groups is needed before any is shrunk.
    """
    placed = materialise(groups.join(above, link), key)
    strength = placed.where("n > 0").agg(_concentration(placed).alias("k"))  # one row
    return placed.crossJoin(F.broadcast(strength)).withColumn("post", F.try_divide(F.col("bad") + F.col("k") * F.col("mean"), F.col("n") + F.col("k"))).drop("mean")


#: IPv4 addresses and what stands in brackets.
_ADDRESS = r"^([0-9]{1,3}(\.[0-9]{1,3}){3}|\[.*\])$"
#: The suffix of all addresses, which no name can have.
ADDRESSES = "[address]"


def bare(host: Column) -> Column:
    """A host without user, port and final dots."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", ""), r"\.+$", "")


def registered(host: Column) -> tuple[Column, Column]:
    """Registered domain and public suffix of a host; an address is a domain of its own, below one suffix of all."""
    name = bare(host)
    two = F.substring_index(name, ".", -2)
    wide = two.isin(TWO_LABELS)
    address = name.rlike(_ADDRESS)
    domain = F.when(address, name).when(wide, F.substring_index(name, ".", -3)).otherwise(two)
    return domain, F.when(address, ADDRESSES).when(wide, two).otherwise(F.substring_index(name, ".", -1))


def reputations(pages: DataFrame) -> DataFrame:
    """(host, bad_mean, bad_bound, overall) from rows (host, bad): bad is 1, 0 or null if unlabelled.

    Hosts without a label have their domain's mean and the spread of the prior.
    Pages are counted by host before anything else; what follows has a row for a
    host at most.
    """
    domain, suffix = registered(F.col("host"))
    hosts = pages.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = materialise(hosts.withColumns({"domain": domain, "suffix": suffix}), "hosts")
    total = lambda df, *by: df.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = materialise(total(hosts, "domain", "suffix"), "domains")
    suffixes = materialise(total(domains, "suffix"), "suffixes")
    overall = materialise(suffixes.agg(F.try_divide(F.sum("bad") + 0.5, F.sum("n") + 1.0).alias("mean")), "overall")  # one row
    mean = lambda df, key: df.select(key, F.col("post").alias("mean"))
    suffix = _shrink(suffixes, "suffix", suffixes.select("suffix").crossJoin(F.broadcast(overall)), "suffix")
    domain = _shrink(domains, "domain", mean(suffix, "suffix"), "suffix")
    host_ = _shrink(hosts, "host", mean(domain, "domain"), "domain")
    sd = F.sqrt(F.col("post") * (1 - F.col("post")) / (F.col("n") + F.col("k") + 1))
    bounds = host_.select("host", F.col("post").alias("bad_mean"), (F.col("post") - Z * sd).alias("bad_bound"))
    return bounds.crossJoin(F.broadcast(overall.withColumnRenamed("mean", "overall")))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]] = RULES, lift: float = LIFT) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_mean, bad_bound) of each row of ``pages`` (page_id, url).

    ``outcomes`` (page_id, bad 0 or 1) holds the labelled pages; of several rows
    for one page the worst counts, rows with nulls count not at all.  Null urls,
    and those without ``://``, have an empty host and path and are judged as
    such.  Repeated pages are judged, and if labelled counted, one by one.
    """
    parsed = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    known = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    # Written, so that both sides of the last join are plain shuffles and Spark can split a common host.
    seen = materialise(reputations(parsed.join(known, "page_id", "left").select("host", "bad")), "reputations")
    rule, ruled = rule_for(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("bad_bound") >= lift * F.col("overall"), "block").otherwise("allow")
    return parsed.join(seen, "host").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(ruled, method).alias("verdict"), "bad_mean", "bad_bound")
