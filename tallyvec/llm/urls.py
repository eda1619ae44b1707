"""URL filter: explicit host and path rules, and an empirical-Bayes reputation where no rule fits.

Labelled page outcomes are shrunk through beta-binomial priors: a suffix's rate towards that of all pages, a registered
domain's towards its suffix's, a host's towards its domain's. Each level's prior strength comes from the spread of the
rates below it (method of moments). A page is allowed if the posterior says, at the bound's confidence, that its host's
rate of good pages reaches the floor, and blocked otherwise. Hosts are grouped by name, without a user name, port or
final dot. Suffix is the last label, or a longer one of those given as public suffixes; the registered domain has one
label more. An IPv4 or bracketed IPv6 address is its own domain and suffix. The host in the result stays as it stands
in the url.

Defined results. A null url, or one without `://`, has an empty host and path, no rule, and the reputation of the empty
host. A host without outcomes has its domain's prior, a domain without any its suffix's, a suffix that of all pages;
without any outcome at all that prior is 0.8 and the verdict allow. Null labels and labels of other
pages are ignored; repeated rows count and appear each. Urls may be of any length. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path start), as given.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Public suffixes of two labels; a parameter, since the full list is long and changes.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.za", "co.in", "co.jp", "co.kr", "com.br", "com.cn", "com.mx", "com.tr")
_ADDRESS = r"^(\d{1,3}(\.\d{1,3}){3}|\[.*\])\z"
#: Good pages a host must have as a share; normal quantile of the one-sided bound; least and most strength of a prior (most where rates show no spread).
FLOOR, QUANTILE = 0.5, 1.645
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null if none fits. Equally long rules: the first in order of text."""
    rule = verdict = F.lit(None).cast("string")
    for word, where, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == where) | F.endswith(host, F.lit("." + where))) & F.startswith(path, F.lit(start))
        rule = F.when(fits, F.lit(where + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(word)).otherwise(verdict)
    return rule, verdict


def named(host: Column) -> Column:
    """The host's name or address: without a user name, port or final dot."""
    return F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r"(:[0-9]*)?\z|\.(:[0-9]*)?\z", "")


def registered(name: Column, suffixes=SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and suffix."""
    longer = F.substring_index(name, ".", -2).isin(*suffixes)
    part = lambda n: F.when(name.rlike(_ADDRESS), name).when(longer, F.substring_index(name, ".", -n - 1)).otherwise(F.substring_index(name, ".", -n))
    return part(2), part(1)


def _sums(units: DataFrame, by: list[str], prefix: str) -> DataFrame:
    """Of the units below (n pages with outcomes, good ones): their sums, and the strength of the beta prior that their rates' spread gives."""
    n, good = F.sum("n").cast("double"), F.sum("good").cast("double")
    p = good / F.nullif(n, F.lit(0.0))
    between = F.sum(F.when(F.col("n") > 0, F.col("good") * F.col("good") / F.col("n"))) / F.nullif(n, F.lit(0.0)) - p * p
    count = F.sum((F.col("n") > 0).cast("bigint"))
    spread = between - p * (1 - p) * count / F.nullif(n, F.lit(0.0))
    fitted = F.greatest(F.lit(LEAST_STRENGTH), F.least(F.lit(MOST_STRENGTH), p * (1 - p) / F.nullif(spread, F.lit(0.0)) - 1))
    strength = F.when((count < 2) | (spread <= 1e-6), F.lit(MOST_STRENGTH)).otherwise(fitted)
    return units.groupBy(*by).agg(F.sum("n").alias(f"{prefix}_n"), F.sum("good").alias(f"{prefix}_good"), F.coalesce(strength, F.lit(MOST_STRENGTH)).alias(f"{prefix}_k"))


def reputation(pages: DataFrame, suffixes=SUFFIXES) -> DataFrame:
    """pages: host and good (1, 0, or null: no outcome). One row for each host: host, n, a, b of its posterior.

    Counts are combined before they are shuffled, so a hot host is one row from each task; the later levels have a row
    for each host, domain and suffix.
    """
    hosts = pages.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    domain, suffix = registered(named(F.col("host")), suffixes)
    hosts = hosts.withColumns({"domain": domain, "suffix": suffix})
    domains = _sums(hosts, ["domain", "suffix"], "d")
    suffixes = _sums(domains.select("suffix", F.col("d_n").alias("n"), F.col("d_good").alias("good")), ["suffix"], "s")
    total = _sums(suffixes.select(F.col("s_n").alias("n"), F.col("s_good").alias("good")), [], "t")
    top = total.select(((F.coalesce("t_good", F.lit(0)) + 1) / (F.coalesce("t_n", F.lit(0)) + 1.25)).alias("t_p"), "t_k")
    suffixes = suffixes.crossJoin(F.broadcast(top)).withColumn("s_p", (F.col("s_good") + F.col("t_k") * F.col("t_p")) / (F.col("s_n") + F.col("t_k")))
    domains = domains.join(suffixes.select("suffix", "s_p", "s_k"), "suffix").withColumn("d_p", (F.col("d_good") + F.col("s_k") * F.col("s_p")) / (F.col("d_n") + F.col("s_k")))
    return hosts.join(domains.select("domain", "d_p", "d_k"), "domain").select("host", "n", (F.col("good") + F.col("d_k") * F.col("d_p")).alias("a"), (F.col("n") - F.col("good") + F.col("d_k") * (1 - F.col("d_p"))).alias("b"))


def lower_bound(a: Column, b: Column, quantile: float = QUANTILE) -> Column:
    """Of a beta posterior, by its mean and deviation."""
    return a / (a + b) - F.lit(quantile) * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))


def judge(pages: DataFrame, labels: DataFrame, *, page_id: str = "page_id", url: str = "url", label_id: str = "doc_id", label: str = "quality", rules=RULES, suffixes=SUFFIXES, floor: float = FLOOR, quantile: float = QUANTILE) -> DataFrame:
    """page_id, host, path, rule, verdict, and bound (the host's) for each page."""
    host, path = split_url(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    outcomes = labels.where(F.col(label).isNotNull()).select(F.col(label_id).alias("page_id"), F.col(label).cast("bigint").alias("good"))
    posterior = reputation(rows.select("page_id", "host").join(outcomes, "page_id", "left").select("host", "good"), suffixes)
    bounds = posterior.select("host", lower_bound(F.col("a"), F.col("b"), quantile).alias("bound"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("bound") < floor, F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(bounds, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), "bound")
