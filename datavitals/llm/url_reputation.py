"""URL filtering by rules and, where none fits, by the reputation of the host.

Pages that a rule decides are labelled outcomes (blocked or not). Their rate is shrunk down a chain of
beta-binomial priors: all pages, the suffix (the last label, or the longest of `suffixes` that ends the host), the
registered domain (the label before the suffix with it), the host. A port counts for the host alone. The strength of each prior is estimated from the spread of its children by the method of
moments, so hosts with few labelled pages fall back on their domain, and domains on their suffix. A prior is
never stronger than what its parent itself is based on, so that a host of which nothing is known stays uncertain. A page
without a rule is blocked if the lower bound of its host's posterior rate is above `threshold`.

A null url, or one without "://", has an empty host and path; such pages form one host like any other.
Repeated rows are judged each and count as outcomes each; an empty table gives an empty result; extra columns are
ignored. Without any labelled page the rate is one half with a wide posterior, so pages are allowed."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import pick, staged

ALLOW, BLOCK = "allow", "block"
#: Common suffixes of several labels under which names are registered; no copy of the public suffix list.
SUFFIXES = ("ac.uk", "co.uk", "gov.uk", "org.uk", "uk.com", "com.au", "net.au", "org.au", "co.nz", "co.za", "com.br", "com.cn", "com.mx", "com.tr",
            "com.tw", "co.in", "co.jp", "ne.jp", "or.jp", "co.kr")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) between the first "://" and the next / ? # or the end, and the path up to ? # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    lower = F.translate(host, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def matching(rules: Sequence[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, both null if none does. `rules` is a short list of (verdict, host/path)."""
    rule = verdict = F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def domain_and_suffix(host: Column, suffixes: Sequence[str]) -> tuple[Column, Column]:
    """The registered domain and the suffix of a host, without its port."""
    name = F.regexp_replace(host, ":[0-9]*$", "")
    domain, suffix = F.substring_index(name, ".", -2), F.substring_index(name, ".", -1)
    for known in sorted(suffixes, key=lambda s: (s.count("."), s)):
        ends = (name == known) | name.endswith("." + known)
        domain = F.when(ends, F.substring_index(name, ".", -2 - known.count("."))).otherwise(domain)
        suffix = F.when(ends, F.lit(known)).otherwise(suffix)
    return domain, suffix


def strength(rows: DataFrame, mean: str) -> float:
    """Prior strength for the children in `rows` (n, k and the parent's mean), from E[n(p-m)^2] = m(1-m)(1+(n-1)rho)."""
    m = F.col(mean)
    own = rows.where("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - m, 2)).alias("spread"), F.sum(m * (1 - m)).alias("least"), F.sum((F.col("n") - 1) * m * (1 - m)).alias("more")).first()
    if not own["more"]:
        return 2.0
    rho = min(max((own["spread"] - own["least"]) / own["more"], 0.001), 0.999)
    return (1 - rho) / rho


def judge_urls(df: DataFrame, rules: Sequence[tuple[str, str]], id: str = "page_id", url: str = "url", threshold: float = 0.8, z: float = 1.645,
               suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """One row per page: id, host, path, rule, verdict. `suffixes` is a short list of suffixes of several labels."""
    pages = pick(df, id=id, url=url)
    host, path = host_and_path(F.col("url"))
    pages = pages.select("id", host.alias("host"), path.alias("path"))
    rule, said = matching(rules, F.col("host"), F.col("path"))
    pages = pages.withColumn("rule", rule).withColumn("said", said)
    domain, suffix = domain_and_suffix(F.col("host"), suffixes)
    hosts = pages.groupBy("host").agg(F.count("said").alias("n"), F.count(F.when(F.col("said") == BLOCK, 1)).alias("k"))
    hosts = staged(hosts.withColumn("domain", domain).withColumn("suffix", suffix), "hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    overall = ((total["k"] or 0) + 1) / ((total["n"] or 0) + 2)

    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("overall", F.lit(overall))
    s = strength(suffixes, "overall")
    suffixes = suffixes.select("suffix", ((F.col("k") + s * overall) / (F.col("n") + s)).alias("suffix_rate"), (F.col("n") + s).alias("held"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).join(suffixes, "suffix")
    s = F.least(F.lit(strength(domains, "suffix_rate")), F.col("held"))
    domains = domains.select("domain", "suffix", ((F.col("k") + s * F.col("suffix_rate")) / (F.col("n") + s)).alias("domain_rate"), (F.col("n") + s).alias("held"))
    judged = hosts.join(domains, ["domain", "suffix"])
    s = F.least(F.lit(strength(judged, "domain_rate")), F.col("held"))
    a = F.col("k") + s * F.col("domain_rate")
    b = F.col("n") - F.col("k") + s * (1 - F.col("domain_rate"))
    low = a / (a + b) - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    judged = staged(judged.select(F.col("host").alias("h"), F.when(low > threshold, BLOCK).otherwise(ALLOW).alias("reputed")), "judged")
    joined = pages.join(judged, F.col("host") == F.col("h"))
    return joined.select("id", "host", "path", "rule", F.coalesce("said", "reputed").alias("verdict"))
