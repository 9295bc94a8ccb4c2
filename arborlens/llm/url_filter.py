"""URL filters by rules, and by the reputation of hosts where no rule fits. DataFrame functions only.

Rules are rows ``(host, path, verdict)``. A rule fits its host and all subdomains, if the url's path starts with the rule's;
the longest rule (host and path) wins, and of equally long ones a block.

Reputation is empirical Bayes over labelled page outcomes. Counts go up from hosts to registered domains to suffixes to all
pages. Going down again, the posterior mean of the parent is the mean of the child's Beta prior, and the strength of the
priors of a level is fitted by moments: the excess of squared deviations of the children over binomial noise gives the
correlation ``rho``, and the strength is ``1 / rho - 1``. So hosts with few labels lean on their domain, and those without
any take the domain's value. A url is blocked if the upper bound of its host's posterior (mean + ``Z`` deviations) is below
``THRESHOLD``: only on firm evidence.

Registered domains are a suffix and one label more; suffixes are the last label, or the last two if listed in
``suffixes``, a parameter (``SUFFIXES`` are common ones). A port is no part of either.

Pages are counted per host before anything is shuffled; the join back from hosts to pages can be split at a hot host.

Defined results: null urls and those without ``://`` have empty host and path; no rule fits an empty host; pages without a
label count for nothing; several labels of a page count each; repeated pages give repeated results; extra columns are
ignored; without any labels the prior mean is one half and nothing is blocked.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlens.llm.tables import hold

# Common public suffixes of two labels.
SUFFIXES = ["ac.jp", "ac.uk", "co.id", "co.il", "co.in", "co.jp", "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.co",
            "com.hk", "com.mx", "com.my", "com.pl", "com.sg", "com.tr", "com.tw", "com.ua", "com.vn", "edu.au", "edu.cn", "go.jp", "gov.au", "gov.cn",
            "gov.in", "gov.uk", "ne.jp", "net.au", "net.br", "net.cn", "net.uk", "or.jp", "or.kr", "org.au", "org.br", "org.cn", "org.nz", "org.uk"]
Z = 1.64
THRESHOLD = 0.5
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def bare(host: Column) -> Column:
    """A host without its port."""
    return F.regexp_replace(host, r":[0-9]*\z", "")


def suffix_of(host: Column, suffixes: list[str]) -> Column:
    host = bare(host)
    last = F.substring_index(host, ".", -1)
    return F.when(F.substring_index(host, ".", -2).isin(suffixes), F.substring_index(host, ".", -2)).otherwise(last) if suffixes else last


def domain_of(host: Column, suffixes: list[str]) -> Column:
    host = bare(host)
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(suffixes), F.substring_index(host, ".", -3)).otherwise(two) if suffixes else two


def _strength(level: DataFrame) -> float:
    """Prior strength fitted to ``n``, ``good`` and the prior mean ``prior`` of the units of a level."""
    noise = F.col("prior") * (1 - F.col("prior"))
    row = level.agg(
        F.sum((F.col("good") - F.col("n") * F.col("prior")) * (F.col("good") - F.col("n") * F.col("prior"))).alias("seen"),
        F.sum(F.col("n") * noise).alias("binomial"), F.sum(F.col("n") * (F.col("n") - 1) * noise).alias("scale")).first()
    rho = (row["seen"] - row["binomial"]) / row["scale"] if row["scale"] else 0.5
    return 1 / min(max(rho, 0.001), 0.999) - 1


def _posterior(level: DataFrame) -> DataFrame:
    strength = _strength(level)
    return level.withColumn("strength", F.lit(strength)).withColumn(
        "mean", (F.col("good") + F.col("prior") * strength) / (F.col("n") + strength))


def reputation(outcomes: DataFrame, suffixes: list[str]) -> DataFrame:
    """``host, n, good, mean, upper`` from rows ``(host, good)``, ``good`` 0, 1 or null (no label)."""
    hosts = hold(
        outcomes.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("bigint").alias("good"))
        .withColumn("domain", domain_of(F.col("host"), suffixes)).withColumn("suffix", suffix_of(F.col("host"), suffixes)), "hosts")
    counts = [F.sum("n").alias("n"), F.sum("good").alias("good")]
    domains = hold(hosts.groupBy("suffix", "domain").agg(*counts), "domains")
    ends = hold(domains.groupBy("suffix").agg(*counts), "suffixes")
    total = ends.agg(*counts).first()
    overall = ((total["good"] or 0) + 1) / ((total["n"] or 0) + 2)
    ends = _posterior(ends.withColumn("prior", F.lit(overall)))
    domains = hold(domains.join(ends.select("suffix", F.col("mean").alias("prior")), "suffix"), "domains")
    domains = _posterior(domains)
    hosts = hold(hosts.join(domains.select("domain", F.col("mean").alias("prior")), "domain"), "hosts")
    hosts = _posterior(hosts)
    first = F.col("good") + F.col("prior") * F.col("strength")
    second = F.col("n") - F.col("good") + (1 - F.col("prior")) * F.col("strength")
    both = first + second
    spread = F.sqrt(first * second / (both * both * (both + 1)))
    return hosts.select("host", "n", "good", "mean", (F.col("mean") + Z * spread).alias("upper"))


def fitting_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, rules``: for each host, its rules in order of preference, by one equi-join of the ends of its name."""
    labels = F.split("host", r"\.")
    count = F.size(labels)
    ends = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(
        F.slice(labels, i, count), "."))).alias("rule_host")).filter("rule_host <> ''")
    listed = rules.select(
        F.col("host").alias("rule_host"), F.struct(
            (-F.length(F.concat("host", "path"))).alias("order"), (F.col("verdict") != "block").alias("mild"),
            F.concat("host", "path").alias("rule"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict")).alias("rule"))
    return ends.join(listed, "rule_host").groupBy("host").agg(F.array_sort(F.collect_set("rule")).alias("rules"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: DataFrame, suffixes: list[str] | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, host_labelled, host_good``.

    ``outcomes`` are labelled pages ``(page_id, good)``.
    """
    suffixes = SUFFIXES if suffixes is None else suffixes
    placed = pages.select(F.col("page_id").cast("bigint"), host_of(F.col("url").cast("string")).alias("host"),
                          path_of(F.col("url").cast("string")).alias("path"))
    labelled = placed.join(outcomes.select(F.col("page_id").cast("bigint"), F.col("good").cast("bigint")), "page_id", "left")
    known = reputation(labelled.select("host", "good"), suffixes)
    table = hold(known.join(fitting_rules(known.select("host"), rules), "host", "left"), "hosts")
    fits = F.filter("rules", lambda r: F.startswith(F.col("path"), r["rule_path"]))
    best = F.try_element_at(fits, F.lit(1))
    return placed.join(table, "host", "left").withColumn("best", best).select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.rule_verdict", F.when(F.col("upper") < THRESHOLD, "block").otherwise("allow")).alias("verdict"),
        F.col("n").alias("host_labelled"), F.col("good").alias("host_good"))
