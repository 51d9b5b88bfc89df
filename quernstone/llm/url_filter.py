"""URL filters: rule lists, and empirical-Bayes host reputation for what no rule judges. DataFrame operations only.

Pages that a rule judges are labelled outcomes (or give ``outcome_col``, 1 for a bad page). Their counts are shrunk
through beta-binomial priors: suffix towards all pages, registered domain towards its suffix, host towards its domain.
Each level's prior strength comes from the data (moment estimator of the intra-class correlation). A host is blocked
if the lower posterior bound of its rate of bad pages is above ``threshold``.

Rules are a table of any size. A page's host gives its suffixes; each suffix that has rules gives the lengths their paths
have, and the page's path cut to these lengths gives the keys that rules are joined by, so a page meets the rules that fit
and no others. Up to ``INLINE_RULES`` rules are one expression instead.

Defined cases: a null url, or one without ``://``, has empty host and path, fits no rule and is allowed; hosts without
labels are judged by their domain's and suffix's prior alone; an empty table gives an empty result; other columns are
ignored; repeated rows each give a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import ascii_lower, written

#: Suffixes of two labels under which names are registered (fixed values; ``url_filter`` takes others).
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "or.jp", "ne.jp", "com.br", "com.cn", "com.mx", "co.in", "co.kr", "co.za", "com.tr")
INLINE_RULES = 64
#: Rules and their hosts are broadcast up to this many rows, joined by a shuffle beyond.
BROADCAST_RULES = 100_000
STRENGTHS = (1.0, 1000.0)


def url_host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule ``host/path`` that fits, or null. A rule fits its host and all subdomains. For few rules."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def longest_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct ``host, path`` that a rule fits, with the longest ``rule`` and its ``judged``. ``rules``: ``rule, verdict``."""
    parts = rules.select("rule", F.col("verdict").alias("judged"), F.substring_index("rule", "/", 1).alias("at"), F.expr("if(locate('/', rule) > 0, substr(rule, locate('/', rule)), '/')").alias("head"))
    parts = parts.dropDuplicates(["rule"]).withColumn("size", F.length("head"))
    fits = rules.count() <= BROADCAST_RULES
    small = F.broadcast if fits else (lambda df: df)
    sizes = parts.groupBy("at").agg(F.collect_set("size").alias("sizes"))
    pairs = pages.select("host", "path").distinct()
    suffixes = F.expr("transform(sequence(1, size(split(host, '[.]'))), k -> substring_index(host, '.', -k))")
    keys = pairs.select("host", "path", F.explode(suffixes).alias("at")).join(small(sizes), "at")
    keys = keys.select("host", "path", "at", F.explode(F.expr("filter(sizes, n -> n <= length(path))")).alias("size")).withColumn("head", F.expr("left(path, size)"))
    found = keys.join(small(parts.drop("size")), ["at", "head"])
    best = found.groupBy("host", "path").agg(F.max(F.struct(F.length("rule"), "rule", "judged")).alias("m"))
    return best.select("host", "path", "m.rule", "m.judged")


def _domain(host: Column, two_label_suffixes: tuple[str, ...]) -> tuple[Column, Column]:
    """Suffix and registered domain."""
    bare = F.regexp_replace(host, r"^.*@|:\d*$", "")
    two = F.substring_index(bare, ".", -2)
    suffix = F.when(two.isin(*two_label_suffixes), two).otherwise(F.substring_index(bare, ".", -1))
    domain = F.when(two.isin(*two_label_suffixes), F.substring_index(bare, ".", -3)).otherwise(two)
    return suffix, domain


def _moments(children: DataFrame, parent: str) -> DataFrame:
    """One row: sums for the moment estimator over all parents of a level."""
    n, b = F.col("n").cast("double"), F.col("b").cast("double")
    by = children.where("n > 0").groupBy(parent).agg(F.count("*").alias("k"), F.sum(n).alias("n"), F.sum(b).alias("b"), F.sum(n * n).alias("nn"), F.sum(b * b / n).alias("bb"))
    return by.agg(
        F.sum(F.col("bb") - F.col("b") * F.col("b") / F.col("n")).alias("ssb"),
        F.sum(F.col("b") - F.col("bb")).alias("ssw"),
        F.sum(F.col("k") - 1).alias("dfb"),
        F.sum(F.col("n") - F.col("k")).alias("dfw"),
        F.sum(F.col("n") - F.col("nn") / F.col("n")).alias("spread"),
    )


def strength(ssb: float | None, ssw: float | None, dfb: float | None, dfw: float | None, spread: float | None) -> float:
    """Pseudo-counts of a level's prior: (1 - rho) / rho, within ``STRENGTHS``; the upper end if nothing tells."""
    low, high = STRENGTHS
    if not dfb or not dfw or not spread:
        return high
    between, within, n0 = ssb / dfb, ssw / dfw, spread / dfb
    below = between + (n0 - 1) * within
    rho = (between - within) / below if below > 0 else 0.0
    return high if rho <= 0 else min(high, max(low, (1 - rho) / rho))


def host_reputation(pages: DataFrame, host_col: str, outcome_col: str, threshold: float = 0.5, z: float = 1.645, two_label_suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """One row per host: ``host, host_labelled, host_bad, bad_rate, bad_low, host_blocked``.

    ``outcome_col``: 1 bad, 0 good, null unlabelled.
    """
    host = F.col("host")
    suffix, domain = _domain(host, two_label_suffixes)
    hosts = pages.groupBy(F.col(host_col).alias("host")).agg(F.count(outcome_col).alias("n"), F.coalesce(F.sum(F.col(outcome_col).cast("long")), F.lit(0)).alias("b"))
    hosts = written(hosts.withColumns({"suffix": suffix, "domain": domain, "every": F.lit(1)}), "hosts")
    sums = lambda df, *keys: df.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    domains = sums(hosts, "domain", "suffix")
    suffixes = sums(domains, "suffix").withColumn("every", F.lit(1))
    m_host, m_domain, m_suffix = (strength(*_moments(c, p).first()) for c, p in ((hosts, "domain"), (domains, "suffix"), (suffixes, "every")))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("b").alias("b")).first()
    p_all = ((total.b or 0) + 1.0) / ((total.n or 0) + 2.0)
    shrunk = lambda m, prior: (F.col("b") + m * prior) / (F.col("n") + m)
    suffixes = suffixes.select("suffix", shrunk(m_suffix, p_all).alias("p_suffix"))
    domains = domains.join(suffixes, "suffix").select("domain", shrunk(m_domain, F.col("p_suffix")).alias("p_domain"))
    rate = shrunk(m_host, F.col("p_domain"))
    low = F.col("bad_rate") - z * F.sqrt(F.col("bad_rate") * (1 - F.col("bad_rate")) / (F.col("n") + m_host + 1))
    return (
        hosts.join(domains, "domain")
        .withColumn("bad_rate", rate)
        .withColumn("bad_low", low)
        .select("host", F.col("n").alias("host_labelled"), F.col("b").alias("host_bad"), "bad_rate", "bad_low", ((F.col("host") != "") & (F.round("bad_low", 9) > threshold)).alias("host_blocked"))
    )


def url_filter(
    pages: DataFrame, rules: dict[str, str] | DataFrame, id_col: str = "page_id", url_col: str = "url", outcome_col: str | None = None, threshold: float = 0.5, z: float = 1.645, two_label_suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES
) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, host_labelled, host_bad``.

    ``rules`` maps ``host/path`` to ``allow`` or ``block``, or is a table ``rule, verdict`` of any size.
    """
    url, spark = F.col(url_col), pages.sparkSession
    rows = pages.select(F.col(id_col).alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path"), *([F.col(outcome_col).alias("given")] if outcome_col else []))
    if isinstance(rules, dict) and len(rules) <= INLINE_RULES:
        judged = F.create_map(*[F.lit(x) for kv in sorted(rules.items()) for x in kv])[F.col("rule")] if rules else F.lit(None).cast("string")
        rows = rows.withColumn("rule", longest_rule(F.col("host"), F.col("path"), rules)).withColumn("judged", judged)
    else:
        listed = spark.createDataFrame(sorted(rules.items()), "rule string, verdict string") if isinstance(rules, dict) else rules
        rows = rows.join(written(longest_rules(rows, listed), "judged"), ["host", "path"], "left")
    by_rule = F.when(F.col("judged") == "block", 1).when(F.col("judged") == "allow", 0)
    rows = rows.withColumn("outcome", F.coalesce(F.col("given"), by_rule) if outcome_col else by_rule)
    reputation = written(host_reputation(rows, "host", "outcome", threshold, z, two_label_suffixes), "reputation")
    verdict = F.coalesce(F.col("judged"), F.when(F.col("host_blocked"), "block").otherwise("allow"))
    return rows.join(reputation, "host", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "host_labelled", "host_bad")
