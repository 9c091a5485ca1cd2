"""URL filter: host reputation by empirical Bayes, overridden by written rules.

Labelled page outcomes are counted by host, registered domain and suffix. Each
level's spread gives a beta prior by the method of moments; a suffix shrinks to
the whole, a domain to its suffix, a host to its domain. A host is blocked if
even the lower bound of its posterior share of bad pages passes a limit. All of
it is column expressions and joins on host; nothing runs in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Suffixes of two labels; any other suffix is the last label.
TWO_LABELS = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "co.jp", "co.nz", "com.br", "co.in", "co.za")
#: Longest first is not needed here; see :func:`rule_columns`.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
#: A host is bad if its bad share exceeds LIMIT by Z posterior deviations.
LIMIT, Z = 0.3, 1.28
#: Share of the variance that groups of one level may explain.
LEAST, MOST = 1e-4, 0.5


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), UPPER, UPPER.lower()), F.coalesce(path, F.lit(""))


def suffix_domain(host: Column) -> tuple[Column, Column]:
    """Suffix and registered domain; a host of one label is both."""
    two = F.substring_index(host, ".", -2)
    long = two.isin(*TWO_LABELS)
    suffix = F.when(long, two).otherwise(F.substring_index(host, ".", -1))
    domain = F.when(long, F.substring_index(host, ".", -3)).otherwise(two)
    return suffix, domain


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (ties: the first in text order) and its verdict."""
    rule = verdict = F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        of, _, rest = text.partition("/")
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(f"/{rest}")
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _prior(counts: DataFrame) -> tuple[float, float]:
    """Mean and strength (pseudo-counts) of a level's beta prior, from one row of sums."""
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    row = counts.filter("n > 0").agg(
        F.count("*").alias("g"), F.sum("n").alias("n"), F.sum("k").alias("k"),
        F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(k * k / n).alias("kk"),
    ).first()
    if not row.g or not 0 < row.k < row.n:
        return (row.k / row.n if row.g else 0.5), 1.0
    mean = row.k / row.n
    free = row.n - row.nn / row.n - (row.g - 1)
    over = (row.kk - row.n * mean * mean) / (mean * (1 - mean)) - (row.g - 1)
    share = min(MOST, max(LEAST, over / free if free > 0 else LEAST))
    return mean, 1 / share - 1


def reputations(hosts: DataFrame) -> DataFrame:
    """host, n, k -> host, bound: the posterior's lower bound of the bad share.

    ``hosts`` has one row a host, unlabelled hosts with n = 0. Priors come from
    one row of sums a level; an empty table gives no rows.
    """
    suffix, domain = suffix_domain(F.col("host"))
    hosts = hosts.withColumns({"suffix": suffix, "domain": domain})
    domains = materialize(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "domains")
    suffixes = materialize(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "suffixes")
    whole, s_strength = _prior(suffixes)
    _, d_strength = _prior(domains)
    _, h_strength = _prior(hosts)

    def shrunk(mean, strength):
        return (F.col("k") + strength * mean) / (F.col("n") + strength)

    by_suffix = suffixes.select("suffix", shrunk(F.lit(whole), s_strength).alias("up"))
    by_domain = domains.join(by_suffix, "suffix").select("suffix", "domain", shrunk(F.col("up"), d_strength).alias("up"))
    a = F.col("k") + h_strength * F.col("up")
    total = F.col("n") + h_strength
    mean = a / total
    deviation = F.sqrt(mean * (1 - mean) / (total + 1))
    return hosts.join(by_domain, ["suffix", "domain"]).select("host", F.round(mean - Z * deviation, 9).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, limit: float = LIMIT) -> DataFrame:
    """Judge every row of ``pages`` (page_id, url).

    ``outcomes`` (url, bad 0/1): labelled pages; null urls or outcomes count
    for nothing. Returns page_id, host, path, rule, verdict, bound. A repeated
    page counts once a row; an empty table gives no rows; other columns are
    dropped, so none can clash.
    """
    host, path = host_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    seen = outcomes.filter("url IS NOT NULL AND bad IS NOT NULL").select(
        host_path(F.col("url"))[0].alias("host"), F.lit(1).cast("long").alias("n"), F.col("bad").cast("long").alias("k")
    )
    zero = F.lit(0).cast("long")
    hosts = materialize(
        parsed.select("host", zero.alias("n"), zero.alias("k")).unionAll(seen)
        .groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k")),
        "hosts",
    )
    scored = materialize(reputations(hosts), "bounds")
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("bound") > limit, "block").otherwise("allow")
    return parsed.join(scored, "host").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_method).alias("verdict"), "bound"
    )
