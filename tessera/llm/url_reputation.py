"""URL filter by rules and by the reputation of hosts.

Reputation. Labelled pages count as good or bad by host. The bad rate is shrunk through beta-binomial priors: a suffix
towards the rate of all pages, a registered domain towards its suffix, a host towards its domain. How strongly is
estimated from the data, one concentration a level, by the method of moments on how much children differ from their
parent. A host is blocked if the lower bound of its posterior bad rate, at `confidence`, is above `most_bad` or, if that is
less, `times_usual` times the rate of all pages.

Rules. A rule is a host and the beginning of a path; it fits its host and all subdomains. The longest rule that fits
decides, and overrides the reputation.

Defined results: a null url, or one without `://`, has an empty host and path and no rule; its reputation is that of the
empty host. A page without labels takes part in the verdicts only. Pages repeated in the table are judged row by row.
With no labelled page at all nothing is blocked but by rules.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import cut_lineage, hot_keys, salted_join

#: A host is blocked if its bad rate is surely above this, or above so many times the rate of all pages.
MOST_BAD = 0.5
TIMES_USUAL = 2.0
CONFIDENCE = 0.95
#: Suffixes of two parts under which domains are registered; all others have one part.
SECOND_LEVEL = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "com.br", "co.in", "co.kr", "co.za", "com.cn", "com.mx", "com.tr")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def page_text(html: Column) -> Column:
    """A page's text as its markup shows it: without scripts, styles, comments and tags, each block on a line of its own."""
    shown = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    shown = F.regexp_replace(shown, r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|nav|section|title|body|head)\b[^>]*>", "\n")
    return F.regexp_replace(shown, r"<[^>]*>", " ")


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    """The registered domain and its public suffix, by the last labels of the name."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")
    two = F.substring_index(name, ".", -2)
    deep = two.isin(*SECOND_LEVEL)
    return F.when(deep, F.substring_index(name, ".", -3)).otherwise(two), F.when(deep, two).otherwise(F.substring_index(name, ".", -1))


def _log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    def log_gamma(x: np.ndarray) -> np.ndarray:
        shift = np.zeros_like(x)
        for _ in range(8):
            small = x < 8
            shift = np.where(small, shift - np.log(x), shift)
            x = np.where(small, x + 1, x)
        return shift + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)

    return log_gamma(a) + log_gamma(b) - log_gamma(a + b)


def beta_quantile(a: np.ndarray, b: np.ndarray, p: float) -> np.ndarray:
    """The p-quantile of Beta(a, b), by bisection on its density's integral in the logit of x."""
    mean = a / (a + b)
    centre = np.log(mean / (1 - mean))
    spread = np.sqrt(1 / a + 1 / b)
    grid = centre[:, None] + spread[:, None] * np.linspace(-40, 40, 4001)[None, :]
    log_x, log_1x = -np.logaddexp(0, -grid), -np.logaddexp(0, grid)
    density = np.exp(a[:, None] * log_x + b[:, None] * log_1x - _log_beta(a, b)[:, None])
    mass = np.cumsum(density, axis=1)
    mass /= mass[:, -1:]
    at = np.argmax(mass >= p, axis=1)
    return 1 / (1 + np.exp(-grid[np.arange(len(a)), at]))


def _concentration(children: DataFrame) -> Column:
    """Beta prior's concentration, from (n, bad, parent_rate) of the children by the method of moments, within 1 and 10,000."""
    m = F.col("parent_rate")
    noise = F.sum(m * (1 - m))
    excess = F.sum((F.col("bad") - F.col("n") * m) ** 2 / F.col("n")) - noise
    between = F.when(F.sum("n") > F.count("*"), excess / (F.sum("n") - F.count("*")))
    mean_noise = noise / F.count("*")
    return F.greatest(F.lit(1.0), F.least(F.lit(1e4), F.coalesce(F.when(between > 0, mean_noise / between - 1), F.lit(1e4))))


def reputations(labelled: DataFrame, hosts: DataFrame, confidence: float = CONFIDENCE) -> DataFrame:
    """(host, n, bad, rate, bound, usual) for every row of `hosts` (host), by `labelled` (host, bad 0/1 or null); usual: the rate of all."""
    counts = labelled.where("bad is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    domain, suffix = domain_and_suffix(F.col("host"))
    levels = hosts.select("host").distinct().join(counts, "host", "left").na.fill(0, ["n", "bad"])
    # The pages are read once: all that follows is by host.
    levels = cut_lineage(levels.select("host", "n", "bad", domain.alias("domain"), suffix.alias("suffix")))
    overall = levels.agg((F.coalesce(F.sum("bad"), F.lit(0)) + F.lit(0.5)) / (F.coalesce(F.sum("n"), F.lit(0)) + F.lit(1.0))).first()[0]
    parents = None
    for level, parent in (("suffix", None), ("domain", "suffix"), ("host", "domain")):
        keys = [level] + ([parent] if parent else [])
        own = levels.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        own = own.join(parents.select(F.col(parent), F.col("rate").alias("parent_rate")), parent) if parent else own.withColumn("parent_rate", F.lit(overall))
        strength = own.where("n > 0").agg(_concentration(own)).first()[0]
        prior = F.lit(float(strength if strength is not None else 1e4))
        a, b = F.col("bad") + prior * F.col("parent_rate"), F.col("n") - F.col("bad") + prior * (1 - F.col("parent_rate"))
        parents = own.select(*keys, "n", "bad", a.alias("a"), b.alias("b"), (a / (a + b)).alias("rate"))

    @F.pandas_udf("double")
    def lower(a: pd.Series, b: pd.Series) -> pd.Series:
        step = 500
        return pd.Series(np.concatenate([beta_quantile(a.to_numpy()[k : k + step], b.to_numpy()[k : k + step], 1 - confidence) for k in range(0, max(len(a), 1), step)] or [np.zeros(0)]))

    return parents.select("host", "n", "bad", "rate", lower("a", "b").alias("bound"), F.lit(overall).alias("usual"))


def judge(urls: DataFrame, rules: DataFrame, labelled: DataFrame | None, id_col: str = "page_id", url_col: str = "url", most_bad: float = MOST_BAD, times_usual: float = TIMES_USUAL, confidence: float = CONFIDENCE) -> DataFrame:
    """(id, host, path, rule, verdict, bad_rate, bound) for every row of `urls`.

    `rules`: (host, path, action), action allow or block. `labelled`: (host, bad). Rules and reputations meet the pages
    in one join, by host: a host's row holds the rules that fit it or a parent of it.
    """
    host, path = host_and_path(F.col(url_col))
    pages = urls.select(F.col(id_col), host.alias("host"), path.alias("path"))
    hosts = cut_lineage(pages.groupBy("host").agg(F.count("*").alias("pages")))
    known = reputations(labelled, hosts, confidence) if labelled is not None else hosts.select("host", *(F.lit(None).cast("double").alias(c) for c in ("rate", "bound", "usual")))
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    rules = rules.select(F.col("host").alias("_rule_host"), F.struct(F.length(F.concat("host", "path")).alias("length"), F.concat(F.col("host"), F.col("path")).alias("rule"), F.col("path").alias("begins"), F.col("action").alias("action")).alias("r"))
    fit = hosts.select("host", F.explode(parents).alias("_rule_host")).join(rules, "_rule_host").groupBy("host").agg(F.collect_list("r").alias("rules"))
    facts = known.join(fit, "host", "left").select("host", "rate", "bound", "usual", "rules")
    found = salted_join(pages, facts, "host", [F.col(id_col), F.col("path")], hot_keys(hosts, "host", "pages"), "left")
    best = F.array_max(F.filter("rules", lambda r: F.startswith(F.col("path"), r["begins"])))
    found = found.withColumn("best", best)
    blocked = F.coalesce(F.col("bound") > F.least(F.lit(most_bad), F.lit(times_usual) * F.col("usual")), F.lit(False))
    verdict = F.coalesce(F.col("best.action"), F.when(blocked, "block").otherwise("allow"))
    return found.select(id_col, "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), F.col("rate").alias("bad_rate"), "bound")
