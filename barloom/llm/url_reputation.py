"""Url filters by rules and empirical-Bayes host reputation (DataFrame functions only).

Rules decide first (longest match). Other pages are judged by the share of bad pages of their host: labelled outcomes are
shrunk through beta-binomial priors from all pages to the public suffix (last label), to the registered domain (last two labels), to
the host, each prior centred on the posterior mean above it with a concentration fitted by moments. A page is blocked when the
lower bound of its host's posterior is above ``threshold``: little evidence does not block.

Defined results: null urls and urls without ``://`` have empty host and path, fit no rule and share the reputation of the empty
host; repeated rows are judged alike; pages without an article, or with an empty one, meet no document; no labels at all allow every page without a rule; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import SPACE, ascii_lower, row_key, stage, text_of

LARGEST_RHO = 1 / 3  # a prior counts as two observations at least, so that one bad page does not block its host
LEVELS = ["suffix", "domain", "host"]
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&(?:apos|#39|#[xX]27);", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&")]  # the ampersand last


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, or null. Only as many host labels are tried as the rules have, whatever the host holds."""
    by_host: dict[str, list[str]] = {}
    for r in rules:
        by_host.setdefault(r.partition("/")[0], []).append(r)
    if not by_host:
        return F.lit(None).cast("string")
    depth = max(h.count(".") for h in by_host) + 1
    table = F.create_map(*[x for h, rs in sorted(by_host.items()) for x in (F.lit(h), F.array(*map(F.lit, sorted(rs))))])
    suffixes = F.transform(F.sequence(F.lit(1), F.lit(depth)), lambda i: _tail(host, i))
    found = F.flatten(F.filter(F.transform(F.array_distinct(suffixes), lambda s: F.try_element_at(table, s)), lambda x: x.isNotNull()))
    fits = F.filter(found, lambda r: F.startswith(path, F.concat(F.lit("/"), F.call_function("substring", r, F.instr(r, "/") + 1))))
    return F.array_max(F.transform(fits, lambda r: F.struct(F.length(r).alias("n"), r.alias("rule"))))["rule"]


def _tail(host: Column, i: Column) -> Column:
    """The last i labels of a host."""
    return F.call_function("substring_index", host, F.lit("."), -i)


def bare(text: Column) -> Column:
    """A text without white space: pages break lines elsewhere."""
    return F.regexp_replace(text, f"[{SPACE}]+", "")


def article_text(html: Column) -> Column:
    """The whole text of a page's article without its heading, unescaped and without white space; empty without an article."""
    out = F.regexp_extract(text_of(html), r"(?is)<article\b[^>]*>(.*)</article>", 1)
    out = F.regexp_replace(out, r"(?is)^\s*<h1\b[^>]*>.*?</h1>", "")
    out = F.regexp_replace(out, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", "")
    out = F.regexp_replace(out, r"<[^>]*+>", "")
    for entity, char in ENTITIES:
        out = F.regexp_replace(out, entity, char)
    return bare(out)


def linked_pages(pages: DataFrame, docs: DataFrame, bad: DataFrame) -> DataFrame:
    """host, linked, bad for each page: whether its article is a document, and the mean of ``bad`` (doc_id, bad) over the documents of that text.

    Pages and documents meet by 128 bits of their whole texts; texts themselves are not shuffled.
    """
    texts = docs.select("doc_id", bare(text_of(F.col("text"))).alias("_b_text")).filter("_b_text != ''").select("doc_id", *row_key(F.col("_b_text")))
    texts = texts.join(bad, "doc_id", "left").groupBy("_b_k1", "_b_k2").agg(F.avg("bad").alias("bad")).withColumn("_b_met", F.lit(True))
    host, _ = host_and_path(F.col("url"))
    named = pages.select(host.alias("host"), article_text(F.col("html")).alias("_b_text")).select("host", *row_key(F.col("_b_text")))
    return named.join(texts, ["_b_k1", "_b_k2"], "left").select("host", F.coalesce("_b_met", F.lit(False)).alias("linked"), "bad")


def outcomes_by_host(pages: DataFrame) -> DataFrame:
    """(host, bad in 0..1) rows to one row per host: n, bad and the levels above."""
    by_host = pages.groupBy("host").agg(F.count("bad").alias("n"), F.sum(F.col("bad").cast("double")).alias("bad"))
    return by_host.select("host", _tail(F.col("host"), F.lit(2)).alias("domain"), _tail(F.col("host"), F.lit(1)).alias("suffix"), F.col("n").cast("double").alias("n"), "bad")


def _concentration(groups: DataFrame) -> float:
    """Prior size of one level by moments: groups (n, bad, prior mean) spread more than binomial draws would."""
    m, p = F.col("prior"), F.col("bad") / F.col("n")
    free = m * (1 - m)
    spread, draws, room = groups.agg(F.sum(F.col("n") * (p - m) ** 2), F.sum(free), F.sum(free * (F.col("n") - 1))).first()
    rho = (spread - draws) / room if room else 0.0
    rho = min(max(rho, 0.001), LARGEST_RHO)
    return 1 / rho - 1


def reputation(hosts: DataFrame, z: float = 1.64) -> tuple[dict[str, DataFrame], float]:
    """Posterior mean and lower bound per suffix, domain and host, and the bound of a page nothing is known about.

    Each level is one aggregate of the one below; three numbers per level come to the driver.
    """
    hosts = stage(hosts, "outcomes")
    n, bad = hosts.agg(F.sum("n"), F.sum("bad")).first()
    overall = (bad + 1) / (n + 2) if n else 0.0
    out, prior = {}, None
    for i, level in enumerate(LEVELS):
        keys = LEVELS[:i + 1]
        groups = hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        groups = groups.withColumn("prior", F.lit(overall)) if prior is None else groups.join(prior.select(*keys[:-1], F.col("mean").alias("prior")), keys[:-1])
        groups = stage(groups, level)
        k = _concentration(groups)
        mean = (F.col("bad") + F.lit(k) * F.col("prior")) / (F.col("n") + k)
        bound = F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + k + 1))
        prior = out[level] = stage(groups.withColumn("mean", mean).select(level, *[c for c in keys if c != level], "mean", bound.alias("bound")), level)
    return out, overall


def judge(pages: DataFrame, rules: dict[str, str], outcomes: DataFrame, threshold: float = 0.5, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, bad_bound for each row of ``pages``.

    ``rules``: rule (``host/path prefix``) to ``allow`` or ``block``; an argument of the job, not a table. ``outcomes``: (host, bad).
    """
    host, path = host_and_path(F.col(url))
    p = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    p = p.withColumns({"suffix": _tail(F.col("host"), F.lit(1)), "domain": _tail(F.col("host"), F.lit(2))}).withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    levels, _ = reputation(outcomes_by_host(outcomes))
    for level in LEVELS:
        p = p.join(levels[level].select(level, F.col("bound").alias(f"_b_{level}")), level, "left")
    bound = F.coalesce(F.col("_b_host"), F.col("_b_domain"), F.col("_b_suffix"), F.lit(0.0))
    verdict = F.lit(None)
    for r, v in rules.items():
        verdict = F.when(F.col("rule") == r, v).otherwise(verdict)
    verdict = F.when(F.col("rule").isNull(), F.when(bound > threshold, "block").otherwise("allow")).otherwise(verdict)
    return p.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.round(bound, 9).alias("bad_bound"))
