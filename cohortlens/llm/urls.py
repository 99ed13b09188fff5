"""URL filter by host reputation.

Labelled page outcomes (good or bad) are counted for each host; hosts roll up to registered domains, domains to
suffixes, suffixes to one root. At each level a beta-binomial prior centred on the parent's posterior mean shrinks
the counts; its strength is fitted by the method of moments over the children of that level. A page is blocked if
the lower bound of its host's posterior badness is above a limit, which follows the share of bad pages overall. Rules
over host and path come first.

Outcomes are counted once per host in one aggregation; the reputation of hosts joins back to pages by host. Where no
labels are given, outcomes are measured on the pages themselves (:func:`page_outcomes`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cohortlens.runtime import Scratch

#: Rule, verdict. The part before the first slash is the host, the rest with its slash the path.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Suffixes of two labels; all others have one.
DOUBLE_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "com.br", "co.nz", "co.in", "co.za", "com.cn", "com.mx")
#: A host is blocked if it is bad, but for the uncertainty, so many times as often as all pages are, or more often than not.
TIMES_USUAL, MOST_OFTEN = 3.0, 0.5
#: A page is bad if fewer than so many visible words are left, the text is a smaller share of the markup, there are more
#: links for a word, more of the text are signs (neither letters, digits, blanks nor common punctuation), or the same
#: visible text stands on so many pages.
LEAST_WORDS, LEAST_SHARE, MOST_LINKS, MOST_SIGNS, MOST_PAGES = 20, 0.05, 0.5, 0.1, 5


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(path, F.lit(""))


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        name, _, tail = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{tail}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def domain_of(host: Column, double_suffixes: Sequence[str] = DOUBLE_SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and suffix of a host; a host without a dot is both."""
    two = F.substring_index(host, ".", -2)
    suffix = F.when(two.isin(*double_suffixes), two).otherwise(F.substring_index(host, ".", -1))
    domain = F.when(two.isin(*double_suffixes), F.substring_index(host, ".", -3)).otherwise(two)
    return domain, suffix


def _strength(children: DataFrame, mean: Column) -> Column:
    """Aggregate: prior strength by the method of moments of children's rates around their parent's mean.

    With n trials and rate x, E[(x - m)^2] = m (1 - m) (1 + (n - 1) / (s + 1)) / n; solved for s over all children.
    """
    n = F.col("n").cast("double")
    spread = F.sum(n * F.pow(F.col("bad") / n - mean, F.lit(2)) - mean * (1 - mean))
    share = F.sum((n - 1) * mean * (1 - mean))
    rho = F.when((share > 0) & (spread > 0), F.least(spread / share, F.lit(0.999))).otherwise(F.lit(0.001))
    return F.least(F.greatest(1 / F.greatest(rho, F.lit(0.001)) - 1, F.lit(1.0)), F.lit(1000.0))


def host_reputation(outcomes: DataFrame, host_col: str = "host", bad_col: str = "bad", z: float = 2.0, double_suffixes: Sequence[str] = DOUBLE_SUFFIXES) -> DataFrame:
    """(host, n, bad, posterior, lower): shrunk badness of each host and its lower bound.

    ``bad_col`` is 1 or 0; rows with a null outcome give their host a place without counting. The bound is ``z``
    posterior standard deviations below the mean. An empty or null host is one host of its own.
    """
    scratch = Scratch(outcomes.sparkSession, "hosts")
    host = F.coalesce(F.col(host_col), F.lit(""))
    domain, suffix = domain_of(F.col("host"), double_suffixes)
    hosts = outcomes.groupBy(host.alias("host")).agg(F.count(bad_col).alias("n"), F.coalesce(F.sum(bad_col), F.lit(0)).cast("long").alias("bad"))
    hosts = scratch.keep(hosts.select("*", domain.alias("domain"), suffix.alias("suffix")), "hosts")
    root = hosts.agg(((F.sum("bad") + 1) / (F.sum("n") + 2)).alias("m")).first()["m"] or 0.5
    level = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    strength = level.where("n > 0").agg(_strength(level, F.lit(root)).alias("s")).first()["s"] or 1.0
    suffixes = level.select("suffix", ((F.col("bad") + root * strength) / (F.col("n") + strength)).alias("up"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).join(suffixes, "suffix")
    domains = scratch.keep(domains, "domains")
    strength = domains.where("n > 0").agg(_strength(domains, F.col("up")).alias("s")).first()["s"] or 1.0
    domains = domains.select("domain", ((F.col("bad") + F.col("up") * strength) / (F.col("n") + strength)).alias("up"))
    leaves = scratch.keep(hosts.join(domains, "domain"), "leaves")
    strength = leaves.where("n > 0").agg(_strength(leaves, F.col("up")).alias("s")).first()["s"] or 1.0
    a, total = F.col("bad") + F.col("up") * strength, F.col("n") + strength
    mean = a / total
    sd = F.sqrt(mean * (1 - mean) / (total + 1))
    return leaves.select("host", "n", "bad", mean.alias("posterior"), F.greatest(mean - z * sd, F.lit(0.0)).alias("lower"))


def page_outcomes(pages: DataFrame, scratch: Scratch, html_col: str = "html") -> DataFrame:
    """Adds ``bad``: 1 or 0 by what is measured on a page, null where there is no html.

    It stands in for human labels, which no table has. Measured are visible words, the share of visible text in the
    markup, links for a word, the share of signs, and on how many pages the same visible text stands.
    """
    html = F.col(html_col)
    visible = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(html, r"(?s)<(script|style)[^>]*>.*?</\1>", " "), r"<[^>]*>", " "), r"\s+", " "))
    rows = pages.withColumn("__text", visible)
    words = F.when(F.col("__text") == "", 0).otherwise(F.size(F.split("__text", " ")))
    links = F.size(F.split(F.lower(html), "<a ")) - 1
    signs = F.length(F.regexp_replace("__text", r"""[\p{L}\p{N}\s.,;:!?'"()-]+""", ""))
    thin = (words < LEAST_WORDS) | (F.length("__text") < LEAST_SHARE * F.length(html)) | (links > MOST_LINKS * words) | (signs > MOST_SIGNS * F.length("__text"))
    rows = scratch.keep(rows.select("*", F.xxhash64("__text").alias("__body"), thin.alias("__thin")).drop("__text", html_col), "pages")
    often = scratch.keep(rows.where("__thin is not null").groupBy("__body").count().where(F.col("count") >= MOST_PAGES).select("__body", F.lit(True).alias("__often")), "often")
    bad = (F.col("__thin") | F.coalesce("__often", F.lit(False))).cast("int")
    return rows.join(often, "__body", "left").withColumn("bad", bad).drop("__body", "__thin", "__often")


def judge_urls(pages: DataFrame, limit: float | None = None, rules=RULES, id_col: str = "page_id", url_col: str = "url", outcome: Column | None = None, double_suffixes: Sequence[str] = DOUBLE_SUFFIXES) -> DataFrame:
    """(id_col, host, path, rule, verdict, posterior, lower) for every page.

    The longest rule that fits decides; else a page is blocked if its host's lower bound of badness is above
    ``limit``, by default TIMES_USUAL times the share of bad pages overall, but MOST_OFTEN at most. ``outcome`` gives a page's label (1 bad, 0 good, null unknown); without it labels are measured. A null
    URL, or one without ``://``, has an empty host and path and is judged as the host ''. Rows that repeat an id are
    pages of their own; other columns are ignored. An empty table gives an empty one.
    """
    host, path = url_parts(F.col(url_col))
    scratch = Scratch(pages.sparkSession, "urls")
    named = [F.col(id_col), host.alias("host"), path.alias("path")]
    if outcome is None:
        seen = page_outcomes(pages.select(*named, F.col("html").alias("__html")), scratch, "__html")
    else:
        seen = pages.select(*named, outcome.cast("int").alias("bad"))
    seen = scratch.keep(seen, "seen")
    judged = scratch.keep(host_reputation(seen, double_suffixes=double_suffixes), "judged")
    if limit is None:
        usual = judged.agg(((F.sum("bad") + 1) / (F.sum("n") + 2)).alias("m")).first()["m"] or 0.5
        limit = min(MOST_OFTEN, TIMES_USUAL * usual)
    judged = judged.select("host", "posterior", "lower")
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("lower") > limit, F.lit("block")).otherwise(F.lit("allow"))
    return seen.join(judged, "host").select(id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "posterior", "lower")


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
