"""URL filters: lists of allowed and blocked sites, and the reputation of hosts, shrunk from host to registered domain to suffix. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastervec.llm.common import ident, stored

#: Prior observations that a level's spread of rates may stand for.
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0
#: Bad rate that one observation before all others stands for.
FIRST_RATE = 0.05


def host_of(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z in lower case; empty for null and for what has no ://."""
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    host = F.when(F.locate("://", url) > 0, F.regexp_extract(rest, r"^[^/?#]*", 0))
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    return F.coalesce(F.when(F.locate("://", url) > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """(size, rule, verdict) of the longest of ``rules`` (verdict, host and path in one text) that fits, ties by the greatest text; null for none. The list is a parameter and goes into the plan: some thousands at most."""
    if not rules:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    split = [(verdict, rule, *rule.partition("/")) for verdict, rule in rules]
    listed = F.array(*(F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"), F.lit("." + at).alias("at"), F.lit(slash + rest).alias("start")) for verdict, rule, at, slash, rest in split))
    fits = F.filter(listed, lambda r: F.endswith(F.concat(F.lit("."), host), r["at"]) & F.startswith(path, r["start"]))
    return F.array_max(F.transform(fits, lambda r: F.struct(r["size"].alias("size"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))


def junk(html: Column, *, least_words: int = 20) -> Column:
    """1 if a page's text has under ``least_words`` words or over 5% symbols, 0 if not, null for no page: an outcome for pages that nobody labelled."""
    text = F.regexp_replace(F.regexp_replace(html, r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>", " "), r"&[A-Za-z0-9#]+;", "&")
    symbols = F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    return F.when(html.isNotNull(), ((words < least_words) | (20 * symbols > F.length(text))).cast("int"))


def _strength(children: DataFrame) -> DataFrame:
    """One row: s, the observations that a level's prior counts as, from the spread of its rates about the means ``m`` of their parents (method of moments for the beta-binomial)."""
    children = children.where("n > 0")
    each = F.col("n") * F.col("m") * (1 - F.col("m"))
    spread = F.sum(F.pow(F.col("k") - F.col("n") * F.col("m"), 2.0)) - F.sum(each)
    rho = spread / F.nullif(F.sum(each * (F.col("n") - 1)), F.lit(0.0))
    low, high = 1 / (MOST_STRENGTH + 1), 1 / (LEAST_STRENGTH + 1)
    return children.agg((1 / F.least(F.greatest(F.coalesce(rho, F.lit(low)), F.lit(low)), F.lit(high)) - 1).alias("s"))


def reputation(pages: DataFrame, outcome: Column, *, url: str = "url", z: float = 1.645) -> DataFrame:
    """(host, domain, suffix, n, k, mean, low, high): pages with an outcome, bad ones (1), the posterior mean of a host's bad rate and its bounds.

    The root's rate is that of all pages and of one more, of FIRST_RATE. A suffix's prior is a beta distribution about the root's mean, a domain's about its suffix's posterior mean, a host's about its domain's; how many observations a prior
    counts as follows from the spread on its level. The bounds are ``z`` standard deviations of the beta posterior. Hosts without outcomes (null) have their prior.
    A domain is the last two labels without a port, the suffix the last. Pages are summed by host before anything else, so a host with a third of all pages is a row a task. An empty table gives none."""
    hosts = pages.select(host_of(ident(url)).alias("host"), outcome.cast("long").alias("y")).groupBy("host").agg(F.count("y").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("k"))
    labels = F.split(F.regexp_replace("host", ":[0-9]*$", ""), r"\.")
    domain = F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), 2), ".")
    hosts = stored(hosts.select("host", domain.alias("domain"), F.element_at(labels, -1).alias("suffix"), "n", "k"), "hosts")
    sums = (F.sum("n").alias("n"), F.sum("k").alias("k"))
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    root = suffixes.agg(((F.coalesce(F.sum("k"), F.lit(0)) + FIRST_RATE) / (F.coalesce(F.sum("n"), F.lit(0)) + 1)).alias("m"))

    def shrunk(children: DataFrame) -> DataFrame:
        """Adds a and b, the posterior, to children with their parent's mean ``m``; one row is broadcast."""
        with_s = children.join(F.broadcast(_strength(children)))
        return with_s.withColumns({"a": F.col("k") + F.col("s") * F.col("m"), "b": F.col("n") - F.col("k") + F.col("s") * (1 - F.col("m"))}).drop("m", "s")

    mean = F.col("a") / (F.col("a") + F.col("b"))
    by_suffix = shrunk(suffixes.join(F.broadcast(root))).select("suffix", mean.alias("m"))
    by_domain = shrunk(domains.join(by_suffix, "suffix")).select("domain", "suffix", mean.alias("m"))
    out = shrunk(hosts.join(by_domain, ["domain", "suffix"])).withColumn("mean", mean)
    width = z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("a") + F.col("b") + 1))
    return out.select("host", "domain", "suffix", "n", "k", F.round("mean", 9).alias("mean"), F.round(F.col("mean") - width, 9).alias("low"), F.round(F.col("mean") + width, 9).alias("high"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], outcome: Column, *, page_id: str = "page_id", url: str = "url", most_bad: float = 0.2, z: float = 1.645) -> DataFrame:
    """(page_id, host, path, rule, verdict): the verdict of the longest rule that fits, else block for hosts whose bad rate is over ``most_bad`` by its lower posterior bound, else allow.

    A null url, or one without ://, has an empty host and path, no rule, and the reputation of the empty host. Repeated rows give a row each, other columns are not read, an empty table gives none.
    Urls of any length are cut by one expression. Blocked hosts are joined by host: a host of a third of all pages is split by the join (adaptive execution)."""
    host, path = host_of(ident(url)), path_of(ident(url))
    rows = pages.select(ident(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules))
    blocked = reputation(pages, outcome, url=url, z=z).where(F.col("low") > most_bad).select("host", F.lit("block").alias("_verdict"))
    rows = rows.join(blocked, "host", "left")
    return rows.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), "_verdict", F.lit("allow")).alias("verdict"))
