"""URL filters: allow and block rules by host and path, and their decisions carried over to aliases.

Pages that redirect to each other, or name one canonical address, are one page. Each written url, its normal form
(what sites redirect the common variants to), the target that the page's HTML declares and the rows of a redirect log
are nodes of a graph; connected components over it are the classes of aliases. A page that no rule fits takes the
decision of its class: allowed if any rule allows a member, blocked if none does and one blocks a member. Built-in
expressions only, so nothing leaves the JVM; HTML is read in the scan's own stage and never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorale.llm.common import stored
from chorale.llm.components import components

#: (host, beginning of the path, decision)
Rule = tuple[str, str, str]
#: So many rules are compared inside the scan; give longer lists as a table, which is joined by host.
INLINE_RULES = 200
#: Query parameters that name where a visitor came from and don't choose a page.
TRACKING = r"^(utm_[^=]*|gclid|fbclid|msclkid|mc_cid|mc_eid|ref)(=|$)"
CANONICAL = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH_URL = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without :// or for null."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def normal_form(url: Column) -> Column:
    """host/path?query of an address as sites redirect its variants to: no scheme, usual port, www. or m., index page, .html, closing slash,
    fragment or tracking parameter, and parameters in order; null without a host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), ":(80|443)$", ""), r"^(?:www|m)\.([^.]+\..+)$", "$1")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"(/index)?\.html?$", ""), "/+$", "")
    asked = F.split(F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1), "&")
    kept = F.array_join(F.array_sort(F.filter(asked, lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.when(host != "", F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def declared(html: Column, url: Column) -> Column:
    """Where the page says that it stands or sends its readers: its canonical link, else its refresh; made absolute by the url, dot segments
    as written; null if it names nothing on the web."""
    said = F.coalesce(F.nullif(F.regexp_extract(F.regexp_extract(html, CANONICAL, 0), HREF, 1), F.lit("")), F.nullif(F.regexp_extract(F.regexp_extract(html, REFRESH, 0), REFRESH_URL, 1), F.lit("")))
    site, scheme = F.concat(F.substring_index(url, "://", 1), F.lit("://"), host_of(url)), F.concat(F.substring_index(url, "://", 1), F.lit(":"))
    folder = F.regexp_extract(path_of(url), "(?s)^.*/", 0)
    return (
        F.when(said.rlike("(?i)^https?://"), said).when(said.rlike("(?i)^[a-z][a-z0-9+.-]*:") | said.startswith("#") | (F.instr(url, "://") == 0), F.lit(None))
        .when(said.startswith("//"), F.concat(scheme, said)).when(said.startswith("/"), F.concat(site, said))
        .when(said.startswith("?"), F.concat(site, path_of(url), said)).otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), said))
    )


def matched(urls: DataFrame, rules: Sequence[Rule] | DataFrame) -> DataFrame:
    """urls (with host and path) and the longest rule that fits: rule, decision; null without one.

    A rule fits its host and all subdomains, if the path starts with the rule's. Of fitting rules of one length that with the longer
    host wins, then the greater text. A table of rules (host, path, decision) of any size is joined with the hosts' suffixes.
    """
    if isinstance(rules, DataFrame):
        return _joined(urls, rules)
    if len(rules) > INLINE_RULES:
        return _joined(urls, urls.sparkSession.createDataFrame(list(rules), "host string, path string, decision string"))
    fits = [
        F.when(((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path), F.struct(F.lit(len(host + path)), F.lit(len(host)), F.lit(host + path).alias("rule"), F.lit(decision).alias("decision")))
        for host, path, decision in rules
    ]
    if not fits:
        return urls.withColumns({"rule": F.lit(None).cast("string"), "decision": F.lit(None).cast("string")})
    best = F.array_max(F.array(*fits))
    return urls.withColumn("__best", best).select(*urls.columns, "__best.rule", "__best.decision")


def _joined(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Hosts and paths meet the rules once each, whatever the number of pages that have them."""
    asked = urls.select("host", "path").distinct()
    parts = F.split("host", r"\.")
    suffixes = asked.withColumn("__suffix", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))))
    own = rules.select(F.col("host").alias("__host"), F.col("path").alias("__path"), F.col("decision").alias("__decision"))
    best = F.max(F.struct(F.length(F.concat("__host", "__path")), F.length("__host"), F.concat("__host", "__path").alias("rule"), F.col("__decision").alias("decision")))
    found = suffixes.join(own, (F.col("__suffix") == F.col("__host")) & F.col("path").startswith(F.col("__path"))).groupBy("host", "path").agg(best.alias("__best"))
    return urls.join(found, ["host", "path"], "left").select(*urls.columns, "__best.rule", "__best.decision")


def verdicts(pages: DataFrame, rules: Sequence[Rule] | DataFrame, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict, reason) of every row; reason: rule, alias or default.

    The rule that fits decides. Otherwise the page's aliases do: allow if a rule allows any of them, else block if a rule blocks any.
    A page that neither decides is allowed. redirects (source, target): a log of redirections, of addresses that needn't be pages; targets
    are judged like pages. A null url, or one without ://, has an empty host and path, no rule and no aliases. Rows that
    repeat an id or an address are answered each; null and empty HTML declares nothing.
    """
    own = pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    read = own.select("page_id", "url", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.coalesce(path_of(F.col("url")), F.lit("")).alias("path"), declared(F.col("html"), F.col("url")).alias("target"))
    known = stored(matched(read, rules), "urls")
    links = known.select(F.col("url").alias("source"), "target").where("target IS NOT NULL")
    if redirects is not None:
        links = links.unionByName(redirects.select(F.col("source").cast("string"), F.col("target").cast("string")).where("source IS NOT NULL AND target IS NOT NULL"))
    others = links.select("target") if redirects is None else links.select("target").unionByName(links.select(F.col("source").alias("target")))
    others = matched(others.distinct().select(F.col("target").alias("url"), host_of(F.col("target")).alias("host"), path_of(F.col("target")).alias("path")), rules)
    named = known.select("url", "decision").unionByName(others.select("url", "decision")).withColumn("node", _node(normal_form(F.col("url")))).where("node IS NOT NULL")
    written = named.select(_node(F.regexp_extract(_rest(F.col("url")), "^[^#]*", 0)).alias("a"), F.col("node").alias("b"))
    edges = written.unionByName(links.select(_node(normal_form(F.col("source"))).alias("a"), _node(normal_form(F.col("target"))).alias("b"))).where("a != b")
    classes = stored(components(edges), "aliases")
    judged = named.where("decision IS NOT NULL").groupBy("node").agg(F.max(F.col("decision") == "allow").alias("allowed"))
    judged = judged.join(classes, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.max("allowed").alias("allowed"))
    placed = known.withColumn("node", F.when(F.col("rule").isNull(), _node(normal_form(F.col("url")))))
    open_ = placed.where("node IS NOT NULL")  # the others have no class to ask, and would all meet under the null key
    carried = open_.select("node").distinct().join(classes, "node", "left").withColumn("component", F.coalesce("component", "node")).join(judged, "component").select("node", "allowed")
    spread = open_.join(carried, "node", "left").unionByName(placed.where("node IS NULL").withColumn("allowed", F.lit(None).cast("boolean")))
    by_alias = F.when(F.col("allowed"), "allow").when(~F.col("allowed"), "block")
    return spread.select(
        "page_id", "host", "path", "rule", F.coalesce("decision", by_alias, F.lit("allow")).alias("verdict"),
        F.when(F.col("rule").isNotNull(), "rule").when(F.col("allowed").isNotNull(), "alias").otherwise("default").alias("reason"),
    )


def _node(address: Column) -> Column:
    """16 bytes of the address's SHA-256."""
    return F.substring(F.unhex(F.sha2(address, 256)), 1, 16)
