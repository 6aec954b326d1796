"""URL filter: host and path rules, carried to aliases along redirects and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.graph import components
from tracewell.session import staged

ALLOW, BLOCK = "allow", "block"
# Rule (host, path prefix) and verdict.
RULES = (("net/", BLOCK), ("example.net/en/", ALLOW), ("example.com/de/", BLOCK), ("org/fr/", ALLOW))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINKS = (
    r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)""",
    r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["']?[^"'>]*\burl\s*=\s*["']?([^"'\s>]+)""",
    r"""(?is)<meta\b(?=[^>]*\bproperty\s*=\s*["']?og:url\b)[^>]*\bcontent\s*=\s*["']?([^"'\s>]+)""",
)


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def locator(url: Column) -> Column:
    """What names a page: the URL without its fragment, scheme and host in lower case, a slash for no path; null for no URL."""
    scheme = F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))
    path = path_of(url)
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    return F.when(
        url.contains("://"), F.concat(scheme, F.lit("://"), host_of(url), F.when(path == "", F.lit("/")).otherwise(path), query)
    )


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...], part: int) -> Column:
    """The longest rule that fits (part 0) or its verdict (part 1), else null."""
    chosen = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = rule[0].partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        chosen = F.when(fits, F.lit(rule[part])).otherwise(chosen)
    return chosen


def _without_dots(path: Column) -> Column:
    """A path without ``.`` and ``..`` steps; one that ends in a step names the folder."""
    steps = F.split(F.regexp_replace(path, r"/(\.\.?)$", "/$1/"), "/", -1)
    walked = F.aggregate(
        F.slice(steps, 2, F.greatest(F.size(steps) - 1, F.lit(0))), F.array().cast("array<string>"),
        lambda done, step: F.when(step == ".", done)
        .when(step == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(step))),
    )
    return F.concat(F.lit("/"), F.array_join(walked, "/"))


def _absolute(link: Column, url: Column) -> Column:
    """A link of the page at ``url`` as a whole URL; null for a mere fragment, another scheme or a page without URL."""
    link = F.regexp_replace(F.regexp_replace(link, r"&(?:quot|apos|#0*3[49]);", ""), "&amp;", "&")
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    site = F.concat(scheme, F.lit("://"), host_of(url))
    folder = F.regexp_extract(path_of(url), r"(?s)^(.*/)", 1)
    target, rest = F.regexp_extract(link, r"(?s)^([^?#]*)", 1), F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)
    whole = F.when(link.startswith("/"), target).otherwise(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), target))
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:|#)") | (link == "") | ~url.contains("://"), F.lit(None))
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("?"), F.concat(site, path_of(url), link))
        .otherwise(F.concat(site, _without_dots(whole), rest))
    )


def judged(
    pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, redirects: DataFrame | None = None,
    id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, alias_of (root of the page's alias group or null).

    A rule fits its host and all subdomains where the path starts with the rule's; the longest wins and decides.
    Other pages take the verdict of their alias group: URLs, without fragments, connected by canonical links, refresh and
    og:url entries of the html and by ``redirects`` (from_url, to_url), and by nothing else. A group with an explicit allow is allowed, else one
    with a block is blocked; a page of neither is allowed. ``rules`` are an argument and short; groups are found
    by a distributed union-find.

    Defined cases: a null url or one without ``://`` has empty host and path, no rule and no alias; null html has
    no links; all links of a page count, relative ones from its url; mere fragments and other schemes are none. Repeated rows give repeated results, null ids are
    carried along. Other columns are ignored, whatever their names. Empty in, empty out.
    """
    url, html = F.col("url"), F.col("html")
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    every = F.concat(*[F.coalesce(F.regexp_extract_all(html, F.lit(link), F.lit(1)), F.array().cast("array<string>")) for link in _LINKS])
    known = staged(
        source.select(
            "page_id", "url", F.array_distinct(F.array_compact(F.transform(every, lambda link: _absolute(link, url)))).alias("links")
        ), "url-links"
    )
    judge = known.select(
        "page_id", host_of(url).alias("host"), path_of(url).alias("path"), locator(url).alias("locator")
    )
    judge = judge.select(
        "*", rule_for(F.col("host"), F.col("path"), rules, 0).alias("rule"),
        rule_for(F.col("host"), F.col("path"), rules, 1).alias("ruled"),
    )
    hops = known.select("url", F.explode("links").alias("to"))
    if redirects is not None:
        hops = hops.unionByName(redirects.select(F.col("from_url").alias("url"), F.col("to_url").alias("to")))
    hops = staged(hops, "url-hops")
    groups = components(hops.select(locator(url).alias("a"), locator(F.col("to")).alias("b")), "a", "b")
    ends = hops.select("url").unionByName(hops.select(F.col("to").alias("url"))).distinct().select(
        locator(url).alias("vertex"), rule_for(host_of(url), path_of(url), rules, 1).alias("ruled")
    ).where("vertex IS NOT NULL AND ruled IS NOT NULL").distinct()
    flags = groups.join(ends, "vertex").groupBy("root").agg(
        F.max((F.col("ruled") == ALLOW).cast("int")).alias("allowed"), F.max((F.col("ruled") == BLOCK).cast("int")).alias("blocked")
    )
    carried = groups.join(flags, "root", "left").select(
        F.col("vertex").alias("locator"), F.col("root").alias("alias_of"),
        F.when(F.col("allowed") == 1, ALLOW).when(F.col("blocked") == 1, BLOCK).alias("carried"),
    )
    # A page without URL has a key of its own that no group has, so such pages do not meet in one task.
    judge = judge.withColumn("locator", F.coalesce("locator", F.concat(F.lit("#"), F.xxhash64("page_id", "host").cast("string"))))
    return judge.join(carried, "locator", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", "carried", F.lit(ALLOW)).alias("verdict"), "alias_of"
    )
