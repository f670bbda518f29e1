"""URL filters: rules by host and path, and block decisions carried to aliases over redirects and canonical links."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import BROADCAST_ROWS, ascii_lower, cut
from folioforge.llm.near_dup import link_components


@dataclass(frozen=True)
class Rule:
    """host: it and its subdomains; path: what the path starts with; allows or else blocks."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


#: So many rules are tried as expressions of a scan; more are joined.
EXPRESSION_RULES = 200

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; '' without one."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, _URL, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def address(url: Column) -> Column:
    """What the addresses share that a server commonly redirects to one another: without scheme, leading www., default
    port, fragment, closing slash, index file or tracking parameters. Null where there is no ://."""
    host = F.regexp_replace(host_of(url), r"(?::(?:80|443))?\z", "")
    host = F.regexp_replace(host, r"\Awww\.(?=[^.]+\.)", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"/index\.(?:html?|php)\z", "/"), r"/+\z", "")
    kept = F.filter(F.split(F.regexp_extract(url, _URL, 3), "&"), lambda p: (p != "") & ~p.rlike("^(?:utm_[a-z]+|gclid|fbclid)="))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(F.contains(url, F.lit("://")), F.concat(host, path, query))


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, in either quotes or none."""
    found = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.trim(F.replace(F.concat(*[F.regexp_extract(tag, found, k) for k in (1, 2, 3)]), F.lit("&amp;"), F.lit("&")))


def link_targets(html: Column) -> Column:
    """array<string>: where canonical links and refreshing meta tags of a page point to, as written; comments and scripts don't count."""
    shown = F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script>", " ")
    tags = F.when(html.rlike("(?i)canonical|refresh"), F.regexp_extract_all(shown, F.lit(r"(?is)<(?:link|meta)\s[^>]*>"), F.lit(0)))

    def target(tag: Column) -> Column:
        rel = F.split(F.lower(_attribute(tag, "rel")), r"\s+")
        refresh = F.regexp_extract(_attribute(tag, "content"), r"""(?is)^\s*[0-9.]+\s*[;,]\s*(?:url\s*=\s*)?["']?(.*?)["']?\s*$""", 1)
        canonical = tag.rlike(r"(?i)^<link\s") & F.array_contains(rel, "canonical")
        return F.when(canonical, _attribute(tag, "href")).when(tag.rlike(r"(?i)^<meta\s") & (F.lower(_attribute(tag, "http-equiv")) == "refresh"), refresh)

    return F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), target), lambda x: x.isNotNull() & (x != ""))


def resolved(base: Column, target: Column) -> Column:
    """The target of a link on the page ``base``, in full; null for none on the web (mailto: and the like)."""
    origin = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*", 0)
    folder = F.concat(F.regexp_replace(path_of(base), r"[^/]*\z", ""))
    return (
        F.when(target.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(F.regexp_extract(base, r"(?s)^(.*?:)//", 1), target))
        .when(target.startswith("#") | target.rlike("(?i)^[a-z][a-z0-9+.-]*:"), F.lit(None))
        .when(target.startswith("/"), F.concat(origin, target))
        .when(target.startswith("?"), F.concat(origin, path_of(base), target))
        .otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), F.regexp_replace(target, r"\A(?:\./)+", "")))
    )


def _in_order(rules: Sequence[Rule]) -> list[Rule]:
    """The longest first; of equals what allows, then by text."""
    return sorted(set(rules), key=lambda r: (-len(r.name), r.verdict != "allow", r.name))


def _ruled(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``rows`` (host, path, ...) with rule and own, its verdict; null where no rule fits."""
    ordered = _in_order(rules)
    if len(ordered) <= EXPRESSION_RULES:
        fits = lambda r: ((F.col("host") == r.host) | F.col("host").endswith(f".{r.host}")) & F.col("path").startswith(r.path)
        first = F.coalesce(*[F.when(fits(r), F.lit(i)) for i, r in enumerate(ordered)], F.lit(None).cast("int"))
        pick = lambda values: F.get(F.array(*map(F.lit, values)).cast("array<string>"), F.col("_at"))
        return rows.withColumn("_at", first).withColumns({"rule": pick([r.name for r in ordered]), "own": pick([r.verdict for r in ordered])}).drop("_at")
    # by equality: each ending of a host with each beginning of a path that has the length of some rule's
    spark = rows.sparkSession
    table = F.broadcast(spark.createDataFrame([(i, r.host, r.path, r.name, r.verdict) for i, r in enumerate(ordered)], "i int, h string, p string, rule string, own string")) if len(ordered) <= BROADCAST_ROWS else spark.createDataFrame([(i, r.host, r.path, r.name, r.verdict) for i, r in enumerate(ordered)], "i int, h string, p string, rule string, own string")
    lengths = F.array(*map(F.lit, sorted({len(r.path) for r in ordered})))
    labels = F.split("host", r"\.")
    keys = rows.select("host", "path").distinct()
    keys = keys.withColumn("h", F.explode(F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))))
    keys = keys.withColumn("p", F.explode(F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substr("path", F.lit(1), n))))
    best = keys.join(table, ["h", "p"]).groupBy("host", "path").agg(F.min(F.struct("i", "rule", "own")).alias("b")).select("host", "path", "b.rule", "b.own")
    return rows.join(cut(best), ["host", "path"], "left")


def filter_urls(pages: DataFrame, rules: Sequence[Rule], redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """page_id, url, host, path, rule (host and path of the one that decides, or null), verdict (allow or block), via (rule, alias or default):
    a row for each row of ``pages``.

    A rule fits its host and all its subdomains where the path starts with the rule's; the longest decides, of equals
    one that allows. Where none fits, the page takes the block decision of any alias: addresses are aliases that are equal
    by ``address``, or that redirects (``redirects``: from_url, to_url), canonical links or refreshing meta tags connect over any
    number of steps and in either direction, fetched or not. A page with an allowing rule stays allowed whatever its aliases are;
    it doesn't clear them. What no rule or alias blocks is allowed.

    A url that is null or has no :// has host and path '' and no alias, and only a rule of an empty host could fit it. Null html has no links.
    Rows that repeat an id or url are judged each, alike. Columns of other names are ignored; an empty table gives an empty result.

    Pages are scanned once for their links and once for their own verdicts. Only links between different addresses
    enter the components, as 128-bit hashes; those spread by minima per node, so a target that a third of all pages name costs a row a
    task. Blocked addresses are broadcast while few, beyond that joined by a shuffle that AQE can split at a hot address."""
    spark, url = pages.sparkSession, F.col("url")
    node = lambda c: F.md5(address(c))
    base = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"))
    judged = _ruled(base.withColumns({"host": host_of(url), "path": path_of(url), "node": node(url)}), rules)

    pairs = []
    if html_col is not None and html_col in pages.columns:
        linked = pages.select(F.col(f"`{url_col}`").cast("string").alias("from_url"), F.explode(link_targets(F.col(f"`{html_col}`").cast("string"))).alias("t"))
        pairs.append(linked.select("from_url", resolved(F.col("from_url"), F.col("t")).alias("to_url")))
    if redirects is not None:
        pairs.append(redirects.select(F.col("from_url").cast("string"), F.col("to_url").cast("string")))
    blocked = judged.where("own = 'block'").select("node")
    tainted = blocked
    if pairs:
        links = pairs[0]
        for more in pairs[1:]:
            links = links.unionByName(more)
        links = links.withColumns({"a": node(F.col("from_url")), "b": node(F.col("to_url"))}).where("a <> b").distinct()
        links = cut(links)
        ends = links.select(F.col("from_url").alias("url"), F.col("a").alias("node")).unionByName(links.select(F.col("to_url").alias("url"), F.col("b").alias("node")))
        ends = _ruled(ends.withColumns({"host": host_of(url), "path": path_of(url)}), rules)
        blocked = blocked.unionByName(ends.where("own = 'block'").select("node"))
        labels = link_components(links.select("a", "b"))
        bad = cut(blocked.distinct())
        lost = labels.join(bad, "node").select("component").distinct()
        tainted = bad.unionByName(labels.join(lost, "component").select("node"))
    tainted = cut(tainted.distinct()).select(F.col("node").alias("_node"))
    small = F.broadcast(tainted) if tainted.count() <= BROADCAST_ROWS else tainted
    out = judged.join(small, (F.col("node") == F.col("_node")) & F.col("own").isNull(), "left")
    alias = F.when(F.col("_node").isNotNull(), "block")
    via = F.when(F.col("own").isNotNull(), "rule").when(alias.isNotNull(), "alias").otherwise("default")
    return out.select("page_id", "url", "host", "path", "rule", F.coalesce("own", alias, F.lit("allow")).alias("verdict"), via.alias("via"))
