"""URL filters: block and allow rules on host suffixes and path prefixes, carried over redirect and canonical-link edges.

A page that a rule fits takes the rule's verdict: the longest rule wins, and an allow rule wins over a block rule of the
same length. Pages are aliases of each other if redirects (http-equiv refresh) or canonical links join them, over any
number of edges; a page that no rule fits is blocked if one of its aliases is, and else allowed. An explicit allow is
never overturned, and a blocked alias is not cleared by an allowed one. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bind, materialise
from tessera.llm.components import components

Rule = tuple[str, str, str]  # host, path, verdict


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def address_key(url: Column) -> Column:
    """What equal addresses share: scheme and host in lower case, without the scheme's usual port, no #fragment, / for an empty path. Others stay as they are."""
    part = lambda k: F.regexp_extract(url, r"(?s)^([^:/?#]+)://([^/?#]*)([^?#]*)(\?[^#]*)?", k)
    lower = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    host = F.when(lower(part(1)) == "http", F.regexp_replace(lower(part(2)), ":80$", "")).when(lower(part(1)) == "https", F.regexp_replace(lower(part(2)), ":443$", "")).otherwise(lower(part(2)))
    whole = F.concat(lower(part(1)), F.lit("://"), host, F.when(part(3) == "", F.lit("/")).otherwise(part(3)), part(4))
    return F.when(part(1) == "", url).otherwise(whole)


def _without_dots(path: Column) -> Column:
    """An absolute path without its . and .. segments, as RFC 3986 (5.2.4) removes them."""
    parts = F.split(F.substr(path, F.lit(2)), "/")
    last = F.element_at(parts, -1).isin(".", "..")
    step = lambda kept, x: F.when(x == ".", kept).when(x == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(x)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.concat(F.lit("/"), F.array_join(F.when(last, F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/"))


def resolved(source: Column, target: Column) -> Column:
    """The absolute address that target means on the page source (RFC 3986, 5.2.2); null if it has a scheme without ://."""
    scheme, host, path, query = (F.regexp_extract(source, r"(?s)^([^:/?#]+)://([^/?#]*)([^?#]*)(\?[^#]*)?", k) for k in (1, 2, 3, 4))
    root = F.concat(scheme, F.lit("://"), host)
    tail = F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    own = F.regexp_extract(target, r"(?s)^([^?#]*)", 1)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, r"(?s)^(.*/)", 1))
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(scheme == "", None)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(target.startswith("/"), F.concat(root, _without_dots(own), tail))
        .when(target.startswith("?"), F.concat(root, path, target))
        .when(target.startswith("#"), F.concat(root, path, query, target))
        .otherwise(F.concat(root, _without_dots(F.concat(folder, own)), tail))
    )


def match_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The rule that fits, as a struct of rule and verdict; null if none does.

    The rules are compiled into one expression, longest first, and of equal length allow first.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[2] == "allow", r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


#: A tag with its quoted values, which may hold >, and the attributes in it, one after the other.
_TAG = r"""(?is)(<(?:link|meta|base)(?=[\s/>])(?:[^>"']++|"[^"]*+"|'[^']*+')*+>)"""
_ATTRIBUTE = r"""(?s)([^\s"'<>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*))?)"""
_UNSEEN = r"(?is)<!--.*?(?:-->|\z)|<script(?=[\s/>]).*?(?:</script\s*>|\z)|<style(?=[\s/>]).*?(?:</style\s*>|\z)"


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's first attribute of a name; null if it has none."""
    all_of = F.regexp_extract_all(F.regexp_replace(tag, r"^<\w+|>$", ""), F.lit(_ATTRIBUTE), F.lit(1))
    first = F.get(F.filter(all_of, lambda a: F.lower(F.regexp_extract(a, r"^([^\s=]+)", 1)) == name), F.lit(0))
    value = F.regexp_extract(first, r"(?s)^[^=]*=\s*(.*)$", 1)
    return F.when(value.rlike("^[\"']"), F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value)


def alias_edges(pages: DataFrame) -> DataFrame:
    """source, target: the addresses that a page redirects to or names as canonical, from its html.

    What stands in comments, scripts and styles is no tag. A link counts if canonical is one of its rel's words, a meta
    refresh with or without url=. Targets without a scheme are resolved against the page's base, else its url. Pages
    without a url or such a tag give no edges.
    """
    asked = F.lower(F.col("html")).rlike("canonical|refresh")
    tags = F.regexp_extract_all(F.regexp_replace(F.coalesce(F.col("html"), F.lit("")), _UNSEEN, ""), F.lit(_TAG), F.lit(1))
    page = pages.filter(asked).select(F.col("url").alias("source"), tags.alias("tags"))
    kind = lambda t, name: F.lower(t).rlike(rf"^<{name}[\s/>]")
    plain = lambda x: F.replace(F.trim(x), F.lit("&amp;"), F.lit("&"))
    base = plain(_attribute(F.get(F.filter("tags", lambda t: kind(t, "base") & F.coalesce(_attribute(t, "href") != "", F.lit(False))), F.lit(0)), "href"))
    page = page.select("source", "tags", base.alias("base"))
    page = page.select("source", F.coalesce(resolved(F.col("source"), F.col("base")), "source").alias("base"), F.explode("tags").alias("tag"))
    canonical = F.when(kind(F.col("tag"), "link") & F.array_contains(F.split(F.lower(F.trim(_attribute(F.col("tag"), "rel"))), r"\s+"), "canonical"), _attribute(F.col("tag"), "href"))
    wait = r"""(?is)^\s*[\d.]*\s*(?:[;,]\s*|(?<=\d)\s+)(?:url\s*=\s*)?['"]?([^'"\s]+)"""
    refresh = F.when(kind(F.col("tag"), "meta") & (F.lower(F.trim(_attribute(F.col("tag"), "http-equiv"))) == "refresh"), F.regexp_extract(_attribute(F.col("tag"), "content"), wait, 1))
    target = plain(F.coalesce(canonical, refresh))
    found = page.select("source", "base", target.alias("to")).filter("source is not null and to <> ''")
    return found.select("source", bind(F.struct("base", "to"), lambda x: resolved(x["base"], x["to"])).alias("target")).filter("target is not null and target <> '' and source <> target")


def judge_pages(pages: DataFrame, rules: Sequence[Rule], edges: DataFrame | None = None) -> DataFrame:
    """page_id, url, host, path, rule, verdict for every row of pages.

    edges (source, target) are addresses known to be aliases; without them they are taken from the html. An address
    need not be a page itself: a rule that blocks it blocks its aliases as well. Addresses are compared by address_key. Null and malformed urls have empty host
    and path, fit no rule, and are allowed. Rows that repeat a page_id or url are judged alike; an empty table gives no
    rows; columns besides page_id, url and html are ignored.
    """
    edges = alias_edges(pages) if edges is None else edges
    judged = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = judged.withColumn("hit", match_rule(F.col("host"), F.col("path"), rules))
    links = materialise(edges.select(address_key(F.col("source")).alias("u"), address_key(F.col("target")).alias("v")).filter("u <> v"), "aliases")
    verdict = F.col("hit.verdict")
    if links.isEmpty():
        return judged.select("page_id", "url", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce(verdict, F.lit("allow")).alias("verdict"))
    groups = materialise(components(links), "alias-groups")
    own = match_rule(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"]
    blocked = materialise(groups.withColumn("own", own).filter("own = 'block'").select("root").distinct(), "blocked-groups")
    spread = materialise(groups.join(blocked, "root", "left_semi").select(F.col("node").alias("_key"), F.lit("block").alias("spread")), "spread")
    return judged.withColumn("_key", address_key(F.col("url"))).join(spread, "_key", "left").select("page_id", "url", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce(verdict, "spread", F.lit("allow")).alias("verdict"))
