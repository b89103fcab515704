"""Text functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def folded(x: Column) -> Column:
    """Lower case, runs of white space as one blank, none at the ends."""
    return F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))


def tokens(x: Column, shortest: int = 1) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text, of at least `shortest` characters."""
    return F.regexp_extract_all(F.lower(x), F.lit(f"[a-z0-9]{{{shortest},}}"), F.lit(0))


def keywords(x: Column, stop: tuple[str, ...] = ()) -> Column:
    """Distinct runs of four letters or more that are no stop words."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit("[a-z]{4,}"), F.lit(0)))
    return F.array_except(found, F.array(*(F.lit(s) for s in stop))) if stop else found


def occurrences(x: Column, term: str) -> Column:
    """How often term stands in x, without overlaps."""
    return ((F.length(x) - F.length(F.replace(x, F.lit(term), F.lit("")))) / len(term)).cast("int")


def slug(x: Column, words: int = 10, default: str = "capture") -> Column:
    """The first words joined by hyphens."""
    return F.coalesce(F.nullif(F.array_join(F.slice(tokens(x), 1, words), "-"), F.lit("")), F.lit(default))


def title_of(x: Column, words: int = 8) -> Column:
    """The first words of the first line that isn't blank, without marks at the ends."""
    line = F.filter(F.transform(F.split(x, "\n"), lambda x: F.trim(x)), lambda s: s != "")[0]
    return F.btrim(F.array_join(F.slice(F.split(line, r"\s+"), 1, words), " "), F.lit(" .,:;"))


def compact(x: Column, limit: int) -> Column:
    """At most limit characters, with an ellipsis where something is cut off."""
    return F.when(F.length(x) <= limit, x).otherwise(F.concat(F.rtrim(F.substring(x, 1, limit - 3)), F.lit("...")))


def without_links(x: Column) -> Column:
    """Markdown links replaced by their labels."""
    return F.regexp_replace(x, r"\[([^\]]+)\]\([^)]+\)", "$1")


def wikilinks(x: Column) -> Column:
    """The targets of [[target]] and [[label|target]] links, distinct."""
    inner = F.regexp_extract_all(x, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))
    return F.array_distinct(F.transform(inner, lambda s: F.trim(F.element_at(F.split(s, r"\|"), -1))))


def token_estimate(x: Column) -> Column:
    """Runs without white space."""
    return F.size(F.regexp_extract_all(x, F.lit(r"\S+"), F.lit(0)))


def claim_hash(subject: Column, predicate: Column, object_: Column) -> Column:
    """SHA-256 of a claim's three folded parts, one a line."""
    return F.sha2(F.concat_ws("\n", folded(subject), folded(predicate), folded(object_)), 256)


def looks_like_page_id(x: Column) -> Column:
    """A path, or a name without capitals."""
    return x.contains("/") | (x == F.lower(x))


def link_targets(x: Column) -> Column:
    """The page that each [[...]] names, in order: of two parts the right one if it looks like a page, else the left one if it does."""
    begun = F.substr(x, F.greatest(F.locate("[[", x), F.lit(1)))  # no pattern is tried on what comes before the first one
    inner = F.regexp_extract_all(begun, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))

    def target(s: Column) -> Column:
        left, right = F.trim(F.substring_index(s, "|", 1)), F.when(s.contains("|"), F.trim(F.regexp_replace(s, r"^[^|]*\|", ""))).otherwise(F.lit(""))
        return F.when((right != "") & looks_like_page_id(right), right).when(looks_like_page_id(left), left).when(right != "", right).otherwise(left)

    return F.filter(F.transform(inner, target), lambda t: t != "")


def is_url(x: Column) -> Column:
    return x.rlike("^https?://")


def resolve_link(path: Column, page_id: Column) -> Column:
    """The page id that a link's path means on a page: absolute from /, else beside the page; null outside the root or for none."""
    p = F.replace(F.trim(path), F.lit("\\"), F.lit("/"))
    whole = F.when(p.startswith("/"), p).otherwise(F.concat(F.regexp_replace(page_id, "[^/]*$", ""), p))
    # The first of the kept parts is a place holder, so there is always a last one.
    up = lambda kept: F.when((F.size(kept) == 1) | (F.element_at(kept, -1) == ".."), F.concat(kept, F.array(F.lit("..")))).otherwise(F.slice(kept, 1, F.size(kept) - 1))
    step = lambda kept, x: F.when((x == "") | (x == "."), kept).when(x == "..", up(kept)).otherwise(F.concat(kept, F.array(x)))
    parts = F.aggregate(F.split(whole, "/"), F.array(F.lit("")), step)
    out = F.regexp_replace(F.array_join(F.slice(parts, 2, F.size(parts)), "/"), r"\.md$", "")
    return F.when((p == "") | (out == "") | out.startswith("../") | (out == "..") | ~out.rlike(r"^[A-Za-z0-9_][\w.-]*(/[A-Za-z0-9_][\w.-]*)*$"), None).otherwise(out)


def rewrite_wikilinks(x: Column) -> Column:
    """[[label|target]] and [[target]] as Markdown links, outside code fences; one pass over the lines."""
    fence = lambda line: line.rlike(r"^\s*(```|~~~)")

    def linked(line: Column) -> Column:
        both = F.regexp_replace(line, r"\[\[\s*([^\]|]+?)\s*\|\s*([^\]\s]+)\s*\]\]", "[$1](/$2)")
        return F.regexp_replace(both, r"\[\[\s*((?:[^\]|\s]*/)?([^\]|/\s]+))\s*\]\]", "[$2](/$1)")

    start = F.struct(F.lit(False).alias("fenced"), F.array().cast("array<string>").alias("lines"))

    def step(state: Column, line: Column) -> Column:
        kept = F.when(fence(line) | state["fenced"], line).otherwise(linked(line))
        return F.struct((state["fenced"] != fence(line)).alias("fenced"), F.concat(state["lines"], F.array(kept)).alias("lines"))

    return F.aggregate(F.split(x, "\n"), start, step, lambda s: F.array_join(s["lines"], "\n"))


def prose(x: Column) -> Column:
    """Markdown without its fenced lines and code spans."""
    start = F.struct(F.lit(False).alias("fenced"), F.array().cast("array<string>").alias("lines"))

    def step(state: Column, line: Column) -> Column:
        fence = line.rlike(r"^\s*(```|~~~)")
        kept = F.when(fence | state["fenced"], state["lines"]).otherwise(F.concat(state["lines"], F.array(line)))
        return F.struct((state["fenced"] != fence).alias("fenced"), kept.alias("lines"))

    return F.regexp_replace(F.aggregate(F.split(x, "\n"), start, step, lambda s: F.array_join(s["lines"], "\n")), r"(`+)[^`\n]*\1", " ")


def shown_links(x: Column) -> Column:
    """href, label of the links in Markdown prose: wiki links, whose names are absolute, then inline links, then web addresses."""
    wiki, inline = r"\[\[([^\[\]\n]+)\]\]", r"!?\[([^\[\]]*)\]\(\s*(?:<([^<>\n]*)>|([^\s()<>]+))(?:\s+[\"'][^\n]*?[\"'])?\s*\)"

    def named(s: Column) -> Column:
        bar = s.contains("|")
        to = F.trim(F.when(bar, F.regexp_replace(s, r"^[^|]*\|", "")).otherwise(s))
        said = F.when(bar, F.trim(F.substring_index(s, "|", 1))).otherwise(F.initcap(F.translate(F.substring_index(to, "/", -1), "-_", "  ")))
        return F.struct(F.when(to.rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:|[/.#])"), to).otherwise(F.concat(F.lit("/"), to)).alias("href"), said.alias("label"))

    def written(s: Column) -> Column:
        href = F.concat(F.regexp_extract(s, inline, 2), F.regexp_extract(s, inline, 3))
        return F.struct(href.alias("href"), F.regexp_extract(s, inline, 1).alias("label"))

    no_wiki = F.regexp_replace(x, wiki, " ")
    wikis = F.transform(F.regexp_extract_all(x, F.lit(wiki), F.lit(1)), lambda s: named(F.trim(s)))
    inlines = F.transform(F.filter(F.regexp_extract_all(no_wiki, F.lit(inline), F.lit(0)), lambda s: ~s.startswith("!")), written)
    bare = F.regexp_extract_all(F.regexp_replace(no_wiki, inline, " "), F.lit(r"https?://[^\s<>\")\]]*[^\s<>\")\].,;:!?']"), F.lit(0))
    webs = F.transform(bare, lambda s: F.struct(s.alias("href"), s.alias("label")))
    return F.filter(F.concat(wikis, inlines, webs), lambda link: (F.trim(link["href"]) != "") & (link["href"] != "/"))


def path_date(page_id: Column, written: Column) -> Column:
    """The first part of a path that is a date, else the day of a timestamp's text; null for neither."""
    iso = lambda s: F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), s.try_cast("date"))
    named = F.get(F.filter(F.transform(F.split(page_id, "/"), iso), lambda d: d.isNotNull()), F.lit(0))
    return F.coalesce(named, iso(F.substring(written, 1, 10)))


def iso_time(x: Column) -> Column:
    """ISO dates and times as UTC timestamps; null where it is none, for callers that keep the raw text."""
    return F.replace(F.trim(x), F.lit("Z"), F.lit("+00:00")).try_cast("timestamp")


def compact_map(x: Column) -> Column:
    """A map of strings without null and empty values."""
    return F.map_filter(x, lambda k, v: v.isNotNull() & (v != ""))


def content_hash(x: Column) -> Column:
    return F.sha2(x, 256)


def payload_hash(x: Column) -> Column:
    """SHA-256 of a map of strings as JSON in order of its keys, null for null values."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(x)))), 256)
