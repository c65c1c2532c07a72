"""URL operators as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftaudit.functions.common import bind, collapse, strip

SPLIT_RE = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
DOTS_RE = r"//|(?:^|/)\.\.?(?:/|$)"

# File endings that are never crawled, and href prefixes that are no links.
SKIPPED_EXTENSIONS = [
    ".pdf", ".jpg", ".jpeg", ".png", ".gif", ".svg", ".ico",
    ".css", ".js", ".json", ".xml", ".zip", ".tar", ".gz",
    ".mp4", ".avi", ".mov", ".mp3", ".wav", ".doc", ".docx",
    ".xls", ".xlsx", ".ppt", ".pptx",
]
SKIPPED_HREF_PREFIXES = ["#", "javascript:", "mailto:", "tel:"]

SKIPPED_EXTENSION_RE = r"\.(" + "|".join(e[1:] for e in SKIPPED_EXTENSIONS) + r")$"
SKIPPED_HREF_RE = "^(" + "|".join(SKIPPED_HREF_PREFIXES) + ")"


def parts(url: Column) -> Column:
    """Split a URL into scheme, netloc, path (with parameters), query and fragment."""
    pick = lambda n: F.regexp_extract(url, SPLIT_RE, n)
    return F.struct(
        F.lower(pick(1)).alias("scheme"),
        pick(2).alias("netloc"),
        pick(3).alias("path"),
        pick(4).alias("query"),
        pick(5).alias("fragment"),
    )


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, SPLIT_RE, 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, SPLIT_RE, 2)


def path(url: Column) -> Column:
    return F.regexp_extract(url, SPLIT_RE, 3)


def _plain_path(whole: Column) -> Column:
    """Path without the ``;parameters`` of its last segment."""
    return F.regexp_replace(whole, r";[^/]*$", "")


def unsplit(p_scheme: Column, p_netloc: Column, p_path: Column, p_query: Column, p_fragment: Column) -> Column:
    """Put URL parts together again; empty parts leave no mark."""
    rooted = F.when((p_path != "") & ~p_path.startswith("/"), F.concat(F.lit("/"), p_path)).otherwise(p_path)
    authority = F.when(p_netloc != "", F.concat(F.lit("//"), p_netloc, rooted)).otherwise(p_path)
    return F.concat(
        F.when(p_scheme != "", F.concat(p_scheme, F.lit(":"))).otherwise(F.lit("")),
        authority,
        F.when(p_query != "", F.concat(F.lit("?"), p_query)).otherwise(F.lit("")),
        F.when(p_fragment != "", F.concat(F.lit("#"), p_fragment)).otherwise(F.lit("")),
    )


def _walk_segments(whole_path: Column, rooted: Column) -> Column:
    """Resolve ``.`` and ``..``; drop empty inner segments of a path joined to its base."""

    def walked(segments: Column) -> Column:
        last = F.size(segments) - 1
        inner = F.filter(segments, lambda s, i: rooted | (s != "") | (i == 0) | (i == last))
        stack = F.aggregate(
            inner,
            F.array().cast("array<string>"),
            lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(s == ".", acc)
            .otherwise(F.array_append(acc, s)),
        )
        ended = F.when(
            F.element_at(segments, -1).isin(".", ".."), F.array_append(stack, F.lit(""))
        ).otherwise(stack)
        joined = F.array_join(ended, "/")
        return F.when(joined == "", F.lit("/")).otherwise(joined)

    return bind(F.split(whole_path, "/"), walked)


def resolve_parts(base: Column, href: Column, ref: Column) -> Column:
    """Resolve ``href`` (already split into ``ref``) against the split URL ``base``."""
    folder = F.regexp_replace(base["path"], r"[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    rooted = ref["path"].startswith("/")
    joined = F.when(rooted, ref["path"]).otherwise(F.concat(folder, ref["path"]))
    target = bind(joined, lambda j: F.when(j.rlike(DOTS_RE), _walk_segments(j, rooted)).otherwise(j))
    same_page_query = F.when(ref["query"] != "", ref["query"]).otherwise(base["query"])
    return (
        F.when((ref["scheme"] != "") & (ref["scheme"] != base["scheme"]), href)
        .when(
            ref["netloc"] != "",
            unsplit(base["scheme"], ref["netloc"], ref["path"], ref["query"], ref["fragment"]),
        )
        .when(
            ref["path"] == "",
            unsplit(base["scheme"], base["netloc"], base["path"], same_page_query, ref["fragment"]),
        )
        .otherwise(unsplit(base["scheme"], base["netloc"], target, ref["query"], ref["fragment"]))
    )


def resolve(base_url: Column, href: Column) -> Column:
    """Absolute form of ``href`` on the page ``base_url``."""
    return F.when(href == "", base_url).otherwise(
        bind(parts(base_url), lambda b: bind(parts(href), lambda r: resolve_parts(b, href, r)))
    )


def valid_lenient(url: Column) -> Column:
    """True for URLs with a host, or for bare names that look like one."""

    def check(p: Column) -> Column:
        first = F.split(p["path"], "/")[0]
        looks_like_host = (
            first.contains(".")
            & ~first.startswith(".")
            & F.exists(F.split(first, r"\."), lambda s: F.length(s) >= 2)
            & (F.length(first) > 3)
        )
        return (p["netloc"] != "") | ((p["scheme"] == "") & looks_like_host)

    return F.coalesce(bind(parts(F.coalesce(url, F.lit(""))), check), F.lit(False))


def valid_strict(url: Column) -> Column:
    """True for http and https URLs with a host."""
    return F.coalesce(
        bind(parts(F.coalesce(url, F.lit(""))), lambda p: p["scheme"].isin("http", "https") & (p["netloc"] != "")),
        F.lit(False),
    )


def normalize_input(url: Column, default_scheme: str = "https") -> Column:
    """User input to a URL: add a scheme, drop trailing slashes; null when unusable."""
    trimmed = strip(F.coalesce(url, F.lit("")))
    full = F.when(trimmed.contains("://"), trimmed).otherwise(F.concat(F.lit(f"{default_scheme}://"), trimmed))
    return F.when((trimmed != "") & valid_strict(full), F.regexp_replace(full, r"/+$", ""))


def _short_path(p: Column) -> Column:
    cut = F.regexp_replace(p, r"/+$", "")
    return F.when(cut == "", F.lit("/")).otherwise(cut)


def crawl_key(url: Column) -> Column:
    """De-duplication key of the crawler: lower host, no fragment, no trailing slash."""

    def key(p: Column) -> Column:
        params = F.regexp_extract(p["path"], r"(;[^/]*)$", 1)
        short = F.concat(_short_path(_plain_path(p["path"])), params)
        return unsplit(p["scheme"], F.lower(p["netloc"]), short, p["query"], F.lit(""))

    return bind(parts(url), key)


def page_key(url: Column, base_url: Column) -> Column:
    """De-duplication key of the single-site tool: joined, no fragment, trailing slash cut last."""

    def key(p: Column) -> Column:
        whole = unsplit(p["scheme"], p["netloc"], p["path"], p["query"], F.lit(""))
        return F.when((p["scheme"] != "") & (p["netloc"] != ""), whole)

    own = bind(parts(url), key)
    joined = resolve(base_url, url)
    relative = F.coalesce(bind(parts(joined), key), joined)
    picked = F.when(own.isNotNull(), own).when(url.startswith("//"), url).otherwise(relative)
    return F.regexp_replace(picked, r"/+$", "")


def graph_key(url: Column) -> Column:
    """Node key of the link graph: no fragment, no parameters, no trailing slash."""

    def key(p: Column) -> Column:
        short = _short_path(_plain_path(p["path"]))
        head = F.when(
            (p["scheme"] != "") & (p["netloc"] != ""),
            F.concat(p["scheme"], F.lit("://"), p["netloc"], short),
        ).otherwise(short)
        return F.concat(head, F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).otherwise(F.lit("")))

    return F.when(url == "", F.lit("")).otherwise(bind(parts(strip(url)), key))


def lookup_key(url: Column) -> Column:
    """Key of the title lookup: trailing slashes cut."""
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"/+$", "")


def domain_key(value: Column) -> Column:
    """Host of a URL or bare name, lower-cased; null when nothing is left."""
    trimmed = strip(F.coalesce(value, F.lit("")))
    full = F.when(trimmed.contains("://"), trimmed).otherwise(F.concat(F.lit("https://"), trimmed))
    host = bind(parts(full), lambda p: F.when(p["netloc"] != "", p["netloc"]).otherwise(p["path"]))
    cleaned = F.regexp_replace(F.lower(strip(host)), r"^/+|/+$", "")
    return F.when(cleaned != "", cleaned)


def is_internal(url: Column, site_host: Column) -> Column:
    """Same host as the site (case and port count), or no host at all."""
    return bind(netloc(url), lambda h: (h == site_host) | (h == ""))


def is_crawlable(url: Column) -> Column:
    """http, https or relative, and not a known non-page file."""

    def check(p: Column) -> Column:
        return p["scheme"].isin("http", "https", "") & ~F.lower(_plain_path(p["path"])).rlike(SKIPPED_EXTENSION_RE)

    return F.when(F.coalesce(url, F.lit("")) == "", F.lit(False)).otherwise(bind(parts(url), check))


def is_link_href(href: Column) -> Column:
    """False for empty, fragment, script, mail and telephone targets."""
    return (href != "") & ~href.rlike(SKIPPED_HREF_RE)


def slug_topic(url: Column) -> Column:
    """Words of the last path segment, or ``home``."""
    trimmed = F.regexp_replace(_plain_path(path(F.coalesce(url, F.lit("")))), r"^/+|/+$", "")
    last = F.when(trimmed == "", F.lit("home")).otherwise(F.element_at(F.split(trimmed, "/"), -1))
    words = F.regexp_replace(last, r"[-_]+", " ")
    words = F.regexp_replace(words, r"(?i)\.[a-z0-9]+$", "")
    words = collapse(words)
    return F.when(words == "", F.lit("home")).otherwise(words)


def file_words(src: Column) -> Column:
    """Words of the file name in an image address."""
    name = F.element_at(F.split(_plain_path(path(F.coalesce(src, F.lit("")))), "/"), -1)
    name = F.regexp_replace(name, r"(?i)\.[a-z0-9]+$", "")
    return strip(F.regexp_replace(name, r"[-_]+", " "))


def site_domain(given: Column, url: Column) -> Column:
    cleaned = collapse(given)
    return F.when(cleaned != "", cleaned).otherwise(netloc(F.coalesce(url, F.lit(""))))


def site_name(given_name: Column, given_domain: Column, url: Column) -> Column:
    """Given name, else the second-last host label with a capital first letter."""
    cleaned = collapse(given_name)

    def from_host(host: Column) -> Column:
        labels = F.split(F.regexp_extract(host, r"^[^:]*", 0), r"\.")
        label = F.when(F.size(labels) >= 2, F.element_at(labels, -2)).otherwise(labels[0])
        proper = F.concat(F.upper(F.substring(label, 1, 1)), F.lower(_tail(label)))
        return F.when(host == "", F.lit("")).otherwise(proper)

    return F.when(cleaned != "", cleaned).otherwise(bind(site_domain(given_domain, url), from_host))


def _tail(label: Column) -> Column:
    return F.substring(label, F.lit(2), F.length(label))
