"""HTML to structured values as Columns.

A page becomes an array of tokens by one regular expression; every extractor
is an array expression over it. All of it happens inside the row: reading the
facts of a page needs no shuffle, whatever the number of pages.
"""

from __future__ import annotations

import json
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftaudit.functions import walk
from weftaudit.functions.common import bind, strip

# One token: a whole script/style/noscript element, a comment, a tag, or a text run.
# Possessive quantifiers keep long tags off the regex engine's stack.
TOKEN_RE = (
    r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<!--.*?-->"
    r"|<[/!?a-z](?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+>|[^<]+|<"
)
TAG_NAME_RE = r"^</?([A-Za-z][A-Za-z0-9:\-]*)"
RAW_END_RE = r"(?i)</(?:script|style|noscript)\s*>$"
OPEN_TAG_RE = r"(?s)^<(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+>"
ATTR_RE = r"[^\s\"'<>/=]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?"
# Leading zeros of a number do not count; more digits than any code point has still make a (bad) reference.
ENTITY_RE = r"&(?:#0*[0-9]{1,12}|#[xX]0*[0-9a-fA-F]{1,10}|[a-zA-Z][a-zA-Z0-9]*);|[^&]+|&"

VOID_TAGS = [
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
    "track", "wbr",
]
# Elements that end when the same element opens right inside them.
SELF_ENDING_TAGS = ["p", "li", "dt", "dd", "option", "tr", "td", "th"]

# The order in which semantic elements are listed.
SEMANTIC_ELEMENTS = [
    "header", "footer", "nav", "main", "article", "aside", "section", "figure", "figcaption",
]
# Fixed value: an inline style that sets a colour.
INLINE_COLOR_RE = r"(?i)style\s*=\s*[\"'][^\"']*(?:color\s*:|background(?:-color)?\s*:)"


def _entity_names() -> Column:
    """Named character references as one constant map (folded by the optimizer)."""
    table = {name: chr(code) for name, code in {**name2codepoint, "apos": 39}.items()}
    return F.from_json(F.lit(json.dumps(table)), "map<string,string>")


def _code_point(number: Column) -> Column:
    usable = (number > 0) & (number <= 1114111) & ~number.between(55296, 57343)
    encoded = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    return F.when(usable, encoded).otherwise(F.lit("�"))


def decode_entities(text: Column) -> Column:
    """Replace character references in one pass; unknown ones stay as they are."""

    def piece(p: Column) -> Column:
        inner = F.regexp_extract(p, r"^&(.*);$", 1)
        code = (
            F.when(inner.startswith("#x") | inner.startswith("#X"), F.conv(F.regexp_extract(inner, "^#[xX]0*([0-9a-fA-F]+)$", 1), 16, 10))
            .otherwise(F.regexp_extract(inner, "^#0*([0-9]+)$", 1))
            .cast("bigint")
        )
        return (
            F.when(~(p.startswith("&") & p.endswith(";")), p)
            .when(inner.startswith("#"), _code_point(code))
            .otherwise(F.coalesce(F.try_element_at(_entity_names(), inner), p))
        )

    pieces = F.regexp_extract_all(text, F.lit(ENTITY_RE), F.lit(0))
    return F.when(text.contains("&"), F.array_join(F.transform(pieces, piece), "")).otherwise(text)


def tokens(html: Column) -> Column:
    """``array<struct<pos, kind, tag, v>>`` in document order.

    kind is open, close, text, raw (script, style or noscript with its content)
    or skip (comment, declaration). v is the decoded text of a text token and
    the markup of any other.
    """
    named = F.transform(
        F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(TOKEN_RE), F.lit(0)),
        lambda r: F.struct(r.alias("r"), F.lower(F.regexp_extract(r, TAG_NAME_RE, 1)).alias("t")),
    )

    def shape(x: Column, i: Column) -> Column:
        is_text = ~x["r"].startswith("<") | (x["r"] == "<")
        kind = (
            F.when(is_text, F.lit("text"))
            .when(x["t"].isin("script", "style", "noscript") & x["r"].rlike(RAW_END_RE) & ~x["r"].startswith("</"), F.lit("raw"))
            .when(x["t"] == "", F.lit("skip"))
            .when(x["r"].startswith("</"), F.lit("close"))
            .otherwise(F.lit("open"))
        )
        return F.struct(
            i.alias("pos"),
            kind.alias("kind"),
            x["t"].alias("tag"),
            F.when(is_text, decode_entities(x["r"])).otherwise(x["r"]).alias("v"),
        )

    return F.transform(named, shape)


def attributes(markup: Column) -> Column:
    """``array<struct<n, v>>`` of an opening tag: lower-cased name, decoded value."""
    opening = F.regexp_extract(markup, OPEN_TAG_RE, 0)
    body = F.regexp_replace(opening, r"^<[^\s/>]+|/?>$", "")

    def pair(a: Column) -> Column:
        raw = F.regexp_extract(a, r"(?s)^[^=]*=\s*(.*)$", 1)
        bare = F.when(
            raw.startswith('"') | raw.startswith("'"), F.substring(raw, F.lit(2), F.length(raw) - 2)
        ).otherwise(raw)
        return F.struct(
            F.lower(F.regexp_extract(a, r"^[^\s=]+", 0)).alias("n"), decode_entities(bare).alias("v")
        )

    return F.transform(F.regexp_extract_all(body, F.lit(ATTR_RE), F.lit(0)), pair)


def attr(attrs: Column, name: str) -> Column:
    """Value of an attribute (the first one of that name); null when absent."""
    return F.get(F.filter(attrs, lambda a: a["n"] == name), F.lit(0))["v"]


def attr_or(attrs: Column, name: str, default: str = "") -> Column:
    return F.coalesce(attr(attrs, name), F.lit(default))


def class_list(attrs: Column, name: str = "class") -> Column:
    """A blank-separated attribute as an array."""
    return F.filter(F.split(attr_or(attrs, name), r"[\s\p{Z}]+"), lambda c: c != "")


def visible_text(toks: Column) -> Column:
    """All text tokens, joined by blanks and collapsed."""
    return _collapsed(F.filter(toks, lambda t: t["kind"] == "text"))


def _collapsed(texts: Column) -> Column:
    joined = F.array_join(F.transform(texts, lambda t: t["v"]), " ")
    return F.trim(F.regexp_replace(joined, r"[\s\p{Z}]+", " "))


def text_outside(toks: Column, tag_names: list[str]) -> Column:
    """Visible text, leaving out what lies in the given elements.

    An element that is never closed reaches to the end of the page.
    """
    marks = F.transform(
        toks,
        lambda t: F.when(t["kind"] == "text", "t")
        .when(t["tag"].isin(tag_names) & (t["kind"] == "open"), "+")
        .when(t["tag"].isin(tag_names) & (t["kind"] == "close"), "-")
        .otherwise(""),
    )
    return _collapsed(F.transform(walk.texts_outside_of(marks), lambda i: F.get(toks, i)))


def element_text(toks: Column, first: Column, last: Column) -> Column:
    """Stripped text tokens between two positions, joined without a blank."""
    inner = F.slice(toks, first + 2, F.greatest(last - first - 1, F.lit(0)))
    texts = F.filter(inner, lambda t: t["kind"] == "text")
    return F.array_join(F.transform(texts, lambda t: strip(t["v"])), "")


def elements_with_text(toks: Column, tag_names: list[str]) -> Column:
    """``array<struct<pos, tag, v, text>>``: each opening tag with its text.

    The text reaches to the next opening or closing tag of the given names: a link or a
    heading ends where the next one begins, as browsers have it. So each token belongs to
    one element at most.
    """
    marks = F.filter(toks, lambda t: t["tag"].isin(tag_names) & t["kind"].isin("open", "close"))

    def made(ms: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            end = F.coalesce(F.get(ms, i + 1)["pos"], F.size(toks))
            return F.struct(
                m["pos"].alias("pos"),
                m["kind"].alias("kind"),
                m["tag"].alias("tag"),
                m["v"].alias("v"),
                F.when(m["kind"] == "open", element_text(toks, m["pos"], end)).alias("text"),
            )

        return F.filter(F.transform(ms, one), lambda x: x["kind"] == "open")

    return bind(marks, made)


def images_in_context(toks: Column) -> Column:
    """``array<struct<v, place>>``: each img tag with its innermost open element and the containers around it."""
    marks = F.transform(
        F.filter(toks, lambda t: t["kind"].isin("open", "close")),
        lambda t: F.concat(F.when(t["kind"] == "open", "+").otherwise("-"), t["tag"]),
    )
    images = F.filter(toks, lambda t: (t["tag"] == "img") & (t["kind"] == "open"))
    places = walk.image_places_of(marks, VOID_TAGS, SELF_ENDING_TAGS)
    return F.zip_with(images, places, lambda t, p: F.struct(t["v"].alias("v"), p.alias("place")))


def form_inputs(toks: Column) -> Column:
    """``array<array<string>>``: per form, the ids of its inputs (inputs without id left out)."""
    marks = F.transform(
        F.filter(
            toks,
            lambda t: ((t["tag"] == "form") & t["kind"].isin("open", "close"))
            | (t["tag"].isin("input", "textarea", "select") & (t["kind"] == "open")),
        ),
        lambda t: F.when((t["tag"] == "form") & (t["kind"] == "open"), "(")
        .when(t["tag"] == "form", ")")
        .otherwise(F.concat(F.lit("i"), attr_or(attributes(t["v"]), "id"))),
    )
    return walk.inputs_of_forms_of(marks)
