"""Topic, keyword and text of a page as Columns over a facts row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftaudit.functions import text, urls
from weftaudit.functions.common import bind, collapse, strip


def primary_keyword(given: Column) -> Column:
    """Given keyword, else the first of the top keywords, lower-cased; '' when none."""
    own = F.get(F.col("top_keywords"), F.lit(0))["word"]
    return F.lower(strip(F.coalesce(F.nullif(given, F.lit("")), own, F.lit(""))))


def page_text(stored: Column) -> Column:
    """Stored text, else text put together from the page facts."""
    by_level = F.array_sort(
        F.transform(F.col("headings"), lambda h: F.struct(h["level"].alias("l"), h["pos"].alias("p"), h["text"].alias("t")))
    )
    links = F.concat(
        F.filter("links", lambda x: x["internal"]), F.filter("links", lambda x: ~x["internal"])
    )
    pieces = F.concat(
        F.array(F.col("title"), F.col("meta_description")),
        F.transform(by_level, lambda h: h["t"]),
        F.transform(F.col("images"), lambda i: i["alt"]),
        F.transform(links, lambda x: x["text"]),
    )
    made = collapse(F.array_join(F.filter(pieces, lambda p: p != ""), " "))
    own = collapse(stored)
    return F.when(own != "", own).otherwise(made)


def first_h1() -> Column:
    texts = F.transform(F.filter("headings", lambda h: h["level"] == 1), lambda h: collapse(h["text"]))
    return F.coalesce(F.get(F.filter(texts, lambda t: t != ""), F.lit(0)), F.lit(""))


def topics() -> Column:
    """``struct<first_h1, topic, keyword, h1_text>`` from first H1, title or address."""

    def made(parts: Column) -> Column:
        h1, head, slug = parts["h1"], parts["head"], parts["slug"]
        has_title = F.col("title") != ""
        source = F.when(h1 != "", h1).when(has_title, head).otherwise(slug)
        topic = text.title_case(source)
        return F.struct(
            h1.alias("first_h1"),
            topic.alias("topic"),
            source.alias("keyword"),
            F.when(has_title, text.title_case(head)).otherwise(topic).alias("h1_text"),
        )

    return bind(
        F.struct(
            first_h1().alias("h1"),
            text.before_separator(collapse(F.col("title"))).alias("head"),
            urls.slug_topic(F.col("url")).alias("slug"),
        ),
        made,
    )
