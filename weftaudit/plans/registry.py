"""All registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftaudit.plans import queries_html, queries_more, queries_site, queries_streams, queries_text

QUERIES = {
    **queries_html.QUERIES,
    **queries_text.QUERIES,
    **queries_site.QUERIES,
    **queries_more.QUERIES,
    **queries_streams.QUERIES,
}


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Seven summary figures of each site, from the stored pages."""
    return queries_site.agg_site_summary(spark, sf)
