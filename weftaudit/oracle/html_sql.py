"""Oracle SQL for page extraction."""

from __future__ import annotations

from weftaudit.oracle.base import (
    A11Y, CMS, LINKS, PAGE, STACK, TOKENS, collapse, netloc, sql, up,
)

HEAD_COUNTS = """(SELECT page_id, h1_count, h2_count, h3_count, h4_count, h5_count, h6_count, levels FROM fact2)"""

JSON_LD = """
ld AS (
  SELECT page_id, pos, trim(regexp_replace(regexp_replace(raw, '(?s)^<(?:[^"''>]|"[^"]*"|''[^'']*'')*>', ''), '(?i)</script\\s*>$', '')) AS json
  FROM tag_attr WHERE tag = 'script' AND type = 'application/ld+json'
),
ld_ok AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS ord FROM ld WHERE json_valid(json))
"""

SEO_ISSUES = """array_to_string(list_filter([
  CASE WHEN NOT title_tag_found THEN 'Missing title tag' WHEN length(title) = 0 THEN 'Empty title tag'
       WHEN length(title) < 30 THEN 'Title tag too short (< 30 characters)'
       WHEN length(title) > 60 THEN 'Title tag too long (> 60 characters)' END,
  CASE WHEN first_description IS NULL THEN 'Missing meta description' WHEN length(first_description) = 0 THEN 'Empty meta description'
       WHEN length(first_description) < 120 THEN 'Meta description too short (< 120 characters)'
       WHEN length(first_description) > 160 THEN 'Meta description too long (> 160 characters)' END], lambda x: x IS NOT NULL), '|')"""

HEADING_ISSUES = """array_to_string(list_concat(
  CASE WHEN h1_count = 0 THEN ['Missing H1 heading'] WHEN h1_count > 1 THEN ['Multiple H1 headings found (' || h1_count || ')'] ELSE [] END,
  list_filter(list_transform(coalesce(levels, []), lambda x, i: CASE WHEN levels[i + 1] - x > 1 THEN 'Heading hierarchy skip: H' || x || ' to H' || levels[i + 1] END), lambda x: x IS NOT NULL)), '|')"""

SUGGESTION_COUNT = """(CASE WHEN title = '' THEN 1 ELSE 0 END + CASE WHEN meta_description = '' THEN 1 ELSE 0 END
  + CASE WHEN h1_count = 0 OR h1_count > 1 THEN 1 ELSE 0 END + CASE WHEN missing_alt_count > 0 THEN 1 ELSE 0 END
  + CASE WHEN word_count < 300 THEN 1 ELSE 0 END + CASE WHEN coalesce(load_time, 0) > 3 THEN 1 ELSE 0 END)"""

BODY_TEXT = f"""
depth_step AS (
  SELECT page_id, pos, kind, txt, sum(CASE WHEN tag IN ('nav', 'footer', 'header') AND kind = 'open' THEN 1
      WHEN tag IN ('nav', 'footer', 'header') AND kind = 'close' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS s
  FROM tok
),
depth AS (
  SELECT page_id, pos, kind, txt, s - least(0, min(s) OVER (PARTITION BY page_id ORDER BY pos)) AS d FROM depth_step
),
body AS (
  SELECT p.page_id, coalesce({collapse("string_agg(d.txt, ' ' ORDER BY d.pos)")}, '') AS body_text
  FROM pages_raw p LEFT JOIN depth d ON d.page_id = p.page_id AND d.kind = 'text' AND d.d = 0 GROUP BY p.page_id
)
"""

ORACLE = {
    "html_tokens": sql("SELECT page_id, pos, kind, tag, coalesce(txt, raw) AS value FROM tok", TOKENS),
    "html_ancestors": sql(
        "SELECT page_id, index, placement_parent, in_header, in_footer, in_nav, in_article FROM image", TOKENS, STACK
    ),
    "html_visible_text": sql("SELECT page_id, text_content, length(text_content) AS text_length FROM txt", TOKENS),
    "html_body_text": sql("SELECT page_id, body_text FROM body", TOKENS, BODY_TEXT),
    "html_title": sql(
        """SELECT p.page_id, coalesce(min_by(text, pos), '') AS title, length(coalesce(min_by(text, pos), '')) AS title_length,
        count(e.pos) > 0 AS title_tag_found
        FROM pages_raw p LEFT JOIN el e ON e.page_id = p.page_id AND e.tag = 'title' GROUP BY p.page_id""",
        TOKENS,
    ),
    "html_meta_tags": sql("SELECT page_id, key, value FROM meta_tag", *PAGE),
    "html_named_metas": sql(
        """SELECT page_id, meta_description, length(meta_description) AS meta_description_length, meta_keywords, meta_robots,
        first_description FROM fact""",
        *PAGE,
    ),
    "html_open_graph": sql(
        """SELECT page_id, replace(property, 'og:', '') AS key, max_by(coalesce(content, ''), pos) AS value FROM tag_attr
        WHERE tag = 'meta' AND starts_with(property, 'og:') GROUP BY page_id, replace(property, 'og:', '')""",
        TOKENS,
    ),
    "html_twitter_card": sql(
        """SELECT page_id, name AS key, max_by(coalesce(content, ''), pos) AS value FROM tag_attr
        WHERE tag = 'meta' AND starts_with(name, 'twitter:') GROUP BY page_id, name""",
        TOKENS,
    ),
    "html_canonical_language": sql("SELECT page_id, canonical_url, language FROM fact", *PAGE),
    "html_headings": sql(
        """SELECT page_id, CAST(tag[2] AS BIGINT) AS level, pos, text, coalesce(id, '') AS id, coalesce(class, '') AS classes
        FROM el WHERE tag[1] = 'h'""",
        TOKENS,
    ),
    "html_heading_counts": sql(
        """SELECT page_id, h1_count AS h1, h2_count AS h2, h3_count AS h3, h4_count AS h4, h5_count AS h5, h6_count AS h6,
        h1_count > 1 AS has_multiple_h1 FROM fact""",
        *PAGE,
    ),
    "html_heading_issues": sql(f"SELECT page_id, {HEADING_ISSUES} AS issues FROM fact2", *PAGE),
    "html_images": sql(
        """SELECT page_id, index, src, absolute_src, alt, has_alt, title, width, height, placement_parent, loading, class
        FROM image""",
        TOKENS, STACK,
    ),
    "html_missing_alt": sql("SELECT page_id, image_count, missing_alt_count FROM fact", *PAGE),
    "html_image_placement": sql(
        """SELECT page_id, index + 1 AS position, absolute_src AS src, CASE WHEN placement_parent IN ('header', 'nav') THEN 'header'
        WHEN placement_parent IN ('footer', 'aside', 'section') THEN placement_parent ELSE 'body' END AS placement FROM image""",
        TOKENS, STACK,
    ),
    "html_links": sql("SELECT page_id, pos, text, href, absolute_url, title, rel, target, internal FROM link", TOKENS, LINKS),
    "html_plain_links": sql(
        f"""SELECT page_id, pos, absolute_url AS url, text, text <> '' AS has_text,
        ({netloc('absolute_url')} = {netloc('url')} OR {netloc('absolute_url')} = '') AS internal
        FROM anchor_abs WHERE lower({up('absolute_url', 1)}) IN ('http', 'https')""",
        TOKENS, LINKS,
    ),
    "html_structure": sql(
        """SELECT f.page_id, coalesce(list_contains(tags, 'header'), FALSE) AS has_header, coalesce(list_contains(tags, 'footer'), FALSE) AS has_footer,
        coalesce(list_contains(tags, 'nav'), FALSE) AS has_nav, coalesce(list_contains(tags, 'main'), FALSE) AS has_main,
        coalesce(list_contains(tags, 'article'), FALSE) AS has_article, coalesce(list_contains(tags, 'aside'), FALSE) AS has_aside,
        count(*) FILTER (t.tag = 'nav') AS nav_count, count(*) FILTER (t.tag = 'article') AS article_count,
        count(*) FILTER (t.tag = 'section') AS section_count, count(*) FILTER (t.tag = 'div') AS div_count,
        count(*) FILTER (t.tag = 'form') AS form_count, count(*) FILTER (t.tag = 'table') AS table_count,
        count(*) FILTER (t.tag IN ('ul', 'ol')) AS list_count, coalesce(any_value(semantic_elements), '') AS semantic_elements
        FROM fact2 f LEFT JOIN tok t ON t.page_id = f.page_id AND t.kind = 'open' GROUP BY f.page_id, tags""",
        *PAGE,
    ),
    "html_layout_issues": sql(
        """SELECT page_id, array_to_string(list_filter(list_transform(['header', 'nav', 'main', 'footer'],
        lambda e: CASE WHEN NOT coalesce(list_contains(tags, e), FALSE) THEN 'Missing <' || e || '> element' END), lambda x: x IS NOT NULL), '|') AS issues
        FROM fact""",
        *PAGE,
    ),
    "html_json_ld": sql(
        "SELECT page_id, ord, json_extract_string(json, '$.\"@type\"') AS type, json_extract_string(json, '$.name') AS name, json FROM ld_ok",
        TOKENS, JSON_LD,
    ),
    "html_cms": sql(
        """SELECT p.page_id, arg_max(cms, score * 10 - ord) AS cms_probable,
        coalesce(string_agg(cms, '|' ORDER BY ord) FILTER (score >= 3), '') AS cms_detected,
        coalesce(string_agg(cms || '=' || score, '|' ORDER BY ord), '') AS scores
        FROM pages_raw p LEFT JOIN cms_score c ON c.page_id = p.page_id GROUP BY p.page_id""",
        TOKENS, CMS,
    ),
    "html_accessibility": sql(
        """SELECT page_id, array_to_string(issues, '|') AS issues, array_to_string(warnings, '|') AS warnings,
        array_to_string(good, '|') AS good_practices, score FROM a11y_score""",
        *PAGE, A11Y,
    ),
    "html_seo_issues": sql(f"SELECT page_id, {SEO_ISSUES} AS issues FROM fact", *PAGE),
    "html_optimal_flags": sql(
        """SELECT page_id, has_title, has_meta_description, length(title) BETWEEN 50 AND 60 AS title_optimal,
        length(meta_description) BETWEEN 150 AND 160 AS description_optimal FROM fact2""",
        *PAGE,
    ),
    "html_failed_defaults": sql(
        """SELECT page_id, url, error, status_code, text_length, word_count, title, meta_description, image_count, internal_count,
        external_count, h1_count, has_title, coalesce(semantic_elements, '') AS semantic_elements FROM fact2 WHERE NOT fetched""",
        *PAGE,
    ),
    "html_inline_color": sql(
        "SELECT page_id, regexp_matches(html, '(?i)style\\s*=\\s*[\"''][^\"'']*(?:color\\s*:|background(?:-color)?\\s*:)') AS inline_color FROM pages_raw"
    ),
    "html_page_analysis": sql(
        f"""SELECT f.page_id, url, status_code, depth, load_time, text_length, title, length(title) AS title_length,
        length(meta_description) AS meta_description_length, canonical_url, language, word_count, h1_count, image_count,
        missing_alt_count, internal_count, external_count, cms_probable, a.score AS accessibility_score,
        k.word AS first_keyword, CAST({SUGGESTION_COUNT} AS BIGINT) AS suggestion_count
        FROM fact2 f JOIN a11y_score a USING (page_id) LEFT JOIN keyword k ON k.page_id = f.page_id AND k.rank = 1""",
        *PAGE, A11Y,
    ),
}
