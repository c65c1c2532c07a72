"""Oracle SQL for links, graph, scores and site roll-ups."""

from __future__ import annotations

from weftaudit.operators.single_page import GENERAL_ADVICE
from weftaudit.oracle import literals
from weftaudit.oracle.base import (
    A11Y, PAGE, collapse, crawl_key, graph_key, in_list, plain_path, q, round2, sql, strip, up,
)
from weftaudit.oracle.html_sql import BODY_TEXT
from weftaudit.oracle.text_sql import LONG_TAIL, PLAIN

ALL = ("pages_raw", "site_meta", "link_status", "authority_metrics", "robots_rules")

BROKEN = """
ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY internal DESC, pos) - 1 AS rank FROM link),
target AS (SELECT site, page_id, url, rank, text, regexp_replace(absolute_url, '#.*$', '') AS target FROM ranked),
broken AS (
  SELECT t.*, s.status_code FROM target t JOIN link_status s ON s.url = t.target WHERE s.status_code >= 400 OR s.status_code = 0
),
broken10 AS (SELECT * FROM broken WHERE rank < 10),
broken50 AS (SELECT page_id, target, min(rank) AS rank FROM broken WHERE rank < 50 GROUP BY page_id, target)
"""

GRAPH = f"""
node AS (SELECT DISTINCT site, {graph_key('url')} AS node FROM pages_raw WHERE url <> ''),
edge AS (
  SELECT DISTINCT l.site, {graph_key('l.url')} AS src, {graph_key('l.absolute_url')} AS dst FROM link l
  WHERE l.internal AND {graph_key('l.absolute_url')} <> {graph_key('l.url')}
    AND {graph_key('l.absolute_url')} IN (SELECT node FROM node n WHERE n.site = l.site)
),
home AS (
  SELECT p.site, {graph_key("coalesce(nullif(m.homepage_url, ''), nullif(m.base_url, ''), p.first_url)")} AS home
  FROM (SELECT site, min_by(url, page_id) AS first_url FROM pages_raw GROUP BY site) p LEFT JOIN site_meta m USING (site)
),
bfs AS (
  SELECT h.site, h.home AS node, CAST(0 AS BIGINT) AS depth FROM home h JOIN node n ON n.site = h.site AND n.node = h.home
  UNION
  SELECT b.site, e.dst, b.depth + 1 FROM bfs b JOIN edge e ON e.site = b.site AND e.src = b.node
  WHERE b.depth < (SELECT count(*) FROM node)
),
depth_of AS (SELECT site, node, min(depth) AS depth FROM bfs GROUP BY site, node),
indeg AS (SELECT site, dst AS node, count(*) AS in_degree FROM edge GROUP BY site, dst),
position AS (
  SELECT n.site, n.node, d.depth, coalesce(i.in_degree, 0) AS in_degree,
    i.in_degree IS NULL AND n.node NOT IN (SELECT home FROM home h WHERE h.site = n.site) AS orphan,
    d.depth IS NULL OR d.depth > 3 AS deep, coalesce(d.depth <= 2, FALSE) AS shallow
  FROM node n LEFT JOIN depth_of d ON d.site = n.site AND d.node = n.node LEFT JOIN indeg i ON i.site = n.site AND i.node = n.node
),
position_count AS (
  SELECT site, count(*) AS nodes, count(*) FILTER (orphan) AS orphans, count(*) FILTER (deep) AS deep, count(*) FILTER (shallow) AS shallow
  FROM position GROUP BY site
)
"""

ANCHORS = f"""
akey AS (
  SELECT site, page_id, pos, internal, lower({strip('text')}) AS k,
    NOT internal AND len(list_intersect(regexp_split_to_array(lower(rel), '[\\s\\p{{Z}}]+'), ['nofollow', 'noopener', 'noreferrer'])) = 0 AS open_rel
  FROM link
),
page_anchor AS (
  SELECT p.page_id, p.site, count(*) FILTER (k IN {in_list(literals.BAD_ANCHORS)}) AS bad_anchors, count(*) FILTER (open_rel) AS unprotected,
    count(DISTINCT k) FILTER (k <> '') AS distinct_anchors, count(k) AS all_anchors, count(*) FILTER (NOT internal) AS external_count,
    count(*) FILTER (internal) AS inside
  FROM pages_raw p LEFT JOIN akey a ON a.page_id = p.page_id GROUP BY p.page_id, p.site
),
site_anchor AS (
  SELECT p.site, count(*) FILTER (k IN {in_list(literals.BAD_ANCHORS)}) AS bad_anchors, count(*) FILTER (open_rel) AS unprotected,
    count(*) FILTER (NOT internal) AS external_links, count(DISTINCT k) FILTER (k <> '') AS distinct_anchors,
    count(k) FILTER (k <> '') AS all_anchors
  FROM pages_raw p LEFT JOIN akey a ON a.page_id = p.page_id GROUP BY p.site
)
"""


def msgs(*rules: tuple[str, str]) -> str:
    """Messages joined by a bar; each rule is a condition and a SQL text."""
    cells = ", ".join(f"CASE WHEN {c} THEN {t} END" for c, t in rules)
    return f"array_to_string(list_distinct_keep([{cells}]), '|')".replace("list_distinct_keep(", "list_filter(").replace("])", "], lambda x: x IS NOT NULL)", 1)


def grade_of(x: str) -> str:
    return f"CASE WHEN {x} >= 90 THEN 'A' WHEN {x} >= 80 THEN 'B' WHEN {x} >= 70 THEN 'C' WHEN {x} >= 60 THEN 'D' ELSE 'F' END"


def label_of(x: str) -> str:
    return f"CASE WHEN {x} >= 90 THEN 'Excellent' WHEN {x} >= 80 THEN 'Good' WHEN {x} >= 70 THEN 'Fair' WHEN {x} >= 60 THEN 'Needs Work' ELSE 'Critical' END"


def clamp(x: str) -> str:
    return f"greatest(0.0::DOUBLE, least(100.0::DOUBLE, {x}))"


def pts(*rules: tuple[str, float]) -> str:
    return "(" + " + ".join(f"CASE WHEN {c} THEN {float(p)}::DOUBLE ELSE 0.0::DOUBLE END" for c, p in rules) + ")"


def norm(raw: str, most: float) -> str:
    return round2(clamp(f"({raw}) / {float(most)}::DOUBLE * 100.0::DOUBLE"))


def weighted(cols: dict[str, str]) -> str:
    total = "0.0::DOUBLE"
    for name, weight in literals.PILLAR_WEIGHTS.items():
        total = f"({total} + {clamp(cols[name])} * {weight}::DOUBLE)"
    return round2(clamp(total))


def has_term(x: str, term: str) -> str:
    return f"coalesce(list_contains(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+'), {term}), FALSE)"


# The text blocks read documents; here they read the page texts under the same names.
PAGE_PLAIN = PLAIN.replace("d AS (SELECT doc_id, text FROM documents)", "d AS (SELECT page_id AS doc_id, page_text AS text FROM ptext)")
PAGE_TEXTS = f"""
ptext AS (
  SELECT f.page_id, CASE WHEN {collapse('text_content')} <> '' THEN {collapse('text_content')} ELSE {collapse('''concat_ws(' ', title, meta_description,
    (SELECT string_agg(text, ' ' ORDER BY tag, pos) FROM el WHERE el.page_id = f.page_id AND tag[1] = 'h'),
    (SELECT string_agg(alt, ' ' ORDER BY pos) FROM image i WHERE i.page_id = f.page_id),
    (SELECT string_agg(text, ' ' ORDER BY internal DESC, pos) FROM link l WHERE l.page_id = f.page_id))''')} END AS page_text
  FROM fact2 f
)
"""


def score_input(whole_site: bool = True) -> str:
    dup = "count(*) OVER (PARTITION BY f.site, left(t.page_text, 200)) > 1" if whole_site else "FALSE"
    return f"""
ease AS (
  SELECT pw.doc_id AS page_id, CASE WHEN len(ws) = 0 THEN 0.0::DOUBLE ELSE {clamp('''206.835::DOUBLE - 1.015::DOUBLE * (len(ws)::DOUBLE / sentences::DOUBLE)
    - 84.6::DOUBLE * (syllables::DOUBLE / len(ws)::DOUBLE)''')} END AS flesch
  FROM pw JOIN sc USING (doc_id) LEFT JOIN syl USING (doc_id)
),
phr AS (SELECT doc_id AS page_id, string_agg(phrase, ', ' ORDER BY rank) FILTER (rank <= 3) AS phrases FROM phrase WHERE rank <= 5 GROUP BY doc_id),
img AS (
  SELECT page_id, count(*) AS n, count(*) FILTER (trim(alt) <> '') AS alts, count(*) FILTER (regexp_matches(trim(alt), {q(literals.FILENAME_ALT_RE)})) AS file_alts,
    count(*) FILTER (alt <> '' AND length(trim(alt)) < 5) AS short_alts, count(*) FILTER (lower(loading) = 'lazy') AS lazy_n,
    count(*) FILTER (regexp_matches(string_split(lower(src), '?')[1], '\\.(webp|avif)$')) AS modern
  FROM image GROUP BY page_id
),
si AS (
  SELECT f.*, m.primary_keyword, m.https, m.has_robots, m.has_sitemap, m.load_time AS meta_load,
    lower(coalesce(nullif(m.primary_keyword, ''), k.word, '')) AS key, coalesce(k.word, '') AS own, coalesce(k.density, 0.0::DOUBLE) AS own_density,
    coalesce((SELECT max(density) FROM keyword x WHERE x.page_id = f.page_id), 0.0::DOUBLE) AS densest,
    t.page_text, e.flesch, p.phrases, t.page_text <> '' AND {dup} AS duplicated,
    coalesce((SELECT count(*) FROM broken b WHERE b.page_id = f.page_id), 0) AS broken_n,
    coalesce(i.n, 0) AS img_n, coalesce(i.alts, 0) AS alt_n, coalesce(i.file_alts, 0) AS file_alts, coalesce(i.short_alts, 0) AS short_alts,
    coalesce(i.lazy_n, 0) = coalesce(i.n, 0) AS lazy, coalesce(i.modern, 0) > 0 AS modern,
    coalesce(list_contains(f.tags, 'nav'), FALSE) OR coalesce(list_contains(f.tags, 'main'), FALSE) AS landmark,
    coalesce(f.viewport, '') <> '' AS view,
    coalesce((SELECT string_agg(text, ' ' ORDER BY pos) FROM el WHERE el.page_id = f.page_id AND tag = 'h1'), '') AS h1_text,
    (SELECT count(*) FROM meta x WHERE x.page_id = f.page_id AND starts_with(name, 'twitter:')) > 0 AS card,
    (SELECT count(DISTINCT property) FROM meta x WHERE x.page_id = f.page_id AND property IN ('og:title', 'og:description', 'og:image') AND content <> '') = 3 AS og,
    EXISTS (SELECT 1 FROM tag_attr x WHERE x.page_id = f.page_id AND x.tag = 'script' AND x.type = 'application/ld+json'
      AND json_valid(trim(regexp_replace(regexp_replace(x.raw, '(?s)^<(?:[^"''>]|"[^"]*"|''[^'']*'')*>', ''), '(?i)</script\\s*>$', '')))) AS ld,
    regexp_matches(f.page_html, '(?i)style\\s*=\\s*[\"''][^\"'']*(?:color\\s*:|background(?:-color)?\\s*:)') AS color,
    CAST(len(list_intersect(coalesce(f.tags, []), {in_list(literals.SEMANTIC_TARGETS).replace('(', '[').replace(')', ']')})) AS DOUBLE) / 6.0::DOUBLE AS share,
    coalesce(nullif(f.load_time, 0), nullif(m.load_time, 0), 0.0::DOUBLE) AS seconds,
    coalesce(m.https, starts_with(f.url, 'https://')) AS secure, coalesce(m.has_robots, FALSE) AS robots, coalesce(m.has_sitemap, FALSE) AS sitemap,
    coalesce(len(f.levels), 0) > 0 AND NOT f.level_gap AS ordered
  FROM fact2 f LEFT JOIN site_meta m USING (site) LEFT JOIN keyword k ON k.page_id = f.page_id AND k.rank = 1
  JOIN ptext t ON t.page_id = f.page_id JOIN ease e ON e.page_id = f.page_id LEFT JOIN phr p ON p.page_id = f.page_id LEFT JOIN img i ON i.page_id = f.page_id
),
si2 AS (SELECT *, length(trim(title)) AS n, length({strip('meta_description')}) AS d, key <> '' AS known,
  key <> '' AND {has_term('title', 'key')} AS in_title, key <> '' AND {has_term('meta_description', 'key')} AS in_meta,
  key <> '' AND {has_term('h1_text', 'key')} AS in_h1, own <> '' AND own_density BETWEEN 0.5 AND 3.0 AS balanced FROM si)
"""


Q = q
ON_PAGE_RAW = pts(
    ("n > 0", 10), ("n BETWEEN 50 AND 60", 5), ("in_title", 5), ("d > 0", 10), ("d BETWEEN 120 AND 160", 5), ("in_meta", 5),
    ("h1_count >= 1", 10), ("h1_count = 1", 5), ("in_h1", 5), ("ordered", 10), ("canonical_url <> ''", 5), ("ld", 5), ("og", 5),
    ("card", 5), ("densest <= 3.0", 5),
)
ON_PAGE_ISSUES = msgs(
    ("n = 0", Q("Missing title tag")),
    ("n > 0 AND n NOT BETWEEN 50 AND 60", "'Title length is ' || n || ' characters; target 50-60'"),
    ("known AND NOT in_title", Q("Title does not include the primary keyword")),
    ("d = 0", Q("Missing meta description")),
    ("d > 0 AND d NOT BETWEEN 120 AND 160", "'Meta description length is ' || d || ' characters; target 120-160'"),
    ("known AND NOT in_meta", Q("Meta description does not include the primary keyword")),
    ("h1_count = 0", Q("Missing H1 heading")),
    ("h1_count > 1", "'Page has ' || h1_count || ' H1 headings; use only one'"),
    ("known AND NOT in_h1", Q("H1 does not include the primary keyword")),
    ("NOT ordered", Q("Heading hierarchy appears to skip levels")),
    ("canonical_url = ''", Q("Canonical tag is missing")),
    ("NOT ld", Q("Structured data / JSON-LD not detected")),
    ("NOT og", Q("Open Graph tags are incomplete")),
    ("NOT card", Q("Twitter card metadata is missing")),
    ("densest > 3.0", "'Keyword density peaks at ' || printf('%.2f', densest) || '%, which suggests stuffing'"),
)
ON_PAGE_PASSED = msgs(
    ("n > 0", Q("Title tag is present")),
    ("n BETWEEN 50 AND 60", Q("Title length is within the optimal 50-60 character range")),
    ("in_title", "'Title includes the primary keyword ''' || key || ''''"),
    ("d > 0", Q("Meta description is present")),
    ("d BETWEEN 120 AND 160", Q("Meta description length is within the optimal 120-160 character range")),
    ("in_meta", Q("Meta description includes the primary keyword")),
    ("h1_count >= 1", Q("At least one H1 heading is present")),
    ("h1_count = 1", Q("Page uses a single H1 heading")),
    ("in_h1", Q("H1 includes the primary keyword")),
    ("ordered", Q("Heading hierarchy does not skip levels")),
    ("canonical_url <> ''", Q("Canonical tag is present")),
    ("ld", Q("Structured data / JSON-LD is present")),
    ("og", Q("Open Graph title, description, and image are present")),
    ("card", Q("Twitter card metadata is present")),
    ("densest <= 3.0", Q("Keyword density does not indicate stuffing")),
)
VERY, GOOD, FAIR = "flesch BETWEEN 70 AND 80", "(flesch >= 60 AND flesch < 70)", "(flesch >= 40 AND flesch < 60)"
CONTENT_RAW = pts(
    ("word_count >= 300", 15), ("word_count < 300", -15), ("word_count >= 600", 10), ("word_count >= 1200", 5), (VERY, 20), (GOOD, 15),
    (FAIR, 10), ("balanced", 10), ("NOT balanced", -10), ("phrases IS NOT NULL", 10), ("duplicated", -10),
)
SHOWN = "printf('%.1f', flesch)"
CONTENT_ISSUES = msgs(
    ("word_count < 300", "'Thin content detected: ' || word_count || ' words'"),
    (f"NOT ({VERY} OR {GOOD} OR {FAIR})", f"'Readability is outside the preferred range (Flesch ' || {SHOWN} || ')'"),
    ("NOT balanced AND own <> ''", "'Primary keyword density is ' || printf('%.2f', own_density) || '% for ''' || own || ''''"),
    ("NOT balanced AND own = ''", Q("Primary keyword density could not be validated")),
    ("phrases IS NULL", Q("No repeated 2-4 word long-tail phrases were detected")),
    ("duplicated", Q("Opening content appears duplicated across multiple pages")),
)
CONTENT_PASSED = msgs(
    ("word_count >= 300", Q("Content meets the 300-word minimum")),
    ("word_count >= 600", Q("Content exceeds 600 words")),
    ("word_count >= 1200", Q("Content exceeds 1,200 words")),
    (VERY, f"'Readability is very good (Flesch ' || {SHOWN} || ')'"),
    (GOOD, f"'Readability is good (Flesch ' || {SHOWN} || ')'"),
    (FAIR, f"'Readability is fair (Flesch ' || {SHOWN} || ')'"),
    ("balanced", "'Primary keyword density is balanced at ' || printf('%.2f', own_density) || '%'"),
    ("phrases IS NOT NULL", "'Long-tail opportunities found: ' || phrases"),
    ("NOT duplicated", Q("Opening content appears unique across crawled pages")),
)
TECH_RAW = pts(
    ("secure", 15), ("robots", 10), ("sitemap", 10), ("broken_n = 0", 15), ("seconds <> 0 AND seconds < 3.0", 15),
    ("seconds <> 0 AND seconds < 1.5", 5), ("view", 15), ("lazy", 10),
)
TECH_ISSUES = msgs(
    ("NOT secure", Q("HTTPS is not enabled")), ("NOT robots", Q("robots.txt presence not confirmed")),
    ("NOT sitemap", Q("sitemap.xml presence not confirmed")),
    ("broken_n > 0", "broken_n || ' broken link(s) were reported for this page'"),
    ("seconds <> 0 AND seconds >= 3.0", "'Load time is ' || printf('%.2f', seconds) || 's; target under 3 seconds'"),
    ("seconds = 0", Q("Load time data was not provided")), ("NOT view", Q("Viewport meta tag is missing")),
    ("NOT lazy", Q("Images are missing lazy loading")),
)
TECH_PASSED = msgs(
    ("secure", Q("HTTPS is enabled")), ("robots", Q("robots.txt is present")), ("sitemap", Q("sitemap.xml is present")),
    ("broken_n = 0", Q("No broken links were reported for this page")),
    ("seconds <> 0 AND seconds < 3.0", "'Load time is under 3 seconds (' || printf('%.2f', seconds) || 's)'"),
    ("seconds <> 0 AND seconds < 1.5", Q("Load time is under 1.5 seconds")), ("view", Q("Viewport meta tag is present")),
    ("lazy", Q("Images use lazy loading")),
)
MOBILE = "(view AND (landmark OR modern OR lazy))"
UX_RAW = (
    pts(
        ("alt_n = img_n", 15), ("file_alts = 0", 10), ("short_alts = 0", 10), ("NOT color", 5), ("modern OR img_n = 0", 10), ("view", 10),
        (MOBILE, 10),
    )
    + " + share * 20.0::DOUBLE"
)
UX_ISSUES = msgs(
    ("alt_n <> img_n", Q("Some images are missing alt text")),
    ("file_alts > 0", "'Filename-like alt text found on ' || file_alts || ' image(s)'"),
    ("short_alts > 0", "'Alt text is too short on ' || short_alts || ' image(s)'"),
    ("color", Q("Inline color styles were found; review contrast carefully")),
    ("share < 0.66", Q("Semantic HTML5 structure is limited")),
    ("img_n > 0 AND NOT modern", Q("Modern image formats (.webp or .avif) were not detected")),
    ("NOT view", Q("Viewport meta tag is missing")),
    (f"NOT {MOBILE}", Q("Few mobile-friendly implementation signals were detected")),
)
UX_PASSED = msgs(
    ("img_n > 0 AND alt_n = img_n", Q("All images have non-empty alt text")),
    ("img_n = 0", Q("No images require alt text checks")),
    ("file_alts = 0", Q("Image alt text avoids filename-like placeholders")),
    ("short_alts = 0", Q("Image alt text is descriptive in length")),
    ("NOT color", Q("Inline color styles were not detected")),
    ("share >= 0.66", Q("Semantic HTML5 structure is strong")),
    ("img_n > 0 AND modern", Q("Modern image formats are in use")),
    ("img_n = 0", Q("No legacy image assets were detected")),
    ("view", Q("Viewport meta tag is present")),
    (MOBILE, Q("Page shows mobile-friendly implementation signals")),
)
PVAR = "((CASE WHEN all_anchors > 0 THEN distinct_anchors::DOUBLE / all_anchors::DOUBLE ELSE 1.0 END) >= 0.5 AND distinct_anchors >= 2)"
PLINK_RAW = "80.0::DOUBLE - 5.0::DOUBLE * bad_anchors + " + pts(("unprotected = 0", 10), (PVAR, 10))
PLINK_ISSUES = msgs(
    ("bad_anchors > 0", "'Weak anchor text found on ' || bad_anchors || ' link(s)'"),
    ("unprotected > 0", "unprotected || ' external link(s) are missing rel protection'"),
    (f"NOT {PVAR}", Q("Anchor text variety is limited")), ("inside = 0", Q("Page has no internal links")),
)
PLINK_PASSED = msgs(
    ("bad_anchors = 0", Q("Anchor text avoids generic phrases")), ("unprotected = 0", Q("External links use rel protection")),
    (PVAR, Q("Anchor text variety is healthy")), ("inside > 0", "'Page includes ' || inside || ' internal link(s)'"),
)


def pillar_block(name: str, source: str, raw: str, most: float, issues: str, passed: str, key: str = "page_id") -> str:
    return f"""{name} AS (
  SELECT {key}, score, {grade_of('score')} AS grade, issues, passed FROM (
    SELECT {key}, {norm(raw, most)} AS score, {issues} AS issues, {passed} AS passed FROM {source}))"""


P_ON = pillar_block("p_on", "si2", ON_PAGE_RAW, 85, ON_PAGE_ISSUES, ON_PAGE_PASSED)
P_CONTENT = pillar_block("p_content", "si2", CONTENT_RAW, 75, CONTENT_ISSUES, CONTENT_PASSED)
P_TECH = pillar_block("p_tech", "si2", TECH_RAW, 95, TECH_ISSUES, TECH_PASSED)
P_UX = pillar_block("p_ux", "si2", UX_RAW, 90, UX_ISSUES, UX_PASSED)
P_LINKS = pillar_block("p_links", "page_anchor", PLINK_RAW, 100, PLINK_ISSUES, PLINK_PASSED)

SITE_TECH = f"""
st0 AS (
  SELECT f.site, count(*) AS n, bool_and(f.url = '' OR starts_with(f.url, 'https://')) AS all_https,
    sum((SELECT count(*) FROM broken b WHERE b.page_id = f.page_id)) AS broken_n,
    sum(CAST(round_even(f.load_time * 1000000.0, 0) AS BIGINT)) AS load_sum, count(f.load_time) AS load_n,
    count(*) FILTER (coalesce(f.viewport, '') <> '') AS view_n,
    count(*) FILTER (NOT EXISTS (SELECT 1 FROM image i WHERE i.page_id = f.page_id AND lower(i.loading) <> 'lazy')) AS lazy_n
  FROM fact2 f GROUP BY f.site
),
st AS (
  SELECT s.site, CAST(s.broken_n AS BIGINT) AS broken_n, coalesce(m.https, s.all_https) AS secure, coalesce(m.has_robots, FALSE) AS robots, coalesce(m.has_sitemap, FALSE) AS sitemap,
    coalesce(nullif(m.load_time, 0), s.load_sum::DOUBLE / nullif(s.load_n, 0)::DOUBLE / 1000000.0::DOUBLE, 0.0::DOUBLE) AS seconds,
    s.view_n::DOUBLE / s.n::DOUBLE AS view, s.lazy_n::DOUBLE / s.n::DOUBLE AS lazy
  FROM st0 s LEFT JOIN site_meta m USING (site)
)
"""
ST_RAW = (
    pts(("secure", 15), ("robots", 10), ("sitemap", 10), ("broken_n = 0", 15), ("seconds < 3.0", 15), ("seconds < 1.5", 5))
    + " + view * 15.0::DOUBLE + lazy * 10.0::DOUBLE"
)


def pct(x: str) -> str:
    return f"CAST(round_even({x} * 100.0::DOUBLE, 0) AS BIGINT) || '%'"


ST_ISSUES = msgs(
    ("NOT secure", Q("HTTPS is not enabled across the site")), ("NOT robots", Q("robots.txt was not detected")),
    ("NOT sitemap", Q("sitemap.xml was not detected")), ("broken_n > 0", "broken_n || ' broken link(s) were reported'"),
    ("seconds >= 3.0", "'Average load time is ' || printf('%.2f', seconds) || 's; target under 3 seconds'"),
    ("view > 0 AND view < 1", f"'Viewport meta tag is missing on some pages (' || {pct('view')} || ' coverage)'"),
    ("view = 0", Q("Viewport meta tag is missing on all pages")),
    ("lazy > 0 AND lazy < 1", f"'Lazy loading is inconsistent across pages (' || {pct('lazy')} || ' coverage)'"),
    ("lazy = 0", Q("Images are not using lazy loading")),
)
ST_PASSED = msgs(
    ("secure", Q("HTTPS is enabled")), ("robots", Q("robots.txt is present")), ("sitemap", Q("sitemap.xml is present")),
    ("broken_n = 0", Q("No broken links were reported")),
    ("seconds < 3.0", "'Average load time is under 3 seconds (' || printf('%.2f', seconds) || 's)'"),
    ("seconds < 1.5", Q("Average load time is under 1.5 seconds")),
    ("view = 1", Q("Viewport meta tag is present on all scored pages")),
    ("lazy = 1", Q("Images use lazy loading across all scored pages")),
)
P_SITE_TECH = pillar_block("p_site_tech", "st", ST_RAW, 95, ST_ISSUES, ST_PASSED, "site")

SLV = "((CASE WHEN all_anchors > 0 THEN distinct_anchors::DOUBLE / all_anchors::DOUBLE ELSE 1.0 END) >= 0.5 AND distinct_anchors >= 3)"
SHARE = "(shallow::DOUBLE / nodes::DOUBLE)"
SL_RAW = "100.0::DOUBLE - 10.0::DOUBLE * orphans - 5.0::DOUBLE * deep - 5.0::DOUBLE * bad_anchors + " + pts(
    (f"{SHARE} >= 0.8", 10), ("unprotected = 0", 10), (SLV, 10)
)
SL_ISSUES = msgs(
    ("orphans > 0", "'Orphan pages detected: ' || orphans"),
    (f"{SHARE} < 0.8", f"'Only ' || {pct(SHARE)} || ' of pages are within two clicks of the homepage'"),
    ("deep > 0", "'Deep pages detected beyond click depth 3: ' || deep"),
    ("bad_anchors > 0", "'Weak anchor text found on ' || bad_anchors || ' link(s)'"),
    ("unprotected > 0", "unprotected || ' external link(s) are missing rel protection'"),
    (f"NOT {SLV}", Q("Anchor text variety is limited")),
)
SL_PASSED = msgs(
    ("orphans = 0", Q("No orphan pages were detected")),
    (f"{SHARE} >= 0.8", Q("Most pages are reachable within two clicks of the homepage")),
    ("deep = 0", Q("No pages exceed click depth 3")), ("bad_anchors = 0", Q("Anchor text avoids generic phrases like 'click here'")),
    ("unprotected = 0", Q("External links use safe rel attributes")), (SLV, Q("Anchor text variety is healthy")),
)
P_SITE_LINKS = "sl AS (SELECT * FROM site_anchor JOIN position_count USING (site)),\n" + pillar_block(
    "p_site_links", "sl", SL_RAW, 100, SL_ISSUES, SL_PASSED, "site"
)

_alias_rows = ", ".join(
    f"({q(n)}, {i}, {q(lbl)}, {o}, {w}::DOUBLE, {q(sc)})"
    for o, (lbl, names, w, sc) in enumerate(literals.METRICS)
    for i, n in enumerate(names)
)
AUTHORITY = f"""
alias AS (SELECT * FROM (VALUES {_alias_rows}) AS v(metric, alias_ord, label, ord, weight, scale)),
resolved AS (
  SELECT domain, provider, priority, label, ord, weight, scale, min_by(value, alias_ord) AS value
  FROM authority_metrics JOIN alias USING (metric) WHERE value IS NOT NULL GROUP BY ALL
),
normal AS (
  SELECT *, CASE scale WHEN 'plain' THEN {clamp('value')} WHEN 'log4' THEN {clamp('log10(greatest(0.0, value) + 1) / 4.0::DOUBLE * 100.0::DOUBLE')}
    WHEN 'log3' THEN {clamp('log10(greatest(0.0, value) + 1) / 3.0::DOUBLE * 100.0::DOUBLE')}
    ELSE CASE WHEN value <= 0 THEN 0.0 ELSE {clamp('100.0::DOUBLE - log10(value) / 7.0::DOUBLE * 100.0::DOUBLE')} END END AS x FROM resolved
),
chosen AS (
  SELECT * FROM normal n WHERE priority = (SELECT min(priority) FROM resolved r WHERE r.domain = n.domain)
),
auth AS (
  SELECT s.site AS domain, any_value(c.provider) AS provider, count(c.label) = 0 AS educational_mode,
    CASE WHEN count(c.label) = 0 THEN 50.0::DOUBLE ELSE
      list_reduce(list(c.x * c.weight ORDER BY c.ord), lambda a, b: a + b) / list_reduce(list(c.weight ORDER BY c.ord), lambda a, b: a + b) END AS raw
  FROM (SELECT DISTINCT site FROM pages_raw) s LEFT JOIN chosen c ON c.domain = s.site GROUP BY s.site
),
auth_msg AS (
  SELECT a.domain, a.provider, a.educational_mode, a.raw, {round2(clamp('a.raw'))} AS score, {grade_of('a.raw')} AS grade,
    CASE WHEN a.educational_mode THEN {q(literals.NEUTRAL_ISSUE)} ELSE coalesce((SELECT string_agg(CASE WHEN c.label IS NULL THEN l.label || ' was not provided' ELSE l.label || ' is weak' END, '|' ORDER BY l.ord)
      FROM (SELECT DISTINCT label, ord FROM alias) l LEFT JOIN chosen c ON c.label = l.label AND c.domain = a.domain WHERE c.label IS NULL OR c.x < 40), '') END AS issues,
    CASE WHEN a.educational_mode THEN {q(literals.NEUTRAL_PASSED)} ELSE coalesce((SELECT string_agg(c.label || ' is strong', '|' ORDER BY c.ord) FROM chosen c WHERE c.domain = a.domain AND c.x >= 70), '') END AS passed
  FROM auth a
)
"""

PAGE_SCORE = f"""
ps AS (
  SELECT si2.page_id, si2.site, p_on.score AS on_page_seo, p_content.score AS content_quality, p_tech.score AS technical_seo,
    a.score AS authority, p_ux.score AS ux_design, p_links.score AS links_architecture
  FROM si2 JOIN p_on USING (page_id) JOIN p_content USING (page_id) JOIN p_tech USING (page_id) JOIN p_ux USING (page_id)
  JOIN p_links USING (page_id) JOIN auth_msg a ON a.domain = si2.site
),
page_score AS (SELECT *, {weighted({n: n for n in literals.PILLAR_WEIGHTS})} AS overall FROM ps)
"""


def blend(site: str, page: str) -> str:
    return round2(clamp(f"{site} * 0.7::DOUBLE + {page} * 0.3::DOUBLE"))


def mean_cents(col: str) -> str:
    return f"(sum(CAST(round_even({col} * 100.0::DOUBLE, 0) AS BIGINT))::DOUBLE / count(*)::DOUBLE / 100.0::DOUBLE)"


SITE_SCORE = f"""
means AS (SELECT site, count(*) AS pages, {', '.join(f'{mean_cents(n)} AS {n}' for n in literals.PILLAR_WEIGHTS if n != 'authority')} FROM page_score GROUP BY site),
ss AS (
  SELECT m.site, m.pages, {round2('m.on_page_seo')} AS on_page_seo, {round2('m.content_quality')} AS content_quality,
    {blend('t.score', 'm.technical_seo')} AS technical_seo, a.score AS authority, {round2('m.ux_design')} AS ux_design,
    {blend('l.score', 'm.links_architecture')} AS links_architecture
  FROM means m JOIN p_site_tech t USING (site) JOIN p_site_links l USING (site) JOIN auth_msg a ON a.domain = m.site
),
site_score AS (SELECT *, {weighted({n: n for n in literals.PILLAR_WEIGHTS})} AS overall FROM ss)
"""

CORE = (*PAGE, BROKEN, ANCHORS)
SCORE = (*CORE, PAGE_TEXTS, PAGE_PLAIN, LONG_TAIL, score_input())
SCORE_ALONE = (*CORE, PAGE_TEXTS, PAGE_PLAIN, LONG_TAIL, score_input(False))
PILLARS = (P_ON, P_CONTENT, P_TECH, P_UX, P_LINKS)

# The quality gate checks all links of a page, each address once.
BROKEN_ONCE = "broken_once AS (SELECT page_id, target, min(rank) AS rank FROM broken GROUP BY page_id, target)"


def single_score(broken: str) -> str:
    return f"""
seo AS (
  SELECT f.page_id, f.site, f.url, f.fetched, f.title, f.first_description, f.h1_count, f.image_count, f.missing_alt_count, f.internal_count, f.external_count,
    (SELECT count(*) FROM {broken} b WHERE b.page_id = f.page_id) AS broken_count, f.tags FROM fact2 f
),
seo_score AS (
  SELECT *, CAST(greatest(0, 100
    - CASE WHEN title = '' THEN 15 WHEN length(title) < 30 OR length(title) > 60 THEN 5 ELSE 0 END
    - CASE WHEN coalesce(first_description, '') = '' THEN 15 WHEN length(first_description) < 120 OR length(first_description) > 160 THEN 5 ELSE 0 END
    - CASE WHEN h1_count = 0 THEN 10 WHEN h1_count > 1 THEN 5 ELSE 0 END
    - CASE WHEN image_count = 0 THEN 0 WHEN (image_count - missing_alt_count)::DOUBLE / image_count < 0.5 THEN 10
           WHEN (image_count - missing_alt_count)::DOUBLE / image_count < 0.8 THEN 5 ELSE 0 END
    - least(broken_count * 5, 20) - CASE WHEN coalesce(list_contains(tags, 'main'), FALSE) THEN 0 ELSE 5 END) AS BIGINT) AS seo_score
  FROM seo
)
"""

SINGLE_SCORE = single_score("broken50")
PLAIN_COUNT = f"""bw AS (SELECT page_id, count(*) AS n FROM (
  SELECT page_id, unnest(regexp_extract_all(lower(body_text), {q(literals.WORD_RE)})) AS word FROM body) WHERE regexp_matches(word, '^[a-z]{{3,}}$') GROUP BY page_id)"""


def summary(broken: str, where: str) -> str:
    return f"""summ AS (
  SELECT f.site, count(*) AS total_pages_analyzed, CAST(sum(image_count) AS BIGINT) AS total_images, CAST(sum(missing_alt_count) AS BIGINT) AS images_without_alt,
    CAST(sum(internal_count) AS BIGINT) AS total_internal_links, CAST(sum(external_count) AS BIGINT) AS total_external_links,
    CAST({broken} AS BIGINT) AS broken_links_found, CAST(floor(sum(word_count)::DOUBLE / count(*)) AS BIGINT) AS avg_word_count
  FROM fact2 f WHERE {where} GROUP BY f.site)"""


BROKEN10_SUM = "sum((SELECT count(*) FROM broken10 b WHERE b.page_id = f.page_id))"


def counts(broken: str, where: str) -> str:
    return f"""cnt AS (
  SELECT f.site, count(*) AS pages, count(*) FILTER (NOT has_title) AS no_title, count(*) FILTER (NOT has_meta_description) AS no_description,
    count(*) FILTER (h1_count > 1) AS many_h1, count(*) FILTER (h1_count = 0) AS no_h1, CAST(sum(image_count) AS BIGINT) AS images,
    CAST(sum(missing_alt_count) AS BIGINT) AS no_alt, CAST({broken} AS BIGINT) AS broken,
    count(*) FILTER (coalesce(semantic_count, 0) < 3) AS few_semantic, sum(word_count)::DOUBLE / count(*)::DOUBLE AS mean,
    sum(external_count)::DOUBLE / count(*)::DOUBLE AS external, count(*) FILTER (a.score >= 80) AS accessible
  FROM fact2 f JOIN a11y_score a USING (page_id) WHERE {where} GROUP BY f.site)"""


PLATFORM_LISTS = {
    "critical": msgs(("no_title > 0", "no_title || ' page(s) missing title tags. Add unique, descriptive titles to all pages.'")),
    "warnings": msgs(
        ("no_description > 0", "no_description || ' page(s) missing meta descriptions. Add compelling descriptions (150-160 characters).'"),
        ("many_h1 > 0", "many_h1 || ' page(s) have multiple H1 tags. Use only one H1 per page.'"),
        ("no_h1 > 0", "no_h1 || ' page(s) missing H1 tags. Add a primary H1 heading to each page.'"),
        ("no_alt > 0", "no_alt || ' out of ' || images || ' images missing alt text. Add descriptive alt text for accessibility.'"),
    ),
    "recommendations": msgs(
        ("mean < 300", "'Average page word count is ' || CAST(floor(mean) AS BIGINT) || '. Consider adding more quality content (aim for 300+ words).'")
    ),
    "positive": msgs(
        ("mean >= 300", "'Good content depth with average ' || CAST(floor(mean) AS BIGINT) || ' words per page.'"),
        ("accessible > pages * 0.8", "accessible || ' out of ' || pages || ' pages have good accessibility scores.'"),
    ),
}
CRAWL_LISTS = {
    "critical": msgs(
        ("no_title > 0", "no_title || ' page(s) missing title tags. Add unique, descriptive titles to all pages.'"),
        ("broken > 0", "'Found ' || broken || ' potentially broken link(s). Fix or remove broken links to improve user experience and SEO.'"),
    ),
    "warnings": msgs(
        ("no_description > 0", "no_description || ' page(s) missing meta descriptions. Add compelling descriptions (150-160 characters) to improve click-through rates.'"),
        ("many_h1 > 0", "many_h1 || ' page(s) have multiple H1 tags. Use only one H1 per page for better SEO.'"),
        ("no_h1 > 0", "no_h1 || ' page(s) missing H1 tags. Add a primary H1 heading to each page.'"),
        ("no_alt > 0", "no_alt || ' out of ' || images || ' images missing alt text. Add descriptive alt text for accessibility and SEO.'"),
    ),
    "recommendations": msgs(
        ("few_semantic > 0", "few_semantic || ' page(s) use limited semantic HTML5 elements. Use elements like <header>, <nav>, <main>, <article> for better structure.'"),
        ("mean < 300", "'Average page word count is ' || CAST(floor(mean) AS BIGINT) || '. Consider adding more quality content (aim for 300+ words per page).'"),
        ("external < 2", "'Consider adding more authoritative external links to improve content credibility.'"),
    ),
    "positive": msgs(("mean >= 300", "'Good content depth with average ' || CAST(floor(mean) AS BIGINT) || ' words per page.'")),
}


def insight_select(lists: dict[str, str]) -> str:
    return "SELECT site, " + ", ".join(f"{v} AS {k}" for k, v in lists.items()) + " FROM cnt"


def list_count(x: str) -> str:
    return f"CAST(CASE WHEN {x} = '' THEN 0 ELSE len(string_split({x}, '|')) END AS BIGINT)"


INSIGHT = (*PAGE, A11Y, counts("0", "fetched"), f"insight AS ({insight_select(PLATFORM_LISTS)})")
CRIT, WARN, RECS = (list_count(k) for k in ("critical", "warnings", "recommendations"))
FALLBACK = f"""fallback AS (
  SELECT site, CAST(greatest(0, 100 - {CRIT} * 15 - {WARN} * 6 - CASE WHEN avg_word_count >= 300 THEN 0 ELSE least(20, (300 - avg_word_count) // 15) END) AS BIGINT) AS seo,
    CAST(greatest(0, 100 - floor(images_without_alt::DOUBLE / greatest(1, total_images) * 45.0::DOUBLE) - CASE WHEN {WARN} > 0 THEN 10 ELSE 0 END) AS BIGINT) AS accessibility,
    CAST(greatest(0, 100 - CASE WHEN avg_word_count < 300 THEN 15 ELSE 0 END - least(25, {RECS} * 5)) AS BIGINT) AS content,
    CAST(greatest(0, 100 - broken_links_found * 12 - {CRIT} * 8) AS BIGINT) AS technical,
    CAST(least(100, 40 + total_external_links * 3) AS BIGINT) AS authority
  FROM summ JOIN insight USING (site)
),
fallback_score AS (SELECT *, CAST(round_even((seo + accessibility + content + technical + authority) / 5.0::DOUBLE, 0) AS BIGINT) AS overall FROM fallback)"""


def pillar_sql(block: str, name: str) -> str:
    return sql(f"SELECT page_id, score, grade, issues, passed FROM {name}", *SCORE, block, tables=ALL)


PAGE_PILLAR_MSG = " UNION ALL ".join(
    f"SELECT page_id, '{pillar}' AS pillar, '{kind}' AS kind, unnest(string_split({kind}, '|')) AS message, generate_subscripts(string_split({kind}, '|'), 1) - 1 AS i FROM {table} WHERE {kind} <> ''"
    for pillar, table in (("on_page_seo", "p_on"), ("content_quality", "p_content"), ("ux_design", "p_ux"))
    for kind in ("issues", "passed")
)

CRAWL = f"""
follow AS (
  SELECT l.site, {crawl_key('l.url')} AS src, l.pos, {crawl_key('l.absolute_url')} AS dst FROM link l JOIN pages_raw p USING (page_id)
  WHERE l.internal AND p.html <> '' AND lower({up('l.absolute_url', 1)}) IN ('http', 'https', '')
    AND NOT regexp_matches(lower({plain_path(up('l.absolute_url', 3))}), {q(literals.SKIPPED_EXTENSION_RE)})
),
path AS (
  SELECT s.site, 'https://' || s.site || '/p/0' AS url, CAST(0 AS BIGINT) AS depth, [CAST(0 AS BIGINT)] AS way FROM (SELECT DISTINCT site FROM pages_raw) s
  UNION ALL
  SELECT p.site, f.dst, p.depth + 1, list_append(p.way, f.pos)
  FROM path p JOIN follow f ON f.site = p.site AND f.src = p.url
  WHERE p.depth < 3 AND coalesce((SELECT min_by(r.allow, r.ord) FROM robots_rules r WHERE r.site = p.site AND r.agent = '*'
    AND starts_with({up('f.dst', 3)} || CASE WHEN {up('f.dst', 4)} <> '' THEN '?' || {up('f.dst', 4)} ELSE '' END, r.prefix)), TRUE)
),
seen AS (SELECT site, url, min(depth) AS depth, min_by(way, (depth, way)) AS way FROM path GROUP BY site, url),
crawl AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY depth, way) AS ord FROM seen)
"""

ORACLE = {
    "join_broken_links": sql("SELECT page_id, rank, target, status_code, text FROM broken", *CORE, tables=ALL),
    "join_broken_links_sampled": sql(
        "SELECT page_id, target, rank, 'ten' AS profile FROM broken10 UNION ALL SELECT page_id, target, rank, 'fifty' FROM broken50", *CORE, tables=ALL
    ),
    "join_edges": sql("SELECT site, src, dst FROM edge", *PAGE, GRAPH, tables=ALL),
    "join_alias_metrics": sql("SELECT domain, provider, label, value FROM resolved", AUTHORITY, tables=ALL),
    "join_provider_choice": sql(
        """SELECT s.site AS domain, any_value(c.provider) AS provider, count(c.label) = 0 AS educational_mode, count(c.label) AS metrics
        FROM (SELECT DISTINCT site FROM pages_raw) s LEFT JOIN chosen c ON c.domain = s.site GROUP BY s.site""",
        AUTHORITY, tables=ALL,
    ),
    "join_form_labels": sql(
        """SELECT DISTINCT f.page_id, f.id AS input_id FROM form_mark f WHERE f.tag <> 'form' AND f.kind = 'open' AND f.last_form = 'open' AND coalesce(f.id, '') <> ''
        AND NOT EXISTS (SELECT 1 FROM tag_attr l WHERE l.page_id = f.page_id AND l.tag = 'label' AND l.kind = 'open' AND l.for_id = f.id)""",
        *PAGE, A11Y,
    ),
    "agg_site_summary": sql("SELECT * FROM summ", *PAGE, summary("0", "fetched")),
    "agg_site_summary_crawl": sql("SELECT * FROM summ", *CORE, summary(BROKEN10_SUM, "TRUE"), tables=ALL),
    "agg_insights": sql("SELECT * FROM insight", *INSIGHT),
    "agg_insights_crawl": sql(insight_select(CRAWL_LISTS), *CORE, A11Y, counts(BROKEN10_SUM, "TRUE"), tables=ALL),
    "agg_insight_counts": sql(
        "SELECT site, " + ", ".join(f"{list_count(k)} AS {k}_count" for k in PLATFORM_LISTS) + " FROM insight", *INSIGHT
    ),
    "agg_suggestion_counts": sql(
        """SELECT page_id, CAST(CASE WHEN title = '' THEN 1 ELSE 0 END AS BIGINT) AS critical,
        CAST(CASE WHEN meta_description = '' THEN 1 ELSE 0 END + CASE WHEN h1_count = 0 THEN 1 ELSE 0 END + CASE WHEN missing_alt_count > 0 THEN 1 ELSE 0 END AS BIGINT) AS high,
        CAST(CASE WHEN h1_count > 1 THEN 1 ELSE 0 END + CASE WHEN word_count < 300 THEN 1 ELSE 0 END + CASE WHEN coalesce(load_time, 0) > 3 THEN 1 ELSE 0 END AS BIGINT) AS medium
        FROM fact2""",
        *PAGE,
    ),
    "agg_single_page_advice": sql(
        "SELECT site, concat_ws('|', nullif("
        + msgs(
            ("no_h1 > 0", "'Add H1 headings to ' || no_h1 || ' page(s) for better SEO and accessibility.'"),
            ("many_h1 > 0", "'Reduce to one H1 heading per page on ' || many_h1 || ' page(s).'"),
            ("no_alt > 0", "'Add alt text to ' || no_alt || ' images (' || printf('%.1f', no_alt::DOUBLE / images::DOUBLE * 100.0::DOUBLE) || '% of total) for accessibility and SEO.'"),
            ("broken > 0", "'Fix ' || broken || ' broken link(s) to improve user experience and SEO.'"),
            ("no_d > 0", "'Add meta descriptions to ' || no_d || ' page(s) to improve search result click-through rates.'"),
        )
        + ", ''), "
        + ", ".join(q(a) for a in GENERAL_ADVICE)
        + """) AS lines FROM (SELECT site, count(*) FILTER (fetched AND h1_count = 0) AS no_h1, count(*) FILTER (fetched AND h1_count > 1) AS many_h1,
        CAST(sum(image_count) FILTER (fetched) AS BIGINT) AS images, CAST(sum(missing_alt_count) FILTER (fetched) AS BIGINT) AS no_alt,
        CAST(sum(broken_count) FILTER (fetched) AS BIGINT) AS broken, count(*) FILTER (fetched AND first_description IS NULL) AS no_d FROM seo GROUP BY site)""",
        *CORE, SINGLE_SCORE, tables=ALL,
    ),
    "agg_single_page_summary": sql(
        """SELECT page_id, url, image_count, missing_alt_count, internal_count, external_count, broken_count, coalesce(n, 0) AS word_count, seo_score
        FROM seo_score LEFT JOIN bw USING (page_id) WHERE fetched""",
        *CORE, SINGLE_SCORE, BODY_TEXT, PLAIN_COUNT, tables=ALL,
    ),
    "agg_page_ratios": sql("SELECT site, seconds, view, lazy FROM st", *CORE, SITE_TECH, tables=ALL),
    "agg_anchor_stats": sql(
        f"SELECT *, {round2('(distinct_anchors::DOUBLE / all_anchors::DOUBLE)')} AS variety FROM site_anchor", *PAGE, ANCHORS
    ),
    "agg_page_anchor_stats": sql(
        "SELECT page_id, bad_anchors, unprotected, distinct_anchors, all_anchors, external_count FROM page_anchor", *PAGE, ANCHORS
    ),
    "agg_fallback_scores": sql("SELECT * FROM fallback_score", *INSIGHT, summary("0", "fetched"), FALLBACK),
    "agg_site_comparison": sql(
        """SELECT *, rank() OVER (ORDER BY seo_score DESC) AS score_rank FROM (
        SELECT site, min_by(url, page_id) AS url, min_by(seo_score, page_id) AS seo_score, min_by(word_count, page_id) AS word_count,
          min_by(missing_alt_count, page_id) AS missing_alt_count, min_by(broken_count, page_id) AS broken_count
        FROM (SELECT s.*, f.word_count FROM seo_score s JOIN fact2 f USING (page_id)) GROUP BY site)""",
        *CORE, SINGLE_SCORE, tables=ALL,
    ),
    "agg_pillar_messages": sql(
        f"""SELECT site, pillar, kind, message, count(*) AS pages, min(page_id) AS first_page, min_by(i, (page_id, i)) AS first_pos
        FROM ({PAGE_PILLAR_MSG}) JOIN pages_raw USING (page_id) GROUP BY site, pillar, kind, message""",
        *SCORE, *PILLARS, tables=ALL,
    ),
    "scr_on_page_seo": pillar_sql(P_ON, "p_on"),
    "scr_content_quality": pillar_sql(P_CONTENT, "p_content"),
    "scr_page_technical": pillar_sql(P_TECH, "p_tech"),
    "scr_ux_design": pillar_sql(P_UX, "p_ux"),
    "scr_page_links": sql("SELECT page_id, score, grade, issues, passed FROM p_links", *PAGE, ANCHORS, P_LINKS),
    "scr_grades": f"SELECT event_id, score, {grade_of('score')} AS grade, {label_of('score')} AS label FROM (SELECT event_id, {norm('value', 85)} AS score FROM events)",
    "scr_weighted": "SELECT event_id, "
    + weighted({n: f"(value + user_id % {10 + i})" for i, n in enumerate(literals.PILLAR_WEIGHTS)})
    + " AS overall FROM events",
    "scr_site_technical": sql("SELECT site, score, grade, issues, passed FROM p_site_tech", *CORE, SITE_TECH, P_SITE_TECH, tables=ALL),
    "scr_authority": sql("SELECT domain, provider, educational_mode, score, grade, issues, passed FROM auth_msg", AUTHORITY, tables=ALL),
    "scr_authority_metrics": sql(f"SELECT domain, provider, label, {round2('x')} AS normalised FROM normal", AUTHORITY, tables=ALL),
    "scr_site_links": sql(
        "SELECT site, score, grade, issues, passed FROM p_site_links", *PAGE, ANCHORS, GRAPH, P_SITE_LINKS, tables=ALL
    ),
    "scr_checks": sql(
        """SELECT page_id, coalesce(len(levels), 0) > 0 AND NOT level_gap AS valid_hierarchy,
        NOT EXISTS (SELECT 1 FROM image i WHERE i.page_id = f.page_id AND lower(i.loading) <> 'lazy') AS lazy FROM fact2 f""",
        *PAGE,
    ),
    "scr_page_scores": sql(
        f"SELECT page_id, overall, {grade_of('overall')} AS grade, {label_of('overall')} AS label, {', '.join(literals.PILLAR_WEIGHTS)} FROM page_score",
        *SCORE, *PILLARS, AUTHORITY, PAGE_SCORE, tables=ALL,
    ),
    "scr_single_page": sql(
        f"SELECT page_id, overall, {grade_of('overall')} AS grade, content_quality FROM page_score",
        *SCORE_ALONE, *PILLARS, AUTHORITY, PAGE_SCORE, tables=ALL,
    ),
    "scr_site_scores": sql(
        f"SELECT *, {grade_of('overall')} AS grade, {label_of('overall')} AS label FROM site_score",
        *SCORE, *PILLARS, AUTHORITY, PAGE_SCORE, SITE_TECH, P_SITE_TECH, GRAPH, P_SITE_LINKS, SITE_SCORE, tables=ALL,
    ),
    "scr_seo_score": sql("SELECT page_id, seo_score FROM seo_score", *CORE, SINGLE_SCORE, tables=ALL),
    "scr_quality_gate": sql(
        "SELECT page_id, failed = '' AS passed, failed FROM (SELECT page_id, "
        + msgs(
            ("seo_score < 70", "'SEO score ' || seo_score || ' is below minimum 70'"),
            ("broken_count > 0", "broken_count || ' broken link(s) found'"),
            ("title = ''", "'Missing title tag'"), ("coalesce(first_description, '') = ''", "'Missing meta description'"),
            ("h1_count = 0", "'Missing H1 heading'"),
        )
        + " AS failed FROM seo_score)",
        *CORE, BROKEN_ONCE, single_score("broken_once"), tables=ALL,
    ),
    "graph_in_degree": sql("SELECT site, node, in_degree FROM indeg", *PAGE, GRAPH, tables=ALL),
    "graph_homepage": sql("SELECT site, home FROM home", *PAGE, GRAPH, tables=ALL),
    "graph_click_depth": sql("SELECT site, node, depth FROM position", *PAGE, GRAPH, tables=ALL),
    "graph_positions": sql("SELECT * FROM position", *PAGE, GRAPH, tables=ALL),
    "graph_position_counts": sql("SELECT * FROM position_count", *PAGE, GRAPH, tables=ALL),
    "graph_crawl_order": sql(
        f"""SELECT c.site, c.url, c.ord, c.depth, EXISTS (SELECT 1 FROM pages_raw p WHERE p.site = c.site AND p.html <> '' AND {crawl_key('p.url')} = c.url) AS found
        FROM crawl c WHERE ord <= 50""",
        *PAGE, CRAWL, tables=ALL,
    ),
}
ORACLE["str_page_audit"] = ORACLE["scr_page_scores"]  # the stream ends with the scores of the batch job
