"""Oracle SQL for recommendations, reports, answers, jobs, sources and sets."""

from __future__ import annotations

from weftaudit.functions import advice
from weftaudit.functions.suggest import PLATFORM_HELP, RULE_TEXTS
from weftaudit.operators import qa, report
from weftaudit.oracle import literals
from weftaudit.oracle.base import PAGE, collapse, in_list, netloc, plain_path, q, round2, sql, strip, up
from weftaudit.oracle.site_sql import (
    ALL, AUTHORITY, CORE, FALLBACK, GRAPH, INSIGHT, P_SITE_LINKS, P_SITE_TECH, PAGE_SCORE, PILLARS, SCORE, SITE_SCORE, SITE_TECH,
    list_count, summary,
)
from weftaudit.oracle.text_sql import LABEL, SLUG, STUFF, TOPICS, limit, title_case

KINDS = report.KINDS


def split(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN CAST([] AS VARCHAR[]) ELSE string_split({x}, '|') END"


def help_of(rule: str) -> str:
    cells = PLATFORM_HELP.get(rule)
    if not cells:
        return "NULL"
    return "CASE cms_probable " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in cells.items()) + " END"


def suggestion(rule: str, cond: str, ord_: int, number: str | None = None, issue: str | None = None) -> str:
    priority, category, text, say, plain = RULE_TEXTS[rule]
    advice_sql = q(say)
    if number:
        before, after = say.split("{n}")
        advice_sql = f"{q(before)} || {number} || {q(after)}"
    return f"""SELECT page_id, {ord_} AS o, {q(priority)} AS priority, {q(category)} AS category, {issue or q(text)} AS issue,
      {advice_sql} AS suggestion, {q(plain)} AS plain_language, {help_of(rule)} AS platform_help FROM fact2 WHERE {cond}"""


SUGGESTIONS = " UNION ALL ".join(
    [
        suggestion("title", "title = ''", 0),
        suggestion("description", "meta_description = ''", 1),
        suggestion("no_h1", "h1_count = 0", 2),
        suggestion("many_h1", "h1_count > 1", 3),
        suggestion("alt", "missing_alt_count > 0", 4, issue=f"missing_alt_count || {q(RULE_TEXTS['alt'][2])}"),
        suggestion("thin", "word_count < 300", 5, number="word_count"),
        suggestion("slow", "coalesce(load_time, 0) > 3", 6, number="printf('%.2f', load_time)"),
    ]
)

SITE_NAME = f"""CASE WHEN {collapse('site_name')} <> '' THEN {collapse('site_name')} WHEN {netloc('url')} = '' THEN ''
  ELSE upper(({LABEL})[1]) || lower(({LABEL})[2:]) END"""


def title_text(place: str) -> str:
    """Expects topic (cased keyword), name and head42."""
    named = "concat_ws(' - ', nullif(head42, ''), nullif(name, ''))"
    placed = f"CASE WHEN {place} = '' THEN {named} WHEN {named} = '' THEN {place} ELSE {named} || ' | ' || {place} END"
    return f"coalesce(nullif({placed}, ''), topic)"


def fit(t: str) -> str:
    """Expects collapsed text."""
    n = len(advice.META_FILLER)
    cut = f"rtrim(regexp_replace(left({t}, 157), ' [^ ]*$', ''), ' ,.;:')"
    filled = f"rtrim(left({t} || repeat({q(advice.META_FILLER)}, CAST(ceil((150 - length({t})) / {float(n)}) AS INTEGER)), 160), ' ,.;:')"
    return f"""CASE WHEN length({t}) > 160 THEN {cut} || '...' WHEN length({t}) < 150 THEN
      left({filled} || CASE WHEN right({filled}, 1) IN ('.', '!', '?') THEN '' ELSE '.' END, 160) ELSE {t} END"""


FILE = f"{strip(f'''regexp_replace(regexp_replace(string_split({plain_path(up('src', 3))}, '/')[-1], '(?i)\\.[a-z0-9]+$', ''), '[-_]+', ' ', 'g')''')}"

CONTEXT = f"""
ctx0 AS (
  SELECT f.page_id, f.site, f.url, f.h1_count, f.word_count, f.viewport, {collapse('f.title')} AS title, {collapse('f.meta_description')} AS meta,
    t.topic, t.keyword, t.h1_text, {collapse('m.location')} AS place, m.call_to_action, m.site_name, s.ss, coalesce(s.ss[1], '') AS context,
    CASE WHEN len(s.ss) > 0 THEN {limit('s.ss[1]', 110)} ELSE 'Helpful information about ' || lower(t.topic) END AS summary
  FROM fact2 f JOIN topic_row t USING (page_id) JOIN sent s USING (page_id) LEFT JOIN site_meta m ON m.site = f.site
),
ctx1 AS (SELECT *, {SITE_NAME} AS name, {netloc('url')} AS domain_name, {limit('topic', 42)} AS head42 FROM ctx0),
ctx2 AS (
  SELECT *, {title_text('place')} AS long_built, {title_text("''")} AS short_built,
    rtrim({collapse('summary')}, '. ') || '. ' || coalesce(nullif(call_to_action, ''), {q(advice.DEFAULT_CALL)}) || '. Learn more at ' || domain_name || '.' AS m0
  FROM ctx1
),
ctx3 AS (
  SELECT *, {limit('long_built', 60)} AS built, {limit('short_built', 60)} AS rebuilt,
    {collapse("CASE WHEN length(m0) < 150 THEN replace(rtrim(m0, '.') || '. Get practical details about ' || lower(topic) || ' and next steps.', '..', '.') ELSE m0 END")} AS m1
  FROM ctx2
),
ctx AS (SELECT *, {fit('m1')} AS described FROM ctx3)
"""


def rules(overall: str = "80.0") -> str:
    return f"""
title_rule AS (
  SELECT site, page_id, url AS page_url, CASE WHEN title = '' THEN 'title_missing' WHEN length(title) > 60 THEN 'title_long'
      WHEN length(title) < 10 THEN 'title_short' WHEN keyword <> '' AND NOT contains(lower(title), lower(keyword)) THEN 'title_keyword' END AS rule,
    CASE WHEN title = '' THEN 'Critical' WHEN length(title) > 60 AND coalesce({overall}, 80.0) < 40 THEN 'High' ELSE 'Medium' END AS severity,
    CASE WHEN title = '' THEN 'No <title> tag found.' WHEN length(title) > 60 THEN 'Current title is ' || length(title) || ' characters: ' || title
      WHEN length(title) < 10 THEN 'Current title is too short (' || length(title) || ' characters): ' || title
      ELSE 'Current title does not include the main topic keyword: ' || title END AS current_state,
    CASE WHEN title = '' THEN 'Add this title tag to your <head>: <title>' || built || '</title>'
      WHEN length(title) BETWEEN 1 AND 9 THEN 'Replace the current title tag with: <title>' || built || '</title>'
      ELSE 'Replace the current title tag with: <title>' || rebuilt || '</title>' END AS exact_fix, 0 AS o
  FROM ctx
),
page_rule AS (
  SELECT * FROM title_rule WHERE rule IS NOT NULL
  UNION ALL SELECT site, page_id, url, CASE WHEN meta = '' THEN 'meta_missing' ELSE 'meta_length' END, CASE WHEN meta = '' THEN 'High' ELSE 'Medium' END,
    CASE WHEN meta = '' THEN 'No meta description found.' ELSE 'Current meta description is ' || length(meta) || ' characters: ' || meta END,
    '<meta name="description" content="' || described || '">', 1 FROM ctx WHERE length(meta) NOT BETWEEN 150 AND 160
  UNION ALL SELECT site, page_id, url, 'h1_missing', 'Critical', 'No <h1> heading found on the page.', '<h1>' || h1_text || '</h1>', 2 FROM ctx WHERE h1_count = 0
  UNION ALL SELECT site, page_id, url, 'h1_many', 'High', 'Found ' || h1_count || ' H1 tags: ' || coalesce((SELECT string_agg({collapse('e.text')}, ', ' ORDER BY pos)
      FROM el e WHERE e.page_id = c.page_id AND e.tag = 'h1' AND {collapse('e.text')} <> ''), 'multiple H1 elements'), {q(advice.H1_MANY_FIX)}, 2 FROM ctx c WHERE h1_count > 1
  UNION ALL SELECT site, page_id, url, 'thin_content', 'Medium', 'Current word count is ' || word_count || ' words.',
    'Add at least ' || (300 - word_count) || ' more words about ' || topic || '. ' || {q(advice.THIN_FIX_TAIL)}, 3 FROM ctx WHERE word_count < 300
  UNION ALL SELECT site, page_id, url, 'viewport', 'Medium', 'No viewport meta tag found.', {q(advice.VIEWPORT_FIX)}, 4 FROM ctx WHERE viewport IS NULL
  UNION ALL SELECT site, page_id, url, 'image_alt', 'Medium', 'Image ' || CASE WHEN src <> '' THEN src ELSE '#' END || ' is missing alt text.',
    'alt="' || {limit('alt1', 125)} || '"', 5 + index FROM (
      SELECT *, {collapse("alt0 || CASE WHEN context <> '' AND NOT contains(lower(alt0), lower(context)) THEN ' - ' || rtrim(left(context, 50), ' ,.;:') ELSE '' END")} AS alt1 FROM (
        SELECT c.*, i.src, i.index, CASE WHEN {FILE} <> '' AND NOT regexp_matches({FILE}, '(?i)^(img\\d+|image\\d*|photo\\d*|pic\\d*)$')
          THEN {title_case(FILE)} ELSE topic || ' image' END AS alt0
        FROM ctx c JOIN image i ON i.page_id = c.page_id WHERE NOT i.has_alt))
  UNION ALL SELECT c.site, c.page_id, c.url, 'stuffing', 'Medium',
    'Keyword "' || s.keyword || '" appears at ' || s.density || '% density. Sentences to review: ' || s.examples,
    'Reduce repeated uses of "' || s.keyword || '" in these sentences: ' || s.examples || {q(advice.STUFFING_FIX_TAIL)}, 500 + s.rank
  FROM ctx c JOIN stuffing s USING (page_id)
)
"""


# The slug of an anchor target; the shared expression reads a column called url.
ANCHOR_RULE = f"""
weak AS (
  SELECT site, page_id, url AS page_url, pos, absolute_url, {collapse('text')} AS shown, rtrim(absolute_url, '/') AS url FROM link
  WHERE lower({collapse('text')}) IN {in_list([*advice.VAGUE_ANCHORS, ''])}
),
page_name AS (
  SELECT site, rtrim(url, '/') AS key, max_by(coalesce(nullif(clean_title, ''), nullif(first_h1, ''), topic), page_id) AS name FROM topic_row GROUP BY ALL
),
slugged AS (SELECT *, coalesce(nullif({collapse(SLUG)}, ''), 'home') AS slug FROM weak),
anchor_rule AS (
  SELECT w.site, w.page_id, w.page_url, w.pos, CASE WHEN shown = '' THEN 'High' ELSE 'Medium' END AS severity,
    CASE WHEN shown = '' THEN 'Empty anchor text' ELSE 'Current anchor text is "' || shown || '"' END || ' for link ' || absolute_url || '.' AS current_state,
    coalesce(nullif(n.name, ''), {title_case('slug')}) AS exact_fix
  FROM slugged w LEFT JOIN page_name n ON n.site = w.site AND n.key = w.url
)
"""

BROKEN_RULE = f"""
broken_rule AS (
  SELECT site, page_id, url AS page_url, 'High' AS severity, 'Broken links found: ' || string_agg(
    coalesce(nullif({collapse('text')}, ''), 'this link') || ' → ' || target || ' (' || status_code || ')', '; ' ORDER BY rank) FILTER (place <= 5) AS current_state
  FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY rank) AS place FROM broken) GROUP BY site, page_id, url
)
"""

SITE_RULE = f"""
site0 AS (
  SELECT p.site, {collapse("coalesce(nullif(m.base_url, ''), p.first_url)")} AS base, m.https, m.has_robots, m.has_sitemap
  FROM (SELECT site, min_by(url, page_id) AS first_url FROM pages_raw GROUP BY site) p LEFT JOIN site_meta m USING (site)
),
site1 AS (SELECT *, {netloc('base')} AS dom FROM site0),
site_rule AS (
  SELECT site, base AS page_url, 'https' AS rule, 'Critical' AS severity, 'The site is loading without HTTPS enabled.' AS current_state, {q(advice.HTTPS_FIX)} AS exact_fix
  FROM site1 WHERE NOT coalesce(https, lower({up('base', 1)}) = 'https')
  UNION ALL SELECT site, base, 'robots', 'High', 'No robots.txt file was found.', CASE WHEN dom <> '' THEN
    'User-agent: *' || chr(10) || 'Allow: /' || chr(10) || chr(10) || 'Sitemap: https://' || dom || '/sitemap.xml' ELSE 'User-agent: *' || chr(10) || 'Allow: /' END
  FROM site1 WHERE NOT has_robots
  UNION ALL SELECT site, base, 'sitemap', 'High', 'No XML sitemap was found.', CASE WHEN dom <> '' THEN
    'Create an XML sitemap and publish it at https://' || dom || '/sitemap.xml' ELSE 'Create an XML sitemap and publish it at /sitemap.xml' END
  FROM site1 WHERE NOT has_sitemap
)
"""

ALL_RULES = f"""
rec AS (
  SELECT site, page_id, page_url, rule, severity, current_state, exact_fix, o FROM page_rule
  UNION ALL SELECT site, page_id, page_url, 'anchor_text', severity, current_state, exact_fix, 1000 + pos FROM anchor_rule
  UNION ALL SELECT site, page_id, page_url, 'broken_links', severity, current_state, {q(advice.BROKEN_FIX)}, 100000 FROM broken_rule
  UNION ALL SELECT site, -1, page_url, rule, severity, current_state, exact_fix, 0 FROM site_rule
),
merged AS (
  SELECT site, rule, severity, exact_fix, count(DISTINCT page_url) AS n_pages, count(*) AS n_rows, min(page_url) AS first_url,
    min_by(current_state, (page_id, o)) AS first_state FROM rec GROUP BY site, rule, severity, exact_fix
),
rule_text AS (SELECT * FROM (VALUES {', '.join(f"({q(k)}, {q(r['pillar'])}, {q(r['element'])}, {q(r['why'])}, {q(r['place'])}, {q(r['impact'])})" for k, r in advice.RULES.items())})
  AS v(rule, pillar, element, why_it_matters, placement_instructions, estimated_impact)),
rule_step AS (SELECT * FROM (VALUES {', '.join(f"({q(k)}, {q(p)}, {q(s)})" for k, r in advice.RULES.items() for p, s in r['steps'].items())}) AS v(rule, platform, steps))
"""

# The score of a page: by its address without slashes at the end (the plain address first), else that of the site unless it is 0, else 80.
SCORE_OF = """
score_of AS (
  SELECT x.site, rtrim(coalesce(x.url, ''), '/') AS key, first(p.overall ORDER BY x.url <> rtrim(x.url, '/'), x.page_id) AS overall
  FROM pages_raw x JOIN page_score p USING (page_id) GROUP BY x.site, rtrim(coalesce(x.url, ''), '/')
)
"""
SCORED = (*SCORE, *PILLARS, AUTHORITY, PAGE_SCORE, SITE_TECH, P_SITE_TECH, GRAPH, P_SITE_LINKS, SITE_SCORE, SCORE_OF, TOPICS, STUFF, CONTEXT)
OVERALL = """coalesce((SELECT s.overall FROM score_of s WHERE s.site = ctx.site AND s.key = rtrim(ctx.url, '/')),
  (SELECT nullif(t.overall, 0) FROM site_score t WHERE t.site = ctx.site))"""

STATES = """
state AS (
  SELECT site, rule, severity, exact_fix, current_state, min((page_id, o)) AS place, min(page_id) AS first_page FROM rec
  GROUP BY site, rule, severity, exact_fix, current_state
),
kept_state AS (
  SELECT *, current_state <> '' AND NOT EXISTS (
    SELECT 1 FROM state e WHERE e.site = s.site AND e.rule = s.rule AND e.severity = s.severity AND e.exact_fix = s.exact_fix
      AND e.place < s.place AND contains(e.current_state, s.current_state)) AS kept
  FROM state s
)
"""

REC_PAGE = (*CORE, TOPICS, STUFF, CONTEXT, rules())
REC = (*SCORED, rules(OVERALL), ANCHOR_RULE, BROKEN_RULE, SITE_RULE, ALL_RULES)


def rule_query(where: str) -> str:
    return sql(
        f"SELECT page_id, rule, severity, current_state, exact_fix FROM page_rule WHERE {where}", *REC_PAGE, tables=ALL
    )


# Reports

META = """meta_row AS (SELECT site, min_by(url, page_id) AS base_url, site AS domain, count(*) AS pages_crawled FROM pages_raw GROUP BY site),
asm AS (SELECT m.*, s.* EXCLUDE (site), i.* EXCLUDE (site), '2024-01-31 00:00:00' AS analysis_date
  FROM meta_row m LEFT JOIN summ s USING (site) LEFT JOIN insight i USING (site))"""
ASM = (*INSIGHT, summary("0", "fetched"), META)
NL = "chr(10)"


def lines(*parts: str) -> str:
    return f"concat_ws({NL}, " + ", ".join(parts) + ")"


def numbered(x: str, tag: str = "") -> str:
    return f"list_transform({x}, lambda m, i: i || '. {tag}' || m)"


LEAD = "list_concat(" + "list_concat(" + ", ".join(
    f"list_transform(({split(k)})[1:{n}], lambda m: {q(tag)} || m)" for k, n, tag, _ in report.LEADING[:2]
) + f"), list_transform(({split('recommendations')})[1:2], lambda m: '[RECOMMENDATION] ' || m))"
CN = {k: list_count(k) for k in KINDS}
EXEC = lines(
    "'SITE HEALTH OVERVIEW'", q(report.DASHES), f"'Total Issues Found: ' || ({CN['critical']} + {CN['warnings']})",
    f"'  - Critical: ' || {CN['critical']}", f"'  - Warnings: ' || {CN['warnings']}", f"'  - Recommendations: ' || {CN['recommendations']}",
    f"'  - Positive Findings: ' || {CN['positive']}", "''", "'TOP PRIORITY ACTION ITEMS'", q(report.DASHES),
    f"CASE WHEN len({LEAD}) > 0 THEN array_to_string({numbered(LEAD)}, {NL}) ELSE '✓ No critical issues found - site is in good health!' END",
)
GROUPS = ", ".join(
    f"CASE WHEN {k} <> '' THEN {q(report.TEXT_HEADS[k])} || {NL} || {q(report.DASHES)} || {NL} || array_to_string({numbered(split(k))}, {NL}) || {NL} END"
    for k in KINDS
)
DETAILS = f"coalesce(nullif(concat_ws({NL}, {GROUPS}), ''), 'No insights generated.')"


def head(title: str) -> list[str]:
    return [q(report.RULER), q(title), q(report.RULER), "''"]


TEXT = lines(
    *head("WEBSITE ANALYSIS REPORT"), "'Domain: ' || domain", "'URL: ' || base_url", "'Analysis Date: ' || analysis_date",
    "'Pages Crawled: ' || pages_crawled", "''", *head("EXECUTIVE SUMMARY"), EXEC, "''", *head("KEY STATISTICS"),
    lines(*[f"{q(n)} || {c}" for n, c in report.TEXT_STATS]), "''", *head("DETAILED INSIGHTS"), DETAILS, "''",
    q(report.RULER), "'END OF REPORT'", q(report.RULER),
)


def email_group(kind: str, title: str) -> str:
    return f"CASE WHEN {kind} <> '' THEN '{title}' || {NL} || array_to_string(list_transform(({split(kind)})[1:3], lambda m: '  • ' || m), {NL}) || {NL} END"


EMAIL = lines(
    "'Website Analysis Complete: ' || domain", "''", "'Quick Summary:'", "'- ' || total_pages_analyzed || ' pages analyzed'",
    f"'- ' || {CN['critical']} || ' critical issues'", f"'- ' || {CN['warnings']} || ' warnings'", "''",
    email_group("critical", "Top Critical Issues:"), email_group("warnings", "Top Warnings:"),
    "'View the full report for detailed analysis and recommendations.'",
)


def esc(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


HTML_LEAD = "concat(" + ", ".join(
    f"coalesce(array_to_string(list_transform(({split(k)})[1:{n}], lambda m: '<li><strong>{tag}</strong> ' || {esc('m')} || '</li>'), ''), '')"
    for k, n, _, tag in report.LEADING
) + ")"
HTML_CARDS = "concat(" + ", ".join(
    f"""'<div class="stat-card"><div class="stat-value">' || {c} || '</div><div class="stat-label">{n}</div></div>'""" for n, c in report.HTML_STATS
) + ")"
HTML_GROUPS = "concat(" + ", ".join(
    f"""CASE WHEN {k} <> '' THEN '<div class="insight-group"><h3>{report.HTML_HEADS[k]}</h3>' || array_to_string(list_transform({split(k)},
      lambda m: '<div class="insight-item {report.HTML_ITEM_CLASS[k]}">' || {esc('m')} || '</div>'), '') || '</div>' ELSE '' END"""
    for k in KINDS
) + ")"
HTML = lines(
    "'<!DOCTYPE html>'", "'<html lang=\"en\">'", "'<head>'", "'<meta charset=\"UTF-8\">'",
    "'<meta name=\"viewport\" content=\"width=device-width, initial-scale=1.0\">'",
    f"'<title>Website Analysis Report - ' || {esc('domain')} || '</title>'", "'</head>'", "'<body>'",
    f"""'<div class="header"><h1>Website Analysis Report</h1><div class="subtitle">' || {esc('domain')} || '</div><div>URL: ' || {esc('base_url')}
      || '</div><div>Analysis Date: ' || analysis_date || '</div><div>Pages Crawled: ' || pages_crawled || '</div></div>'""",
    f"""'<div class="summary-box"><h2>Executive Summary</h2><h3>Prioritized Action Items</h3><ul>' || coalesce(nullif({HTML_LEAD}, ''), '<li>No issues found - great job!</li>') || '</ul></div>'""",
    f"""'<div class="summary-box"><h2>Key Statistics</h2><div class="stats-grid">' || {HTML_CARDS} || '</div></div>'""",
    f"""'<div class="insights-section"><h2>Detailed Insights</h2>' || {HTML_GROUPS} || '</div>'""",
)

SUGG_BLOCK = f"sugg AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY o) - 1 AS ord FROM ({SUGGESTIONS}))"
SECTION = f"""section AS (
  SELECT f.*, row_number() OVER (PARTITION BY f.site ORDER BY f.page_id) AS number,
    (SELECT count(*) FROM sugg s WHERE s.page_id = f.page_id AND priority = 'critical') AS crit,
    (SELECT count(*) FROM sugg s WHERE s.page_id = f.page_id AND priority = 'high') AS high,
    (SELECT arg_max(cms, -ord) FROM cms_score c WHERE c.page_id = f.page_id AND score >= 3) AS cms_first,
    (SELECT string_agg('<div class="insight-item ' || priority || '"><strong>' || {esc('issue')} || '</strong><span class="priority-badge priority-' || priority || '">'
       || upper(priority) || '</span><div>' || {esc('suggestion')} || '</div><div>' || {esc('plain_language')} || '</div>'
       || CASE WHEN platform_help IS NOT NULL THEN '<div class="platform-help"><strong>How to fix:</strong> ' || {esc('platform_help')} || '</div>' ELSE '' END || '</div>', '' ORDER BY o)
     FROM sugg s WHERE s.page_id = f.page_id) AS advice
  FROM fact2 f)"""


def cell(name: str, value: str) -> str:
    return f"""'<div class="metadata-item"><div class="metadata-label">{name}</div><div class="metadata-value">' || {value} || '</div></div>'"""


HTML_SECTION = f"""concat('<div class="page-section"><div class="page-header"><h2>Page ', number, '</h2><div class="page-url">', {esc('url')}, '</div><span>Status: ', status_code, '</span>',
  CASE WHEN cms_first IS NOT NULL THEN '<span class="cms-badge">' || upper(cms_first[1]) || cms_first[2:] || ' Detected</span>' ELSE '' END,
  '</div><div class="section-title">SEO Overview</div><div class="metadata-grid">', {cell('Title', esc('title'))},
  {cell('Title Length', "length(title) || ' chars ' || CASE WHEN length(title) BETWEEN 50 AND 60 THEN '✅' ELSE '⚠️' END")},
  {cell('Meta Description', esc('left(meta_description, 100)'))},
  {cell('Description Length', "length(meta_description) || ' chars ' || CASE WHEN length(meta_description) BETWEEN 150 AND 160 THEN '✅' ELSE '⚠️' END")},
  {cell('Word Count', 'word_count')}, '</div>',
  CASE WHEN advice IS NOT NULL THEN '<div class="section-title">Actionable Suggestions</div>' || advice ELSE '<div class="section-title">✅ No issues found!</div>' END, '</div>')"""
TEXT_SECTION = lines(
    "'Page ' || number || ': ' || CASE WHEN length(url) <= 65 THEN url ELSE left(url, 62) || '...' END", "'  Status: ' || status_code",
    "'  Title: ' || left(title, 60)", "'  Word Count: ' || word_count",
    "CASE WHEN crit > 0 OR high > 0 THEN '  Issues: ' || crit || ' critical, ' || high || ' high priority' ELSE '  Issues: None' END", "''",
)

CARD = f"""concat('PAGE ANALYSIS: ', url, {NL}, {NL}, 'Status Code: ', status_code, {NL}, 'Word Count: ', word_count, {NL}, {NL}, 'SEO:', {NL}, '  Title: ', title, ' (', length(title),
  ' chars)', {NL}, '  Meta Description: ', left(meta_description, 100), '... (', length(meta_description), ' chars)', {NL}, {NL}, 'HTML Structure:', {NL}, '  Semantic elements: ',
  replace(coalesce(semantic_elements, ''), '|', ', '), {NL}, {NL}, 'Images: ', image_count, ' total, ', missing_alt_count, ' missing alt text', {NL}, {NL}, 'Links: ', internal_count,
  ' internal, ', external_count, ' external', {NL})"""

# Answers

MSG = f"""msg AS (
  SELECT conv_id, turn, site, coalesce(nullif(role, ''), 'user') AS role, {strip("coalesce(text, '')")} AS text FROM chat_messages WHERE {strip("coalesce(text, '')")} <> ''
)"""
TOPIC_LIST = "list_filter([" + ", ".join(
    f"CASE WHEN contains(lower(text), {q(w)}) THEN {q(t)} END" for w, t in literals.KEYWORD_TOPICS
) + "], lambda x: x IS NOT NULL)"
TOPICS_SQL = f"list_filter({TOPIC_LIST}, lambda x, i: list_position({TOPIC_LIST}, x) = i)"
PLAN = "(" + " OR ".join(f"contains(lower(text), {q(w)})" for w in literals.PLAN_WORDS) + ")"
CMS_NAMED = "CASE " + " ".join(f"WHEN contains(lower(text), {q(n)}) THEN {q(n)}" for n, *_ in literals.CMS_PATTERNS) + " ELSE site_cms END"


def fill(template: str) -> str:
    out = q(template)
    for name in (
        "avg_word_count", "no_title", "no_description", "no_h1", "images_without_alt", "broken_links_found",
        "total_external_links", "total_pages_analyzed", "critical_count", "warnings_count",
    ):
        out = out.replace("{" + name + "}", f"' || {name} || '")
    return out


FIGURES = f"""platform AS (
  SELECT site, max_by(cms_probable, (n, cms_probable)) AS site_cms FROM (
    SELECT site, cms_probable, count(*) AS n FROM fact2 WHERE cms_probable IS NOT NULL GROUP BY ALL) GROUP BY site),
figures AS (
  SELECT a.*, c.no_title, c.no_description, c.no_h1, {CN['critical'].replace('critical', 'a.critical')} AS critical_count,
    {CN['warnings'].replace('warnings', 'a.warnings')} AS warnings_count, f.seo, f.accessibility, f.content, f.technical, f.overall, p.site_cms
  FROM asm a LEFT JOIN cnt c USING (site) LEFT JOIN fallback_score f USING (site) LEFT JOIN platform p USING (site)),
asked AS (SELECT m.conv_id, m.turn, m.text, g.* FROM msg m LEFT JOIN figures g USING (site) WHERE m.role = 'user')"""

TIP_CELLS = []
for _topic in dict.fromkeys(t for _, t in literals.KEYWORD_TOPICS):
    _body = "[" + ", ".join(fill(t) for t in qa.TIPS[_topic]) + "]"
    if _topic == "cms":
        _extra = "CASE cms " + " ".join(f"WHEN {q(n)} THEN [{q(t)}]" for n, t in qa.CMS_TIPS.items()) + " ELSE CAST([] AS VARCHAR[]) END"
        _body = f"list_concat({_body}, {_extra})"
    TIP_CELLS.append(f"WHEN {q(_topic)} THEN {_body}")
TIP_SQL = "flatten(list_transform(topics, lambda t: CASE t " + " ".join(TIP_CELLS) + " END))"
ANSWERS = f"""
routed AS (SELECT *, {TOPICS_SQL} AS topics, {PLAN} AS planned, {CMS_NAMED} AS cms FROM asked),
found AS (
  SELECT *, list_concat(CASE WHEN planned THEN list_filter([
      CASE WHEN critical <> '' THEN 'Phase 1: resolve critical issues such as ' || string_split(critical, '|')[1] END,
      CASE WHEN warnings <> '' THEN 'Phase 2: clean up warning-level items like ' || string_split(warnings, '|')[1] END,
      CASE WHEN images_without_alt > 0 THEN 'Phase 3: add descriptive alt text to ' || images_without_alt || ' image(s)' END,
      CASE WHEN broken_links_found > 0 THEN 'Phase 4: repair or redirect ' || broken_links_found || ' broken link(s)' END,
      CASE WHEN total_pages_analyzed > 0 THEN {q(qa.PLAN_LAST)} END], lambda x: x IS NOT NULL) ELSE CAST([] AS VARCHAR[]) END, {TIP_SQL}) AS tips FROM routed
),
bulleted AS (
  SELECT *, list_concat(CASE WHEN len(tips) > 0 THEN tips ELSE [{', '.join(fill(t) for t in qa.TIPS['general'])}] END,
    CASE WHEN critical <> '' THEN ['Address the highest-risk issue first: ' || string_split(critical, '|')[1]]
         WHEN warnings <> '' THEN ['Start with this warning: ' || string_split(warnings, '|')[1]] ELSE CAST([] AS VARCHAR[]) END) AS bs FROM found
),
answered AS (
  SELECT conv_id, turn, 'Here are practical audit recommendations for ' || site || ':' || {NL} || '- ' || array_to_string(
    list_filter(bs, lambda x, i: list_position(list_transform(bs, lambda y: lower(trim(y))), lower(trim(x))) = i)[1:6], {NL} || '- ') AS answer FROM bulleted
)
"""
PICKED = f"list_concat(list_concat({split('critical')}, {split('warnings')}), {split('recommendations')})[1:3]"
SHORT = f"""CASE WHEN contains(lower(text), 'score') THEN 'Overall score: ' || overall || '/100. SEO ' || seo || ', accessibility ' || accessibility || ', content ' || content || ', technical ' || technical || '.'
  WHEN regexp_matches(lower(text), 'recommend|fix|priority') THEN CASE WHEN len({PICKED}) = 0 THEN 'No major recommendations are available yet.' ELSE 'Top priorities: ' || array_to_string({PICKED}, ' | ') END
  ELSE 'The audit analyzed ' || total_pages_analyzed || ' page(s). It found ' || critical_count || ' critical issues and ' || warnings_count || ' warnings. First action: '
    || coalesce({PICKED}[1], 'review the full report for next steps.') END"""
QA_ALL = (*ASM, FALLBACK, MSG, FIGURES)
QA_TABLES = ("pages_raw", "chat_messages")


def prompt_detail(kind: str, name: str) -> str:
    return f"CASE WHEN {kind} <> '' THEN '- {name}: ' || array_to_string(({split(kind)})[1:3], ' | ') END"


PROMPT = lines(
    "'SITE OVERVIEW'", "'- Domain: ' || domain", "'- Base URL: ' || base_url", "'- Pages crawled: ' || pages_crawled",
    "'- Pages analyzed: ' || total_pages_analyzed", "'- Total images: ' || total_images", "'- Images without alt text: ' || images_without_alt",
    "'- Internal links: ' || total_internal_links", "'- External links: ' || total_external_links", "'- Broken links: ' || broken_links_found",
    "'- Average word count: ' || avg_word_count", "CASE WHEN site_cms IS NOT NULL THEN '- Likely CMS/platform: ' || site_cms END",
    f"{NL} || 'TOP FINDINGS'", f"'- Critical issues: ' || {CN['critical']}", f"'- Warnings: ' || {CN['warnings']}",
    f"'- Recommendations: ' || {CN['recommendations']}", f"'- Positive findings: ' || {CN['positive']}",
    prompt_detail("critical", "Critical details"), prompt_detail("warnings", "Warning details"),
    prompt_detail("recommendations", "Recommended improvements"),
)
PAGE_LINE = """concat('- URL: ', url, '; status=', status_code, '; title=', CASE WHEN has_title THEN 'yes' ELSE 'no' END, '; meta_description=',
  CASE WHEN has_meta_description THEN 'yes' ELSE 'no' END, '; h1_count=', h1_count, '; missing_alt=', missing_alt_count, '; internal_links=', internal_count,
  '; external_links=', external_count, '; word_count=', word_count, coalesce('; error=' || error, ''))"""

_stage = "CASE event_type WHEN 'view' THEN 'crawl' WHEN 'click' THEN 'analyze' WHEN 'signup' THEN 'score' WHEN 'purchase' THEN 'finish' ELSE 'done' END"
_prog = "CASE " + _stage + " " + " ".join(
    f"WHEN '{n}' THEN {a}::DOUBLE + value / 50.0::DOUBLE * {w}::DOUBLE" for n, (a, w) in literals.STAGES.items()
) + " ELSE 100.0::DOUBLE END"
_tier = "CASE WHEN tier IN ('free', 'standard', 'full') THEN tier ELSE 'free' END"

ORACLE = {
    "rec_suggestions": sql(
        "SELECT page_id, ord, priority, category, issue, suggestion, plain_language, platform_help FROM sugg", *PAGE, SUGG_BLOCK
    ),
    "rec_titles": sql(
        "SELECT page_id, rule, severity, current_state, exact_fix FROM title_rule WHERE rule IS NOT NULL", *SCORED, rules(OVERALL), tables=ALL
    ),
    "rec_descriptions": rule_query("starts_with(rule, 'meta_')"),
    "rec_h1": rule_query("starts_with(rule, 'h1_')"),
    "rec_images": rule_query("rule = 'image_alt'"),
    "rec_content": rule_query("rule IN ('thin_content', 'viewport', 'stuffing')"),
    "rec_anchors": sql(
        "SELECT page_id, 1000 + pos AS ord, severity, current_state, exact_fix FROM anchor_rule", *CORE, TOPICS, ANCHOR_RULE, tables=ALL
    ),
    "rec_broken": sql("SELECT page_id, severity, current_state FROM broken_rule", *CORE, BROKEN_RULE, tables=ALL),
    "rec_site": sql("SELECT * FROM site_rule", SITE_RULE, tables=ALL),
    "rec_all": sql("SELECT site, page_id, page_url, rule, severity, current_state, exact_fix FROM rec", *REC, tables=ALL),
    "rec_merged": sql("SELECT * FROM merged", *REC, tables=ALL),
    "rec_merged_urls": sql(
        "SELECT DISTINCT site, rule, severity, exact_fix, page_url FROM rec WHERE page_url <> ''", *REC, tables=ALL
    ),
    "rec_merged_states": sql(
        """SELECT site, rule, severity, exact_fix, current_state, first_page, kept,
        CASE WHEN kept THEN row_number() OVER (PARTITION BY site, rule, severity, exact_fix, kept ORDER BY place) END AS ord FROM kept_state""",
        *REC, STATES, tables=ALL,
    ),
    "rec_joined_states": sql(
        """SELECT site, rule, severity, exact_fix, count(*) FILTER (kept) AS n_states,
        coalesce(string_agg(current_state, ' | ' ORDER BY place) FILTER (kept), '') AS joined_state FROM kept_state GROUP BY site, rule, severity, exact_fix""",
        *REC, STATES, tables=ALL,
    ),
    "rec_ordered": sql(
        """SELECT site, pillar, severity, element, why_it_matters, exact_fix, placement_instructions, estimated_impact, n_pages, first_url,
        CAST(list_position(['Critical', 'High', 'Medium', 'Low'], severity) - 1 AS BIGINT) AS severity_rank FROM merged JOIN rule_text USING (rule)""",
        *REC, tables=ALL,
    ),
    "rec_platform_steps": sql(
        "SELECT site, rule, n_rows, platform, steps FROM (SELECT site, rule, count(*) AS n_rows FROM rec GROUP BY ALL) JOIN rule_step USING (rule)",
        *REC, tables=ALL,
    ),
    "rec_fallback": sql(
        """SELECT site, row_number() OVER (PARTITION BY site ORDER BY k, i) - 1 AS ord, priority, category, recommendation FROM (
        SELECT site, 0 AS k, 'critical' AS priority, 'technical' AS category, unnest(string_split(critical, '|')) AS recommendation, generate_subscripts(string_split(critical, '|'), 1) AS i FROM insight
        UNION ALL SELECT site, 1, 'high', 'seo', unnest(string_split(warnings, '|')), generate_subscripts(string_split(warnings, '|'), 1) FROM insight
        UNION ALL SELECT site, 2, 'medium', 'content', unnest(string_split(recommendations, '|')), generate_subscripts(string_split(recommendations, '|'), 1) FROM insight)
        WHERE recommendation <> ''""",
        *INSIGHT,
    ),
    "rpt_text": sql(f"SELECT site, {TEXT} AS report FROM asm", *ASM),
    "rpt_executive_summary": sql(f"SELECT site, {EXEC} AS report FROM asm", *ASM),
    "rpt_email": sql(f"SELECT site, {EMAIL} AS report FROM asm", *ASM),
    "rpt_html": sql(f"SELECT site, {HTML} AS report FROM asm", *ASM),
    "rpt_text_pages": sql(f"SELECT site, number, {TEXT_SECTION} AS section FROM section", *PAGE, SUGG_BLOCK, SECTION),
    "rpt_html_pages": sql(f"SELECT site, number, {HTML_SECTION} AS section FROM section", *PAGE, SUGG_BLOCK, SECTION),
    "rpt_assembly": sql(
        "SELECT site, base_url, domain, pages_crawled, total_pages_analyzed, avg_word_count, critical, warnings, recommendations, positive FROM asm", *ASM
    ),
    "rpt_page_lookup": sql(
        f"""SELECT site, page_id, {CARD} || coalesce((SELECT {NL} || 'Broken Links: ' || count(*) || {NL} || string_agg('  - ' || target || ' (Status: ' || status_code || ')' || {NL}, '' ORDER BY rank) FILTER (place <= 3)
          FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY rank) AS place FROM broken) b WHERE b.page_id = f.page_id HAVING count(*) > 0), '') AS card
        FROM fact2 f WHERE page_id IN (SELECT min(page_id) FROM fact2 WHERE contains(url, '/p/2') GROUP BY site)""",
        *CORE, tables=ALL,
    ),
    "qa_system_prompts": sql(
        "SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS system_prompt FROM msg WHERE role = 'system' GROUP BY conv_id",
        MSG, tables=("chat_messages",),
    ),
    "qa_messages_without_system": sql(
        "SELECT conv_id, turn, role, text, upper(left(role, 1)) || lower(substr(role, 2)) || ': ' || text AS line FROM msg WHERE role <> 'system'",
        MSG, tables=("chat_messages",),
    ),
    "qa_extended_answers": sql(
        "SELECT conv_id, turn, CASE WHEN length(m.text) > 30 THEN 'You asked: ' || left(m.text, 40) ELSE answer END AS answer FROM answered JOIN msg m USING (conv_id, turn)",
        *QA_ALL, ANSWERS, tables=QA_TABLES,
    ),
    "rec_rewritten": sql(
        f"""SELECT page_id, rule, {limit(collapse("'Guide: ' || regexp_extract(exact_fix, '(?s)<title>(.*)</title>$', 1)"), 60)} AS title FROM title_rule WHERE rule IS NOT NULL""",
        *SCORE, *PILLARS, AUTHORITY, PAGE_SCORE, TOPICS, STUFF, CONTEXT, rules("(SELECT overall FROM page_score p WHERE p.page_id = ctx.page_id)"), tables=ALL,
    ),
    "qa_topics": sql(
        f"SELECT conv_id, turn, array_to_string({TOPICS_SQL}, '|') AS topics, {PLAN} AS plan FROM msg WHERE role = 'user'", MSG, tables=("chat_messages",)
    ),
    "qa_answers": sql("SELECT conv_id, turn, answer FROM answered", *QA_ALL, ANSWERS, tables=QA_TABLES),
    "qa_short_answers": sql(f"SELECT conv_id, turn, {SHORT} AS answer FROM asked", *QA_ALL, tables=QA_TABLES),
    "qa_cms": sql(f"SELECT conv_id, turn, {CMS_NAMED} AS cms FROM asked", *QA_ALL, tables=QA_TABLES),
    "qa_site_prompt": sql(f"SELECT site, {PROMPT} AS prompt FROM figures", *QA_ALL, tables=QA_TABLES),
    "qa_page_lines": sql(
        f"SELECT site, place, {PAGE_LINE} AS line FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY page_id) AS place FROM fact2) WHERE place <= 5",
        *PAGE,
    ),
    "qa_conversations": sql(
        """SELECT conv_id, max_by(text, turn) FILTER (role = 'user') AS last_user_message, count(*) AS messages, count(*) FILTER (role = 'system') AS system_messages
        FROM msg GROUP BY conv_id""",
        MSG, tables=("chat_messages",),
    ),
    "ops_latest_status": "SELECT user_id, max_by(event_type, (ts, event_id)) AS status, max(ts) AS changed_at FROM events GROUP BY user_id",
    "ops_pending": "SELECT user_id, changed_at FROM (SELECT user_id, max_by(event_type, (ts, event_id)) AS status, max(ts) AS changed_at FROM events GROUP BY user_id) WHERE status = 'view'",
    "ops_funnel": sql(
        f"""SELECT status, count(*) AS jobs, count(seconds) AS timed, {round2('(sum(seconds)::DOUBLE / nullif(count(seconds), 0)::DOUBLE)')} AS mean_seconds,
        max(seconds) AS longest_seconds FROM jobs GROUP BY status""",
        tables=("jobs",),
    ),
    "ops_audit_rollup": "SELECT user_id, event_type, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(*) AS entries FROM events GROUP BY ALL",
    "ops_progress": f"SELECT event_id, {round2(f'greatest(0.0::DOUBLE, least(100.0::DOUBLE, {_prog}))')} AS progress FROM events",
    "ops_monthly_usage": """SELECT user_id, CAST(date_trunc('month', ts) AS TIMESTAMP) AS month, count(*) AS used, greatest(0, 60 - count(*)) AS remaining,
        count(*) >= 60 AS limit_reached FROM events GROUP BY ALL""",
    "join_tier_limits": sql(
        f"""SELECT job_id, {_tier} AS tier, least(max_pages, CASE {_tier} WHEN 'free' THEN 10 WHEN 'standard' THEN 50 ELSE 200 END) AS pages_allowed,
        CAST(CASE {_tier} WHEN 'free' THEN 2 WHEN 'standard' THEN 3 ELSE 5 END AS BIGINT) AS depth_allowed FROM jobs""",
        tables=("jobs",),
    ),
    "sort_jobs": sql("SELECT job_id, owner, status, created_at FROM jobs ORDER BY created_at DESC, job_id DESC LIMIT 100 OFFSET 20", tables=("jobs",)),
    "sort_owner_jobs": sql(
        "SELECT job_id, owner, created_at FROM jobs WHERE owner = 7 ORDER BY created_at DESC, job_id DESC LIMIT 10 OFFSET 2", tables=("jobs",)
    ),
    "win_audit_changes": sql(
        """SELECT *, CASE WHEN score_change < 0 THEN 'SEO Score decreased by ' || -score_change || ' points' WHEN score_change > 0 THEN 'SEO Score improved by ' || score_change || ' points'
          WHEN score_change = 0 THEN 'SEO Score unchanged' END AS trend,
        CASE WHEN broken_change > 0 THEN broken_change || ' new broken link(s) detected' WHEN broken_change < 0 THEN -broken_change || ' broken link(s) fixed' END AS broken_note
        FROM (SELECT site, run_id, ts, seo_score, broken_links, seo_score - lag(seo_score) OVER w AS score_change, broken_links - lag(broken_links) OVER w AS broken_change
              FROM audit_history WINDOW w AS (PARTITION BY site ORDER BY ts, run_id))""",
        tables=("audit_history",),
    ),
    "str_job_progress": sql(
        """SELECT job_id, status, progress, status IN ('completed', 'failed') AS terminal FROM (
          SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY status IN ('completed', 'failed') DESC, ts DESC, status DESC, progress DESC) AS r FROM job_log) WHERE r = 1""",
        tables=("job_log",),
    ),
    "str_audit_alerts": sql(
        """SELECT site, ts, 'score_drop' AS alert, before_score - seo_score AS amount FROM ordered WHERE seo_score < before_score
        UNION ALL SELECT site, ts, 'new_broken_links', broken_links - before_broken FROM ordered WHERE broken_links > before_broken""",
        """ordered AS (SELECT *, lag(seo_score) OVER w AS before_score, lag(broken_links) OVER w AS before_broken
          FROM audit_history WINDOW w AS (PARTITION BY site ORDER BY ts, seo_score, broken_links))""",
        tables=("audit_history",),
    ),
    "win_history": "SELECT conv_id, turn, role, text, back FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 20",
    "win_latest_conversation": sql(
        "SELECT site, conv_id, turn, role, text FROM chat_messages c WHERE conv_id = (SELECT max(conv_id) FROM chat_messages x WHERE x.site = c.site)",
        tables=("chat_messages",),
    ),
    "win_page_numbers": sql("SELECT site, page_id, row_number() OVER (PARTITION BY site ORDER BY page_id) AS number FROM pages_raw"),
    # The watermark of a landing is the latest time of the landings before it less an hour. A row is dropped if its day has
    # ended by then; a day is given out if it has ended by the last watermark.
    "str_event_windows": sql(
        """SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS entries FROM event_landings e JOIN mark USING (landing)
        WHERE (before IS NULL OR date_trunc('day', ts) + INTERVAL 1 DAY > before)
          AND date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM event_landings) GROUP BY ALL""",
        """mark AS (SELECT landing, (SELECT max(ts) - INTERVAL 1 HOUR FROM event_landings x WHERE x.landing < l.landing) AS before
          FROM (SELECT DISTINCT landing FROM event_landings) l)""",
        tables=("event_landings",),
    ),
    "src_snapshots": f"""SELECT page_id, {netloc('url')} AS site, url, length(html) AS html_length, CAST(CASE WHEN coalesce(html, '') = '' THEN 0 ELSE 200 END AS BIGINT) AS status_code,
        CAST(0 AS BIGINT) AS depth, CAST(NULL AS DOUBLE) AS load_time, CASE WHEN coalesce(html, '') = '' THEN 'Failed to fetch' END AS error FROM pages""",
    "src_page_dumps": sql("SELECT page_id, site, url, md5(html) AS html_md5, status_code, depth, load_time, error FROM pages_raw"),
    "src_site_meta": sql("SELECT * FROM site_meta", tables=("site_meta",)),
    "src_link_status": sql("SELECT * FROM link_status", tables=("link_status",)),
    "src_saved_reports": sql("SELECT url, status_code, error, text_length, site AS domain, image_count AS total_images FROM fact2", *PAGE),
    "snk_log": "SELECT event_id, user_id, event_type, ts, CAST(ts AS DATE) AS day FROM events",
    "snk_job_updates": sql(
        """SELECT j.job_id, j.owner, j.max_pages, j.created_at, coalesce(u.status, 'pending') AS status,
        CASE WHEN u.status IN ('completed', 'failed') THEN u.ts END AS finished_at, u.report_path, u.error
        FROM jobs j LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY part DESC, ts DESC, status DESC, report_path DESC, error DESC) AS r
          FROM job_updates) u ON u.job_id = j.job_id AND u.r = 1""",
        tables=("jobs", "job_updates"),
    ),
    "src_authority_metrics": sql("SELECT domain, provider, priority, metric, value FROM authority_metrics", tables=("authority_metrics",)),
    "src_page_payload": sql(
        """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url || '?stored' ELSE url END AS url, CAST(CASE WHEN page_id % 3 = 0 THEN 301 ELSE status_code END AS BIGINT) AS status_code,
        depth, load_time FROM pages_raw"""
    ),
    "src_stored_results": sql("SELECT page_id, site, title, word_count, image_count FROM fact2 WHERE site = 'site1.example.org'", *PAGE),
    "src_report_lines": sql("SELECT site, url, status_code, title, word_count, image_count, load_time FROM fact2", *PAGE),
    "set_all_links": sql("SELECT page_id, absolute_url, CASE WHEN internal THEN 'internal' ELSE 'external' END AS side FROM link", *PAGE),
    "set_distinct_targets": sql("SELECT DISTINCT site, absolute_url FROM link", *PAGE),
    "set_semantic_overlap": sql(
        f"""SELECT page_id, CAST(len(s) AS BIGINT) AS shared, array_to_string(list_sort(s), '|') AS names FROM (
        SELECT page_id, list_filter([{', '.join(q(e) for e in literals.SEMANTIC_TARGETS)}], lambda e: list_contains(coalesce(tags, []), e)) AS s FROM fact2)""",
        *PAGE,
    ),
    "join_assembly": sql(
        """SELECT site, CAST(0 AS BIGINT) AS part, CAST(0 AS BIGINT) AS ord1, CAST(0 AS BIGINT) AS ord2, 'pages=' || count(*) AS payload FROM pages_raw GROUP BY site
        UNION ALL SELECT site, 1, page_id, 0, url FROM pages_raw UNION ALL SELECT site, 2, conv_id, turn, role || ': ' || text FROM chat_messages""",
        tables=("pages_raw", "chat_messages"),
    ),
}
