"""Tables derived from the given ones by SQL that Spark and DuckDB read alike.

The given pages hold no images, forms, descriptions or links between stored
pages; ``pages_enriched`` adds them to every page. The other tables describe
the five sites those pages form.
"""

from __future__ import annotations

PAGES_ENRICHED = """
WITH b AS (
  SELECT page_id, html, page_id % 5 AS s, CAST(floor(page_id / 5) AS BIGINT) AS k FROM pages
)
SELECT page_id,
  concat('https://site', CAST(s AS STRING), '.example.org/p/', CAST(k AS STRING)) AS url,
  replace(replace(html,
    '</head>', concat(
      CASE WHEN page_id % 3 <> 0 THEN concat('<meta name="description" content="Page ', CAST(page_id AS STRING), ' compares storage plans &amp; prices for small kitchens, with measured drawings, cost notes and a short buying checklist.">') ELSE '' END,
      CASE WHEN page_id % 2 = 0 THEN '<meta name="viewport" content="width=device-width">' ELSE '' END,
      CASE WHEN page_id % 4 = 0 THEN '<meta name="generator" content="WordPress 6.0"><script src="/wp-content/a.js"></script>' ELSE '' END,
      CASE WHEN page_id % 6 = 0 THEN '<script type="application/ld+json">{"@type":"Organization","name":"T"}</script>' ELSE '' END,
      CASE WHEN page_id % 7 = 0 THEN '<script type="application/ld+json">{broken</script>' ELSE '' END,
      '<meta property="og:title" content="T"><meta name="twitter:card" content="summary"><link rel="canonical" href="/c"></head>')),
    '</article>', concat(
      '<h2>Plans</h2>', CASE WHEN page_id % 5 = 1 THEN '<h4>Costs</h4>' ELSE '<h3>Costs</h3>' END,
      '<section><img src="img/oak-shelf.webp" alt="" loading="lazy"><img src="/b.jpg" alt="Blue kitchen"></section>',
      CASE WHEN (2 * k + 1) % 7 <> 0 THEN concat('<a href="/p/', CAST(2 * k + 1 AS STRING), '">Next plan</a>') ELSE '' END,
      '<a href="../p/', CAST(2 * k + 2 AS STRING), '#top">read more</a><a href="mailto:a@b.c">Mail</a><a href="#x">Up</a>',
      '<a href="https://other.example.com/x" rel="nofollow noopener">Out</a><a href="https://plain.example.com/"></a>',
      '<form><label for="q">Q</label><input id="q"><input id="r"></form></article>')) AS html
FROM b
"""

# Stored snapshots with fetch facts: every given page whole, and besides them one failed fetch for every 17th page.
PAGES_RAW = """
SELECT page_id, concat('site', CAST(page_id % 5 AS STRING), '.example.org') AS site, url, html,
  CAST(200 AS BIGINT) AS status_code, CAST(page_id % 4 AS BIGINT) AS depth,
  CASE WHEN page_id % 9 = 0 THEN NULL ELSE CAST(page_id % 40 AS DOUBLE) / 8 END AS load_time,
  CAST(NULL AS STRING) AS error
FROM pages_enriched
UNION ALL
SELECT page_id + CAST(1000000000000 AS BIGINT), concat('site', CAST(page_id % 5 AS STRING), '.example.org'),
  concat('https://site', CAST(page_id % 5 AS STRING), '.example.org/gone/', CAST(page_id AS STRING)), '',
  CAST(0 AS BIGINT), CAST(page_id % 4 AS BIGINT), CASE WHEN page_id % 9 = 0 THEN NULL ELSE CAST(page_id % 40 AS DOUBLE) / 8 END, 'Failed to fetch'
FROM pages WHERE page_id % 17 = 16
"""

LINK_STATUS = """
SELECT url, CAST(CASE WHEN page_id % 11 = 0 THEN 404 WHEN page_id % 13 = 0 THEN 0 ELSE 200 END AS BIGINT) AS status_code
FROM pages_enriched
"""

SITE_META = """
SELECT concat('site', CAST(s AS STRING), '.example.org') AS site,
  CASE WHEN s = 3 THEN concat('http://site', CAST(s AS STRING), '.example.org')
       ELSE concat('https://site', CAST(s AS STRING), '.example.org/') END AS base_url,
  CASE WHEN s <> 4 THEN concat('https://site', CAST(s AS STRING), '.example.org/p/0') END AS homepage_url,
  CASE WHEN s = 1 THEN 'Oak & Pine' END AS site_name,
  CASE WHEN s = 2 THEN 'Leeds' END AS location,
  CASE WHEN s = 0 THEN 'plans' END AS primary_keyword,
  CASE WHEN s = 1 THEN 'Book a visit' END AS call_to_action,
  CASE WHEN s = 0 THEN TRUE WHEN s = 2 THEN FALSE END AS https,
  CASE WHEN s = 0 THEN TRUE WHEN s IN (1, 2) THEN FALSE END AS has_robots,
  CASE WHEN s = 1 THEN TRUE WHEN s IN (0, 2) THEN FALSE END AS has_sitemap,
  CASE WHEN s = 2 THEN CAST(2.5 AS DOUBLE) END AS load_time,
  n_pages
FROM (SELECT page_id % 5 AS s, count(*) AS n_pages FROM pages GROUP BY page_id % 5)
"""

# Authority figures: two providers, some metrics without a value, none at all for one site.
AUTHORITY_METRICS = """
SELECT concat('site', CAST(s AS STRING), '.example.org') AS domain, provider, priority, metric,
  CASE WHEN (s + ord) % 4 = 3 THEN NULL ELSE CAST((n_pages * (ord + 1) * 7 + s * 13) % scale AS DOUBLE) END AS value
FROM (SELECT page_id % 5 AS s, count(*) AS n_pages FROM pages GROUP BY page_id % 5)
CROSS JOIN (VALUES ('rank', CAST(1 AS BIGINT)), ('links', CAST(2 AS BIGINT))) AS pr(provider, priority)
CROSS JOIN (VALUES (0, 'linkProfileStrength', 100), (1, 'domain_authority', 100), (2, 'pa', 100),
  (3, 'citation_flow', 100), (4, 'trustFlow', 100), (5, 'backlinks', 100000), (6, 'refDomains', 3000),
  (7, 'referring_ips', 900), (8, 'rank', 900000), (9, 'shares', 500)) AS m(ord, metric, scale)
WHERE s <> 4 AND (s <> 3 OR provider = 'links')
"""

ROBOTS_RULES = """
SELECT concat('site', CAST(s AS STRING), '.example.org') AS site, agent, CAST(ord AS BIGINT) AS ord, allow, prefix
FROM (SELECT DISTINCT page_id % 5 AS s FROM pages)
CROSS JOIN (VALUES ('*', 1, TRUE, '/p/42'), ('*', 2, FALSE, '/p/4'), ('other', 1, FALSE, '/')) AS r(agent, ord, allow, prefix)
WHERE s IN (0, 2)
"""

# Audit runs: one per event, so a user stands for a site and the value for its score.
AUDIT_HISTORY = """
SELECT user_id AS site, event_id AS run_id, ts, CAST(floor(value) AS BIGINT) AS seo_score,
  event_id % 4 AS broken_links, event_id % 6 AS images_without_alt, event_id % 900 AS word_count
FROM events
"""

# Jobs: one per event; status and times follow from the event.
JOBS = """
SELECT event_id AS job_id, user_id AS owner, ts AS created_at,
  CASE event_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'failed' ELSE 'completed' END AS status,
  CAST(event_id % 600 AS BIGINT) AS max_pages,
  CASE WHEN event_id % 5 >= 2 THEN CAST(event_id % 300 AS BIGINT) END AS seconds,
  CASE event_id % 4 WHEN 0 THEN 'free' WHEN 1 THEN 'standard' WHEN 2 THEN 'full' ELSE 'unknown' END AS tier
FROM events
"""

# Progress rows of jobs: several per job, some of them late or after the end.
JOB_LOG = """
SELECT user_id AS job_id, CASE WHEN event_id % 11 = 0 THEN 'completed' WHEN event_id % 29 = 0 THEN 'failed' WHEN event_id % 3 = 0 THEN 'pending' ELSE 'running' END AS status,
  CAST(event_id % 100 AS DOUBLE) AS progress, ts
FROM events
"""

# Changes of stored jobs in two rounds; some of jobs that are not there.
JOB_UPDATES = """
SELECT user_id * 3 AS job_id, ts, CASE WHEN day(ts) <= 15 THEN 0 ELSE 1 END AS part,
  CASE event_id % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN event_id % 4 >= 2 THEN concat('reports/', CAST(event_id AS STRING), '.json') END AS report_path,
  CASE WHEN event_id % 4 = 1 THEN concat('stopped by ', event_type) END AS error
FROM events
"""

# Rows land by thirds of the month, up to 19 hours late; nothing is later than the streams wait for.
_LANDING = "CAST(least(2, floor((day(ts + CASE event_id % 4 WHEN 0 THEN INTERVAL '0' HOUR WHEN 1 THEN INTERVAL '3' HOUR WHEN 2 THEN INTERVAL '11' HOUR ELSE INTERVAL '19' HOUR END) - 1) / 10)) AS BIGINT)"

JOB_LOG_LANDINGS = JOB_LOG.replace("ts\nFROM", f"ts, {_LANDING} AS landing\nFROM")
AUDIT_LANDINGS = AUDIT_HISTORY.replace("SELECT user_id", f"SELECT {_LANDING} AS landing, user_id")

# Events that land by thirds of the month; every 53rd comes a third later, mostly after its day was closed.
EVENT_LANDINGS = """
SELECT event_id, ts, user_id, event_type, value, props,
  CAST(least(2, floor((day(ts) - 1) / 10) + CASE WHEN event_id % 53 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS landing
FROM events
"""

# Messages with English words added to every stored turn, as the stored text is invented, and blank messages between them.
CHAT_MESSAGES = """
SELECT conv_id, turn, role,
  CASE WHEN role = 'user' THEN concat(
    CASE (conv_id + turn) % 12
      WHEN 0 THEN 'How do I fix my title and meta description?'
      WHEN 1 THEN 'Give me an action plan please'
      WHEN 2 THEN 'Is the page speed or mobile layout bad?'
      WHEN 3 THEN 'What is our score?'
      WHEN 4 THEN 'Images and alt text in WordPress'
      WHEN 5 THEN 'Which broken links should we repair?'
      WHEN 6 THEN 'Explain schema, canonical and robots'
      WHEN 7 THEN 'What should we fix first?'
      WHEN 8 THEN 'Accessibility of headings'
      WHEN 9 THEN 'Tell me about content in our CMS'
      WHEN 10 THEN 'Good morning'
      ELSE 'Anything else' END, ' ', text) ELSE text END AS text,
  concat('site', CAST(conv_id % 5 AS STRING), '.example.org') AS site
FROM conversations
UNION ALL
SELECT conv_id, turn + CAST(1000000 AS BIGINT), role, '   ', concat('site', CAST(conv_id % 5 AS STRING), '.example.org')
FROM conversations WHERE (conv_id + turn) % 12 = 11
"""

# Address variants of every stored page.
URL_SAMPLES = """
SELECT page_id, url AS base_url, CAST(n AS BIGINT) AS n, CASE n
  WHEN 0 THEN url WHEN 1 THEN concat(url, '/') WHEN 2 THEN upper(url) WHEN 3 THEN concat(url, '#part')
  WHEN 4 THEN concat('/a/../b/./c', CAST(page_id AS STRING), '/') WHEN 5 THEN concat('x', CAST(page_id AS STRING), '.html;v=1?q=2#z')
  WHEN 6 THEN concat('//cdn.example.com:8080/i', CAST(page_id AS STRING), '.PNG') WHEN 7 THEN concat('shop', CAST(page_id AS STRING), '.example.org/oak-shelf_2.html')
  WHEN 8 THEN concat('mailto:a', CAST(page_id AS STRING), '@b.c') WHEN 9 THEN '' WHEN 10 THEN concat('?page=', CAST(page_id AS STRING))
  WHEN 11 THEN concat('../../up//', CAST(page_id AS STRING)) WHEN 12 THEN concat('ftp://files.example.org/', CAST(page_id AS STRING))
  WHEN 13 THEN concat('  HTTPS://Www.Example.COM/Big-Plan_', CAST(page_id AS STRING), '//  ') WHEN 14 THEN '#top'
  WHEN 15 THEN concat('.hidden', CAST(page_id AS STRING)) WHEN 16 THEN concat('javascript:go(', CAST(page_id AS STRING), ')')
  ELSE concat('https://a.b/p;x=1/q;y=', CAST(page_id AS STRING), '?r=1') END AS url
FROM pages CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11), (12), (13), (14), (15), (16), (17)) AS v(n)
"""

DERIVED = {
    "url_samples": URL_SAMPLES,
    "pages_enriched": PAGES_ENRICHED,
    "pages_raw": PAGES_RAW,
    "link_status": LINK_STATUS,
    "site_meta": SITE_META,
    "authority_metrics": AUTHORITY_METRICS,
    "robots_rules": ROBOTS_RULES,
    "audit_history": AUDIT_HISTORY,
    "jobs": JOBS,
    "job_log": JOB_LOG,
    "job_updates": JOB_UPDATES,
    "job_log_landings": JOB_LOG_LANDINGS,
    "audit_landings": AUDIT_LANDINGS,
    "event_landings": EVENT_LANDINGS,
    "chat_messages": CHAT_MESSAGES,
}
NEEDS = {"pages_raw": ["pages_enriched"], "link_status": ["pages_enriched"]}


def with_clause(*names: str) -> str:
    """Common table expressions for the named derived tables and what they need."""
    ordered: list[str] = []
    for name in names:
        for needed in [*NEEDS.get(name, []), name]:
            if needed not in ordered:
                ordered.append(needed)
    return ",\n".join(f"{name} AS ({DERIVED[name]})" for name in ordered)
