"""DuckDB SQL that computes the same page facts relationally (unnest, window, group)."""

from __future__ import annotations

from html.entities import name2codepoint

from weftaudit.oracle import literals
from weftaudit.plans.fixtures import with_clause


def q(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


WS = r"[\s\p{Z}]+"
TOKEN_RE = (
    r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<!--.*?-->"
    r"|<[/!?a-z](?:[^\"'>]|\"[^\"]*\"|'[^']*')*>|[^<]+|<"
)
OPEN_TAG_RE = r"(?s)^<(?:[^\"'>]|\"[^\"]*\"|'[^']*')*>"
_NAMES = sorted({**name2codepoint, "apos": 39}.items())
ENTITY_MAP = (
    "MAP([" + ", ".join(q(n) for n, _ in _NAMES) + "], [" + ", ".join(q(chr(c)) for _, c in _NAMES) + "])"
)


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '[\\s\\p{{Z}}]+', ' ', 'g'))"


def decode(x: str) -> str:
    inner = "p[2:length(p)-1]"
    return f"""CASE WHEN contains({x}, '&') THEN array_to_string(list_transform(
      regexp_extract_all({x}, {q(literals.ENTITY_RE)}), lambda p: CASE
        WHEN NOT (p[1] = '&' AND right(p, 1) = ';') THEN p
        WHEN p[2:3] IN ('#x', '#X') THEN chr(CAST(('0x' || p[4:length(p)-1]) AS INTEGER))
        WHEN p[2] = '#' THEN chr(CAST(p[3:length(p)-1] AS INTEGER))
        ELSE coalesce({ENTITY_MAP}[{inner}], p) END), '') ELSE {x} END"""


def round2(x: str) -> str:
    return f"(round_even({x} * 100.0, 0) / 100.0)"


def up(x: str, n: int) -> str:
    return f"regexp_extract({x}, {q(literals.SPLIT_RE)}, {n})"


def netloc(x: str) -> str:
    return up(x, 2)


def unsplit(s: str, n: str, p: str, query: str, f: str) -> str:
    return f"""concat(CASE WHEN {s} <> '' THEN {s} || ':' ELSE '' END,
      CASE WHEN {n} <> '' THEN '//' || {n} || CASE WHEN {p} <> '' AND NOT starts_with({p}, '/') THEN '/' ELSE '' END || {p} ELSE {p} END,
      CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END, CASE WHEN {f} <> '' THEN '#' || {f} ELSE '' END)"""


def resolve(base: str, href: str) -> str:
    """Absolute URL by segment lists, written without the shortcut the Columns take."""
    folder = f"coalesce(nullif(regexp_replace({up(base, 3)}, '[^/]*$', ''), ''), '/')"
    joined = f"CASE WHEN starts_with({up(href, 3)}, '/') THEN {up(href, 3)} ELSE {folder} || {up(href, 3)} END"
    segs = f"string_split({joined}, '/')"
    inner = f"list_filter({segs}, lambda x, i: x <> '' OR i = 1 OR i = len({segs}) OR starts_with({up(href, 3)}, '/'))"
    walked = f"""list_reduce(list_transform({inner}, lambda x: [x]), lambda acc, x: CASE
        WHEN x[1] = '..' THEN acc[1:len(acc)-1] WHEN x[1] = '.' THEN acc ELSE list_concat(acc, x) END, CAST([] AS VARCHAR[]))"""
    ended = f"list_concat({walked}, CASE WHEN {segs}[-1] IN ('.', '..') THEN [''] ELSE CAST([] AS VARCHAR[]) END)"
    path = f"coalesce(nullif(array_to_string({ended}, '/'), ''), '/')"
    return f"""CASE WHEN {href} = '' THEN {base}
      WHEN lower({up(href, 1)}) <> '' AND lower({up(href, 1)}) <> lower({up(base, 1)}) THEN {href}
      WHEN {up(href, 2)} <> '' THEN {unsplit(f'lower({up(base, 1)})', up(href, 2), up(href, 3), up(href, 4), up(href, 5))}
      WHEN {up(href, 3)} = '' THEN {unsplit(f'lower({up(base, 1)})', up(base, 2), up(base, 3), f"coalesce(nullif({up(href, 4)}, ''), {up(base, 4)})", up(href, 5))}
      ELSE {unsplit(f'lower({up(base, 1)})', up(base, 2), path, up(href, 4), up(href, 5))} END"""


def short_path(p: str) -> str:
    return f"coalesce(nullif(rtrim({p}, '/'), ''), '/')"


def plain_path(p: str) -> str:
    return f"regexp_replace({p}, ';[^/]*$', '')"


def graph_key(u: str) -> str:
    s = strip(u)
    short = short_path(plain_path(up(s, 3)))
    return f"""CASE WHEN {u} = '' THEN '' ELSE concat(
      CASE WHEN {up(s, 1)} <> '' AND {up(s, 2)} <> '' THEN lower({up(s, 1)}) || '://' || {up(s, 2)} || {short} ELSE {short} END,
      CASE WHEN {up(s, 4)} <> '' THEN '?' || {up(s, 4)} ELSE '' END) END"""


def crawl_key(u: str) -> str:
    path = f"{short_path(plain_path(up(u, 3)))} || regexp_extract({up(u, 3)}, '(;[^/]*)$', 1)"
    return unsplit(f"lower({up(u, 1)})", f"lower({up(u, 2)})", f"({path})", up(u, 4), "''")


TOKENS = f"""
tok_raw AS (
  SELECT page_id, unnest(r) AS raw, generate_subscripts(r, 1) - 1 AS pos
  FROM (SELECT page_id, regexp_extract_all(html, {q(TOKEN_RE)}) AS r FROM pages_raw)
),
tok_kind AS (
  SELECT page_id, pos, raw, lower(regexp_extract(raw, {q(literals.TAG_NAME_RE)}, 1)) AS tag,
    CASE WHEN NOT starts_with(raw, '<') OR raw = '<' THEN 'text'
         WHEN lower(regexp_extract(raw, {q(literals.TAG_NAME_RE)}, 1)) IN ('script', 'style', 'noscript')
              AND regexp_matches(raw, {q(literals.RAW_END_RE)}) AND NOT starts_with(raw, '</') THEN 'raw'
         WHEN regexp_extract(raw, {q(literals.TAG_NAME_RE)}, 1) = '' THEN 'skip'
         WHEN starts_with(raw, '</') THEN 'close' ELSE 'open' END AS kind
  FROM tok_raw
),
tok AS (
  SELECT page_id, pos, kind, tag, raw, CASE WHEN kind = 'text' THEN {decode('raw')} END AS txt FROM tok_kind
),
attr_raw AS (
  SELECT page_id, pos, unnest(a) AS a, generate_subscripts(a, 1) AS ord
  FROM (SELECT page_id, pos, regexp_extract_all(
          regexp_replace(regexp_extract(raw, {q(OPEN_TAG_RE)}, 0), '^<[^\\s/>]+|/?>$', '', 'g'), {q(literals.ATTR_RE)}) AS a
        FROM tok WHERE kind IN ('open', 'raw'))
),
attr_val AS (
  SELECT page_id, pos, ord, lower(regexp_extract(a, '^[^\\s=]+', 0)) AS n,
    regexp_extract(a, '(?s)^[^=]*=\\s*(.*)$', 1) AS v0 FROM attr_raw
),
attr_bare AS (
  SELECT page_id, pos, ord, n,
    CASE WHEN v0 <> '' AND v0[1] IN ('"', '''') THEN v0[2:length(v0)-1] ELSE v0 END AS v0 FROM attr_val
),
attr AS (
  SELECT page_id, pos, n, min_by({decode('v0')}, ord) AS v FROM attr_bare GROUP BY page_id, pos, n
),
tag_attr AS (
  SELECT t.page_id, t.pos, t.kind, t.tag, t.raw,
    max(v) FILTER (n = 'name') AS name, max(v) FILTER (n = 'property') AS property,
    max(v) FILTER (n = 'content') AS content, max(v) FILTER (n = 'href') AS href,
    max(v) FILTER (n = 'src') AS src, max(v) FILTER (n = 'alt') AS alt, max(v) FILTER (n = 'title') AS title,
    max(v) FILTER (n = 'rel') AS rel, max(v) FILTER (n = 'target') AS target, max(v) FILTER (n = 'id') AS id,
    max(v) FILTER (n = 'class') AS class, max(v) FILTER (n = 'loading') AS loading,
    max(v) FILTER (n = 'lang') AS lang, max(v) FILTER (n = 'type') AS type, max(v) FILTER (n = 'for') AS for_id,
    max(v) FILTER (n = 'role') AS role, max(v) FILTER (n = 'width') AS width, max(v) FILTER (n = 'height') AS height
  FROM tok t LEFT JOIN attr a ON a.page_id = t.page_id AND a.pos = t.pos
  WHERE t.kind IN ('open', 'raw') GROUP BY ALL
),
txt AS (
  SELECT p.page_id, coalesce(trim(regexp_replace(string_agg(t.txt, ' ' ORDER BY t.pos), '[\\s\\p{{Z}}]+', ' ', 'g')), '') AS text_content
  FROM pages_raw p LEFT JOIN tok t ON t.page_id = p.page_id AND t.kind = 'text' GROUP BY p.page_id
),
named_el AS (
  SELECT o.page_id, o.pos, o.tag, o.id, o.class, coalesce(min(c.pos), 1000000000) AS z
  FROM tag_attr o LEFT JOIN tok c ON c.page_id = o.page_id AND c.kind IN ('open', 'close') AND c.pos > o.pos
    AND (c.tag = o.tag OR (length(c.tag) = 2 AND length(o.tag) = 2 AND c.tag IN ('h1', 'h2', 'h3', 'h4', 'h5', 'h6') AND o.tag LIKE 'h_'))
  WHERE o.kind = 'open' AND o.tag IN ('a', 'title', 'h1', 'h2', 'h3', 'h4', 'h5', 'h6')
  GROUP BY o.page_id, o.pos, o.tag, o.id, o.class
),
el AS (
  SELECT e.page_id, e.pos, e.tag, e.id, e.class,
    coalesce(string_agg({strip('t.txt')}, '' ORDER BY t.pos), '') AS text
  FROM named_el e LEFT JOIN tok t ON t.page_id = e.page_id AND t.kind = 'text' AND t.pos > e.pos AND t.pos < e.z
  GROUP BY e.page_id, e.pos, e.tag, e.id, e.class
)
"""

LINKS = f"""
anchor AS (
  SELECT t.page_id, t.pos, e.text, {strip('t.href')} AS href, coalesce(t.title, '') AS title,
    coalesce(t.rel, '') AS rel, coalesce(t.target, '') AS target
  FROM tag_attr t JOIN el e ON e.page_id = t.page_id AND e.pos = t.pos
  WHERE t.tag = 'a' AND t.kind = 'open' AND t.href IS NOT NULL
),
anchor_abs AS (
  SELECT a.*, p.url, p.site, {resolve('p.url', 'a.href')} AS absolute_url FROM anchor a JOIN pages_raw p USING (page_id)
),
link AS (
  SELECT *, ({netloc('absolute_url')} = {netloc('url')} OR {netloc('absolute_url')} = '') AS internal
  FROM anchor_abs WHERE href <> '' AND NOT regexp_matches(href, {q(literals.SKIPPED_HREF_RE)})
)
"""

STACK = f"""
mark AS (
  SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS i, pos, kind, tag
  FROM tok WHERE kind IN ('open', 'close')
),
walk AS (
  SELECT page_id, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS up FROM pages_raw
  UNION ALL
  SELECT w.page_id, m.i, CASE
    WHEN m.tag IN {in_list(literals.VOID_TAGS)} THEN w.up
    WHEN m.kind = 'open' AND m.tag IN {in_list(literals.SELF_ENDING_TAGS)} AND coalesce(w.up[1] = m.tag, FALSE) THEN w.up
    WHEN m.kind = 'open' THEN list_prepend(m.tag, w.up)
    WHEN coalesce(list_position(w.up, m.tag), 0) > 0 THEN w.up[list_position(w.up, m.tag) + 1:]
    ELSE w.up END
  FROM walk w JOIN mark m ON m.page_id = w.page_id AND m.i = w.i + 1
),
image AS (
  SELECT t.page_id, t.pos, row_number() OVER (PARTITION BY t.page_id ORDER BY t.pos) - 1 AS index,
    coalesce(t.src, '') AS src, CASE WHEN coalesce(t.src, '') = '' THEN '' ELSE {resolve('p.url', 't.src')} END AS absolute_src,
    coalesce(t.alt, '') AS alt, coalesce(t.alt, '') <> '' AS has_alt, coalesce(t.title, '') AS title,
    coalesce(t.width, '') AS width, coalesce(t.height, '') AS height, coalesce(w.up[1], 'body') AS placement_parent,
    list_contains(w.up, 'header') AS in_header, list_contains(w.up, 'footer') AS in_footer,
    list_contains(w.up, 'nav') AS in_nav, list_contains(w.up, 'article') AS in_article,
    coalesce(t.loading, '') AS loading, coalesce(t.class, '') AS class
  FROM tag_attr t JOIN mark m ON m.page_id = t.page_id AND m.pos = t.pos
  JOIN walk w ON w.page_id = t.page_id AND w.i = m.i - 1 JOIN pages_raw p ON p.page_id = t.page_id
  WHERE t.tag = 'img' AND t.kind = 'open'
)
"""

# Images without the ancestor walk, for the many queries that do not need it.
IMAGES = """
image AS (
  SELECT page_id, pos, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS index, coalesce(src, '') AS src,
    coalesce(alt, '') AS alt, coalesce(alt, '') <> '' AS has_alt, coalesce(loading, '') AS loading
  FROM tag_attr WHERE tag = 'img' AND kind = 'open'
)
"""

WORDS = f"""
wordlist AS (
  SELECT page_id, text_content, regexp_extract_all(lower(text_content), {q(literals.WORD_RE)}) AS ws FROM txt
),
word AS (SELECT page_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM wordlist),
word_n AS (SELECT page_id, word, count(*) AS n, min(pos) AS pos FROM word GROUP BY page_id, word),
keyword AS (
  SELECT k.page_id, k.word, k.n, k.pos, {round2('(k.n::DOUBLE / len(w.ws)::DOUBLE * 100.0)')} AS density,
    row_number() OVER (PARTITION BY k.page_id ORDER BY k.n DESC, k.pos) AS rank
  FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, pos) AS r FROM word_n) k
  JOIN wordlist w USING (page_id)
  WHERE r <= 20 AND word NOT IN {in_list(literals.KEYWORD_STOP_WORDS)} AND length(word) > 2
)
"""

_cms_rows = []
for _i, (_name, _pattern, _scripts, _classes) in enumerate(literals.CMS_PATTERNS):
    _cms_rows.append(
        f"""SELECT p.page_id, {_i} AS ord, {q(_name)} AS cms,
      CASE WHEN coalesce(regexp_matches(g.content, {q('(?i)' + _pattern)}), FALSE) THEN 3 ELSE 0 END
      + CASE WHEN coalesce(s.srcs, '') <> '' AND ({' OR '.join(f"contains(s.srcs, {q(x)})" for x in _scripts)}) THEN 2 ELSE 0 END
      + CASE WHEN {' OR '.join(f"contains(p.html, {q(x)})" for x in _classes)} THEN 1 ELSE 0 END AS score
    FROM pages_raw p
    LEFT JOIN (SELECT page_id, min_by(coalesce(content, ''), pos) AS content FROM tag_attr
               WHERE tag = 'meta' AND kind = 'open' AND name = 'generator' GROUP BY page_id) g ON g.page_id = p.page_id
    LEFT JOIN (SELECT page_id, string_agg(src, chr(10)) AS srcs FROM tag_attr WHERE tag = 'script' AND src IS NOT NULL
               GROUP BY page_id) s ON s.page_id = p.page_id"""
    )
CMS = "cms_score AS (SELECT * FROM (" + "\nUNION ALL ".join(_cms_rows) + ") WHERE score > 0)"

FACTS = f"""
meta AS (
  SELECT page_id, pos, coalesce(name, '') AS name, coalesce(property, '') AS property, coalesce(content, '') AS content,
    coalesce(nullif(lower(coalesce(name, '')), ''), lower(coalesce(property, ''))) AS key
  FROM tag_attr WHERE tag = 'meta' AND kind = 'open'
),
meta_tag AS (SELECT page_id, key, max_by(content, pos) AS value FROM meta WHERE key <> '' GROUP BY page_id, key),
fact AS (
  SELECT p.page_id, p.site, p.url, p.status_code, p.depth, p.load_time, p.error, p.html <> '' AS fetched, p.html AS page_html,
    x.text_content, length(x.text_content) AS text_length, CAST(len(w.ws) AS BIGINT) AS word_count,
    coalesce((SELECT min_by(text, pos) FROM el WHERE el.page_id = p.page_id AND tag = 'title'), '') AS title,
    (SELECT count(*) FROM el WHERE el.page_id = p.page_id AND tag = 'title') > 0 AS title_tag_found,
    coalesce((SELECT max_by(content, pos) FROM meta m WHERE m.page_id = p.page_id AND lower(name) = 'description'), '') AS meta_description,
    (SELECT min_by(content, pos) FROM meta m WHERE m.page_id = p.page_id AND name = 'description') AS first_description,
    coalesce((SELECT max_by(content, pos) FROM meta m WHERE m.page_id = p.page_id AND lower(name) = 'keywords'), '') AS meta_keywords,
    coalesce((SELECT max_by(content, pos) FROM meta m WHERE m.page_id = p.page_id AND lower(name) = 'robots'), '') AS meta_robots,
    (SELECT value FROM meta_tag m WHERE m.page_id = p.page_id AND key = 'viewport') AS viewport,
    coalesce((SELECT min_by(coalesce(lang, ''), pos) FROM tag_attr t WHERE t.page_id = p.page_id AND tag = 'html' AND kind = 'open'), '') AS language,
    coalesce((SELECT min_by(coalesce(href, ''), pos) FROM tag_attr t WHERE t.page_id = p.page_id AND tag = 'link' AND kind = 'open'
      AND list_contains(regexp_split_to_array(coalesce(rel, ''), '[\\s\\p{{Z}}]+'), 'canonical')), '') AS canonical_url,
    (SELECT count(*) FROM el WHERE el.page_id = p.page_id AND tag = 'h1') AS h1_count,
    (SELECT count(*) FROM el WHERE el.page_id = p.page_id AND tag = 'h2') AS h2_count,
    (SELECT count(*) FROM el WHERE el.page_id = p.page_id AND tag = 'h3') AS h3_count,
    (SELECT count(*) FROM el WHERE el.page_id = p.page_id AND tag = 'h4') AS h4_count,
    (SELECT count(*) FROM el WHERE el.page_id = p.page_id AND tag = 'h5') AS h5_count,
    (SELECT count(*) FROM el WHERE el.page_id = p.page_id AND tag = 'h6') AS h6_count,
    (SELECT list(DISTINCT CAST(tag[2] AS INTEGER) ORDER BY CAST(tag[2] AS INTEGER)) FROM el
      WHERE el.page_id = p.page_id AND tag[1] = 'h') AS levels,
    (SELECT count(*) FROM image i WHERE i.page_id = p.page_id) AS image_count,
    (SELECT count(*) FROM image i WHERE i.page_id = p.page_id AND NOT has_alt) AS missing_alt_count,
    (SELECT count(*) FROM link l WHERE l.page_id = p.page_id AND internal) AS internal_count,
    (SELECT count(*) FROM link l WHERE l.page_id = p.page_id AND NOT internal) AS external_count,
    (SELECT list(DISTINCT tag) FROM tok t WHERE t.page_id = p.page_id AND kind = 'open') AS tags,
    (SELECT list(DISTINCT role) FROM tag_attr t WHERE t.page_id = p.page_id AND kind = 'open' AND role IS NOT NULL) AS roles,
    (SELECT arg_max(cms, score * 10 - ord) FROM cms_score c WHERE c.page_id = p.page_id) AS cms_probable
  FROM pages_raw p JOIN txt x USING (page_id) JOIN wordlist w USING (page_id)
),
fact2 AS (
  SELECT *, title <> '' AS has_title, meta_description <> '' AS has_meta_description,
    CAST(len(list_filter({in_list(literals.SEMANTIC_ELEMENTS).replace('(', '[').replace(')', ']')}, lambda e: list_contains(tags, e))) AS BIGINT) AS semantic_count,
    array_to_string(list_filter({in_list(literals.SEMANTIC_ELEMENTS).replace('(', '[').replace(')', ']')}, lambda e: list_contains(tags, e)), '|') AS semantic_elements,
    coalesce(len(list_filter(levels, lambda x, i: i > 1 AND x - levels[i - 1] > 1)), 0) > 0 AS level_gap
  FROM fact
)
"""

A11Y = """
form_mark AS (
  SELECT page_id, pos, kind, tag, id,
    sum(CASE WHEN tag = 'form' AND kind = 'open' THEN 1 ELSE 0 END) OVER w AS form_no,
    last_value(CASE WHEN tag = 'form' THEN kind END IGNORE NULLS) OVER w AS last_form
  FROM (SELECT t.page_id, t.pos, t.kind, t.tag, a.id FROM tok t LEFT JOIN tag_attr a ON a.page_id = t.page_id AND a.pos = t.pos
        WHERE t.kind IN ('open', 'close') AND t.tag IN ('form', 'input', 'textarea', 'select'))
  WINDOW w AS (PARTITION BY page_id ORDER BY pos)
),
bare_input AS (
  SELECT DISTINCT f.page_id, f.form_no FROM form_mark f
  WHERE f.tag <> 'form' AND f.kind = 'open' AND f.last_form = 'open' AND coalesce(f.id, '') <> ''
    AND NOT EXISTS (SELECT 1 FROM tag_attr l WHERE l.page_id = f.page_id AND l.tag = 'label' AND l.kind = 'open' AND l.for_id = f.id)
),
a11y AS (
  SELECT f.page_id,
    CASE WHEN f.missing_alt_count > 0 THEN [f.missing_alt_count || ' image(s) missing alt text'] ELSE CAST([] AS VARCHAR[]) END AS issues,
    list_concat(list_concat(
      list_resize(CAST([] AS VARCHAR[]), (SELECT count(*) FROM bare_input b WHERE b.page_id = f.page_id), 'Form input without associated label'),
      CASE WHEN f.level_gap THEN ['Heading hierarchy skips levels'] ELSE CAST([] AS VARCHAR[]) END),
      CASE WHEN landmarks THEN CAST([] AS VARCHAR[]) ELSE ['Consider using semantic landmarks (main, nav)'] END) AS warnings,
    list_concat(CASE WHEN f.missing_alt_count = 0 AND f.image_count > 0 THEN ['All images have alt text'] ELSE CAST([] AS VARCHAR[]) END,
      CASE WHEN landmarks THEN ['Page uses semantic landmarks'] ELSE CAST([] AS VARCHAR[]) END) AS good
  FROM (SELECT *, (coalesce(list_contains(tags, 'main'), FALSE) OR coalesce(list_contains(roles, 'main'), FALSE))
      AND (coalesce(list_contains(tags, 'nav'), FALSE) OR coalesce(list_contains(roles, 'navigation'), FALSE)) AS landmarks FROM fact2) f
),
a11y_score AS (
  SELECT page_id, issues, warnings, good, CAST(greatest(0, 100 - 20 * len(issues) - 10 * len(warnings)) AS BIGINT) AS score FROM a11y
)
"""


def sql(select: str, *blocks: str, tables: tuple[str, ...] = ("pages_raw",)) -> str:
    """A full query: derived tables, the named blocks, then the select."""
    parts = [with_clause(*tables) if tables else "", *[b.strip() for b in blocks]]
    return "WITH RECURSIVE " + ",\n".join(p for p in parts if p) + "\n" + select


TOK = (TOKENS,)
PAGE = (TOKENS, LINKS, IMAGES, WORDS, CMS, FACTS)
