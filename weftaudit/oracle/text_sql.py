"""Oracle SQL for addresses and texts."""

from __future__ import annotations

from weftaudit.oracle import literals
from weftaudit.oracle.base import (
    PAGE, TOKENS, collapse, crawl_key, graph_key, in_list, netloc, plain_path, q, resolve, round2, sql, strip, unsplit, up,
)

S = "url"
LENIENT_PARTS = f"string_split(string_split({up(S, 3)}, '/')[1], '.')"
FIRST = f"string_split({up(S, 3)}, '/')[1]"


def lower_up(x: str, n: int) -> str:
    return f"lower({up(x, n)})"


def strict(x: str) -> str:
    return f"({lower_up(x, 1)} IN ('http', 'https') AND {up(x, 2)} <> '')"


def normal_input(scheme: str) -> str:
    t = strip(S)
    full = f"CASE WHEN contains({t}, '://') THEN {t} ELSE '{scheme}://' || {t} END"
    return f"CASE WHEN {t} <> '' AND {strict(f'({full})')} THEN rtrim({full}, '/') END"


ABS = resolve("base_url", S)


def whole_key(x: str) -> str:
    return f"""CASE WHEN {up(x, 1)} <> '' AND {up(x, 2)} <> '' THEN {unsplit(lower_up(x, 1), up(x, 2), up(x, 3), up(x, 4), "''")} END"""


SAMPLES = ("url_samples",)

SLUG_PATH = f"trim({plain_path(up(S, 3))}, '/')"
SLUG = f"""regexp_replace(regexp_replace(CASE WHEN {SLUG_PATH} = '' THEN 'home' ELSE string_split({SLUG_PATH}, '/')[-1] END, '[-_]+', ' ', 'g'), '(?i)\\.[a-z0-9]+$', '')"""
HOST = f"regexp_extract({netloc(S)}, '^[^:]*')"
LABELS = f"string_split({HOST}, '.')"
LABEL = f"CASE WHEN len({LABELS}) >= 2 THEN {LABELS}[-2] ELSE {LABELS}[1] END"

DOC_WORDS = f"""
d AS (SELECT doc_id, source, text FROM documents),
wl AS (SELECT doc_id, regexp_extract_all(lower(text), {q(literals.WORD_RE)}) AS ws FROM d),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM wl)
"""


def top(where_word: str, keep: str) -> str:
    return f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) AS rank, word, n, density FROM (
      SELECT c.doc_id, c.word, c.n, c.pos, {round2('(c.n::DOUBLE / t.total::DOUBLE * 100.0)')} AS density,
        row_number() OVER (PARTITION BY c.doc_id ORDER BY c.n DESC, c.pos) AS r
      FROM (SELECT doc_id, word, count(*) AS n, min(pos) AS pos FROM w WHERE {where_word} GROUP BY doc_id, word) c
      JOIN (SELECT doc_id, count(*) AS total FROM w WHERE {where_word} GROUP BY doc_id) t USING (doc_id))
    WHERE r <= 20 AND {keep}"""


# Plain words: maximal runs of word signs and apostrophes, cut where a segment holds another sign.
PLAIN = f"""
d AS (SELECT doc_id, text FROM documents),
run AS (SELECT doc_id, text, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}\\p{{M}}_'']+') AS runs FROM d),
pw AS (
  SELECT doc_id, text, list_filter(flatten(list_transform(runs, lambda r: string_split(
    regexp_replace(trim(r, ''''), '[a-zA-Z0-9]*[^a-zA-Z0-9''][^'']*', '#', 'g'), '#'))), lambda x: x <> '') AS ws FROM run
),
sc AS (
  SELECT doc_id, greatest(1, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: regexp_matches(s, '[^\\s\\p{{Z}}]')))) AS sentences FROM d
),
syl AS (
  SELECT doc_id, CAST(coalesce(sum(greatest(1, g - CASE WHEN right(c, 1) = 'e' AND g > 1 THEN 1 ELSE 0 END)), 0) AS BIGINT) AS syllables
  FROM (SELECT doc_id, c, len(regexp_extract_all(c, '[aeiouy]+')) AS g
        FROM (SELECT doc_id, regexp_replace(lower(unnest(ws)), '[^a-z]', '', 'g') AS c FROM pw)) GROUP BY doc_id
)
"""

STOPS = in_list(literals.PHRASE_STOP_WORDS)
LONG_TAIL = f"""
lw AS (SELECT doc_id, list_transform(ws, lambda x: lower(x)) AS ws FROM pw WHERE len(ws) >= 4),
one AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM lw),
step AS (
  SELECT doc_id, i, x, x IN {STOPS} AS stop, lead(x, 1) OVER g AS x1, lead(x, 2) OVER g AS x2, lead(x, 3) OVER g AS x3
  FROM one WINDOW g AS (PARTITION BY doc_id ORDER BY i)
),
gram AS (
  SELECT doc_id, x || ' ' || x1 AS phrase FROM step WHERE x1 IS NOT NULL AND NOT (stop AND x1 IN {STOPS})
  UNION ALL SELECT doc_id, x || ' ' || x1 || ' ' || x2 FROM step WHERE x2 IS NOT NULL AND NOT (stop AND x2 IN {STOPS})
  UNION ALL SELECT doc_id, x || ' ' || x1 || ' ' || x2 || ' ' || x3 FROM step WHERE x3 IS NOT NULL AND NOT (stop AND x3 IN {STOPS})
),
phrase AS (
  SELECT doc_id, phrase, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, length(phrase) DESC, phrase) AS rank
  FROM (SELECT doc_id, phrase, count(*) AS n FROM gram GROUP BY doc_id, phrase) WHERE n >= 2
)
"""


def sentences(x: str) -> str:
    return f"list_filter(string_split(regexp_replace({collapse(x)}, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"


def capital(w: str) -> str:
    return f"CASE WHEN {w}[1] = 'ß' THEN 'SS' ELSE upper({w}[1]) END || {w}[2:]"


def title_case(x: str) -> str:
    return f"array_to_string(list_transform(string_split({collapse(x)}, ' '), lambda w: {capital('w')}), ' ')"


def limit(x: str, n: int) -> str:
    """Expects collapsed text."""
    head = f"left({x}, {n - 3})"
    at = f"rtrim(regexp_replace({head}, ' [^ ]*$', ''), ' ,.;:')"
    return f"CASE WHEN length({x}) <= {n} THEN {x} ELSE rtrim(CASE WHEN {at} <> '' THEN {at} ELSE {head} END) || '...' END"


DOC_SENTENCES = f"ds AS (SELECT doc_id, source, {sentences('text')} AS ss FROM documents)"


def page_piece(where: str) -> str:
    return f"coalesce((SELECT string_agg({where}), '')"


PAGE_TEXT = f"""
made AS (
  SELECT f.page_id, f.text_content, {collapse('''concat_ws(' ', title, meta_description,
    (SELECT string_agg(text, ' ' ORDER BY tag, pos) FROM el WHERE el.page_id = f.page_id AND tag[1] = 'h'),
    (SELECT string_agg(alt, ' ' ORDER BY pos) FROM image i WHERE i.page_id = f.page_id),
    (SELECT string_agg(text, ' ' ORDER BY internal DESC, pos) FROM link l WHERE l.page_id = f.page_id))''')} AS synth
  FROM fact2 f
)
"""

HEAD_PART = strip("regexp_extract(" + collapse("title") + ", '^[^|\\-]*', 0)")
TOPICS = f"""
topic0 AS (
  SELECT f.page_id, f.site, f.url, {collapse('f.title')} AS clean_title, {HEAD_PART} AS head,
    coalesce((SELECT min_by({collapse('text')}, pos) FROM el WHERE el.page_id = f.page_id AND tag = 'h1' AND {collapse('text')} <> ''), '') AS first_h1,
    coalesce(nullif({collapse(SLUG)}, ''), 'home') AS slug
  FROM fact2 f
),
topic AS (
  SELECT page_id, site, url, clean_title, head, first_h1, slug,
    CASE WHEN first_h1 <> '' THEN first_h1 WHEN clean_title <> '' THEN head ELSE slug END AS keyword
  FROM topic0
),
topic_row AS (
  SELECT *, {title_case('keyword')} AS topic,
    CASE WHEN clean_title <> '' THEN {title_case('head')} ELSE {title_case('keyword')} END AS h1_text FROM topic
)
"""

STUFF = f"""
sent AS (SELECT page_id, {sentences('text_content')} AS ss FROM txt),
stuff AS (
  SELECT k.page_id, k.rank, k.word AS keyword, k.density,
    list_filter(s.ss, lambda x: list_contains(regexp_extract_all(lower(x), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+'), k.word))[1:3] AS hits
  FROM keyword k JOIN sent s USING (page_id) WHERE k.density > 3 AND length(k.word) >= 4
),
stuffing AS (
  SELECT page_id, rank, keyword, density,
    CASE WHEN len(hits) > 0 THEN array_to_string(hits, ' | ') ELSE 'Repeated keyword found: ' || keyword END AS examples FROM stuff
)
"""

ORACLE = {
    "url_validity": sql(
        f"""SELECT page_id, n, {up(S, 2)} <> '' OR ({up(S, 1)} = '' AND contains({FIRST}, '.') AND NOT starts_with({FIRST}, '.')
          AND len(list_filter({LENIENT_PARTS}, lambda x: length(x) >= 2)) > 0 AND length({FIRST}) > 3) AS lenient,
        {strict(S)} AS strict, {normal_input('https')} AS app_input, {normal_input('http')} AS tool_input FROM url_samples""",
        tables=SAMPLES,
    ),
    "url_resolve": sql(f"SELECT page_id, n, {ABS} AS absolute_url FROM url_samples", tables=SAMPLES),
    "url_keys": sql(
        f"""SELECT page_id, n, {crawl_key(S)} AS crawl_key,
        rtrim(CASE WHEN {whole_key(S)} IS NOT NULL THEN {whole_key(S)} WHEN starts_with(url, '//') THEN url
          ELSE coalesce({whole_key('abs')}, abs) END, '/') AS page_key,
        {graph_key(S)} AS graph_key, rtrim(url, '/') AS lookup_key
        FROM (SELECT *, {ABS} AS abs FROM url_samples)""",
        tables=SAMPLES,
    ),
    "url_domain": sql(
        f"""SELECT page_id, n, nullif(dom, '') AS domain, nullif(dom, '') IS NULL AS quarantined FROM (
        SELECT page_id, n, trim(lower({strip(f"coalesce(nullif({up('full_url', 2)}, ''), {up('full_url', 3)})")}), '/') AS dom
        FROM (SELECT page_id, n, CASE WHEN contains(t, '://') THEN t ELSE 'https://' || t END AS full_url
              FROM (SELECT *, {strip(S)} AS t FROM url_samples)))""",
        tables=SAMPLES,
    ),
    "url_classes": sql(
        f"""SELECT page_id, n, ({netloc(S)} = {netloc('base_url')} OR {netloc(S)} = '') AS internal,
        url <> '' AND {lower_up(S, 1)} IN ('http', 'https', '') AND NOT regexp_matches(lower({plain_path(up(S, 3))}), {q(literals.SKIPPED_EXTENSION_RE)}) AS crawlable,
        url <> '' AND NOT regexp_matches(url, {q(literals.SKIPPED_HREF_RE)}) AS link_href,
        {lower_up('abs', 1)} IN ('http', 'https') AS plain_href
        FROM (SELECT *, {ABS} AS abs FROM url_samples)""",
        tables=SAMPLES,
    ),
    "url_robots": sql(
        f"""SELECT p.page_id, any_value(p.url) AS url, coalesce(min_by(r.allow, r.ord), TRUE) AS allowed
        FROM pages_raw p LEFT JOIN robots_rules r ON r.site = p.site AND r.agent = '*'
          AND starts_with(coalesce(nullif({up('p.url', 3)}, ''), '/') || CASE WHEN {up('p.url', 4)} <> '' THEN '?' || {up('p.url', 4)} ELSE '' END, r.prefix)
        GROUP BY p.page_id""",
        tables=("pages_raw", "robots_rules"),
    ),
    "url_slugs": sql(
        f"""SELECT page_id, n, coalesce(nullif({collapse(SLUG)}, ''), 'home') AS slug,
        {strip(f"regexp_replace(regexp_replace(string_split({plain_path(up(S, 3))}, '/')[-1], '(?i)\\.[a-z0-9]+$', ''), '[-_]+', ' ', 'g')")} AS file_words,
        CASE WHEN n = 1 THEN 'Given Name' WHEN {netloc(S)} = '' THEN '' ELSE upper(({LABEL})[1]) || lower(({LABEL})[2:]) END AS site_name
        FROM url_samples""",
        tables=SAMPLES,
    ),
    "txt_words": sql(
        "SELECT doc_id, CAST(len(ws) AS BIGINT) AS word_count, array_to_string(ws, ' ') AS words FROM wl", DOC_WORDS, tables=()
    ),
    "txt_top_keywords": sql(
        top("TRUE", f"word NOT IN {in_list(literals.KEYWORD_STOP_WORDS)} AND length(word) > 2"), DOC_WORDS, tables=()
    ),
    "txt_plain_keywords": sql(top("regexp_matches(word, '^[a-z]{3,}$')", "TRUE"), DOC_WORDS, tables=()),
    "txt_primary_keyword": sql(
        """SELECT p.page_id, lower(coalesce(nullif(m.primary_keyword, ''), k.word, '')) AS keyword
        FROM pages_raw p LEFT JOIN site_meta m USING (site) LEFT JOIN keyword k ON k.page_id = p.page_id AND k.rank = 1""",
        *PAGE, tables=("pages_raw", "site_meta"),
    ),
    "txt_contains_term": sql(
        """SELECT f.page_id, coalesce(list_contains(regexp_extract_all(lower(f.title), '[\\p{L}\\p{N}\\p{M}_]+'), k.word), FALSE) AS in_title,
        list_contains(regexp_extract_all(lower(f.text_content), '[\\p{L}\\p{N}\\p{M}_]+'), 'plans') AS has_plans
        FROM fact2 f LEFT JOIN keyword k ON k.page_id = f.page_id AND k.rank = 1""",
        *PAGE,
    ),
    "txt_flesch": sql(
        """SELECT pw.doc_id, CASE WHEN len(ws) = 0 THEN 0.0::DOUBLE ELSE round(greatest(0.0, least(100.0, 206.835::DOUBLE
          - 1.015::DOUBLE * (len(ws)::DOUBLE / sentences) - 84.6::DOUBLE * (syllables::DOUBLE / len(ws)))), 6) END AS flesch
        FROM pw JOIN sc USING (doc_id) LEFT JOIN syl USING (doc_id)""",
        PLAIN, tables=(),
    ),
    "txt_syllables": sql(
        """SELECT pw.doc_id, CAST(len(ws) AS BIGINT) AS plain_words, CAST(sentences AS BIGINT) AS sentences, coalesce(syllables, 0) AS syllables
        FROM pw JOIN sc USING (doc_id) LEFT JOIN syl USING (doc_id)""",
        PLAIN, tables=(),
    ),
    "txt_long_tail": sql("SELECT doc_id, rank, phrase FROM phrase WHERE rank <= 5", PLAIN, LONG_TAIL, tables=()),
    "txt_collapse": f"SELECT doc_id, {collapse('text')} AS clean FROM documents",
    "txt_fingerprint": f"SELECT doc_id, CASE WHEN {collapse('text')} = '' THEN '' ELSE sha256(left({collapse('text')}, 200)) END AS opening FROM documents",
    "txt_duplicates": f"""SELECT doc_id, source, opening <> '' AND count(*) OVER (PARTITION BY source, opening) > 1 AS duplicated
        FROM (SELECT doc_id, source, left({collapse('text')}, 200) AS opening FROM documents)""",
    "txt_duplicate_counts": f"""SELECT source, sha256(opening) AS opening, count(*) AS n
        FROM (SELECT source, left({collapse('text')}, 200) AS opening FROM documents) WHERE opening <> '' GROUP BY ALL""",
    "txt_page_text": sql(
        f"""SELECT page_id, CASE WHEN {collapse('text_content')} <> '' THEN {collapse('text_content')} ELSE synth END AS page_text, synth AS made_text FROM made""",
        *PAGE, PAGE_TEXT,
    ),
    "txt_sentences": sql(
        "SELECT doc_id, unnest(range(1, len(ss) + 1)) AS ord, unnest(ss) AS sentence FROM ds", DOC_SENTENCES, tables=()
    ),
    "txt_topic_summary": sql(
        f"SELECT doc_id, CASE WHEN len(ss) > 0 THEN {limit('ss[1]', 110)} ELSE 'Helpful information about ' || lower(source) END AS summary FROM ds",
        DOC_SENTENCES, tables=(),
    ),
    "txt_title_case": f"SELECT doc_id, {title_case('text')} AS titled FROM documents",
    "txt_limit_length": f"SELECT doc_id, {limit('t', 60)} AS cut60, {limit('t', 125)} AS cut125 FROM (SELECT doc_id, {collapse('text')} AS t FROM documents)",
    "txt_stuffing": sql("SELECT page_id, keyword, density, examples FROM stuffing", *PAGE, STUFF),
    "txt_topics": sql("SELECT page_id, topic, keyword, first_h1, h1_text FROM topic_row", *PAGE, TOPICS),
    "txt_dedupe": f"""SELECT doc_id, string_agg(word, '|' ORDER BY r) AS exact, string_agg(word, '|' ORDER BY r) FILTER (fr = 1) AS folded
        FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(word) ORDER BY r) AS fr
          FROM (SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY min(pos)) AS r
            FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos
                  FROM (SELECT doc_id, regexp_extract_all(text, {q(literals.WORD_RE)}) AS ws FROM documents)) GROUP BY doc_id, word))
        GROUP BY doc_id""",
    "txt_alt_checks": sql(
        f"""SELECT page_id, index, regexp_matches(trim(alt || CASE WHEN page_id % 2 = 0 THEN '.jpg' ELSE '' END), {q(literals.FILENAME_ALT_RE)}) AS filename_alt,
        alt <> '' AND length(trim(alt)) < 5 AS short_alt
        FROM (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS index, coalesce(alt, '') AS alt FROM tag_attr
              WHERE tag = 'img' AND kind = 'open')""",
        TOKENS,
    ),
    "txt_flatten": """SELECT conv_id, turn, CASE turn % 4 WHEN 1 THEN concat_ws(chr(10), nullif(text, ''), nullif(role, ''))
        WHEN 2 THEN concat_ws(chr(10), nullif(text, ''), nullif(role, '')) ELSE text END AS content FROM conversations""",
    "txt_body_keywords": "",
}

from weftaudit.oracle.html_sql import BODY_TEXT  # noqa: E402

ORACLE["txt_body_keywords"] = sql(
    """SELECT b.page_id, count(w.word) AS plain_word_count,
    coalesce((SELECT string_agg(word, '|' ORDER BY n DESC, pos) FROM (
      SELECT word, count(*) AS n, min(pos) AS pos FROM bw x WHERE x.page_id = b.page_id GROUP BY word ORDER BY n DESC, pos LIMIT 10)), '') AS top_ten
    FROM body b LEFT JOIN bw w ON w.page_id = b.page_id GROUP BY b.page_id""",
    TOKENS, BODY_TEXT,
    f"""bw AS (SELECT page_id, word, pos FROM (
      SELECT page_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos
      FROM (SELECT page_id, regexp_extract_all(lower(body_text), {q(literals.WORD_RE)}) AS ws FROM body))
      WHERE regexp_matches(word, '^[a-z]{{3,}}$'))""",
)
