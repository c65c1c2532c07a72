"""Fixed values of the oracle, spelled out here and not taken from the Spark modules.

A change of a pattern, list or weight on one side alone turns the comparison red.
"""

from __future__ import annotations

# Html.
TAG_NAME_RE = r"^</?([A-Za-z][A-Za-z0-9:\-]*)"
RAW_END_RE = r"(?i)</(?:script|style|noscript)\s*>$"
ATTR_RE = r'''[^\s\"'<>/=]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?'''
ENTITY_RE = r"&(?:#0*[0-9]{1,12}|#[xX]0*[0-9a-fA-F]{1,10}|[a-zA-Z][a-zA-Z0-9]*);|[^&]+|&"
VOID_TAGS = [
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
]
SELF_ENDING_TAGS = ["p", "li", "dt", "dd", "option", "tr", "td", "th"]
SEMANTIC_ELEMENTS = ["header", "footer", "nav", "main", "article", "aside", "section", "figure", "figcaption"]

# Text.
WORD_RE = r"[\p{L}\p{N}_]+"
FILENAME_ALT_RE = r"(?i)^[\p{L}\p{N}_\-]+\.(?:jpg|jpeg|png|gif|svg|webp|avif)$"
KEYWORD_STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is", "was", "are",
    "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "should", "could", "may", "might",
    "must", "can", "this", "that", "these", "those", "i", "you", "he", "she", "it", "we", "they",
]
PHRASE_STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is", "was", "are",
    "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "should", "could", "may", "might",
    "must", "can", "this", "that", "these", "those", "it", "its", "their", "there", "your", "our", "about", "into", "than",
    "then", "them", "they", "you", "we", "he", "she", "his", "her", "him", "who", "what", "when", "where", "why", "how", "also",
    "not", "too", "very", "more", "most", "such", "all", "any",
]

# Urls.
SPLIT_RE = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
SKIPPED_EXTENSION_RE = r"\.(pdf|jpg|jpeg|png|gif|svg|ico|css|js|json|xml|zip|tar|gz|mp4|avi|mov|mp3|wav|doc|docx|xls|xlsx|ppt|pptx)$"
SKIPPED_HREF_RE = r"^(#|javascript:|mailto:|tel:)"

# Qa.
KEYWORD_TOPICS = [
    ("seo", "seo"), ("title", "title"), ("meta", "meta"), ("description", "meta"), ("h1", "heading"), ("heading", "heading"),
    ("image", "image"), ("alt", "image"), ("link", "link"), ("speed", "speed"), ("performance", "speed"),
    ("accessibility", "accessibility"), ("cms", "cms"), ("wordpress", "cms"), ("squarespace", "cms"), ("wix", "cms"),
    ("shopify", "cms"), ("content", "content"), ("schema", "schema"), ("structured", "schema"), ("canonical", "canonical"),
    ("robots", "robots"), ("mobile", "mobile"),
]
PLAN_WORDS = ["action plan", "plan", "priorit", "roadmap", "next step"]

# Ops.
STAGES = {"crawl": (0.0, 50.0), "analyze": (50.0, 40.0), "score": (90.0, 5.0), "finish": (95.0, 5.0)}

# Grades.
PILLAR_WEIGHTS = {
    "on_page_seo": 0.25,
    "content_quality": 0.2,
    "technical_seo": 0.2,
    "authority": 0.15,
    "ux_design": 0.1,
    "links_architecture": 0.1,
}

# Scoring.
SEMANTIC_TARGETS = ["header", "main", "footer", "nav", "article", "section"]

# Links.
BAD_ANCHORS = ["click here", "here", "read more", "learn more", "more", ""]

# Per platform the generator pattern, script paths and class marks, in listing order.
CMS_PATTERNS = [
    ("wordpress", r"WordPress", ["/wp-content/", "/wp-includes/"], ["wp-", "wordpress"]),
    ("squarespace", r"Squarespace", ["/universal/scripts-compressed/"], ["sqs-", "squarespace"]),
    ("wix", r"Wix\.com", ["parastorage.com", "wixstatic.com"], ["wix-"]),
    ("shopify", r"Shopify", ["/cdn.shopify.com"], ["shopify-"]),
    ("joomla", r"Joomla", ["/media/system/js/"], ["joomla"]),
    ("drupal", r"Drupal", ["/misc/drupal.js"], ["drupal"]),
]

# Metric label, accepted spellings in order, weight and scale.
METRICS = [
    ("Link Profile Strength", ["link_profile_strength", "linkProfileStrength", "lps"], 0.15, "plain"),
    ("Domain Authority", ["domain_authority", "domainAuthority", "da"], 0.18, "plain"),
    ("Page Authority", ["page_authority", "pageAuthority", "pa"], 0.12, "plain"),
    ("Citation Flow", ["citation_flow", "citationFlow", "cf"], 0.10, "plain"),
    ("Trust Flow", ["trust_flow", "trustFlow", "tf"], 0.15, "plain"),
    ("External Backlinks", ["external_backlinks", "externalBacklinks", "backlinks"], 0.10, "log4"),
    ("Referring Domains", ["referring_domains", "refDomains", "referringDomains"], 0.10, "log3"),
    ("Referring IPs", ["referring_ips", "refIPs", "referringIPs"], 0.05, "log3"),
    ("Top Rank", ["top_rank", "topRank", "rank"], 0.03, "rank"),
    ("Facebook Shares", ["facebook_shares", "facebookShares", "shares"], 0.02, "log3"),
]

# What the authority pillar says without figures.
NEUTRAL_ISSUE = "Authority data was not provided; educational mode enabled with a neutral score of 50."
NEUTRAL_PASSED = "Provide authority_data to replace the neutral score with measured backlink metrics."
