"""Text operators as Columns. Everything works inside the row, so no shuffle is needed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftaudit.functions.common import bind, collapse, empty, round2, strip

WORD_RE = r"[\p{L}\p{N}_]+"
# Plain words with digits and apostrophes between Unicode word boundaries.
PLAIN_WORD_RE = r"(?U)\b[a-zA-Z0-9']+\b"

# Words left out of the keyword list of a page.
KEYWORD_STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for",
    "of", "with", "by", "from", "as", "is", "was", "are", "were", "be",
    "been", "being", "have", "has", "had", "do", "does", "did", "will",
    "would", "should", "could", "may", "might", "must", "can", "this",
    "that", "these", "those", "i", "you", "he", "she", "it", "we", "they",
]

# Words that may not bound (or fill) a long-tail phrase.
PHRASE_STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of",
    "with", "by", "from", "as", "is", "was", "are", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "will", "would", "should", "could",
    "may", "might", "must", "can", "this", "that", "these", "those", "it", "its",
    "their", "there", "your", "our", "about", "into", "than", "then", "them", "they",
    "you", "we", "he", "she", "his", "her", "him", "who", "what", "when", "where",
    "why", "how", "also", "not", "too", "very", "more", "most", "such", "all", "any",
]

# Fixed value: alt texts that are only a file name.
FILENAME_ALT_RE = r"(?i)^[\p{L}\p{N}_\-]+\.(?:jpg|jpeg|png|gif|svg|webp|avif)$"


def words(text: Column) -> Column:
    """Lower-cased word tokens in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_RE), F.lit(0))


def count_terms(tokens: Column) -> Column:
    """Distinct tokens as ``array<struct<neg_n, pos, word>>``, most frequent first.

    Sorting (word, position) pairs puts equal words side by side, so a run
    boundary gives both the count and the first position: n log n work in the
    row and no shuffle.
    """

    def runs(pairs: Column) -> Column:
        n = F.size(pairs)
        starts = F.filter(
            F.sequence(F.lit(0), n - 1),
            lambda i: (i == 0) | (F.get(pairs, i)["word"] != F.get(pairs, i - 1)["word"]),
        )
        return bind(
            starts,
            lambda st: F.transform(
                st,
                lambda s, j: F.struct(
                    (s - F.coalesce(F.get(st, j + 1), n)).cast("bigint").alias("neg_n"),
                    F.get(pairs, s)["pos"].alias("pos"),
                    F.get(pairs, s)["word"].alias("word"),
                ),
            ),
        )

    pairs = F.sort_array(F.transform(tokens, lambda w, i: F.struct(w.alias("word"), i.alias("pos"))))
    nothing = empty("struct<neg_n:bigint,pos:int,word:string>")
    counted = bind(pairs, lambda ps: F.when(F.size(ps) > 0, runs(ps)).otherwise(nothing))
    return F.sort_array(counted)


def _ranked(terms: Column, total: Column) -> Column:
    return F.transform(
        terms,
        lambda t: F.struct(
            t["word"].alias("word"),
            (-t["neg_n"]).alias("n"),
            round2((-t["neg_n"]).cast("double") / total.cast("double") * 100.0).alias("density"),
        ),
    )


def top_keywords(tokens: Column, k: int = 20) -> Column:
    """The k most frequent words, then without stop words and words of one or two letters."""
    return bind(
        tokens,
        lambda ws: _ranked(
            F.filter(
                F.slice(count_terms(ws), 1, k),
                lambda t: ~t["word"].isin(KEYWORD_STOP_WORDS) & (F.length(t["word"]) > 2),
            ),
            F.size(ws),
        ),
    )


def plain_keyword_tokens(tokens: Column) -> Column:
    """Word tokens of three or more ASCII letters."""
    return F.filter(tokens, lambda w: w.rlike("^[a-z]{3,}$"))


def plain_keywords(tokens: Column, k: int = 20) -> Column:
    """The k most frequent plain words with density; no stop words are removed."""
    return bind(tokens, lambda ws: _ranked(F.slice(count_terms(ws), 1, k), F.size(ws)))


def contains_term(text: Column, term: Column) -> Column:
    """Whole-word containment, ignoring case."""
    quoted = F.concat(F.lit(r"(?U)\b\Q"), F.lower(term), F.lit(r"\E\b"))
    usable = (F.coalesce(text, F.lit("")) != "") & (F.coalesce(term, F.lit("")) != "")
    return F.when(usable, F.regexp_like(F.lower(text), quoted)).otherwise(F.lit(False))


def plain_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PLAIN_WORD_RE), F.lit(0))


def syllables(word: Column) -> Column:
    """Vowel groups of a word, a trailing e not counted, one at least."""

    def count(letters: Column) -> Column:
        groups = F.regexp_count(letters, F.lit("[aeiouy]+"))
        silent = F.when(letters.endswith("e") & (groups > 1), F.lit(1)).otherwise(F.lit(0))
        return F.greatest(groups - silent, F.lit(1))

    return bind(F.regexp_replace(F.lower(word), "[^a-z]", ""), count)


def sentence_count(text: Column) -> Column:
    """Non-blank segments between runs of ``.!?``; one at least."""
    segments = F.filter(F.split(text, "[.!?]+"), lambda s: s.rlike(r"[^\s\p{Z}]"))
    return F.greatest(F.size(segments), F.lit(1))


def syllable_total(tokens: Column) -> Column:
    return F.aggregate(
        tokens, F.lit(0).cast("bigint"), lambda acc, w: acc + syllables(w).cast("bigint")
    )


def flesch(text: Column) -> Column:
    """Flesch reading ease between 0 and 100."""

    def ease(tokens: Column) -> Column:
        n = F.size(tokens).cast("double")
        raw = (
            206.835
            - 1.015 * (n / sentence_count(text).cast("double"))
            - 84.6 * (syllable_total(tokens).cast("double") / n)
        )
        return F.when(F.size(tokens) == 0, F.lit(0.0)).otherwise(
            F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))
        )

    return bind(plain_words(text), ease)


def long_tail_phrases(text: Column, k: int = 5) -> Column:
    """Repeated phrases of 2-4 words that do not begin and end with a stop word.

    A longer phrase can repeat only where its word pairs do, so hashes of all pairs are
    sorted first and strings are made for the places of repeated pairs alone.
    """

    def repeated_places(ws: Column) -> Column:
        n = F.size(ws)
        hashes = F.zip_with(F.slice(ws, 1, n - 1), F.slice(ws, 2, n - 1), lambda a, b: F.xxhash64(a, b))
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        return bind(
            F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            lambda ps: F.transform(
                F.filter(ps, lambda p, j: same(p, F.get(ps, j + 1)) | same(p, F.get(ps, j - 1))), lambda p: p["i"]
            ),
        )

    def grams(ws: Column, places: Column, size: int) -> Column:
        stop = lambda i: F.get(ws, i).isin(PHRASE_STOP_WORDS)
        kept = F.filter(places, lambda i: ~(stop(i) & stop(i + (size - 1))))
        return F.transform(kept, lambda i: F.array_join(F.slice(ws, i + 1, F.lit(size)), " "))

    def ranked(ws: Column, twos: Column) -> Column:
        threes = F.array_intersect(twos, F.transform(twos, lambda i: i - 1))
        fours = F.array_intersect(threes, F.transform(twos, lambda i: i - 2))
        phrases = F.concat(grams(ws, twos, 2), grams(ws, threes, 3), grams(ws, fours, 4))
        repeated = F.filter(count_terms(phrases), lambda t: t["neg_n"] <= -2)
        order = F.sort_array(
            F.transform(
                repeated,
                lambda t: F.struct(
                    t["neg_n"].alias("neg_n"), (-F.length(t["word"])).alias("neg_len"), t["word"].alias("word")
                ),
            )
        )
        return F.transform(F.slice(order, 1, k), lambda t: t["word"])

    return bind(
        F.transform(plain_words(text), lambda w: F.lower(w)),
        lambda ws: F.when(F.size(ws) >= 4, bind(repeated_places(ws), lambda twos: ranked(ws, twos))).otherwise(empty("string")),
    )


def fingerprint(text: Column) -> Column:
    """SHA-256 of the first 200 characters of the collapsed text; empty text gives ''."""
    opening = F.substring(collapse(text), 1, 200)
    return F.when(opening == "", F.lit("")).otherwise(F.sha2(opening, 256))


def sentences(text: Column) -> Column:
    """Collapsed text split after ``.``, ``!`` or ``?`` and a blank."""
    return F.filter(
        F.transform(F.split(collapse(text), r"(?<=[.!?])[\s\p{Z}]+"), strip), lambda s: s != ""
    )


def limit_length(text: Column, most: int) -> Column:
    """Cut at a word boundary and add dots when the collapsed text is too long."""

    def cut(t: Column) -> Column:
        head = F.substring(t, 1, most - 3)
        at_word = F.regexp_replace(F.regexp_replace(head, r"(?s) [^ ]*$", ""), r"[ ,.;:]+$", "")
        kept = F.when(at_word != "", at_word).otherwise(head)
        return F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(kept), F.lit("...")))

    return bind(collapse(text), cut)


def title_case(text: Column) -> Column:
    """Upper-case the first letter of each word and leave the rest as it is."""
    return F.array_join(
        F.transform(
            F.split(collapse(text), " "),
            lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w))),
        ),
        " ",
    )


def topic_summary(text_sentences: Column, topic: Column) -> Column:
    """First sentence, at most 110 characters, or a phrase made from the topic."""
    return F.when(F.size(text_sentences) > 0, limit_length(F.get(text_sentences, F.lit(0)), 110)).otherwise(
        F.concat(F.lit("Helpful information about "), F.lower(topic))
    )


def before_separator(title: Column) -> Column:
    """The part of a title before the first ``|`` or ``-``."""
    return strip(F.regexp_extract(title, r"^[^|\-]*", 0))


def dedupe_folded(items: Column) -> Column:
    """Drop blanks and repeats (ignoring case and outer blanks), keeping the order."""
    keys = F.transform(items, lambda x: F.lower(strip(x)))
    firsts = F.sort_array(
        F.transform(F.filter(count_terms(keys), lambda t: t["word"] != ""), lambda t: t["pos"])
    )
    return bind(firsts, lambda ps: F.transform(ps, lambda p: F.get(items, p)))


def is_filename_alt(alt: Column) -> Column:
    return strip(alt).rlike(FILENAME_ALT_RE)


def is_short_alt(alt: Column) -> Column:
    return (alt != "") & (F.length(strip(alt)) < 5)


def flatten_content(content: Column) -> Column:
    """Message content to text: a string, a list of parts, or an object (VARIANT in)."""
    value = lambda v, p: F.try_variant_get(v, p, "string")
    kind = F.schema_of_variant(content)
    part_text = lambda v: F.when(
        F.schema_of_variant(v).startswith("OBJECT"),
        F.coalesce(F.nullif(value(v, "$.text"), F.lit("")), value(v, "$.content"), F.lit("")),
    ).otherwise(F.coalesce(value(v, "$"), F.lit("")))
    as_list = F.array_join(
        F.filter(
            F.transform(F.try_variant_get(content, "$", "array<variant>"), part_text), lambda t: t != ""
        ),
        "\n",
    )
    as_object = F.coalesce(
        F.nullif(value(content, "$.text"), F.lit("")),
        F.nullif(value(content, "$.content"), F.lit("")),
        F.to_json(content),
    )
    return (
        F.when(content.isNull() | (kind == "VOID"), F.lit(""))
        .when(kind.startswith("ARRAY"), as_list)
        .when(kind.startswith("OBJECT"), as_object)
        .otherwise(F.coalesce(value(content, "$"), F.lit("")))
    )
