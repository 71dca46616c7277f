"""Text as columns: cleaning, words, sentences, passages, URLs, buckets.

Everything is a built-in expression but Unicode composition, entities and case folding,
which Spark does not have: `normalized` and `clean_snippet` are Arrow UDFs, and rows of
plain ASCII without markup never reach Python. Patterns use `(?U)` where Unicode counts.
"""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_INPUT_CHARS = 5000
TITLE_CHARS, SUMMARY_CHARS, STORED_CHARS = 200, 500, 10_000

# Sections after which an article has no more content.
BACK_MATTER = (
    "see also", "references", "external links", "further reading", "notes", "bibliography", "sources", "citations",
    "footnotes", "works cited", "selected works", "works", "publications", "discography", "filmography", "gallery",
)
# Abbreviations whose dots end no sentence, also inside longer words.
ABBREVIATIONS = (
    "e.g.", "i.e.", "etc.", "vs.", "cf.", "ca.", "c.", "approx.", "Dr.", "Mr.", "Mrs.", "Ms.", "Prof.", "St.", "Jr.", "Sr.",
    "No.", "Nos.", "Fig.", "Vol.", "U.S.", "U.K.", "U.N.", "Inc.", "Ltd.", "Co.", "Gen.", "Col.", "Lt.", "Capt.", "Sgt.",
    "Gov.", "Rev.", "Mt.", "al.", "op.", "ed.", "eds.",
)
_GUARD = "\u2063"
# The English stop words of Spark's StopWordsRemover.
STOP_WORDS = """
a about above after again against all am an and any are aren't as at be because been before being below between both
but by can can't cannot could couldn't did didn't do does doesn't doing don don't down during each few for from
further had hadn't has hasn't have haven't having he he'd he'll he's her here here's hers herself him himself his how
how's i i'd i'll i'm i've if in into is isn't it it's its itself just let's me more most mustn't my myself no nor not
now of off on once only or other ought our ours ourselves out over own s same shan't she she'd she'll she's should
shouldn't so some such t than that that's the their theirs them themselves then there there's these they they'd
they'll they're they've this those through to too under until up very was wasn't we we'd we'll we're we've were
weren't what what's when when's where where's which while who who's whom why why's will with won't would wouldn't you
you'd you'll you're you've your yours yourself yourselves
""".split()


def stop_words() -> list[str]:
    """The default English stop words, those of Spark; every function that needs some takes others."""
    return list(STOP_WORDS)


# What model input loses, in this order, and what stands for it.
REMOVED = (
    (r"<[^>]{1,200}>", " "),
    (r"(?i)\b(?:https?://|www\.)\S+", " "),
    (r"(?<!\w)@\w+", " "),
    (r"(?<!\w)#(\w+)", r"\1"),
)
# An initial before another, and the blanks between two sentences.
INITIAL = r"\b([A-Z])\.(?=\s?[A-Z]\.?)"
SENTENCE_GAP = r"(?<=[.!?])\s+(?=[\"“(\[]?[A-Z0-9])"

class _Dropped(dict):
    """A translation that drops symbols and control characters but line ends and tabs, learned as they come."""

    def __missing__(self, code: int) -> int | None:
        kept = chr(code) in "\n\t" or unicodedata.category(chr(code))[0] not in ("S", "C")
        self[code] = code if kept else None
        return self[code]


_DROPPED = _Dropped()


def _normal(text: str | None, lowercase: bool) -> str:
    text = html.unescape(unicodedata.normalize("NFKC", (text or "")[:MAX_INPUT_CHARS]))
    for pattern, instead in REMOVED:
        text = re.sub(pattern, instead, text)
    text = " ".join(text.translate(_DROPPED).split())
    return text.casefold() if lowercase else text


@F.pandas_udf(T.StringType())
def _normal_udf(text: pd.Series, lowercase: pd.Series) -> pd.Series:
    return pd.Series([_normal(t, low) for t, low in zip(text, lowercase)], dtype=object)


def normalized(text: Column, lowercase: bool = False) -> Column:
    """Model input: composed, without markup, links, mentions, symbols and odd blanks; null gives ''.

    ASCII texts without markup and symbols are done by built-ins, the others by Arrow.
    """
    low = F.lower if lowercase else (lambda c: c)
    plain = text.rlike(r"^[A-Za-z0-9 .,;:!?'\"()\[\]\n\t_/*-]*$") & ~text.rlike(r"(?i)\b(?:https?://|www\.)")
    simple = low(F.trim(F.regexp_replace(F.substring(text, 1, MAX_INPUT_CHARS), r"\s+", " ")))
    return F.when(text.isNull(), "").when(plain, simple).otherwise(_normal_udf(text, F.lit(lowercase)))


def words_of(text: Column) -> Column:
    """ASCII words of already lower-cased text, in order."""
    return F.regexp_extract_all(text, F.lit(r"([a-z][a-z'\-]*)"), 1)


def content_words(lowered: Column, stop: list[str] | None = None) -> Column:
    """Words of more than one letter that are no stop words, in order and with repetition."""
    stops = F.array(*(F.lit(w) for w in (stop_words() if stop is None else stop)))
    return F.filter(words_of(lowered), lambda w: (F.length(w) > 1) & ~F.array_contains(stops, w))


def is_informative(lowered: Column, stop: list[str] | None = None) -> Column:
    return F.size(content_words(lowered, stop)) > 0


def letter_words(lowered: Column) -> Column:
    """Words of letters of any script, with apostrophes inside."""
    return F.regexp_extract_all(lowered, F.lit(r"(?U)([\p{L}\p{M}]+(?:['\u2019][\p{L}\p{M}]+)*)"), 1)


def needs_language_check(lowered: Column, stop: list[str] | None = None) -> Column:
    stops = F.array(*(F.lit(w) for w in (stop_words() if stop is None else stop)))
    return F.exists(letter_words(lowered), lambda w: ~F.array_contains(stops, w))


def clean_text(text: Column) -> Column:
    """Without empty brackets and odd blanks."""
    out = F.regexp_replace(text, r"\([\s;,:]*\)", "")
    out = F.regexp_replace(out, r"\(\s*[;,]\s*", "(")
    out = F.regexp_replace(out, "[ \\t\u00a0]+", " ")
    return F.trim(F.regexp_replace(out, r"\s+([,.;:])", "$1"))


def word_count(text: Column) -> Column:
    """Number of runs without blanks; 0 for blank text, null for null."""
    return F.when(F.trim(text) == "", 0).otherwise(F.size(F.split(F.trim(text), r"\s+")))


def is_heading(line: Column) -> Column:
    return word_count(line).between(1, 8) & ~F.rtrim(line).rlike("[.!?:;\"”)\\]]$")


def paragraphs(text: Column) -> Column:
    """Cleaned paragraphs of at least six words, in order, before the first back-matter heading."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))  # F.trim itself would take the index too
    back = F.array(*(F.lit(s) for s in BACK_MATTER))
    marked = F.transform(lines, lambda x: F.coalesce(is_heading(x) & F.array_contains(back, F.lower(x)), F.lit(False)))
    stop = F.array_position(marked, True)
    kept = F.when(stop > 0, F.slice(lines, 1, F.greatest(stop - 1, F.lit(0)).cast("int"))).otherwise(lines)
    return F.transform(F.filter(kept, lambda x: (word_count(x) >= 6) & ~is_heading(x)), clean_text)


def sentences(paragraph: Column) -> Column:
    """Sentences; dots of abbreviations and initials end none."""
    guarded = paragraph
    for short in (x for x in ABBREVIATIONS if x.count(".") > 1):
        guarded = F.replace(guarded, F.lit(short), F.lit(short.replace(".", _GUARD)))
    # Those with one dot, in one pass that looks back from dots only.
    guarded = F.regexp_replace(guarded, r"\.(?<=(?:" + "|".join(x[:-1] for x in ABBREVIATIONS if x.count(".") == 1) + r")\.)", _GUARD)
    guarded = F.regexp_replace(guarded, INITIAL, "$1" + _GUARD)
    parts = F.split(guarded, SENTENCE_GAP)
    return F.filter(F.transform(parts, lambda p: F.trim(F.translate(p, _GUARD, "."))), lambda p: p != "")


def passages(text: Column, least: int = 12, most: int = 60, count: int = 4) -> Column:
    """Passages of `least` to `most` words: whole sentences of one paragraph, packed greedily, the first `count`.

    A sentence is cut at `most` words. One that does not fit any more closes the passage,
    which counts if it has `least` words; a passage is closed as soon as it has them; what
    is left at a paragraph's end is dropped.
    """

    def one(paragraph: Column) -> Column:
        cut = F.transform(sentences(paragraph), lambda s: F.array_join(F.slice(F.split(s, r"\s+"), 1, most), " "))
        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))

        def step(acc: Column, s: Column) -> Column:
            size = word_count(s)
            over = acc["n"] + size > most
            done = F.when(over & (acc["n"] >= least), F.array_append(acc["done"], acc["open"])).otherwise(acc["done"])
            text_ = F.when(over | (acc["n"] == 0), s).otherwise(F.concat(acc["open"], F.lit(" "), s))
            n = F.when(over, size).otherwise(acc["n"] + size)
            full = n >= least
            return F.struct(F.when(full, F.array_append(done, text_)).otherwise(done).alias("done"), F.when(full, "").otherwise(text_).alias("open"), F.when(full, 0).otherwise(n).alias("n"))

        return F.aggregate(cut, start, step)["done"]

    return F.slice(F.flatten(F.transform(paragraphs(text), one)), 1, count)


def category_name(uri: Column, prefix: str) -> Column:
    """The name behind a resource address: without prefix, decoded, underscores as blanks."""
    bare = F.when(uri.startswith(prefix), F.substring(uri, F.lit(len(prefix) + 1), F.length(uri))).otherwise(uri)
    return F.replace(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), F.lit("_"), F.lit(" "))


@F.pandas_udf(T.StringType())
def _unescaped(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def clean_snippet(text: Column, limit: int) -> Column:
    """Untrusted text without tags, entities and control characters, at most `limit` long; null gives ''."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]*>", "")
    bare = F.when(bare.contains("&"), _unescaped(bare)).otherwise(bare)
    bare = F.regexp_replace(F.trim(F.regexp_replace(bare, r"(?U)\s+", " ")), r"[\p{Cc}]", "")
    return F.when(F.length(bare) <= limit, bare).otherwise(F.concat(F.rtrim(F.substring(bare, 1, limit - 1)), F.lit("…")))


def is_safe_url(url: Column, suffixes: tuple[str, ...]) -> Column:
    """https, at most 2000 characters, and a host that is or ends in one of the suffixes; false for null."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    known = F.lit(False)
    for suffix in suffixes:
        known = known | (host == suffix) | host.endswith("." + suffix)
    return F.coalesce((F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & (F.length(url) <= 2000) & known, F.lit(False))


def stem(word: Column) -> Column:
    """Without one plural s."""
    return F.when((F.length(word) > 3) & word.endswith("s") & ~word.endswith("ss"), F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)


def word_bucket(n: Column) -> Column:
    return F.when(n >= 4, "4+").otherwise(n.cast("string"))


def length_bucket(words: Column, edges: tuple[int, ...] = (0, 15, 25, 40)) -> Column:
    """The bin (low, high] of a number of words; 0 words fall into the last bin."""
    out = None
    for low, high in zip(edges, edges[1:]):
        hit, name = (words > low) & (words <= high), f"{low + 1}-{high}"
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(f">{edges[-1]}")


def seed_of(seed: Column) -> Column:
    """struct<name, depth> of 'name@depth'; names have underscores for blanks; without a depth null."""
    parts = F.split(seed, "@")
    return F.struct(F.get(parts, F.lit(0)).alias("name"), F.get(parts, F.lit(1)).try_cast("int").alias("depth"))


def literal(text: Column) -> Column:
    """A text as a quoted literal of a query language: backslashes and quotes escaped, line ends as signs."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), F.replace(F.replace(out, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit('"'))


def best_guess(general: Column, confidence: Column) -> Column:
    """What is shown of an uncertain answer: the topic with its confidence in percent; '' for none."""
    return F.when(general.isNull(), "").otherwise(F.concat(general, F.lit(" ("), percent(confidence), F.lit(")")))


def display(name: Column) -> Column:
    """An identifier for people: words with capitals."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def percent(share: Column) -> Column:
    return F.format_string("%.1f%%", 100 * share)


# Patterns of things that plain text should not hold, by name.
ANOMALIES = {
    "html_tag": r"<[a-zA-Z/][^>]{0,80}>",
    "url": r"https?://|www\.",
    "mention": r"(?U)(?<!\w)@\w+",
    "hashtag": r"(?U)(?<!\w)#\w+",
    "emoji": r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]",
    "mojibake": "Ã.|â€|Â ",
    "replacement_char": "\ufffd",
    "non_ascii": r"[^\x00-\x7f]",
    "latex": r"\$[^$]+\$|(?U)\\\w+\{",
}


def first_words(text: Column, most: int = 3) -> Column:
    """array<struct<length, prefix>>: the whole text and its first 1..most words where it has more."""
    parts = F.filter(F.split(text, r"\s+"), lambda p: p != "")
    whole = F.array(F.struct(F.lit("full").alias("length"), text.alias("prefix")))
    ks = F.filter(F.sequence(F.lit(1), F.lit(most)), lambda k: F.size(parts) > k)
    return F.concat(whole, F.transform(ks, lambda k: F.struct(k.cast("string").alias("length"), F.array_join(F.slice(parts, F.lit(1), k), " ").alias("prefix"))))


def parity(text: Column) -> Column:
    """0 or 1, by the last hexadecimal digit of the SHA-1."""
    return F.conv(F.substring(F.sha1(text), -1, 1), 16, 10).cast("int") % 2


def dev_or_test(text: Column) -> Column:
    return F.when(parity(text) == 0, "dev").otherwise("test")
