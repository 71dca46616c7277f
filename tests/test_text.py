"""Text functions on literals."""

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import text as X


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    ("text", "want"),
    [("ﬁnance  Ｔｅｘｔ", "finance Text"), ("C++ costs 5$ 😀", "C costs 5"), ("see https://a.b/c?d now", "see now"), ("hi @bob #quantum mail a@b.c", "hi quantum mail a@b.c"), ("a<b>c</b> &amp; d", "a c & d"), (None, ""), ("", ""), ("é#b", "é#b"), ("plain words, (here)", "plain words, (here)"), ("Straße", "Straße")],
)
def test_normalized(spark, text, want):
    assert one(spark, text, X.normalized) == want


def test_normalized_lowercase_folds_and_cuts(spark):
    assert one(spark, "Straße ABC", lambda c: X.normalized(c, True)) == "strasse abc"
    assert len(one(spark, "x" * 9000, X.normalized)) == 5000


def test_words(spark):
    assert one(spark, "what is the quick-fox a don't 12", X.content_words) == ["quick-fox"]
    assert one(spark, "what is it", X.is_informative) is False
    assert one(spark, "привет мир l'été", X.letter_words) == ["привет", "мир", "l'été"]
    assert one(spark, "привет", X.needs_language_check) is True and one(spark, "what is", X.needs_language_check) is False


def test_clean_text(spark):
    assert one(spark, "A ( ; ) b (; c) d  e , f .", X.clean_text) == "A b (c) d e, f."


@pytest.mark.parametrize(("line", "want"), [("History", True), ("It is.", False), ("a b c d e f g h i", False), ("", False), ("Works (1990)", False), ("Early life ", True)])
def test_heading(spark, line, want):
    assert one(spark, line, X.is_heading) is want


ARTICLE = "Title line\n\nThe first paragraph has more than six words here.\nshort one here.\nHistory\nThe second paragraph was written by Dr. Smith in 1999. It has two sentences in it.\nReferences\nThis must never come out of the article at all."


def test_paragraphs_stop_at_back_matter(spark):
    got = one(spark, ARTICLE, X.paragraphs)
    assert got == ["The first paragraph has more than six words here.", "The second paragraph was written by Dr. Smith in 1999. It has two sentences in it."]
    assert one(spark, "References\nThis must never come out of the article at all.", X.paragraphs) == []


@pytest.mark.parametrize(
    ("text", "want"),
    [("One here. Two here? Three!", ["One here.", "Two here?", "Three!"]), ("By Dr. Smith. Then J. K. Lee came.", ["By Dr. Smith.", "Then J. K. Lee came."]), ("It was created. It stayed.", ["It was created. It stayed."]), ("He said \"no.\" Then (A) left.", ["He said \"no.\" Then (A) left."]), ("Ends. lower", ["Ends. lower"])],
)
def test_sentences(spark, text, want):
    assert one(spark, text, X.sentences) == want


def fold(paragraph_sentences, least, most, count):
    out, held, n = [], [], 0
    for s in paragraph_sentences:
        w = s.split()[:most]
        if n + len(w) > most:
            if n >= least:
                out.append(" ".join(held))
            held, n = [], 0
        held += w
        n += len(w)
        if n >= least:
            out.append(" ".join(held))
            held, n = [], 0
    return out[:count]


def test_passages_against_a_plain_fold(spark):
    sents = ["Word " * k + "end." for k in (3, 4, 9, 2, 70, 1, 12, 5, 5, 5)]
    sents = [s[0].upper() + s[1:] for s in sents]
    got = one(spark, " ".join(sents), lambda c: X.passages(c, 8, 20, 4))
    assert got == fold(sents, 8, 20, 4) and all(8 <= len(p.split()) <= 20 for p in got)


def test_names_snippets_addresses(spark):
    prefix = "http://x/Category:"
    assert one(spark, prefix + "C%2B%2B_a+b", lambda c: X.category_name(c, prefix)) == "C++ a+b"
    assert one(spark, "<b>A</b> &lt;x&gt;  y\x07", lambda c: X.clean_snippet(c, 100)) == "A <x> y"
    assert one(spark, "abcdef ghij", lambda c: X.clean_snippet(c, 8)) == "abcdef…" and one(spark, None, lambda c: X.clean_snippet(c, 8)) == ""
    for url, safe in (("https://en.wikipedia.org/wiki/A", True), ("http://en.wikipedia.org", False), ("https://evilwikipedia.org", False), ("https://wikipedia.org.evil.com", False), (None, False), ("javascript:alert(1)", False), ("https://wikipedia.org/" + "a" * 2000, False)):
        assert one(spark, url, lambda c: X.is_safe_url(c, ("wikipedia.org",))) is safe


def test_small_functions(spark):
    assert [one(spark, w, X.stem) for w in ("novels", "class", "gas", "s")] == ["novel", "class", "gas", "s"]
    assert [one(spark, n, X.word_bucket, "int") for n in (0, 1, 3, 4, 9)] == ["0", "1", "3", "4+", "4+"]
    assert [one(spark, n, X.length_bucket, "int") for n in (0, 1, 15, 16, 40, 41)] == [">40", "1-15", "1-15", "16-25", "26-40", ">40"]
    assert one(spark, 0.1234, X.percent, "double") == "12.3%"
    assert [(r.length, r.prefix) for r in one(spark, "a b c", X.first_words)] == [("full", "a b c"), ("1", "a"), ("2", "a b")]
    import hashlib

    for w in ("x", "y", "zz"):
        assert one(spark, w, X.parity) == int(hashlib.sha1(w.encode()).hexdigest(), 16) % 2


def test_abbreviations_are_guarded_wherever_they_stand(spark, sf_dir):
    """As plain replacements one after the other, also inside words and after other dots."""
    import re

    def plain(text):
        for short in X.ABBREVIATIONS:
            text = text.replace(short, short.replace(".", "\u2063"))
        text = re.sub(X.INITIAL, "\\1\u2063", text)
        return [p for p in (x.replace("\u2063", ".").strip(" ") for x in re.split(X.SENTENCE_GAP, text, flags=re.A)) if p]

    texts = ["It was created. Then e.g. Dr. Who etc. Came. U.S. Army vs. No. One. Ends here. Next", "music. Then al. And Nos. 3. Co. Gen. X. Y. Zed. A", "ca.c.ed. B. eds. C", ""]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/passages.parquet").where("text is not null").select("text").collect() if r.text.isascii()]
    got = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", X.sentences(F.col("t")).alias("s")).collect()
    assert all(r.s == plain(texts[r.n]) for r in got)
