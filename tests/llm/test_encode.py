"""Token ids against the vocabulary's own library, and back to the text."""

import random
from pathlib import Path

import pytest

from lumenfold.llm import encode

if not Path(encode.VOCABULARY).exists():
    pytest.skip("no vocabulary files here", allow_module_level=True)

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(encode.VOCABULARY)
    t.encode_special_tokens = True
    return t


TEXTS = ["", " ", "Hello world", "don't we'll 123 4 5", "a" * 5000, "  lead\n\n\ttabs\r\n", "zażółć 日本語 🙂🙃 é", "<|endoftext|>", "x" * 3 + " " * 300 + "y", "   ​", "ab" * 3000]


def test_same_ids_as_the_library(library):
    rng = random.Random(0)
    letters = "abcdefghij ABC  ,.;:!?'0123456789éüß日本🙂\n\t"
    texts = TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 200))) for _ in range(300)]
    assert encode.Encoder().encode(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_ids_decode_to_the_text(library):
    for text in TEXTS:
        assert library.decode(encode.Encoder().encode([text])[0], skip_special_tokens=False) == text


def test_memory_is_bounded(monkeypatch, library):
    monkeypatch.setattr(encode, "REMEMBERED", 3)
    encoder = encode.Encoder()
    for text in ("one two three four five", "six seven", "one six"):
        assert encoder.encode([text])[0] == library.encode(text, add_special_tokens=False).ids


def test_frame(spark):
    rows = [(1, "Hello world", 7), (2, None, 7), (3, "", 7), (None, "Hello", 7), (1, "Hello world", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = [(r.doc_id, r.ids) for r in encode.encode_texts(df).collect()]
    assert sorted(got, key=str) == sorted([(1, [15496, 995]), (2, []), (3, []), (None, [15496]), (1, [15496, 995])], key=str)
    assert encode.encode_texts(df.limit(0)).count() == 0
