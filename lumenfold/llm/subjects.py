"""Subjects of texts by latent Dirichlet topics.

A topic model is fitted to the sentences of labelled passages by variational EM: each
round, Spark tasks infer the topic proportions of their sentences under the broadcast
topics and return expected counts, which are summed to the next topics. One topic starts
from the words of each subtopic label and a few start flat. Afterwards a topic belongs to
the subject that its top terms speak for, by how often labelled passages of each subject
hold them; a topic whose top terms speak for none is background.

The fit uses about FIT_ROWS labelled passages, chosen by hash, whatever the size of the
corpus, and of their words those that tell subjects apart. Every text without a subject is
then inferred sentence by sentence; a sentence is about the subject that its topics give
most of its words to, and a text about those of its sentences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.plans.lineage import cut

#: Labelled passages that the model is fitted to.
FIT_ROWS = 12_000
#: Partitions of these passages; the scan that finds them has its own.
FIT_PARTS = 8
#: The vocabulary: words of at least so many of them, of which one subject has at least this share.
LEAST_TEXTS, LEAST_SHARE = 8, 0.3
FLAT_TOPICS, ROUNDS, INNER = 3, 8, 12
ALPHA, FLAT_ALPHA, ETA = 0.05, 0.3, 0.02
TOP_TERMS, CLEAR = 20, 0.5
#: A sentence counts if so many of its words are of some subject, and one subject has this share of them.
LEAST_WORDS, LEAST_LEAD = 0.8, 0.5

_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_SENTENCE = re.compile(r"(?<=[.!?])[\"'”’)\]]*\s+|\n+")


def sentences(text: str | None) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s.strip()] if text else []


def terms(text: str) -> list[str]:
    return _WORD.findall(text.casefold())


def subject_of(column: str) -> F.Column:
    """The subject as one writes it, null if blank."""
    return F.nullif(F.lower(F.trim(column)), F.lit(""))


def exp_digamma(x: np.ndarray) -> np.ndarray:
    """exp(psi(x)) for x > 0, by the recurrence to x + 4 and the asymptotic series."""
    low = np.zeros_like(x)
    for n in range(4):
        low += 1 / (x + n)
    y = x + 4
    square = 1 / (y * y)
    return np.exp(np.log(y) - 0.5 / y - square * (1 / 12 - square / 120) - low)


def infer(word: np.ndarray, start: np.ndarray, topics: np.ndarray, alpha: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Expected words of each topic in each sentence, and each word's topic shares.

    word: ids of the words of all sentences; start: each sentence's first place (none empty);
    topics: one line of word probabilities a topic.
    """
    given = topics.T[word]
    owner = np.repeat(np.arange(len(start)), np.diff(np.concatenate((start, [len(word)]))))
    gamma = np.tile(alpha + np.float32(1), (len(start), 1))
    for _ in range(rounds):
        share = exp_digamma(gamma)[owner] * given
        share /= share.sum(axis=1, keepdims=True) + np.float32(1e-30)
        counted = np.add.reduceat(share, start, axis=0)
        gamma = alpha + counted
    return counted, share


class Model:
    """Topics over a vocabulary, and the subject of each topic (-1: background)."""

    def __init__(self, vocabulary: list[str], topics: np.ndarray, alpha: np.ndarray, subjects: list[str], belongs: np.ndarray):
        self.place = {w: i for i, w in enumerate(vocabulary)}
        self.topics, self.alpha, self.subjects = topics.astype(np.float32), alpha.astype(np.float32), subjects
        self.to_subject = np.zeros((len(topics), len(subjects)), np.float32)
        for topic, subject in enumerate(belongs.tolist()):
            if subject >= 0:
                self.to_subject[topic, subject] = 1

    def assign(self, texts: list[str | None]) -> list[list[str]]:
        """The subjects of each text, most words first."""
        place = self.place
        owner: list[int] = []
        words: list[list[int]] = []
        for n, text in enumerate(texts):
            for sentence in sentences(text):
                own = [place[t] for t in terms(sentence) if t in place]
                if own:
                    owner.append(n)
                    words.append(own)
        out: list[list[str]] = [[] for _ in texts]
        if not words:
            return out
        length = np.fromiter(map(len, words), np.int64, len(words))
        counted, _ = infer(np.concatenate([np.asarray(w) for w in words]), np.cumsum(length) - length, self.topics, self.alpha, 2 * INNER)
        weight = counted @ self.to_subject
        total, lead = weight.sum(axis=1), weight.argmax(axis=1)
        good = (total >= LEAST_WORDS) & (weight.max(axis=1) >= LEAST_LEAD * total)
        by_text: dict[int, dict[int, float]] = {}
        for n, subject, words_of in zip(np.asarray(owner)[good].tolist(), lead[good].tolist(), weight.max(axis=1)[good].tolist()):
            mine = by_text.setdefault(n, {})
            mine[subject] = mine.get(subject, 0.0) + words_of
        for n, mine in by_text.items():
            out[n] = [self.subjects[s] for s, _ in sorted(mine.items(), key=lambda x: (-x[1], x[0]))]
        return out


def fit_sample(labelled: DataFrame, identity: str, rows: int) -> DataFrame:
    """About `rows` of the labelled rows, the same at every run, in few partitions."""
    there = labelled.count()
    share = min(1.0, rows / max(1, there))
    chosen = labelled.where(F.pmod(F.xxhash64(identity), F.lit(1 << 30)) < int(share * (1 << 30)))
    return cut(chosen.repartition(FIT_PARTS, F.xxhash64("id")))


def fit(passages: DataFrame, taxonomy: DataFrame, identity: str, text: str, general: str, subtopics: str, rows: int = FIT_ROWS) -> tuple | None:
    """What `Model` is made of, from the labelled passages; None if no word tells subjects apart."""
    spark = passages.sparkSession
    known = sorted((r.subtopic, r.general) for r in taxonomy.select("subtopic", F.lower("general").alias("general")).distinct().toLocalIterator())
    subjects = sorted({g for _, g in known})
    labelled = passages.select(F.col(identity).alias("id"), F.col(text).alias("text"), subject_of(general).alias("subject"), F.col(subtopics).alias("subs")).where(F.col("subject").isin(subjects) & (F.trim("text") != ""))
    sample = fit_sample(labelled, "id", rows)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, label = [], []
            for t, g in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own = set(terms(t))
                word += own
                label += [g] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(label, pa.string())], names=["word", "subject"])

    by_subject = sample.mapInArrow(found, "word string, subject string").groupBy("word").pivot("subject", subjects).count().na.fill(0)
    often = by_subject.where(sum((F.col(f"`{s}`") for s in subjects), F.lit(0)) >= LEAST_TEXTS)
    table = sorted(often.toLocalIterator(), key=lambda r: r.word)  # at most rows * mean length / LEAST_TEXTS words
    texts_of = {r.subject: r["count"] for r in sample.groupBy("subject").count().toLocalIterator()}
    counts = np.array([[r[s] for s in subjects] for r in table], float).reshape(-1, len(subjects))
    share = counts / np.array([max(1, texts_of.get(s, 0)) for s in subjects])
    share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-30)
    telling = share.max(axis=1) >= LEAST_SHARE if len(share) else np.zeros(0, bool)
    vocabulary, share = [r.word for r, t in zip(table, telling) if t], share[telling]
    if not vocabulary:
        return None
    place, size, subs = {w: i for i, w in enumerate(vocabulary)}, len(vocabulary), {s: k for k, (s, _) in enumerate(known)}

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, labels = [], []
            for t, s in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                own = [subs[x] for x in (s or "").split("|") if x in subs]
                for sentence in sentences(t):
                    ids = [place[w] for w in terms(sentence) if w in place]
                    if ids:
                        words.append(ids)
                        labels.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.int32())), pa.array(labels, pa.list_(pa.int32()))], names=["words", "labels"])

    corpus = cut(sample.mapInArrow(encoded, "words array<int>, labels array<int>"))
    start = np.full((len(known), size), 0.02)
    pairs = corpus.select(F.explode("labels").alias("k"), "words").select("k", F.explode("words").alias("w")).groupBy("k", "w").count()
    for r in pairs.toLocalIterator():
        start[r.k, r.w] += r["count"]
    overall = start.sum(axis=0) / start.sum()
    start /= start.sum(axis=1, keepdims=True)
    start = np.where(start > 3 * overall, start, 0.02 * start) + 1e-6
    flat = overall * np.random.default_rng(0).gamma(5, 0.2, (FLAT_TOPICS, size)) + 1e-6
    topics = np.concatenate((start, flat))
    topics /= topics.sum(axis=1, keepdims=True)
    alpha = np.concatenate((np.full(len(known), ALPHA), np.full(FLAT_TOPICS, FLAT_ALPHA))).astype(np.float32)

    def expected(given):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((size, len(alpha)))
            for batch in batches:
                column = batch.column(0)
                if not len(column):
                    continue
                word = column.flatten().to_numpy()
                length = np.diff(column.offsets.to_numpy())
                _, of_word = infer(word, np.cumsum(length) - length, given.value, alpha, INNER)
                order = np.argsort(word, kind="stable")
                begin = np.concatenate(([0], np.flatnonzero(np.diff(word[order])) + 1))
                total[word[order][begin]] += np.add.reduceat(of_word[order], begin, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["counts"])

        return run

    for _ in range(ROUNDS):
        given = spark.sparkContext.broadcast(topics.astype(np.float32))
        parts = corpus.mapInArrow(expected(given), "counts binary").toLocalIterator()  # FIT_PARTS at most, of vocabulary x topics numbers
        total = sum(np.frombuffer(p.counts, np.float32).reshape(size, -1).astype(np.float64) for p in parts)
        topics = (total + ETA).T
        topics /= topics.sum(axis=1, keepdims=True)
        given.unpersist()
    belongs = np.full(len(topics), -1)
    for topic, line in enumerate(topics):
        top = np.argsort(-line, kind="stable")[:TOP_TERMS]
        speaks = line[top] @ share[top] / line[top].sum()
        if speaks.max() >= CLEAR:
            belongs[topic] = speaks.argmax()
    return vocabulary, topics, alpha, subjects, belongs


def assign_subjects(passages: DataFrame, taxonomy: DataFrame, identity: str = "passage_id", text: str = "text", general: str = "general", subtopics: str = "subtopics", rows: int = FIT_ROWS) -> DataFrame:
    """(`identity`, general): the subjects of each row whose general is null or blank.

    Null and empty texts and texts without a telling word have no rows, nor have rows with a
    null identity; a repeated identity has each of its subjects once. Labels of other
    passages are the only ones used, and only if the taxonomy has them; if there are none,
    no rows come out.
    """
    kind = dict(passages.dtypes)[identity]
    model = fit(passages, taxonomy, identity, text, general, subtopics, rows)
    schema = f"`{identity}` {kind}, general string"
    if model is None:
        return passages.sparkSession.createDataFrame([], schema)
    sent = passages.sparkSession.sparkContext.broadcast(model)  # a tuple of plain values

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = pa.array(Model(*sent.value).assign(batch.column(1).to_pylist()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pc.list_parent_indices(lists)), lists.flatten()], names=[identity, "general"])

    missing = passages.where(subject_of(general).isNull() & F.col(identity).isNotNull() & (F.col(text) != "")).select(identity, text)
    return missing.mapInArrow(assigned, schema).distinct()
