"""Texts that stop before their content does: a backward character n-gram model.

The model reads backwards from a place in a text: of the last 1, 2, 3, 4 and 6 characters
it knows how often, in the whole corpus, a line that looked like prose, a heading or a list
entry so far went on after them, and how often such a line ended there and the text went
on with another line. From these it estimates, longer contexts resting on shorter ones,
the odds that a complete line ends after the final characters of a text, against the odds
that a line of this kind and language ends anywhere. For lines that look like headings,
which prose cut early does too, the first word counts in the same way. Texts whose
log-odds are below the threshold of their language and kind of line stop too early.

The thresholds are fitted to the corpus (`fitted_thresholds`): all its inner lines, as they
are and cut at some place, show what complete and cut lines score. A dot that a sentence
goes on after counts as a cut, so a corpus with enough abbreviations has a threshold for
sentence ends too. Lines that are complete by form (link, signature, reference, rule) end a
text well, and a broken character, entity or tag or the mark of a cut tells by itself.
A text as long as a limit of its source needs stronger evidence that it is complete, in
whatever form it ends; limits are lengths, in characters or bytes, that a source has far
too often.

The counts go into a table of 2**TABLE_BITS hashed places for each kind, so the model has
one size for any corpus. Every task counts its texts into such a table and sends the
places that it used; these are summed slice by slice, first for groups of tasks, and the
sums are broadcast. Texts are never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.plans.lineage import broadcast_if_few, cut, shuffle_partitions

ORDERS = (1, 2, 3, 4, 6)
TABLE_BITS = 20
SLICES = 16
#: How many observations a shorter context counts as.
REST = 2.0
LANGUAGES = ("en", "de", "fr", "es")
KINDS = ("prose", "heading", "list")
#: A judged kind besides: lines that end as a sentence does.
SENTENCE = len(KINDS)
#: Log-odds below which a text stops too early where too few lines are there to fit a threshold.
THRESHOLD, NEVER, LEAST_LINES = 0.0, -1e3, 200
#: Where the fit of the share of cut last lines begins, its rounds, the bins of log-odds and their width.
PRIOR, FITTED, BINS, BIN = 0.1, 50, 128, 0.25
#: The fitted share of cut last lines, or of complete ones, is no less.
LEAST_SHARE = 0.001
#: By what the log-odds of a text at its source's limit are lowered.
AT_LIMIT = 4.0

#: Marks, broken entities and characters are shorter than this.
MARK_LENGTH = 100
_MARK = re.compile(r"\s*(?:\[\s*(?:\.{3}|…|truncated|cut|snip|continued|more)\s*\]|\(\s*(?:\.{3}|…|truncated|cont(?:inue)?d?\.?|more)\s*\)|<\s*(?:more|truncated|continued)\s*>|…|\.{3,})$", re.I)
_BROKEN = re.compile(r"(?:&(?:#?[0-9a-zA-Z]{0,8})|�+)$")
#: From the last "<" of a line on: little, or a tag with attributes of any length.
_OPEN_TAG = re.compile(r"<[A-Za-z/!][^<>\n]{0,60}$|<[A-Za-z][\w:-]*\s[^<>\n]*=[^<>\n]*$")
_NOT_BROKEN = re.compile(r"[A-Z]&[A-Z]$")
_SENTENCE_END = re.compile(r"[.!?。！？][\"'”’»)\]*_]*$")
_WHOLE = re.compile(r"(?:^--+\s*\S.*|^[A-Za-z]+://\S+|.*,\s*(?:\d{4}|pp?\. ?\d+(?:[-–]\d+)?|box \d+)|^\W*(?:end|fin|ende)?\W*)$")
#: A dot that a sentence goes on after.
_INNER_DOT = re.compile(r"[.!?](?=\s*[^\W_A-Z])")
_LIST = re.compile(r"^\s*(?:(?:[-*•·+]|\d{1,3}[.)])\s+|Tags?: )")
_HEADING = re.compile(r"^[#\s]*[^\W_][^.,;:!?\n]*$")
HEADING_WORDS = 6
#: A context after which prose goes on with another word at this rate may end a whole word.
WHOLE_WORD = 0.02
#: The beginning of a line of prose that might be a heading so far.
_HEAD = re.compile(r"^[#\s]*[^\W_][^.,;:!?\s]*(?:[ \t]+[^.,;:!?\s]+){0,%d}(?=[ \t])" % (HEADING_WORDS - 1))
LINES = 2 * len(KINDS) + 3


def is_whole(line: str) -> bool:
    """Whether a line is complete by its form; the cheap tests let only lines through that may be."""
    return bool((line[-1].isdigit() or not line[0].isalnum() or "://" in line or len(line) < 5) and _WHOLE.match(line))


def kind_of(line: str) -> int:
    """The place in KINDS of a line."""
    if _LIST.match(line):
        return 2
    if len(line) < 80 and _HEADING.match(line) and len(line.split()) <= HEADING_WORDS:
        return 1
    return 0


def language_of(lang: str | None) -> int:
    """The place in LANGUAGES of a language however written, after them for others."""
    code = (lang or "").strip().lower()[:2]
    return LANGUAGES.index(code) if code in LANGUAGES else len(LANGUAGES)


def places(codes: np.ndarray) -> list[np.ndarray]:
    """For each order, the table place of the context that ends at each character."""
    out, context = [], np.zeros(len(codes), np.uint64)
    for n in range(max(ORDERS)):
        context = context * np.uint64(0x100000001B3)
        context[n:] += codes[: len(codes) - n]
        if n + 1 in ORDERS:
            out.append((((context ^ (context >> np.uint64(29))) + np.uint64(n + 1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - TABLE_BITS)).astype(np.int64))
    return out


def opening(line: str) -> int:
    """The table place of the first word of a line."""
    return xxhash.xxh64_intdigest(line.split(None, 1)[0].lower()) >> (64 - TABLE_BITS)


def characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def is_letter(codes: np.ndarray) -> np.ndarray:
    """Whether characters are letters or digits, near enough: of the others only ASCII and general punctuation."""
    low = codes < 128
    known = (codes >= 48) & (codes <= 57) | (codes >= 65) & (codes <= 90) | (codes >= 97) & (codes <= 122)
    return np.where(low, known, (codes > 0xBF) & ((codes < 0x2000) | (codes > 0x206F)))


def line_counts(texts: list[str | None], langs: list[str | None], table: np.ndarray, totals: np.ndarray) -> None:
    """Add the texts to `table` (lines for each kind going on, then for each kind ending) and to `totals` by language."""
    kinds = len(KINDS)
    ended: list[list[str]] = [[] for _ in KINDS]
    went_on: list[list[str]] = [[] for _ in KINDS]
    for text, lang in zip(texts, langs):
        if not text:
            continue
        own = totals[language_of(lang)]
        lines = [x for x in (line.rstrip() for line in text.rstrip().split("\n")) if x]
        for n, line in enumerate(lines, 1):
            if is_whole(line):
                continue
            kind = kind_of(line)
            (ended if n < len(lines) else went_on)[kind].append(line if n < len(lines) else line[:-1])
            own[kind] += len(line) - 1
            own[kinds + kind] += n < len(lines)
            if kind == 0:
                head = _HEAD.match(line)
                if head:
                    went_on[1].append(head[0])
                    own[1] += len(head[0])
                    own[2 * kinds] += 1
            elif kind == 1:
                own[2 * kinds + (n < len(lines))] += 1
    for groups, ends in ((ended, True), (went_on, False)):
        for kind, lines in enumerate(groups):
            if not lines:
                continue
            codes = characters("\n" + "\n".join(lines) + "\n")
            end = np.zeros(len(codes), bool)
            if ends:
                end[:-1] = codes[1:] == 10
            inner = (codes != 10) & ~end
            end &= codes != 10
            # Prose that goes on with another word is counted apart, which tells whether a word is whole.
            parted = inner.copy()
            parted[:-1] &= ~is_letter(codes[1:])
            parts = [(kind, inner & ~parted), (LINES - 1, parted)] if kind == 0 else [(kind, inner)]
            if ends:
                parts.append((kinds + kind, end))
            for place in places(codes):
                for line, which in parts:
                    table[line] += np.bincount(place[which], minlength=table.shape[1])
            if kind == 1:
                first = np.fromiter((opening(x) for x in lines if x.strip()), np.int64)
                table[2 * kinds + ends] += np.bincount(first, minlength=table.shape[1])


def train(documents: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The table and the totals of all texts (columns text, lang)."""
    size, slices = 1 << TABLE_BITS, SLICES
    lines, languages = LINES, len(LANGUAGES) + 1

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, totals = np.zeros((lines, size), np.int64), np.zeros((languages, lines), np.int64)
        for batch in batches:
            line_counts(batch.column(0).to_pylist(), batch.column(1).to_pylist(), table, totals)
        blobs = [*(packed(part) for part in np.split(table, slices, axis=1)), packed(totals)]
        keys, task = range(slices + 1), TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([task] * len(keys), pa.int32()), pa.array(blobs, pa.binary())], names=["slice", "task", "counts"])

    def summed(groups: int):
        """Sums for each slice and group of tasks."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                for n, task, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    at = (n, task % groups)
                    sums[at] = sums[at] + unpacked(blob.as_py()) if at in sums else unpacked(blob.as_py())
            columns = [pa.array([k[0] for k in sums], pa.int32()), pa.array([k[1] for k in sums], pa.int32()), pa.array([packed(x) for x in sums.values()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["slice", "task", "counts"])

        return run

    schema = "slice int, task int, counts binary"
    partitions = shuffle_partitions(documents.sparkSession)
    parts = documents.select("text", "lang").mapInArrow(counted, schema)
    for groups in dict.fromkeys((max(1, partitions // (slices + 1)), 1)):  # first some tasks for each slice, then all
        wide = min(partitions, groups * (slices + 1))
        parts = parts.repartitionById(wide, (F.col("slice") * groups + F.col("task") % groups) % wide).mapInArrow(summed(groups), schema)
    table, totals = np.zeros((lines, size), np.float32), np.zeros((languages, lines), np.int64)
    for row in parts.toLocalIterator():  # SLICES + 1 rows of one fixed size
        if row["slice"] == slices:
            totals = unpacked(row["counts"]).reshape(languages, lines)
        else:
            width = size // slices
            table[:, row["slice"] * width : (row["slice"] + 1) * width] = unpacked(row["counts"]).reshape(lines, width)
    return table, totals


def packed(counts: np.ndarray) -> bytes:
    """Compressed counts, in the narrowest of two widths that holds them."""
    wide = int(counts.max(initial=0) >= 1 << 31)
    return bytes([wide]) + counts.size.to_bytes(8, "little") + pa.compress(counts.astype(np.int64 if wide else np.int32).tobytes(), "zstd", asbytes=True)


def unpacked(blob: bytes) -> np.ndarray:
    kind = np.dtype(np.int64 if blob[0] else np.int32)
    return np.frombuffer(pa.decompress(blob[9:], int.from_bytes(blob[1:9], "little") * kind.itemsize, "zstd", asbytes=True), kind).astype(np.int64)


def length_limits(documents: DataFrame) -> DataFrame:
    """(source, unit, length): lengths in characters or bytes that far too many texts of a source have.

    At most 200 rows a source, as each length has a hundredth of its texts.
    """
    lengths = documents.where(F.trim("text") != "").groupBy("source", F.length("text").alias("chars"), F.octet_length("text").alias("bytes")).agg(F.count("*").alias("n"))
    each = lengths.select("source", "n", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length")))).alias("x"))
    counted = cut(each.groupBy("source", "x.unit", "x.length").agg(F.sum("n").alias("n")))
    usual = counted.groupBy(F.col("source").alias("s"), F.col("unit").alias("u")).agg((F.sum("n") / F.count("*")).alias("usual"), F.sum("n").alias("all"))
    often = counted.where(F.col("n") >= 5)
    far = often.join(usual, F.col("source").eqNullSafe(F.col("s")) & (F.col("unit") == F.col("u")))
    return far.where((F.col("n") >= 8 * F.col("usual")) & (F.col("n") >= 0.01 * F.col("all"))).select("source", "unit", "length")


def judged_kind(line: str) -> int:
    """The place of a line in KINDS, or SENTENCE if it ends as a sentence does."""
    return SENTENCE if _SENTENCE_END.search(line) else kind_of(line)


def log_odds(lines: list[str], language: np.ndarray, kind: np.ndarray, table: np.ndarray, totals: np.ndarray, seen_end: int = 0, seen_on: int = 0) -> np.ndarray:
    """For each line the log-odds that a complete line of its kind ends after it, against those of any place.

    language, kind: of each line; sentences count as prose. seen_end, seen_on: how often the
    counts hold each line's own end as an end or as going on, which is taken off. A list
    entry or row of tags whose last word prose goes on from, as from a whole word, is complete too.
    """
    kinds = len(KINDS)
    if not lines:
        return np.zeros(0)
    tails = [("\n" + x)[-max(ORDERS) - 1 :] for x in lines]
    length = np.fromiter(map(len, tails), np.int64, len(tails))
    last = np.cumsum(length) - 1
    at = [place[last] for place in places(characters("".join(tails)))]
    group = np.where(kind == SENTENCE, 0, kind)
    all_ = totals.sum(axis=0)
    ends = totals[language, kinds + group] + 0.1 * all_[kinds + group] + 1
    going = totals[language, group] + 0.1 * all_[group] + 50

    def odds(which: np.ndarray, ended: int, went_on: list[int], base: np.ndarray) -> np.ndarray:
        p = base
        for n, place in zip(ORDERS, at):
            yes = np.maximum(table[ended, place[which]].astype(np.float64) - seen_end, 0)
            no = np.maximum(sum(table[x, place[which]] for x in went_on).astype(np.float64) - seen_on, 0)
            p = np.where(length[which] >= n, (yes + REST * p) / (yes + no + REST), p)
        p = np.clip(p, 1e-12, 1 - 1e-12)
        return np.log(p / (1 - p)) - np.log(base / (1 - base))

    out = np.zeros(len(lines))
    for k in range(kinds):
        which = np.flatnonzero(group == k)
        if not len(which):
            continue
        out[which] = odds(which, kinds + k, [0, LINES - 1] if k == 0 else [k], (ends / (ends + going))[which])
        if k == 2:
            out[which] = np.maximum(out[which], odds(which, LINES - 1, [0], np.full(len(which), WHOLE_WORD)))
        if k == 1:
            first = np.fromiter((opening(lines[i]) for i in which.tolist()), np.int64, len(which))
            began = (table[2 * kinds + 1, first].astype(np.float64) + 0.5) / (table[2 * kinds, first] + 0.5)
            out[which] += np.clip(np.log(began * (all_[2 * kinds] + 1) / (all_[2 * kinds + 1] + 1)), -3, 3)
    return out


def cut_line(line: str) -> str | None:
    """`line` cut at a place that its hash chooses; None if nothing, a line complete by form or what ends as a sentence is left."""
    if len(line) < 2:
        return None
    at = 1 + xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass")) % (len(line) - 1)
    left = line[:at].rstrip()
    return None if not left or is_whole(left) or _SENTENCE_END.search(left) else left


def fitted_thresholds(documents: DataFrame, model: Broadcast) -> np.ndarray:
    """For each language and judged kind, the log-odds below which a line counts as cut.

    Of all texts (columns text, lang) all lines but the last are scored as they are and cut
    at one place each and at dots that a sentence goes on after, their own counts taken off.
    These give the log-odds of complete and of cut lines; the share of cut ones among the last lines, which are some of either, is
    fitted to these, and the threshold makes the fewest errors with that share. How many texts
    end at a dot inside a sentence is told by how many such dots there are. Languages with
    fewer than LEAST_LINES complete or cut lines of a kind take the threshold of all
    languages; kinds that are so rare take THRESHOLD, and sentence ends are then never doubted.
    """
    languages, kinds = len(LANGUAGES) + 1, len(KINDS) + 1

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, totals = model.value
        sums = np.zeros((languages, kinds, 3, BINS), np.int64)
        for batch in batches:
            groups: list[list[str]] = [[], [], []]
            owners: list[list[int]] = [[], [], []]
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = language_of(lang)
                lines = [x for x in (line.rstrip() for line in (text or "").rstrip().split("\n")) if x]
                for line in lines[:-1]:
                    if not is_whole(line):
                        inner = [line[: dot.end()] for dot in _INNER_DOT.finditer(line)]
                        for which, some in ((0, [line]), (1, [x for x in (cut_line(line), *inner) if x])):
                            groups[which] += some
                            owners[which] += [own] * len(some)
                if lines and form_of(lines[-1]) is None and not is_whole(lines[-1]):
                    groups[2].append(lines[-1])
                    owners[2].append(own)
            for which, (lines, own) in enumerate(zip(groups, owners)):
                language, kind = np.asarray(own, np.int64), np.fromiter(map(judged_kind, lines), np.int64, len(lines))
                np.add.at(sums, (language, kind, which, bin_of(log_odds(lines, language, kind, table, totals, which == 0, which == 1))), 1)
        found = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int32)) for x in found), pa.array(sums[found])], names=["language", "kind", "part", "bin", "n"])

    rows = documents.select("text", "lang").mapInArrow(counted, "language int, kind int, part int, bin int, n long")
    sums = np.zeros((languages, kinds, 3, BINS))
    for r in rows.groupBy("language", "kind", "part", "bin").agg(F.sum("n").alias("n")).toLocalIterator():  # at most languages x kinds x 3 x BINS
        sums[r["language"], r["kind"], r["part"], r["bin"]] = r["n"]
    together = sums.sum(axis=0)
    # Where PRIOR of the texts are cut anywhere, so many end after a dot inside a sentence.
    share = PRIOR * together[SENTENCE, 1].sum() / max(1.0, float(model.value[1][:, : len(KINDS)].sum()))
    plans = [(THRESHOLD, None)] * len(KINDS) + [(NEVER, share)]
    return np.array([[threshold_of(*(own[kind] if own[kind][:2].sum(axis=1).min() >= LEAST_LINES else together[kind]), *plans[kind]) for kind in range(kinds)] for own in sums])


def threshold_of(complete: np.ndarray, cut_: np.ndarray, last: np.ndarray, few: float, known: float | None) -> float:
    """The edge of a bin below which last lines are cut, from the counts of three kinds of lines in each bin; `few` if these are too few.

    known: the share of cut last lines, if it is not to be fitted.
    """
    if min(complete.sum(), cut_.sum()) < LEAST_LINES or not last.sum():
        return few
    one, two = ((x + 0.01) / (x + 0.01).sum() for x in (complete, cut_))
    share = PRIOR if known is None else known
    for _ in range(FITTED if known is None else 0):
        share = float(np.clip((last * share * two / (share * two + (1 - share) * one)).sum() / last.sum(), LEAST_SHARE, 1 - LEAST_SHARE))
    below = lambda x: np.concatenate(([0], np.cumsum(x)))
    errors = (1 - share) * below(one) + share * (1 - below(two))
    edges = (np.flatnonzero(errors <= errors.min() + 1e-12) - BINS // 2) * BIN
    return float(edges[np.argmin(np.abs(edges))])


def bin_of(odds: np.ndarray) -> np.ndarray:
    """The bin of BIN width, BINS in all, with 0 in the middle."""
    return np.clip(np.floor(odds / BIN).astype(np.int64) + BINS // 2, 0, BINS - 1)


def form_of(text: str) -> bool | None:
    """Whether a text without blanks at its end stops early, if a mark of a cut or broken markup at the end tells."""
    tail = text[-MARK_LENGTH:]
    mark = _MARK.search(tail)
    if mark:
        body = text[: len(text) - len(tail) + mark.start()].rstrip()
        return bool(body) and not _SENTENCE_END.search(body[-MARK_LENGTH:])
    opened = text.rfind("<", text.rfind("\n") + 1)
    if opened >= 0 and _OPEN_TAG.match(text, opened):
        return True
    return True if _BROKEN.search(tail) and not _NOT_BROKEN.search(tail) else None


def last_line(text: str) -> str:
    return text[text.rfind("\n") + 1 :].rstrip()


def judge(texts: list[str | None], langs: list[str | None], table: np.ndarray, totals: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text whether it stops early, and whether it would if it were at a limit of its source."""
    early, limited = np.zeros(len(texts), bool), np.zeros(len(texts), bool)
    asked: list[int] = []
    lines: list[str] = []
    formed: list[bool] = []
    for i, text in enumerate(texts):
        text = text.rstrip() if text else ""
        if not text:
            continue
        form = form_of(text)
        if form is not None:
            early[i] = limited[i] = form
        else:
            line = last_line(text)
            whole = is_whole(line)
            if not whole or any(c.isalnum() for c in line):
                asked.append(i)
                lines.append(line)
                formed.append(whole)
    language = np.fromiter((language_of(langs[i]) for i in asked), np.int64, len(asked))
    kind = np.fromiter(map(judged_kind, lines), np.int64, len(lines))
    over = log_odds(lines, language, kind, table, totals) - thresholds[language, kind]
    early[asked] = (over < 0) & ~np.asarray(formed, bool)
    limited[asked] = over < AT_LIMIT
    return early, limited


def truncated(documents: DataFrame, identity: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(`identity`, source, truncated) of every row with an id; null, empty and blank texts are not truncated.

    A repeated id comes out as often as it is there. Null languages and sources are one more
    language and source. An empty table gives no rows.
    """
    rows = documents.select(F.col(identity).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    context = rows.sparkSession.sparkContext
    counts = context.broadcast(train(rows))
    thresholds = fitted_thresholds(rows, counts)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, totals = counts.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            early, limited = judge(texts, batch.column(2).to_pylist(), table, totals, thresholds)
            chars = pa.array([None if t is None else len(t) for t in texts], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), chars, pc.binary_length(batch.column(1).cast(pa.binary())), pa.array(early), pa.array(limited)], names=["id", "source", "chars", "bytes", "early", "limited"])

    # Only ids, sources, lengths and both answers meet the limits, never texts.
    answers = rows.where(F.col("id").isNotNull()).mapInArrow(judged, f"id {dict(rows.dtypes)['id']}, source string, chars int, bytes int, early boolean, limited boolean")
    limits = broadcast_if_few(cut(length_limits(rows)).groupBy("source").agg(F.collect_set(F.struct("unit", "length")).alias("limits")).withColumnRenamed("source", "_s"))
    met = answers.join(limits, F.col("source").eqNullSafe(F.col("_s")), "left")
    at = F.coalesce(F.array_contains("limits", F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length"))) | F.array_contains("limits", F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length"))), F.lit(False))
    return met.select(F.col("id").alias(identity), "source", F.when(at, F.col("limited")).otherwise(F.col("early")).alias("truncated"))


def truncation_rates(documents: DataFrame, **columns) -> DataFrame:
    """(source, documents, truncated, rate) for each source."""
    return truncated(documents, **columns).groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("truncated").cast("long")).alias("truncated"), F.round(F.avg(F.col("truncated").cast("double")), 6).alias("rate"))
