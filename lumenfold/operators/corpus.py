"""Building and checking a corpus: repeats, near repeats across splits, caps, samples, transitions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.operators.evaluation import quantile
from lumenfold.plans.lineage import cut


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in `order`; as a max over structs, so partial results combine before the shuffle."""
    others = [c for c in rows.columns if c not in key]
    names = [f"_o{i}" for i in range(len(order))]
    best = rows.withColumns(dict(zip(names, order))).groupBy(*key).agg(F.max(F.struct(*names, *others)).alias("_best"))
    return best.select(*key, *(F.col("_best")[c].alias(c) for c in others))


def exact_first(rows: DataFrame, text: Column, order: list[str]) -> DataFrame:
    """Rows without later repeats of a text: of equal texts the first in `order` stays. Null texts are equal.

    Only hashes and the order columns are shuffled for the choice.
    """
    key = F.sha2(F.coalesce(text, F.lit("\0")), 256)
    first = rows.select(key.alias("_k"), F.struct(*order).alias("_o")).groupBy("_k").agg(F.min("_o").alias("_o"))
    tagged = rows.withColumns({"_k": key, "_o": F.struct(*order)})
    return tagged.join(first, ["_k", "_o"], "left_semi").drop("_k", "_o")


def recounted(articles: DataFrame, passages: DataFrame, key: str, count: str) -> DataFrame:
    """`articles` with `count` as the number of `passages` they have, 0 if none."""
    n = passages.groupBy(key).agg(F.count("*").alias("_n"))
    return articles.drop(count).join(n, key, "left").withColumn(count, F.coalesce("_n", F.lit(0))).drop("_n")


def tfidf(texts: DataFrame, identity: str, terms: str, fit: Column, least: int = 1, most: float = 1.0, size: int | None = None) -> DataFrame:
    """(id, fit, term, weight): unit vectors of sublinear tf times smooth idf; see `_weighted`."""
    raw = _weighted(texts, identity, terms, fit, least, most, size)
    norms = raw.groupBy("id", "fit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, ["id", "fit"]).select("id", "fit", "term", (F.col("w") / F.col("norm")).alias("weight"))


def _weighted(texts: DataFrame, identity: str, terms: str, fit: Column, least: int = 1, most: float = 1.0, size: int | None = None) -> DataFrame:
    """(id, fit, term, idf, w): w is sublinear tf times smooth idf.

    idf = ln((1 + n)/(1 + df)) + 1 over the rows where `fit` holds. Terms have weight if at
    least `least` of those rows and at most a share `most` of them have them and, with
    `size`, if they are among the so many most frequent.
    """
    pairs = texts.select(F.col(identity).alias("id"), fit.alias("fit"), F.explode(terms).alias("term")).groupBy("id", "fit", "term").agg(F.count("*").alias("tf"))
    n = texts.where(fit).agg(F.countDistinct(identity).alias("n"))
    seen = pairs.where("fit").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("all")).crossJoin(F.broadcast(n)).where((F.col("df") >= least) & (F.col("df") <= most * F.col("n")))
    if size is not None:
        seen = seen.orderBy(F.desc("all"), "term").limit(size)
    idf = seen.select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    return pairs.join(idf, "term").select("id", "fit", "term", "idf", ((1 + F.log("tf")) * F.col("idf")).alias("w"))


def word_terms(words: Column) -> Column:
    """Words and pairs of neighbouring words."""
    pairs = F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat(words[i - 1], F.lit(" "), words[i])))
    return F.concat(words, F.coalesce(pairs, F.array().cast("array<string>")))


def character_terms(words: Column, least: int = 3, most: int = 5) -> Column:
    """Runs of `least` to `most` characters inside each word with a blank on both sides; whole short words once a length."""

    def runs(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        return F.flatten(F.transform(F.sequence(F.lit(least), F.lit(most)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1))), lambda i: F.substring(padded, i, n))))

    return F.flatten(F.transform(words, runs))


def near_duplicates(texts: DataFrame, identity: str, terms: str, train: Column, threshold: float = 0.9) -> DataFrame:
    """(id, best): rows outside train whose TF-IDF cosine with some train row is at least `threshold`.

    Terms are dropped from the candidate search, in one order for all rows, the most common
    first, as long as the norm of what is dropped stays below the threshold. Of a pair, all
    terms that either side dropped come before the later of two places in this order, so one
    side dropped them all and they alone cannot reach the threshold: a pair that close shares
    a term that both keep. Candidates get the exact cosine; equal vectors are compared once.
    """
    raw = _weighted(texts, identity, terms, train)
    codes = [F.bit_xor(F.xxhash64("term", "w", F.lit(i))).alias(f"code{i}") for i in (0, 1)]
    rows = cut(raw.groupBy("id", "fit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), *codes))
    classes = rows.groupBy("fit", "code0", "code1").agg(F.min("id").alias("class"))
    known = rows.join(classes, ["fit", "code0", "code1"])
    chosen = known.where(F.col("id") == F.col("class")).select("id", "fit", "norm")
    vectors = cut(raw.join(chosen, ["id", "fit"]).select("id", "fit", "term", "idf", (F.col("w") / F.col("norm")).alias("weight")))
    by = Window.partitionBy("fit", "id").orderBy("idf", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = vectors.withColumn("rest", F.sum(F.col("weight") * F.col("weight")).over(by))
    kept = marked.where(F.col("rest") >= threshold * threshold - 1e-9)
    left = kept.where(~F.col("fit")).select("term", F.col("id").alias("a"))
    right = kept.where("fit").select("term", F.col("id").alias("b"))
    pairs = left.join(right, "term").select("a", "b").distinct()
    one = vectors.where(~F.col("fit")).select(F.col("id").alias("a"), "term", F.col("weight").alias("x"))
    two = vectors.where("fit").select(F.col("id").alias("b"), "term", F.col("weight").alias("y"))
    dots = pairs.join(one, "a").join(two, ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("cosine"))
    best = dots.where(F.col("cosine") >= threshold - 1e-9).groupBy(F.col("a").alias("class")).agg(F.max("cosine").alias("best"))
    return known.where(~F.col("fit")).join(best, "class").select("id", "best")


def closest_report(best: DataFrame, others: int, threshold: float = 0.9) -> DataFrame:
    """(n, max_cosine, p99_cosine, near): from (id, best), the largest cosines of those that have one; the others' count as 0.

    others: how many texts were compared in all.
    """
    share = quantile(best.select(F.col("best").alias("v")).unionByName(best.sparkSession.range(0, max(0, others - best.count())).select(F.lit(0.0).alias("v"))), "v", [0.99])
    return best.agg(F.lit(others).cast("long").alias("n"), F.coalesce(F.max("best"), F.lit(0.0)).alias("max_cosine"), F.count(F.when(F.col("best") >= threshold - 1e-9, 1)).alias("near")).crossJoin(share.select(F.col("value").alias("p99_cosine")))


def top_by_hash(rows: DataFrame, strata: list[Column], text: Column, n: int) -> DataFrame:
    """The `n` rows of each stratum with the least SHA-1 of `text`; a reproducible sample or cap.

    Row numbers up to a limit are cut before the shuffle, so a large stratum is no burden.
    """
    by = Window.partitionBy(*strata).orderBy(F.sha1(text), text)
    return rows.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= n).drop("_n")


def off_topic_choice(members: DataFrame, order: list[tuple[str, str]], per_category: int) -> DataFrame:
    """(title, split, category): the first titles of each category that no earlier one took.

    members: (title, split, category, depth). Categories come one after another in `order`,
    and which titles one takes depends on those before. But only its first titles can
    matter: with the k-th category at most (k - 1) * per_category titles are taken before,
    so of each category that many more than it takes are ranked, in one pass, and the turns
    go over these few rows on the driver.
    """
    place = {pair: n for n, pair in enumerate(order)}
    numbers = F.create_map(*(x for (s, c), n in place.items() for x in (F.concat(F.lit(s), F.lit("\0"), F.lit(c)), F.lit(n))))
    own = members.withColumn("turn", F.try_element_at(numbers, F.concat("split", F.lit("\0"), "category"))).where("turn IS NOT NULL")
    least = own.groupBy("turn", "title").agg(F.min("depth").alias("depth"))
    by = Window.partitionBy("turn").orderBy("depth", F.sha1("title"), "title")
    first = least.withColumn("n", F.row_number().over(by)).where(F.col("n") <= per_category * len(order)).where(F.col("n") <= per_category * (F.col("turn") + 1))
    taken: set[str] = set()
    left = dict.fromkeys(range(len(order)), per_category)
    rows = []
    for r in first.orderBy("turn", "n").toLocalIterator():  # at most per_category * categories ** 2 / 2 titles
        if left[r.turn] and r.title not in taken:
            taken.add(r.title)
            left[r.turn] -= 1
            rows.append((r.title, *order[r.turn]))
    return members.sparkSession.createDataFrame(rows, "title string, split string, category string")


def transitions(old: DataFrame, new: DataFrame, key: str, label: str) -> DataFrame:
    """(old, new, n): how labels changed; rows that only one side has count with null."""
    a, b = old.select(key, F.col(label).alias("old")), new.select(key, F.col(label).alias("new"))
    return a.join(b, key, "full").groupBy("old", "new").agg(F.count("*").alias("n"))


def split_overlaps(rows: DataFrame, split: str, key: str) -> DataFrame:
    """(one, two, shared): how many keys two splits share, for each pair that shares some."""
    sets = rows.where(F.col(key).isNotNull() & F.col(split).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("s")).where(F.size("s") > 1)
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("one"), b.alias("two")))))
    return sets.select(F.explode(pairs).alias("p")).groupBy("p.one", "p.two").agg(F.count("*").alias("shared"))


def recover(missing: DataFrame, aliases: DataFrame, dump: DataFrame, used: DataFrame) -> DataFrame:
    """(title, wiki_id, dump_title): texts for titles, by exact title, else by the longest alias's.

    missing: title; aliases: (title, alias); dump: (title, wiki_id, text); used: wiki_id of
    pages already taken. An alias that is itself missing is not borrowed; a page goes to one
    title only, the first by name; titles that lose it take their next best in another round.
    """
    exact = missing.join(dump, "title").join(used, "wiki_id", "left_anti").select("title", "wiki_id", F.col("title").alias("dump_title"), F.lit(1 << 30).alias("n"))
    borrowed = aliases.join(missing.select(F.col("title").alias("alias")), "alias", "left_anti").join(missing, "title", "left_semi")
    by_alias = borrowed.join(dump.select(F.col("title").alias("alias"), "wiki_id", F.length("text").alias("n")), "alias").join(used, "wiki_id", "left_anti").select("title", "wiki_id", F.col("alias").alias("dump_title"), "n")
    options = exact.unionByName(by_alias)
    out = None
    while True:
        best = options.withColumn("r", F.row_number().over(Window.partitionBy("title").orderBy(F.desc("n"), "dump_title"))).where("r = 1").drop("r")
        won = best.withColumn("r", F.row_number().over(Window.partitionBy("wiki_id").orderBy("title"))).where("r = 1").drop("r", "n")
        out = won if out is None else out.unionByName(won)
        options = options.join(won, "title", "left_anti").join(won, "wiki_id", "left_anti")
        out, options = cut(out), cut(options)
        if options.isEmpty():
            return out


def with_quota(rows: DataFrame, split: Column, text: Column, quotas: dict[str, int]) -> DataFrame:
    """`rows` with `part`: of each part named in `quotas` at most so many rows, those of the least SHA-256 of `text`; other parts have none."""
    limit = F.try_element_at(F.create_map(*(F.lit(x) for pair in quotas.items() for x in pair)), F.col("part"))
    by = Window.partitionBy("part").orderBy(F.sha2(text, 256), text)
    return rows.withColumn("part", split).withColumn("_n", F.row_number().over(by)).where((F.col("_n") <= max(quotas.values())) & (F.col("_n") <= limit)).drop("_n")


def unseen_with_passages(titles: DataFrame, known: DataFrame, passages: DataFrame, n: int, times: int = 2) -> DataFrame:
    """(primary, title): of each primary subtopic the first `n` unseen titles, by hash, that turn out to have a passage.

    titles: (title, primary); known and passages: (title). Only the first times * n titles of each are looked at, as texts may have to be fetched for them.
    """
    drawn = top_by_hash(titles.join(known.select("title").distinct(), "title", "left_anti"), [F.col("primary")], F.col("title"), times * n)
    return top_by_hash(drawn.join(passages.select("title").distinct(), "title", "left_semi"), [F.col("primary")], F.col("title"), n).select("primary", "title")


def strata_sample(rows: DataFrame, identity: str, strata: dict[str, Column], n: int) -> DataFrame:
    """(stratum, `identity`): `n` rows of each stratum in turn, by hash, none that an earlier stratum took.

    With the k-th stratum at most (k - 1) * n rows are taken before, so k * n candidates of each are ranked in one pass and the turns go over these.
    """
    numbered = F.array_compact(F.array(*(F.when(condition, F.lit(k)) for k, condition in enumerate(strata.values()))))
    each = rows.select(F.col(identity).alias("_id"), F.explode(numbered).alias("_k")).distinct()
    by = Window.partitionBy("_k").orderBy(F.sha1(F.col("_id").cast("string")), "_id")
    first = each.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= n * len(strata)).where(F.col("_n") <= n * (F.col("_k") + 1))
    names, taken, left, out = list(strata), set(), dict.fromkeys(range(len(strata)), n), []
    for r in first.orderBy("_k", "_n").toLocalIterator():  # at most n * strata ** 2 / 2 rows
        if left[r["_k"]] and r["_id"] not in taken:
            taken.add(r["_id"])
            left[r["_k"]] -= 1
            out.append((names[r["_k"]], r["_id"]))
    return rows.sparkSession.createDataFrame(out, f"stratum string, `{identity}` {dict(rows.dtypes)[identity]}")


def fates(audited: DataFrame, current: DataFrame, key: str, label: str) -> DataFrame:
    """(fate, n): what became of audited rows: removed, unchanged or relabelled."""
    now = current.select(key, F.col(label).alias("_now"), F.lit(True).alias("_there"))
    fate = F.when(F.col("_there").isNull(), "removed").when(F.col(label).eqNullSafe(F.col("_now")), "unchanged").otherwise("relabelled")
    return audited.join(now, key, "left").groupBy(fate.alias("fate")).agg(F.count("*").alias("n"))


def contained(documents: DataFrame, items: DataFrame, identity: str, item: str, text: str = "text", most: int = 200_000) -> DataFrame:
    """(`identity`, `item`): documents whose text contains a whole item, character by character.

    Items are sent to all tasks, `most` at a time, as one automaton that reads every text once
    whatever their number; each block of items is one pass. Empty and null items are in nothing.
    """
    import ahocorasick

    kinds = dict(documents.dtypes)[identity], dict(items.dtypes)[item]
    schema = f"`{identity}` {kinds[0]}, `{item}` {kinds[1]}"
    own = documents.where(F.col(identity).isNotNull() & F.col(text).isNotNull()).select(identity, text)
    known = items.where(F.col(text) != "").select(item, text).distinct()

    def search(block: list[tuple]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            machine, by = ahocorasick.Automaton(), {}
            for n, t in block:
                by.setdefault(t, []).append(n)
            for t, ns in by.items():
                machine.add_word(t, ns)
            machine.make_automaton()
            for batch in batches:
                rows = [(d, n) for d, t in zip(batch[identity], batch[text]) for n in {n for _, ns in machine.iter(t) for n in ns}]
                yield pd.DataFrame(rows, columns=[identity, item])

        return run

    out, block = documents.sparkSession.createDataFrame([], schema), []
    for row in known.toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == most:
            out, block = out.unionByName(own.mapInPandas(search(block), schema)), []
    return out.unionByName(own.mapInPandas(search(block), schema)).distinct() if block else out.distinct()


def texts_of_cases(cases) -> list[str]:
    """Every sentence of nested cases: the values of "text", and strings with blanks in lists, but for comments, notes and ids."""
    found: list[str] = []
    open_ = [cases]
    while open_:
        node = open_.pop()
        if isinstance(node, dict):
            inside = [v for k, v in node.items() if k not in ("text", "comment", "note", "id")]
            found += [node["text"]] if isinstance(node.get("text"), str) else []
        elif isinstance(node, list):
            found += [v for v in node if isinstance(v, str) and " " in v]
            inside = [v for v in node if not isinstance(v, str)]
        else:
            continue
        open_ += reversed(inside)
    return found
