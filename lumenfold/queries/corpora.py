"""Queries that build and check a corpus: crawls, labels, choices, splits, repeats, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.functions import text as X
from lumenfold.operators import corpus, detectors, evaluation, hierarchy, profile
from lumenfold.queries import Registry
from lumenfold.sources import files
from lumenfold.sources.tables import table

R = Registry()
GENERAL = "nullif(lower(trim(general)), '')"
SPLIT = "lower(trim(split))"
#: One row a passage id, the latest delivery; equal times by their text.
PASSAGES = f"(SELECT * EXCLUDE rn FROM (SELECT *, {GENERAL} AS g, {SPLIT} AS s, row_number() OVER (PARTITION BY passage_id ORDER BY loaded_at DESC, coalesce(split, '') DESC, coalesce(text_source, '') DESC) AS rn FROM passages) WHERE rn = 1)"
DIM = "(SELECT g - 1 AS general_ix, general, row_number() OVER (ORDER BY g, k) - 1 AS sub_ix, subtopic FROM (VALUES " + ", ".join(f"({g + 1}, '{n}', {k}, '{s}')" for g, (n, (_, _, subs)) in enumerate(hierarchy.GENERALS.items()) for k, s in enumerate(subs)) + ") AS v(g, general, k, subtopic))"
MEMBERS = "(SELECT title, subtopic, min(depth) AS depth FROM (SELECT title, depth, unnest(string_split(subtopics, '|')) AS subtopic FROM articles WHERE title IS NOT NULL AND subtopics IS NOT NULL) WHERE subtopic <> '' GROUP BY ALL)"


def delivered(spark: SparkSession, d: str) -> DataFrame:
    """One row a passage id, the latest delivery, with g and s as `general` and `split` are meant."""
    rows = table(spark, d, "passages").withColumns({"g": F.nullif(F.lower(F.trim("general")), F.lit("")), "s": F.lower(F.trim("split"))})
    return corpus.latest(rows, ["passage_id"], [F.col("loaded_at"), F.coalesce("split", F.lit("")), F.coalesce("text_source", F.lit(""))])


def membership(spark: SparkSession, d: str) -> DataFrame:
    """(title, subtopic, depth) of the catalogue's articles."""
    rows = table(spark, d, "articles").where("title is not null").select("title", F.explode(hierarchy.subtopic_list("subtopics")).alias("subtopic"), "depth")
    return rows.groupBy("title", "subtopic").agg(F.min("depth").alias("depth"))


@R.register(f"SELECT passage_id, wiki_id, g AS general, s AS split, text_source, md5(coalesce(text, '')) AS digest FROM {PASSAGES}")
def s1_latest_passages(spark, d):
    return delivered(spark, d).select("passage_id", "wiki_id", F.col("g").alias("general"), F.col("s").alias("split"), "text_source", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))


@R.register(f"SELECT general_ix, sub_ix, general, subtopic, n FROM {DIM} LEFT JOIN (SELECT subtopic, count(*) AS c FROM (SELECT unnest(string_split(subtopics, '|')) AS subtopic FROM {PASSAGES}) GROUP BY 1) USING (subtopic), LATERAL (SELECT coalesce(c, 0) AS n)")
def h1_subtopic_counts(spark, d):
    """Passages of each subtopic of the taxonomy."""
    counts = delivered(spark, d).select(F.explode(hierarchy.subtopic_list("subtopics")).alias("subtopic")).groupBy("subtopic").agg(F.count("*").alias("n"))
    return hierarchy.taxonomy(spark).join(counts, "subtopic", "left").select(F.col("general_ix").cast("long").alias("general_ix"), F.col("sub_ix").cast("long").alias("sub_ix"), "general", "subtopic", F.coalesce("n", F.lit(0)).alias("n"))


@R.register(f"""SELECT g AS general, ok AS consistent, count(*) AS n FROM (SELECT g, CASE WHEN g IN (SELECT general FROM {DIM}) THEN
  length(list_filter(string_split(coalesce(subtopics, ''), '|'), lambda x: x <> '' AND NOT list_contains(kids, x))) = 0 END AS ok
  FROM {PASSAGES} LEFT JOIN (SELECT general AS gg, list(subtopic) AS kids FROM {DIM} GROUP BY 1) ON g = gg) GROUP BY ALL""")
def h2_consistency(spark, d):
    """How many passages name only subtopics of their general topic."""
    ok = hierarchy.is_consistent(F.col("g"), hierarchy.subtopic_list("subtopics"))
    return delivered(spark, d).groupBy(F.col("g").alias("general"), ok.alias("consistent")).agg(F.count("*").alias("n"))


@R.register(f"SELECT wiki_id, (SELECT min(general_ix) FROM {DIM} WHERE general = a.g) AS general_ix, list_aggregate(list_transform(k, lambda x: CASE WHEN list_contains(string_split(coalesce(subtopics, ''), '|'), x) THEN '1' ELSE '0' END), 'string_agg', '') AS bits FROM (SELECT *, {GENERAL} AS g FROM articles) a, (SELECT list(subtopic ORDER BY sub_ix) AS k FROM {DIM})")
def h4_encoded(spark, d):
    """Every article's general topic as a number and its subtopics as 28 bits."""
    bits = hierarchy.encode_subtopics(hierarchy.subtopic_list("subtopics"))
    return table(spark, d, "articles").select("wiki_id", hierarchy.encode_general(F.nullif(F.lower(F.trim("general")), F.lit(""))).cast("long").alias("general_ix"), F.array_join(bits.cast("array<string>"), "").alias("bits"))


@R.register(f"""WITH RECURSIVE edges AS (SELECT general AS parent, subtopic AS child FROM taxonomy_subtopics UNION SELECT subtopic, title FROM {MEMBERS}),
walk AS (SELECT DISTINCT general AS seed, general AS node, 0 AS depth FROM taxonomy_subtopics UNION SELECT seed, child, depth + 1 FROM walk JOIN edges ON parent = node WHERE depth < 2 AND NOT (depth > 0 AND regexp_matches(node, '^history_')))
SELECT seed, node, min(depth) AS depth FROM walk GROUP BY ALL""")
def c1_crawl(spark, d):
    """Subtopics and articles under each general topic, not through one whose name matches a pattern."""
    dim = table(spark, d, "taxonomy_subtopics")
    edges = dim.select(F.col("general").alias("parent"), F.col("subtopic").alias("child")).unionByName(membership(spark, d).select(F.col("subtopic").alias("parent"), F.col("title").alias("child")))
    found = hierarchy.crawl(edges, dim.select(F.col("general").alias("seed")).distinct(), 2, "^history_")
    return found.select("seed", "node", F.col("depth").cast("int").alias("depth"))


_PATTERNS = "(VALUES " + ", ".join("('{}', '{}')".format(s, p.replace("'", "''")) for s, p in hierarchy.exclusions()) + ") AS x(subtopic, pattern)"


@R.register(f"SELECT subtopic, count(*) AS excluded FROM (SELECT DISTINCT subtopic, title FROM (SELECT DISTINCT replace(title, ' ', '_') AS title FROM articles WHERE title IS NOT NULL) JOIN {_PATTERNS} ON regexp_matches(title, pattern)) GROUP BY subtopic")
def h5_patterns(spark, d):
    """How many names in the catalogue a crawl of each subtopic would not go through."""
    titles = table(spark, d, "articles").where("title is not null").select(F.replace(F.col("title"), F.lit(" "), F.lit("_")).alias("title")).distinct()
    each: dict[str, list[str]] = {}
    for sub, pattern in hierarchy.exclusions():
        each.setdefault(sub, []).append(pattern)
    hits = F.array_compact(F.array(*(F.when(F.greatest(*(F.col("title").rlike(p) for p in ps)), F.lit(sub)) for sub, ps in each.items())))
    return titles.select(F.explode(hits).alias("subtopic")).groupBy("subtopic").agg(F.count("*").alias("excluded"))


@R.register(f"""WITH RECURSIVE edges AS (SELECT general AS parent, subtopic AS child FROM taxonomy_subtopics UNION SELECT subtopic, replace(title, ' ', '_') FROM {MEMBERS}), pt AS (SELECT DISTINCT general AS seed, pattern FROM taxonomy_subtopics JOIN {_PATTERNS} USING (subtopic)),
walk AS (SELECT DISTINCT general AS seed, general AS node, 0 AS depth, false AS excluded FROM taxonomy_subtopics UNION SELECT w.seed, child, depth + 1, EXISTS (SELECT 1 FROM pt WHERE pt.seed = w.seed AND regexp_matches(child, pattern)) FROM walk w JOIN edges ON parent = node WHERE depth < 2 AND NOT excluded)
SELECT seed, excluded, count(*) AS n FROM (SELECT seed, node, bool_or(excluded) AS excluded FROM walk GROUP BY ALL) GROUP BY ALL""")
def h5_crawl(spark, d):
    """What a crawl reaches and what it does not go through, each seed with the patterns of its subtopics."""
    dim = table(spark, d, "taxonomy_subtopics")
    named = membership(spark, d).select(F.col("subtopic").alias("parent"), F.replace(F.col("title"), F.lit(" "), F.lit("_")).alias("child"))
    edges = dim.select(F.col("general").alias("parent"), F.col("subtopic").alias("child")).unionByName(named)
    patterns = spark.createDataFrame(hierarchy.exclusions(), "subtopic string, pattern string").join(dim, "subtopic").select(F.col("general").alias("seed"), "pattern").distinct()
    return hierarchy.crawl(edges, dim.select(F.col("general").alias("seed")).distinct(), 2, patterns=patterns).groupBy("seed", "excluded").agg(F.count("*").alias("n"))


@R.register(r"SELECT wiki_id FROM articles WHERE title IS NOT NULL AND NOT regexp_matches(replace(title, ' ', '_'), '^Category:|^(List|Lists|Index|Outline|Timeline|Glossary)_of_|\(disambiguation\)')")
def c2_articles(spark, d):
    """Entries of the catalogue that are articles, not lists, indexes or the like."""
    return table(spark, d, "articles").where("title is not null").where(hierarchy.is_article(F.replace(F.col("title"), F.lit(" "), F.lit("_")))).select("wiki_id")


@R.register(f"SELECT subtopic, count(*) AS articles, count(*) FILTER (WHERE depth = 0) AS depth_0, count(*) FILTER (WHERE depth = 1) AS depth_1, count(*) FILTER (WHERE depth = 2) AS depth_2 FROM {MEMBERS} GROUP BY subtopic")
def c4_statistics(spark, d):
    """Articles of each subtopic by depth."""
    return hierarchy.membership_statistics(membership(spark, d))


@R.register(f"""WITH m AS (SELECT * FROM {MEMBERS} JOIN {DIM} USING (subtopic)), b AS (SELECT title, general, min(depth) AS gd FROM m GROUP BY ALL),
w AS (SELECT title, min(gd) AS best FROM b GROUP BY 1), n AS (SELECT title, best, count(*) AS winners, min(general) AS general FROM b JOIN w USING (title) WHERE gd = best GROUP BY ALL)
SELECT title, CASE WHEN winners = 1 THEN n.general END AS general, CASE WHEN winners = 1 THEN (SELECT string_agg(subtopic, '|' ORDER BY subtopic) FROM m WHERE m.title = n.title AND m.general = n.general AND (m.depth = best OR m.depth <= 1)) END AS subtopics, best AS depth, winners > 1 AS ambiguous FROM n""")
def c5_labels(spark, d):
    """Labels of every article by the least depth at which a topic reaches it."""
    dim = hierarchy.taxonomy(spark)
    return hierarchy.assign_labels(membership(spark, d), dim).select("title", "general", F.array_join("subtopics", "|").alias("subtopics"), "depth", "ambiguous")


@R.register(f"SELECT DISTINCT title FROM (SELECT title, row_number() OVER (PARTITION BY subtopic ORDER BY depth, sha1(title), title) AS r FROM {MEMBERS}) WHERE r <= 450")
def c6_balanced(spark, d):
    """Articles among the first 450 of one of their subtopics."""
    members = membership(spark, d)
    return hierarchy.select_balanced(members.groupBy("title").agg(F.collect_list("subtopic").alias("subtopics")), members, 450)


@R.register(f"""WITH a AS (SELECT title, min({GENERAL}) AS general, min(string_split(subtopics, '|')[1]) AS first FROM articles WHERE title IS NOT NULL AND subtopics IS NOT NULL GROUP BY title),
r AS (SELECT *, row_number() OVER (PARTITION BY general, first ORDER BY sha1(title), title) AS i, count(*) OVER (PARTITION BY general, first) AS n FROM a),
k AS (SELECT *, CASE WHEN n >= 3 THEN greatest(1, CAST(round_even(n * 0.15, 0) AS INT)) ELSE 0 END AS t FROM r)
SELECT title, CASE WHEN i <= t THEN 'test' WHEN i <= 2 * t THEN 'val' ELSE 'train' END AS split FROM k""")
def c7_splits(spark, d):
    """Stratified splits of the catalogue's articles, by hash order."""
    rows = table(spark, d, "articles").where("title is not null and subtopics is not null").groupBy("title").agg(F.min(F.nullif(F.lower(F.trim("general")), F.lit(""))).alias("general"), F.min(F.split("subtopics", r"\|")[0]).alias("first"))
    articles = rows.select("title", "general", F.array("first").alias("subtopics"))
    return hierarchy.assign_splits(articles).select("title", "split")


@R.register("""WITH t AS (SELECT 'h' || item_id AS id, true AS fit, text FROM heldout_items UNION ALL SELECT passage_id, false, min(text) FROM ood_passages WHERE text IS NOT NULL GROUP BY 1),
p AS (SELECT id, fit, term, count(*) AS tf FROM (SELECT id, fit, unnest(w || list_transform(range(1, length(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM (SELECT id, fit, regexp_extract_all(lower(text), '[a-z0-9]{2,}') AS w FROM t)) GROUP BY ALL),
i AS (SELECT term, ln((1 + (SELECT count(DISTINCT id) FROM t WHERE fit)) / (1 + count(*))) + 1 AS idf FROM p WHERE fit GROUP BY 1),
v AS (SELECT id, fit, term, (1 + ln(tf)) * idf AS w FROM p JOIN i USING (term)), n AS (SELECT id, sqrt(sum(w * w)) AS l FROM v GROUP BY 1), u AS (SELECT id, fit, term, w / l AS w FROM v JOIN n USING (id)),
c AS (SELECT a.id, b.id AS other, sum(a.w * b.w) AS cosine FROM u a JOIN u b USING (term) WHERE NOT a.fit AND b.fit GROUP BY ALL)
SELECT id, round(max(cosine), 6) AS best FROM c WHERE cosine >= 0.3 - 1e-9 GROUP BY 1""")
def c9_near_duplicates(spark, d):
    """Off-topic passages whose TF-IDF cosine with a held-out text is at least 0.3."""
    found = corpus.near_duplicates(held_and_other(spark, d), "id", "terms", F.col("fit"), 0.3)
    return found.select("id", F.round("best", 6).alias("best"))


def held_and_other(spark: SparkSession, d: str) -> DataFrame:
    """(id, fit, terms) of held-out texts, which are fitted to, and of off-topic passages."""
    held = table(spark, d, "heldout_items").select(F.concat(F.lit("h"), F.col("item_id").cast("string")).alias("id"), F.lit(True).alias("fit"), "text")
    other = table(spark, d, "ood_passages").where("text is not null").groupBy(F.col("passage_id").alias("id")).agg(F.min("text").alias("text")).select("id", F.lit(False).alias("fit"), "text")
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]{2,})"), 1)
    return held.unionByName(other).withColumn("terms", corpus.word_terms(words))


@R.register()
def c9_split_duplicates(spark, d):
    """Validation and test passages whose TF-IDF cosine with a training passage is at least 0.9. SQL compares far too many pairs."""
    rows = delivered(spark, d).where("s IN ('train', 'val', 'test') AND text IS NOT NULL").select("passage_id", (F.col("s") == "train").alias("fit"), F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]{2,})"), 1).alias("words"))
    found = corpus.near_duplicates(rows.withColumn("terms", corpus.word_terms(F.col("words"))), "passage_id", "terms", F.col("fit"))
    return found.select(F.col("id").alias("passage_id"), F.round("best", 6).alias("best"))


@R.register(f"SELECT passage_id FROM (SELECT passage_id, row_number() OVER (PARTITION BY lower(text) ORDER BY title NULLS FIRST, passage_id) AS r FROM {PASSAGES}) WHERE r = 1")
def c11_without_repeats(spark, d):
    """Passages without later ones of the same text."""
    return corpus.exact_first(delivered(spark, d).select("passage_id", "title", "text"), F.lower("text"), ["title", "passage_id"]).select("passage_id")


@R.register(f"SELECT a.wiki_id, count(p.passage_id) AS n_passages FROM articles a LEFT JOIN {PASSAGES} p USING (wiki_id) GROUP BY 1")
def c11_recounted(spark, d):
    """How many passages every article has."""
    return corpus.recounted(table(spark, d, "articles").select("wiki_id", "n_passages"), delivered(spark, d), "wiki_id", "n_passages")


@R.register("""SELECT site, question_id, min(general) AS general, bool_or(list_contains(tags, 'notebook')) AS tagged FROM se_locked WHERE general IS NOT NULL GROUP BY ALL HAVING count(DISTINCT general) = 1""")
def c12_questions(spark, d):
    """Questions of one general topic only, once each."""
    rows = table(spark, d, "se_locked").where("general is not null").groupBy("site", "question_id")
    return rows.agg(F.min("general").alias("general"), F.bool_or(F.array_contains("tags", "notebook")).alias("tagged"), F.count_distinct("general").alias("n")).where("n = 1").drop("n")


_PARITY = "(strpos('0123456789abcdef', right(sha1(text), 1)) - 1) % 2"


@R.register(f"SELECT site, CASE WHEN {_PARITY} = 0 THEN 'dev' ELSE 'test' END AS part, count(*) AS n FROM se_locked WHERE text IS NOT NULL GROUP BY ALL")
def c13_dev_or_test(spark, d):
    return table(spark, d, "se_locked").where("text is not null").groupBy("site", X.dev_or_test(F.col("text")).alias("part")).agg(F.count("*").alias("n"))


@R.register("SELECT split, category, passage_id FROM (SELECT split, category, passage_id, row_number() OVER (PARTITION BY split, category ORDER BY sha1(passage_id), passage_id) AS r FROM (SELECT DISTINCT split, category, passage_id FROM ood_passages)) WHERE r <= 40")
def c14_capped(spark, d):
    """At most 40 off-topic passages of each split and category, by hash."""
    rows = table(spark, d, "ood_passages").select("split", "category", "passage_id").distinct()
    return corpus.top_by_hash(rows, [F.col("split"), F.col("category")], F.col("passage_id"), 40)


@R.register()
def c8_off_topic(spark, d):
    """Off-topic titles, 30 for each category in turn, none twice."""
    rows = table(spark, d, "ood_passages").where("category is not null and title is not null")
    order = [(s, c) for s in ("val", "test") for c in sorted(r.category for r in rows.select("category").distinct().toLocalIterator())]
    return corpus.off_topic_choice(rows.select("title", "split", "category", F.lit(0).alias("depth")), order, 30)


@R.register(f"SELECT DISTINCT p.title FROM {PASSAGES} p WHERE p.title IS NOT NULL AND NOT EXISTS (SELECT 1 FROM articles a WHERE a.title = p.title)")
def c16_unknown_titles(spark, d):
    """Titles of passages that the catalogue does not have as they are written."""
    return delivered(spark, d).where("title is not null").select("title").distinct().join(table(spark, d, "articles").select("title").distinct(), "title", "left_anti")


@R.register("SELECT in_general, site_general IS NOT NULL AS site_view, is_ood, count(DISTINCT (site, question_id)) AS n FROM se_locked GROUP BY ALL")
def c17_views(spark, d):
    """Questions by their independent views."""
    return table(spark, d, "se_locked").groupBy("in_general", F.col("site_general").isNotNull().alias("site_view"), "is_ood").agg(F.count_distinct("site", "question_id").alias("n"))


@R.register(f"SELECT o.g AS old, n.g AS new, count(*) AS n FROM (SELECT wiki_id, {GENERAL} AS g FROM articles) o FULL JOIN (SELECT wiki_id, min(g) AS g FROM {PASSAGES} GROUP BY 1) n USING (wiki_id) GROUP BY ALL")
def c18_transitions(spark, d):
    """From the catalogue's general topic to the least one of an article's passages."""
    old = table(spark, d, "articles").select("wiki_id", F.nullif(F.lower(F.trim("general")), F.lit("")).alias("g"))
    return corpus.transitions(old, delivered(spark, d).groupBy("wiki_id").agg(F.min("g").alias("g")), "wiki_id", "g")


@R.register(f"SELECT g AS general, passage_id FROM (SELECT g, passage_id, row_number() OVER (PARTITION BY g ORDER BY sha1(passage_id), passage_id) AS r FROM {PASSAGES} WHERE g IS NOT NULL) WHERE r <= 20")
def c19_audit_sample(spark, d):
    """Twenty passages of each general topic, for an audit."""
    return corpus.top_by_hash(delivered(spark, d).where("g is not null").select(F.col("g").alias("general"), "passage_id"), [F.col("general")], F.col("passage_id"), 20)


@R.register(f"""SELECT general, k, n, round((p + q / 2 - z * sqrt(p * (1 - p) / n + q / (4 * n))) / (1 + q), 4) AS low, round((p + q / 2 + z * sqrt(p * (1 - p) / n + q / (4 * n))) / (1 + q), 4) AS high
FROM (SELECT *, k / n AS p, z * z / n AS q FROM (SELECT g AS general, count(*) FILTER (WHERE s = 'test') AS k, count(*) AS n, 1.96::DOUBLE AS z FROM {PASSAGES} WHERE g IS NOT NULL GROUP BY 1))""")
def c20_wilson(spark, d):
    """The share of test passages of each general topic with its interval."""
    counts = delivered(spark, d).where("g is not null").groupBy(F.col("g").alias("general")).agg(F.count(F.when(F.col("s") == "test", 1)).alias("k"), F.count("*").alias("n"))
    low, high = hierarchy.wilson(F.col("k"), F.col("n"))
    return counts.select("general", "k", "n", low.alias("low"), high.alias("high"))


@R.register(f"SELECT g AS general, count(*) FILTER (WHERE s = 'train') AS train, count(*) FILTER (WHERE s = 'val') AS val, count(*) FILTER (WHERE s = 'test') AS test FROM {PASSAGES} WHERE g IS NOT NULL GROUP BY 1")
def c21_pivot(spark, d):
    """General topics by splits."""
    return delivered(spark, d).where("g is not null").groupBy(F.col("g").alias("general")).pivot("s", ["train", "val", "test"]).count().na.fill(0)


@R.register(f"SELECT a.s AS one, b.s AS two, count(*) AS shared FROM (SELECT DISTINCT s, title FROM {PASSAGES} WHERE s IS NOT NULL AND title IS NOT NULL) a JOIN (SELECT DISTINCT s, title FROM {PASSAGES} WHERE s IS NOT NULL AND title IS NOT NULL) b ON a.title = b.title AND a.s < b.s GROUP BY ALL")
def e22_split_overlaps(spark, d):
    """Titles that two splits share."""
    return corpus.split_overlaps(delivered(spark, d), "s", "title")


@R.register(f"SELECT rows, null_text, null_title, null_general, null_split, distinct_text, round(quantile_cont(words, 0.5), 6) AS median_words, round(quantile_cont(words, 0.95), 6) AS p95_words FROM (SELECT length(regexp_split_to_array(trim(text), '[ \\t\\n\\r\\f\\v]+'))::DOUBLE AS words FROM {PASSAGES} WHERE trim(text) <> ''), (SELECT count(*) AS rows, count(*) FILTER (WHERE text IS NULL) AS null_text, count(*) FILTER (WHERE title IS NULL) AS null_title, count(*) FILTER (WHERE g IS NULL) AS null_general, count(*) FILTER (WHERE s IS NULL) AS null_split, count(DISTINCT text) AS distinct_text FROM {PASSAGES}) GROUP BY ALL")
def e19_profile(spark, d):
    """Nulls, distinct texts and word quantiles of the passages."""
    return profile.text_profile(delivered(spark, d))


@R.register(f"""WITH w AS (SELECT g, w, count(*) AS n FROM (SELECT g, unnest(regexp_extract_all(lower(text), '[a-z][a-z\\-]+')) AS w FROM {PASSAGES} WHERE g IS NOT NULL) WHERE NOT list_contains({"[" + ", ".join("'" + x.replace("'", "''") + "'" for x in X.stop_words()) + "]"}, w) GROUP BY ALL)
SELECT g AS general, w AS token, n FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, w) AS r FROM w) WHERE r <= 15""")
def e20_top_tokens(spark, d):
    """The fifteen most frequent tokens of each general topic."""
    return profile.top_tokens(delivered(spark, d).where("g is not null"), "g", "text", 15).withColumnRenamed("g", "general")


@R.register(f"SELECT min(n) AS smallest, max(n) AS largest, count(*) AS classes, round(max(n) / min(n), 6) AS imbalance FROM (SELECT g, count(*) AS n FROM {PASSAGES} WHERE g IS NOT NULL GROUP BY 1)")
def e23_imbalance(spark, d):
    return profile.imbalance(delivered(spark, d).where("g is not null"), "g")


@R.register("SELECT source, count(*) AS rows, count(*) FILTER (WHERE n > 1) / count(*) AS repeated, count(*) FILTER (WHERE trim(coalesce(text, '')) = '') / count(*) AS empty FROM (SELECT source, text, count(*) OVER (PARTITION BY text) AS n FROM documents) GROUP BY source")
def e23_repeats(spark, d):
    """Shares of repeated and of empty texts of each source."""
    return profile.repeat_rates(table(spark, d, "documents"), "source", "text")


@R.register(f"SELECT w AS word FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM {PASSAGES} WHERE s = 'train') GROUP BY 1")
def m8_lexicon(spark, d):
    """Every word of the training passages."""
    return delivered(spark, d).where("s = 'train'").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias("word")).distinct()


@R.register(f"""WITH t AS (SELECT passage_id, g, regexp_extract_all(lower(text), '[a-z]+') AS w FROM {PASSAGES} WHERE s = 'train' AND g IS NOT NULL AND text IS NOT NULL), nc AS (SELECT g, count(*) AS nc FROM t GROUP BY 1),
d AS (SELECT w, g, count(DISTINCT passage_id) AS df, count(*) AS tf FROM (SELECT passage_id, g, unnest(w) AS w FROM t) WHERE length(w) > 1 AND NOT list_contains({"[" + ", ".join("'" + x.replace("'", "''") + "'" for x in X.stop_words()) + "]"}, w) GROUP BY ALL)
SELECT w AS word, round((ln((1 + (SELECT count(*) FROM t)) / (1 + sum(df))) + 1) * max(df / nc) / sum(df / nc), 4) AS weight FROM d JOIN nc USING (g) GROUP BY w HAVING sum(df) >= 3""")
def m9_vocabulary(spark, d):
    """Words of the training passages with idf times their concentration on one topic."""
    rows = delivered(spark, d).where("s = 'train' and g is not null and text is not null")
    return profile.vocabulary(rows, "passage_id", "text", "g")


def over_passages(held: str) -> str:
    """SQL over held-out items as SQL over passages."""
    return held.replace("FROM heldout_items", f"FROM {PASSAGES}").replace("item_id", "passage_id")


@R.register("""WITH t AS (SELECT item_id, strpos('0123456789abcdef', md5(w)[30:30]) * 256 - 256 + strpos('0123456789abcdef', md5(w)[31:31]) * 16 - 16 + strpos('0123456789abcdef', md5(w)[32:32]) - 1 AS slot FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM heldout_items)),
c AS (SELECT item_id, slot, count(*) AS n FROM t GROUP BY ALL) SELECT item_id, slot, round(n / sqrt(sum(n * n) OVER (PARTITION BY item_id)), 6) AS x FROM c""")
def m4_hashed_encoder(spark, d):
    """Held-out texts as unit vectors of word counts in 4,096 hashed slots."""
    return profile.hashed_vectors(table(spark, d, "heldout_items"), "item_id", "text").select("item_id", "slot", F.round("x", 6).alias("x"))


_TFIDF = """WITH p AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(w || list_transform(range(1, length(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z][a-z''\\-]*') AS w FROM heldout_items)) GROUP BY ALL),
i AS (SELECT term, ln((1 + (SELECT count(*) FROM heldout_items)) / (1 + count(*))) + 1 AS idf FROM p GROUP BY 1 HAVING count(*) >= 2 AND count(*) <= 0.9 * (SELECT count(*) FROM heldout_items)),
v AS (SELECT item_id, term, (1 + ln(tf)) * idf AS w FROM p JOIN i USING (term)) SELECT item_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY item_id)), 6) AS weight FROM v"""


@R.register(_TFIDF)
def m1_tfidf(spark, d):
    """Held-out texts as TF-IDF vectors of words and pairs of words."""
    texts = table(spark, d, "heldout_items").select("item_id", corpus.word_terms(X.words_of(F.lower("text"))).alias("terms"))
    return corpus.tfidf(texts, "item_id", "terms", F.lit(True), 2, 0.9).select(F.col("id").alias("item_id"), "term", F.round("weight", 6).alias("weight"))


@R.register("""SELECT item_id, count(*) AS n_terms, count(DISTINCT term) AS n_distinct FROM (SELECT item_id, unnest(flatten(list_transform([3, 4, 5], lambda n: list_transform(range(1, greatest(length(p) - n + 1, 1) + 1), lambda i: substr(p, i, n))))) AS term FROM (SELECT item_id, ' ' || unnest(regexp_extract_all(lower(text), '[a-z][a-z''\\-]*')) || ' ' AS p FROM heldout_items)) GROUP BY item_id""".replace("\\\\", "\\"))
def m2_character_terms(spark, d):
    """Character runs of the held-out texts."""
    each = table(spark, d, "heldout_items").select("item_id", F.explode(corpus.character_terms(X.words_of(F.lower("text")))).alias("t"))
    return each.groupBy("item_id").agg(F.count("*").alias("n_terms"), F.count_distinct("t").alias("n_distinct"))


@R.register(over_passages(R.sql["m4_hashed_encoder"]))
def m4_hashed_passages(spark, d):
    """Passages as unit vectors of word counts in 4,096 hashed slots."""
    return profile.hashed_vectors(delivered(spark, d), "passage_id", "text").select("passage_id", "slot", F.round("x", 6).alias("x"))


@R.register(over_passages(_TFIDF))
def m1_tfidf_passages(spark, d):
    """Passages as TF-IDF vectors of words and pairs of words."""
    texts = delivered(spark, d).select("passage_id", corpus.word_terms(X.words_of(F.lower("text"))).alias("terms"))
    return corpus.tfidf(texts, "passage_id", "terms", F.lit(True), 2, 0.9).select(F.col("id").alias("passage_id"), "term", F.round("weight", 6).alias("weight"))


@R.register(over_passages(R.sql["m2_character_terms"]))
def m2_character_passages(spark, d):
    """Character runs of the passages; counted inside each row."""
    terms = delivered(spark, d).select("passage_id", corpus.character_terms(X.words_of(F.lower("text"))).alias("t")).where(F.size("t") > 0)
    return terms.select("passage_id", F.size("t").cast("long").alias("n_terms"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


def prefixes(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, length, english, words): every document and its first words, and the lower-case words of each."""
    rows = table(spark, d, "documents").where(F.trim("text") != "").select("doc_id", (F.lower(F.substring(F.trim("lang"), 1, 2)) == "en").alias("english"), F.explode(X.first_words(F.col("text"))).alias("p")).where("english IS NOT NULL")
    return rows.select("doc_id", "p.length", "english", F.regexp_extract_all(F.lower("p.prefix"), F.lit("([a-z]+)"), 1).alias("words"))


_PREFIXES = f"""lx AS ({R.sql["m8_lexicon"]}), dc AS (SELECT doc_id, lower(left(trim(lang), 2)) = 'en' AS english, text, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS p FROM documents WHERE trim(text) <> '' AND lang IS NOT NULL),
px AS (SELECT doc_id, english, unnest([{{'length': 'full', 'prefix': text}}] || list_transform(list_filter([1, 2, 3], lambda k: length(p) > k), lambda k: {{'length': CAST(k AS VARCHAR), 'prefix': array_to_string(p[1:k], ' ')}}), recursive := true) FROM dc),
un AS (SELECT DISTINCT doc_id, length FROM (SELECT doc_id, length, unnest(regexp_extract_all(lower(prefix), '[a-z]+')) AS word FROM px) WHERE word NOT IN (SELECT word FROM lx)),
ac AS (SELECT px.doc_id, px.length, english, un.doc_id IS NULL AS accepted FROM px LEFT JOIN un ON un.doc_id = px.doc_id AND un.length = px.length)""".replace("\\\\", "\\")


def gated(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, length, english, accepted): accepted if the training passages have all words."""
    rows = prefixes(spark, d).withColumnRenamed("english", "truth")
    found = detectors.accepts_english(F.col("words"), m8_lexicon(spark, d), F.lit("xx"), F.lit(1.0), {k: 0.0 for k in ("0", "1", "2", "3", "4+")}, rows)
    return found.select("doc_id", "length", F.col("truth").alias("english"), F.col("english").alias("accepted"))


@R.register(f"WITH {_PREFIXES} SELECT CASE WHEN GROUPING(length) = 1 THEN 'all' ELSE length END AS length, round(avg(accepted::INT) FILTER (WHERE english), 6) AS english_accepted, round(avg(1 - accepted::INT) FILTER (WHERE NOT english), 6) AS non_english_rejected, round((avg(accepted::INT) FILTER (WHERE english) + avg(1 - accepted::INT) FILTER (WHERE NOT english)) / 2, 6) AS balanced_accuracy, count(*) FILTER (WHERE english) AS n_english, count(*) FILTER (WHERE NOT english) AS n_non_english FROM ac GROUP BY GROUPING SETS ((length), ())")
def e13_gate_rates(spark, d):
    """How the lexicon tells English by the length of what it sees, and over all."""
    rates = evaluation.gate_rates(gated(spark, d), "length")
    return rates.select("length", *(F.round(c, 6).alias(c) for c in ("english_accepted", "non_english_rejected", "balanced_accuracy")), "n_english", "n_non_english")


@R.register(f"WITH {_PREFIXES} SELECT length, round(avg(accepted::INT) FILTER (WHERE english), 4) AS english_accepted, round(avg(1 - accepted::INT) FILTER (WHERE NOT english), 4) AS non_english_rejected FROM ac GROUP BY length")
def e12_language(spark, d):
    """Acceptance and rejection rates by the number of first words."""
    rates = evaluation.gate_rates(gated(spark, d), "length").where("length <> 'all'")
    return rates.select("length", F.round("english_accepted", 4).alias("english_accepted"), F.round("non_english_rejected", 4).alias("non_english_rejected"))


_LEAST = 0.2


@R.register(f"""WITH {_PREFIXES}, wd AS (SELECT doc_id, english, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM dc), sh AS (SELECT doc_id, any_value(english) AS english, count(*) FILTER (WHERE word NOT IN (SELECT word FROM lx)) / count(*)::DOUBLE AS share FROM wd GROUP BY doc_id),
sw AS (SELECT t, round(avg((share <= t)::INT) FILTER (WHERE english), 6) AS a, round(avg(1 - (share <= t)::INT) FILTER (WHERE NOT english), 6) AS r FROM sh, (SELECT unnest([0.05, 0.1, 0.2, 0.4])::DOUBLE AS t) GROUP BY t),
el AS (SELECT *, a >= {_LEAST} AS eligible FROM sw) SELECT t AS threshold, a AS english_accepted, r AS non_english_rejected, eligible, eligible AND row_number() OVER (ORDER BY eligible DESC, round((a + r) / 2, 6) DESC, t) = 1 AS chosen FROM el""")
def x8_gate_grid(spark, d):
    """A gate that rejects texts with too many unknown words, at several shares; chosen is the eligible one of the best balanced accuracy."""
    words = prefixes(spark, d).where("length = 'full'").select("doc_id", "english", F.explode("words").alias("word"))
    lexicon = m8_lexicon(spark, d).withColumn("known", F.lit(1))
    shares = words.groupBy("doc_id", "english", "word").agg(F.count("*").alias("n")).join(lexicon, "word", "left").groupBy("doc_id", "english").agg((F.sum(F.when(F.col("known").isNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("share"))
    grid = [0.05, 0.1, 0.2, 0.4]
    kept = shares.select("english", F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), (F.col("share") <= t).alias("accepted")) for t in grid))).alias("g")).select("english", "g.*")
    rates = evaluation.gate_rates(kept.withColumn("threshold", F.col("threshold").cast("string")), "threshold").where("threshold <> 'all'").withColumn("threshold", F.col("threshold").cast("double"))
    rounded = rates.select("threshold", F.round("english_accepted", 6).alias("english_accepted"), F.round("non_english_rejected", 6).alias("non_english_rejected"))
    marked = rounded.withColumn("eligible", F.col("english_accepted") >= _LEAST).withColumn("balanced", F.round((F.col("english_accepted") + F.col("non_english_rejected")) / 2, 6))
    best = evaluation.best_by(marked.where("eligible"), [], "balanced", ["threshold"]).select("threshold", F.lit(True).alias("chosen"))
    return marked.join(F.broadcast(best), "threshold", "left").select("threshold", "english_accepted", "non_english_rejected", "eligible", F.coalesce("chosen", F.lit(False)).alias("chosen"))


@R.register(R.sql["c9_near_duplicates"].replace("SELECT id, round(max(cosine), 6) AS best FROM c WHERE cosine >= 0.3 - 1e-9 GROUP BY 1", "SELECT (SELECT count(DISTINCT id) FROM t WHERE NOT fit) AS n, round(max(best), 6) AS max_cosine, count(*) FILTER (WHERE best >= 0.3 - 1e-9) AS near, (SELECT round(quantile_cont(coalesce(b.best, 0), 0.99), 6) FROM (SELECT DISTINCT id FROM t WHERE NOT fit) o LEFT JOIN (SELECT id, max(cosine) AS best FROM c WHERE cosine >= 0.05 - 1e-9 GROUP BY 1) b USING (id)) AS p99_cosine FROM (SELECT id, max(cosine) AS best FROM c WHERE cosine >= 0.05 - 1e-9 GROUP BY 1)"))
def e21_closest(spark, d):
    """How close off-topic passages come to held-out texts: the largest and the 99th percentile of the cosines, and how many reach 0.3."""
    texts = held_and_other(spark, d)
    best = corpus.near_duplicates(texts, "id", "terms", F.col("fit"), 0.05)
    report = corpus.closest_report(best, texts.where("NOT fit").select("id").distinct().count(), 0.3)
    return report.select("n", F.round("max_cosine", 6).alias("max_cosine"), "near", F.round("p99_cosine", 6).alias("p99_cosine"))


@R.register("SELECT part, site, question_id FROM (SELECT site, question_id, part, row_number() OVER (PARTITION BY part ORDER BY sha256(text), text, site, question_id) AS r FROM (SELECT DISTINCT site, question_id, text, CASE WHEN (strpos('0123456789abcdef', right(sha256(text), 1)) - 1) % 2 = 0 THEN 'dev' ELSE 'test' END AS part FROM se_locked WHERE text IS NOT NULL)) WHERE r <= CASE WHEN part = 'dev' THEN 60 ELSE 40 END")
def c15_quotas(spark, d):
    """At most 60 questions of one part and 40 of the other, parts by parity of the hash."""
    rows = table(spark, d, "se_locked").where("text IS NOT NULL").select("site", "question_id", "text").distinct()
    parity = F.conv(F.substring(F.sha2("text", 256), -1, 1), 16, 10).cast("int") % 2
    return corpus.with_quota(rows, F.when(parity == 0, "dev").otherwise("test"), F.col("text"), {"dev": 60, "test": 40}).select("part", "site", "question_id")


@R.register(f"""WITH c AS (SELECT title, min(string_split(subtopics, '|')[1]) AS "primary" FROM articles WHERE title IS NOT NULL AND subtopics IS NOT NULL GROUP BY title), u AS (SELECT * FROM c WHERE title NOT IN (SELECT title FROM {PASSAGES} WHERE s = 'train' AND title IS NOT NULL)),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "primary" ORDER BY sha1(title), title) AS r FROM u) WHERE r <= 30), k AS (SELECT *, row_number() OVER (PARTITION BY "primary" ORDER BY sha1(title), title) AS q FROM o WHERE title IN (SELECT title FROM {PASSAGES} WHERE title IS NOT NULL))
SELECT "primary", title FROM k WHERE q <= 15""")
def c16_chosen(spark, d):
    """Fifteen titles of each first subtopic that no training passage has and some passage has."""
    titles = table(spark, d, "articles").where("title IS NOT NULL AND subtopics IS NOT NULL").groupBy("title").agg(F.min(F.split("subtopics", r"\|")[0]).alias("primary"))
    named = delivered(spark, d).where("title IS NOT NULL")
    return corpus.unseen_with_passages(titles, named.where("s = 'train'"), named, 15)


_BY_HASH = "ORDER BY sha1(passage_id), passage_id"


@R.register(f"""WITH p AS (SELECT passage_id, s, g FROM {PASSAGES}), a AS (SELECT passage_id FROM p WHERE s = 'test' {_BY_HASH} LIMIT 25), b AS (SELECT passage_id FROM p WHERE s IN ('test', 'val') AND passage_id NOT IN (FROM a) {_BY_HASH} LIMIT 25), c AS (SELECT passage_id FROM p WHERE g IS NULL AND passage_id NOT IN (FROM a) AND passage_id NOT IN (FROM b) {_BY_HASH} LIMIT 25)
SELECT 'test' AS stratum, passage_id FROM a UNION ALL SELECT 'held out', passage_id FROM b UNION ALL SELECT 'unlabelled', passage_id FROM c""")
def c19_strata(spark, d):
    """Passages for an audit from strata that overlap, none twice."""
    return corpus.strata_sample(delivered(spark, d), "passage_id", {"test": F.col("s") == "test", "held out": F.col("s").isin("test", "val"), "unlabelled": F.col("g").isNull()}, 25)


@R.register(f"""WITH a AS (SELECT wiki_id, {GENERAL} AS g FROM articles), n AS (SELECT wiki_id, min(g) AS g FROM {PASSAGES} WHERE depth < 2 GROUP BY 1) SELECT CASE WHEN n.wiki_id IS NULL THEN 'removed' WHEN a.g IS NOT DISTINCT FROM n.g THEN 'unchanged' ELSE 'relabelled' END AS fate, count(*) AS n FROM a LEFT JOIN n USING (wiki_id) GROUP BY 1""")
def c21_fates(spark, d):
    """What became of the catalogue's labels in the passages that are not at the lowest depth."""
    old = table(spark, d, "articles").select("wiki_id", F.nullif(F.lower(F.trim("general")), F.lit("")).alias("g"))
    return corpus.fates(old, delivered(spark, d).where("depth < 2").groupBy("wiki_id").agg(F.min("g").alias("g")), "wiki_id", "g")


@R.register("SELECT doc_id, item_id FROM documents d, heldout_items h WHERE contains(d.text, h.text)")
def e22_contained(spark, d):
    """Documents that contain a held-out text as it stands."""
    return corpus.contained(table(spark, d, "documents"), table(spark, d, "heldout_items"), "doc_id", "item_id")


@R.register(f"SELECT g AS general, s AS split, count(*) AS n, min(length(text)) AS shortest, max(length(text)) AS longest FROM {PASSAGES} WHERE text IS NOT NULL GROUP BY ALL")
def e19_by_split(spark, d):
    """Passages of each general topic and split, with their shortest and longest text."""
    return delivered(spark, d).where("text IS NOT NULL").groupBy(F.col("g").alias("general"), F.col("s").alias("split")).agg(F.count("*").alias("n"), F.min(F.length("text")).cast("long").alias("shortest"), F.max(F.length("text")).cast("long").alias("longest"))


@R.register(f"SELECT s || CASE WHEN v = 1 THEN '_general' ELSE '' END AS name, count(*) AS n FROM {PASSAGES}, (SELECT unnest([0, 1]) AS v) WHERE s IN ('train', 'val', 'test') AND (v = 0 OR g IS NOT NULL) GROUP BY ALL")
def s3_fan_out(spark, d):
    """Rows of each split, and of those with a general topic."""
    out = None
    for name, rows in files.fan_out(delivered(spark, d), "s", ["train", "val", "test"], F.col("g").isNotNull()).items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n").where("n > 0")
        out = one if out is None else out.unionByName(one)
    return out


@R.register("SELECT category, CASE WHEN split = 'val' THEN 'dev' ELSE 'locked' END AS split, count(*) AS n FROM ood_passages WHERE category NOT IN (SELECT min(category) FROM ood_passages) AND split IN ('val', 'test') GROUP BY ALL")
def s12_intents(spark, d):
    """Off-topic passages but for one category, their splits named anew."""
    rows = table(spark, d, "ood_passages")
    first = rows.agg(F.min("category")).first()[0]
    return files.without_intents(rows, "category", [first], {"val": "dev", "test": "locked"}).groupBy("category", "split").agg(F.count("*").alias("n"))


_STOPS = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in X.stop_words()) + "]"
_PLAIN_WORDS = f"list_filter(regexp_extract_all(lower({{0}}), '[a-z][a-z''\\-]*'), lambda w: length(w) > 1 AND NOT list_contains({_STOPS}, w))".replace("\\\\", "\\")
_STEM = "CASE WHEN length({0}) > 3 AND {0} LIKE '%s' AND {0} NOT LIKE '%ss' THEN left({0}, length({0}) - 1) ELSE {0} END"
#: Keywords of the questions, as `q3_keywords` in another module; the vocabulary is that of m9.
KEYWORDS_SQL = f"""WITH voc AS ({R.sql["m9_vocabulary"]}), ms AS (SELECT site || ':' || question_id AS id, min(text) AS text, min(coalesce(general, '')) AS phrase FROM se_locked GROUP BY site, question_id),
ws AS (SELECT id, phrase, unnest(w) AS word, generate_subscripts(w, 1) AS nth FROM (SELECT id, phrase, {_PLAIN_WORDS.format("text")} AS w FROM ms)), st AS (SELECT id, word, nth, {_STEM.format("word")} AS stem FROM ws WHERE length(word) >= 4 AND NOT list_contains(list_transform({_PLAIN_WORDS.format("phrase")}, lambda x: {_STEM.format("x")}), {_STEM.format("word")})),
kn AS (SELECT id, stem, arg_min(word, nth) AS word, arg_min(weight, nth) AS weight FROM st JOIN voc USING (word) GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY weight DESC, word) AS r FROM kn)
SELECT ms.id, coalesce(string_agg(word, '|' ORDER BY r) FILTER (WHERE r <= 2), '') AS keywords FROM ms LEFT JOIN rk USING (id) GROUP BY ms.id"""
