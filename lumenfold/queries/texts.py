"""Queries over texts: words, cleaning, lines, hashes, buckets, addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import text as X
from lumenfold.queries import Registry
from lumenfold.sources.tables import table

R = Registry()
_STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in X.stop_words()) + "]"
_WORDS = r"regexp_extract_all(lower(text), '[a-z][a-z''\-]*')"
_CONTENT = f"list_filter({_WORDS}, lambda w: length(w) > 1 AND NOT list_contains({_STOP}, w))"


def passages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "passages")


@R.register(f"SELECT passage_id, epoch_us(loaded_at) AS loaded, length(list_filter({_WORDS}, lambda w: true)) AS n_words, length({_CONTENT}) AS n_content, md5(array_to_string({_CONTENT}, ' ')) AS digest FROM passages WHERE text IS NOT NULL")
def t3_content_words(spark, d):
    """Content words of every passage: how many, and a digest of them in order."""
    words = X.content_words(F.lower("text"))
    return passages(spark, d).where("text is not null").select("passage_id", F.unix_micros("loaded_at").alias("loaded"), F.size(X.words_of(F.lower("text"))).cast("long").alias("n_words"), F.size(words).cast("long").alias("n_content"), F.md5(F.array_join(words, " ")).alias("digest"))


@R.register(f"SELECT length({_CONTENT}) > 0 AS informative, count(*) AS n FROM passages WHERE text IS NOT NULL GROUP BY 1")
def t4_informative(spark, d):
    return passages(spark, d).where("text is not null").groupBy(X.is_informative(F.lower("text")).alias("informative")).agg(F.count("*").alias("n"))


@R.register(r"""SELECT passage_id, epoch_us(loaded_at) AS loaded, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
  '\([ \t\n\r\f\v;,:]*\)', '', 'g'), '\([ \t\n\r\f\v]*[;,][ \t\n\r\f\v]*', '(', 'g'), '[ \t\x{00a0}]+', ' ', 'g'), '[ \t\n\r\f\v]+([,.;:])', '\1', 'g'))) AS digest FROM passages WHERE text IS NOT NULL""")
def t7_clean_text(spark, d):
    return passages(spark, d).where("text is not null").select("passage_id", F.unix_micros("loaded_at").alias("loaded"), F.md5(X.clean_text(F.col("text"))).alias("digest"))


@R.register(r"""SELECT source, count(*) AS lines, count(*) FILTER (WHERE n BETWEEN 1 AND 8 AND NOT regexp_matches(rtrim(line), '[.!?:;"”)\]]$')) AS headings
FROM (SELECT source, line, CASE WHEN trim(line) = '' THEN 0 ELSE length(regexp_split_to_array(trim(line), '[ \t\n\r\f\v]+')) END AS n
      FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)) GROUP BY source""")
def t8_headings(spark, d):
    """Lines and headings of each source."""
    lines = table(spark, d, "documents").where("text is not null").select("source", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("source").agg(F.count("*").alias("lines"), F.count(F.when(X.is_heading(F.col("line")), 1)).alias("headings"))


_COUNT = "CASE WHEN trim({0}) = '' THEN 0 ELSE length(regexp_split_to_array(trim({0}), '[ \\t\\n\\r\\f\\v]+')) END"
_HEADS = f"({_COUNT.format('x')} BETWEEN 1 AND 8 AND NOT regexp_matches(rtrim(x), '[.!?:;\"”)\\]]$'))"
_BACK = "[" + ", ".join(f"'{name}'" for name in X.BACK_MATTER) + "]"
_CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '\([ \t\n\r\f\v;,:]*\)', '', 'g'), '\([ \t\n\r\f\v]*[;,][ \t\n\r\f\v]*', '(', 'g'), '[ \t\x{00a0}]+', ' ', 'g'), '[ \t\n\r\f\v]+([,.;:])', '\1', 'g'))"


@R.register(f"""WITH l AS (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) AS pos FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda y: trim(y)) AS ls FROM documents WHERE text IS NOT NULL)),
h AS (SELECT *, {_HEADS} AS head, {_COUNT.format('x')} AS n FROM l), e AS (SELECT doc_id, min(pos) AS stop FROM h WHERE head AND list_contains({_BACK}, lower(x)) GROUP BY 1)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS at, {_CLEAN} AS paragraph FROM h LEFT JOIN e USING (doc_id) WHERE (stop IS NULL OR pos < stop) AND n >= 6 AND NOT head""")
def t9_paragraphs(spark, d):
    """Content paragraphs of every document."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(X.paragraphs(F.col("text"))).alias("at", "paragraph")).select("doc_id", F.col("at").cast("long").alias("at"), "paragraph")


@R.register()
def t11_passages(spark, d):
    """Passages of 12 to 60 words from every document."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(X.passages(F.col("text"))).alias("at", "passage"))


@R.register()
def t1_normalized(spark, d):
    """Model input of every passage."""
    return passages(spark, d).select("passage_id", F.unix_micros("loaded_at").alias("loaded"), X.normalized(F.col("text")).alias("text"))


@R.register("SELECT doc_id, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL")
def t12_hashes(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha1("text").alias("sha1"), F.sha2("text", 256).alias("sha256"))


@R.register("SELECT wiki_id, replace(url_decode(replace(substr(url, 27), '+', '%2B')), '_', ' ') AS name FROM articles WHERE url IS NOT NULL AND starts_with(url, 'https://wiki.example/page/')")
def t13_names(spark, d):
    """Article names from their addresses."""
    prefix = "https://wiki.example/page/"
    return table(spark, d, "articles").where(F.col("url").startswith(prefix)).select("wiki_id", X.category_name(F.col("url"), prefix).alias("name"))


@R.register()
def t14_snippets(spark, d):
    """Bounded snippets of untrusted texts."""
    return passages(spark, d).select("passage_id", F.unix_micros("loaded_at").alias("loaded"), X.clean_snippet(F.col("text"), 120).alias("snippet"))


@R.register(r"SELECT coalesce(length(url) <= 2000 AND regexp_matches(url, '^https://([^/?#]*\.)?wiki\.example([/?#:]|$)'), false) AS safe, count(*) AS n FROM articles GROUP BY 1")
def t15_safe_addresses(spark, d):
    return table(spark, d, "articles").groupBy(X.is_safe_url(F.col("url"), ("wiki.example",)).alias("safe")).agg(F.count("*").alias("n"))


@R.register(f"""SELECT stem, count(*) AS n FROM (SELECT CASE WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, length(w) - 1) ELSE w END AS stem
FROM (SELECT unnest({_CONTENT}) AS w FROM passages WHERE text IS NOT NULL)) GROUP BY stem""")
def t16_stems(spark, d):
    words = passages(spark, d).where("text is not null").select(F.explode(X.content_words(F.lower("text"))).alias("w"))
    return words.groupBy(X.stem(F.col("w")).alias("stem")).agg(F.count("*").alias("n"))


_N = "CASE WHEN trim(text) = '' THEN 0 ELSE length(regexp_split_to_array(trim(text), '[ \\t\\n\\r\\f\\v]+')) END"


@R.register(f"""SELECT split, CASE WHEN n > 0 AND n <= 15 THEN '1-15' WHEN n > 15 AND n <= 25 THEN '16-25' WHEN n > 25 AND n <= 40 THEN '26-40' ELSE '>40' END AS bucket, count(*) AS n
FROM (SELECT lower(trim(split)) AS split, {_N} AS n FROM passages WHERE text IS NOT NULL) GROUP BY ALL""")
def t18_length_buckets(spark, d):
    return passages(spark, d).where("text is not null").groupBy(F.lower(F.trim("split")).alias("split"), X.length_bucket(X.word_count(F.col("text"))).alias("bucket")).agg(F.count("*").alias("n"))


#: The same patterns in the dialect without look-behind, whose word characters are ASCII only.
_W = r"[\p{L}\p{M}\p{Nd}\p{Pc}\x{200c}\x{200d}]"
_PLAIN = X.ANOMALIES | {"mention": f"(^|[^{_W[1:-1]}])@{_W}", "hashtag": f"(^|[^{_W[1:-1]}])#{_W}", "latex": r"\$[^$]+\$|\\" + _W + r"+\{"}


@R.register("SELECT source, " + ", ".join(f"count(*) FILTER (WHERE regexp_matches(text, '{p}'))" + f" AS {n}" for n, p in _PLAIN.items() if n not in ("replacement_char", "non_ascii")) + ", count(*) FILTER (WHERE contains(text, chr(65533))) AS replacement_char, count(*) FILTER (WHERE strlen(text) <> length(text)) AS non_ascii FROM documents GROUP BY source")
def t20_anomalies(spark, d):
    """Texts of each source with markup, addresses, emoji, broken characters and formulas."""
    return table(spark, d, "documents").groupBy("source").agg(*(F.count(F.when(F.col("text").rlike(p), 1)).alias(n) for n, p in X.ANOMALIES.items()))


@R.register(f"""SELECT item_id, unnest([{{'length': 'full', 'prefix': text}}] || list_transform(list_filter([1, 2, 3], lambda k: length(p) > k), lambda k: {{'length': CAST(k AS VARCHAR), 'prefix': array_to_string(p[1:k], ' ')}}), recursive := true)
FROM (SELECT item_id, text, regexp_split_to_array(trim(text), '[ \\t\\n\\r\\f\\v]+') AS p FROM heldout_items)""")
def t21_prefixes(spark, d):
    """Every held-out text and its first one, two and three words."""
    return table(spark, d, "heldout_items").select("item_id", F.explode(X.first_words(F.col("text"))).alias("p")).select("item_id", "p.length", "p.prefix")


@R.register("SELECT strftime(to_timestamp(created) AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS n FROM se_locked WHERE created >= epoch(TIMESTAMP '2026-01-01') AND created < epoch(TIMESTAMP '2026-07-01') GROUP BY 1")
def t22_window(spark, d):
    """Questions of a window of days, by month."""
    low, high = (F.unix_timestamp(F.lit(x).cast("timestamp")) for x in ("2026-01-01 00:00:00Z", "2026-07-01 00:00:00Z"))
    rows = table(spark, d, "se_locked").where((F.col("created") >= low) & (F.col("created") < high))
    return rows.groupBy(F.date_format(F.timestamp_seconds("created"), "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
