"""Queries over conversations, stored tables and search payloads.

Conversations are the documents that are written as turns; a turn's scores over four toy
labels are the shares of its words by their hash, which SQL can say too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.functions import text as X
from lumenfold.operators import conversation, evaluation, hierarchy, profile, store
from lumenfold.plans import simulation
from lumenfold.queries import Registry, corpora
from lumenfold.sources.tables import table

R = Registry()
LABELS = ["a", "b", "c", "d"]
_TURNS = """ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
tn AS (SELECT doc_id AS session, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS turn, line FROM ln WHERE regexp_matches(line, '^(user|assistant): ')),
wd AS (SELECT session, turn, line, regexp_extract_all(lower(line), '[a-z]+') AS w FROM tn),
sc AS (SELECT session, turn, line, list_transform([0, 1, 2, 3], lambda k: length(list_filter(w, lambda x: (strpos('0123456789abcdef', right(md5(x), 1)) - 1) % 4 = k)) / length(w)::DOUBLE) AS p FROM wd),
tu AS (SELECT *, CASE WHEN list_max(p) >= 0.35 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS weight FROM sc)"""


def turns(spark: SparkSession, d: str) -> DataFrame:
    """(session, turn, line, probs array, weight)."""
    scored = spoken(spark, d).withColumn("slots", F.transform("words", lambda w: F.conv(F.substring(F.md5(w), -1, 1), 16, 10).cast("int") % 4))
    probs = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.size(F.filter("slots", lambda s: s == k)) / F.size("slots"))
    return scored.select("session", "turn", "line", probs.alias("probs")).withColumn("weight", F.when(F.array_max("probs") >= 0.35, 1.0).otherwise(0.0))


def spoken(spark: SparkSession, d: str) -> DataFrame:
    """(session, turn, line, words): the turns of a document stand in one row, so they are numbered without a shuffle."""
    said = F.filter(F.split("text", "\n"), lambda line: line.rlike("^(user|assistant): "))
    lines = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("session"), F.posexplode(said).alias("at", "line"))
    return lines.select("session", (F.col("at") + 1).cast("long").alias("turn"), "line", F.regexp_extract_all(F.lower("line"), F.lit("([a-z]+)"), 1).alias("words"))


def mapped(rows: DataFrame) -> DataFrame:
    return rows.withColumn("probs", F.map_from_arrays(F.array(*map(F.lit, LABELS)), "probs"))


_FOLD = f"""WITH RECURSIVE {_TURNS}, st AS (
SELECT session, turn, list_transform(p, lambda x: weight * x) AS s0, CASE WHEN weight > 0 THEN 0 ELSE 1 END AS idle, 2 AS lim FROM tu WHERE turn = 1
UNION ALL SELECT tu.session, tu.turn, list_transform(range(1, 5), lambda i: CASE WHEN weight <= 0 AND idle + 1 >= lim THEN 0 ELSE s0[i] * 0.7 + weight * p[i] END), CASE WHEN weight > 0 THEN 0 ELSE idle + 1 END, lim FROM st JOIN tu ON tu.session = st.session AND tu.turn = st.turn + 1)
SELECT session, turn, round(s0[1], 6) AS a, round(s0[2], 6) AS b, round(s0[3], 6) AS c, round(s0[4], 6) AS d, idle::BIGINT AS idle FROM st"""


@R.register(_FOLD)
def v1_decayed_scores(spark, d):
    """Decayed scores after every turn; two idle turns clear them."""
    rows = conversation.decayed_scores(mapped(turns(spark, d)), LABELS, 0.7, 2)
    return rows.select(F.col("session").cast("long").alias("session"), "turn", *(F.round(F.col("scores")[x], 6).alias(x) for x in LABELS), F.col("idle").cast("long").alias("idle"))


_ARG = "list_max(list_transform(range(1, 5), lambda i: CASE WHEN {v}[i] = list_max({v}) THEN i ELSE 0 END))"
_THEME = f"""WITH RECURSIVE {_TURNS}, st AS (
SELECT session, 0::BIGINT AS turn, [0.0, 0.0, 0.0, 0.0]::DOUBLE[] AS s, 0 AS idle, 0::BIGINT AS dom, 0::BIGINT AS ch, 0 AS streak, false AS expired FROM tu WHERE turn = 1
UNION ALL SELECT session, turn, CASE WHEN over THEN [0.0, 0.0, 0.0, 0.0]::DOUBLE[] ELSE n END, idle, CASE WHEN over THEN 0 WHEN weight <= 0 THEN dom WHEN take THEN lead WHEN vote = dom THEN dom WHEN (CASE WHEN vote = ch THEN streak + 1 ELSE 1 END) >= 2 THEN vote ELSE dom END,
  CASE WHEN over THEN 0 WHEN weight <= 0 THEN ch WHEN take OR vote = dom OR (CASE WHEN vote = ch THEN streak + 1 ELSE 1 END) >= 2 THEN 0 ELSE vote END,
  CASE WHEN over THEN 0 WHEN weight <= 0 THEN streak WHEN take OR vote = dom OR (CASE WHEN vote = ch THEN streak + 1 ELSE 1 END) >= 2 THEN 0 WHEN vote = ch THEN streak + 1 ELSE 1 END, over
FROM (SELECT *, weight <= 0 AND idle >= 2 AS over, CASE WHEN dom = 0 THEN true ELSE CASE WHEN list_sum(n) > 0 THEN n[dom] / list_sum(n) ELSE 0 END < 0.2 END AS take, {_ARG.format(v='n')} AS lead, {_ARG.format(v='p')} AS vote
  FROM (SELECT tu.session, tu.turn, p, weight, list_transform(range(1, 5), lambda i: s[i] * 0.7 + weight * p[i]) AS n, CASE WHEN weight > 0 THEN 0 ELSE idle + 1 END AS idle, dom, ch, streak FROM st JOIN tu ON tu.session = st.session AND tu.turn = st.turn + 1))),
sh AS (SELECT session, turn, dom, k, s[k] / list_sum(s) AS x, row_number() OVER (PARTITION BY session, turn ORDER BY s[k] DESC, k) AS r FROM st, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE list_sum(s) > 0 AND s[k] / list_sum(s) >= 0.2),
tp AS (SELECT session, turn, string_agg('abcd'[k] || printf(':%.4f', round_even(x, 4)), ' ' ORDER BY CASE WHEN k = dom THEN 0 ELSE 1 END, r) AS topics FROM sh WHERE r <= 3 GROUP BY ALL)
SELECT session, turn, CASE WHEN dom > 0 THEN 'abcd'[dom] END AS dominant, expired, idle::BIGINT AS idle, coalesce(topics, '') AS topics FROM st LEFT JOIN tp USING (session, turn) WHERE turn > 0"""
RULES = conversation.Rules(expire_after=2)


@R.register(_THEME)
def v3_themes(spark, d):
    """The theme of every conversation after every turn."""
    topics = F.array_join(F.transform("topics", lambda t: F.concat(t["topic"], F.lit(":"), F.format_string("%.4f", t["share"]))), " ")
    return conversation.themes(mapped(turns(spark, d)), RULES).select(F.col("session").cast("long").alias("session"), "turn", "dominant", "expired", F.col("idle").cast("long").alias("idle"), topics.alias("topics"))


#: The real labels in the order of their names, which decides ties; toy scores spread words over the subtopics by their hash.
TOPICS = sorted(hierarchy.GENERALS)
SUBTOPICS = sorted(r[5] for r in hierarchy.taxonomy_rows())
PARENTS = [TOPICS.index(next(g for g, (_, _, subs) in hierarchy.GENERALS.items() if s in subs)) for s in SUBTOPICS]


def topical_turns(spark: SparkSession, d: str) -> DataFrame:
    """(session, turn, line, words, probs, sub_probs, weight): shares of a turn's words by subtopic and by general topic."""
    slots = F.transform("words", lambda w: F.conv(F.substring(F.md5(w), -2, 2), 16, 10).cast("int") % len(SUBTOPICS))
    rows = spoken(spark, d).withColumn("slots", slots).withColumn("parents", F.transform("slots", lambda s: F.array(*map(F.lit, PARENTS))[s]))
    share = lambda names, column: F.map_from_arrays(F.array(*map(F.lit, names)), F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda k: F.size(F.filter(column, lambda s: s == k)) / F.size(column)))
    scored = rows.withColumns({"probs": share(TOPICS, "parents"), "sub_probs": share(SUBTOPICS, "slots")})
    return scored.withColumn("weight", F.when(F.array_max(F.map_values("probs")) >= 0.3, 1.0).otherwise(0.0)).drop("slots", "parents")


def _list(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in values) + "]"


_N, _Q, _HEX = len(TOPICS), len(SUBTOPICS), "strpos('0123456789abcdef', md5(x)[{0}:{0}]) - 1"
_ZERO8, _ZERO28 = (f"{[0.0] * n}::DOUBLE[]" for n in (_N, _Q))
_TOPICAL = f"""WITH RECURSIVE {_TURNS.split("sc AS")[0]}
sk AS (SELECT session, turn, line, list_transform(w, lambda x: (({_HEX.format(31)}) * 16 + {_HEX.format(32)}) % {_Q}) AS k FROM wd),
pq AS (SELECT session, turn, line, list_transform(range(0, {_Q}), lambda j: length(list_filter(k, lambda x: x = j)) / length(k)::DOUBLE) AS q, list_transform(range(0, {_N}), lambda g: length(list_filter(k, lambda x: {PARENTS}[x + 1] = g)) / length(k)::DOUBLE) AS p FROM sk),
tu AS (SELECT *, CASE WHEN list_max(p) >= 0.3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS weight FROM pq),
st AS (SELECT session, 0::BIGINT AS turn, {_ZERO8} AS s, {_ZERO28} AS z, 0 AS idle, 0::BIGINT AS dom, 0::BIGINT AS ch, 0 AS streak, false AS expired FROM tu WHERE turn = 1
UNION ALL SELECT session, turn, CASE WHEN over THEN {_ZERO8} ELSE n END, CASE WHEN over THEN {_ZERO28} ELSE m END, idle,
  CASE WHEN over THEN 0 WHEN weight <= 0 THEN dom WHEN take THEN lead WHEN vote = dom THEN dom WHEN again >= 2 THEN vote ELSE dom END,
  CASE WHEN over THEN 0 WHEN weight <= 0 THEN ch WHEN take OR vote = dom OR again >= 2 THEN 0 ELSE vote END,
  CASE WHEN over THEN 0 WHEN weight <= 0 THEN streak WHEN take OR vote = dom OR again >= 2 THEN 0 ELSE again END, over
FROM (SELECT *, weight <= 0 AND idle >= 2 AS over, dom = 0 OR coalesce(n[dom] / nullif(list_sum(n), 0), 0) < 0.2 AS take, {_ARG.format(v='n').replace('range(1, 5)', f'range(1, {_N + 1})')} AS lead, vote, CASE WHEN vote = ch THEN streak + 1 ELSE 1 END AS again
  FROM (SELECT tu.session, tu.turn, weight, list_transform(range(1, {_N + 1}), lambda i: s[i] * 0.7 + weight * p[i]) AS n, list_transform(range(1, {_Q + 1}), lambda i: z[i] * 0.7 + weight * q[i]) AS m, CASE WHEN weight > 0 THEN 0 ELSE idle + 1 END AS idle, dom, ch, streak, {_ARG.format(v='p').replace('range(1, 5)', f'range(1, {_N + 1})')} AS vote FROM st JOIN tu ON tu.session = st.session AND tu.turn = st.turn + 1))),
sh AS (SELECT session, turn, dom, g, s[g] / list_sum(s) AS x, row_number() OVER (PARTITION BY session, turn ORDER BY s[g] DESC, g) AS r FROM st, (SELECT unnest(range(1, {_N + 1})) AS g) WHERE list_sum(s) > 0 AND s[g] / list_sum(s) >= 0.2),
ac AS (SELECT session, turn, g, x, row_number() OVER (PARTITION BY session, turn ORDER BY CASE WHEN g = dom THEN 0 ELSE 1 END, r) AS nth FROM sh WHERE r <= 3),
kid AS (SELECT unnest(range(1, {_Q + 1})) AS j, unnest({[g + 1 for g in PARENTS]}) AS g),
su AS (SELECT ac.session, ac.turn, ac.nth, kid.g, j, z[j] AS v, sum(z[j]) OVER (PARTITION BY ac.session, ac.turn, kid.g ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS al FROM ac JOIN st USING (session, turn) JOIN kid ON kid.g = ac.g),
sr AS (SELECT session, turn, nth, g, j, round_even(v / al, 4) AS share, row_number() OVER (PARTITION BY session, turn, g ORDER BY v DESC, j) AS place FROM su WHERE al > 0 AND v / al >= 0.35)"""


@R.register(f"""{_TOPICAL}, tp AS (SELECT session, turn, string_agg({_list(TOPICS)}[g] || printf(':%.4f', round_even(x, 4)), ' ' ORDER BY nth) AS topics FROM ac GROUP BY ALL),
sp AS (SELECT session, turn, string_agg({_list(SUBTOPICS)}[j] || printf(':%.4f', share), ' ' ORDER BY nth, place) AS subtopics FROM sr WHERE place <= 2 GROUP BY ALL)
SELECT session, turn, CASE WHEN dom > 0 THEN {_list(TOPICS)}[dom] END AS dominant, expired, coalesce(topics, '') AS topics, coalesce(subtopics, '') AS subtopics FROM st LEFT JOIN tp USING (session, turn) LEFT JOIN sp USING (session, turn) WHERE turn > 0""")
def v6_subtopics(spark, d):
    """Active general topics after every turn, and the active subtopics of each."""
    shown = lambda column, name: F.array_join(F.transform(column, lambda t: F.concat(t[name], F.lit(":"), F.format_string("%.4f", t["share"]))), " ")
    found = conversation.themes(topical_turns(spark, d), RULES)
    return found.select(F.col("session").cast("long").alias("session"), "turn", "dominant", "expired", shown("topics", "topic").alias("topics"), shown("subtopics", "id").alias("subtopics"))


def last_themes(spark: SparkSession, d: str) -> DataFrame:
    """(session, turn, theme) of every conversation's last turn."""
    last = conversation.themes(topical_turns(spark, d), RULES).groupBy("session").agg(F.max_by(F.struct("turn", "topics", "subtopics"), "turn").alias("x")).select(F.col("session").cast("long").alias("session"), "x.*")
    return last.select("session", "turn", conversation.composed(F.transform("topics", lambda t: t["topic"]), conversation.focus_of(F.col("subtopics"))).alias("theme"))


_ROWS = {r[1]: r for r in hierarchy.taxonomy_rows()}
_SUBS = {r[5]: r for r in hierarchy.taxonomy_rows()}
_NAMED = [hierarchy.NAMES.get(x, x.replace("_", " ").title()) for x in TOPICS], [hierarchy.NAMES.get(x, x.replace("_", " ").title()) for x in SUBTOPICS]
_BROADER = [TOPICS.index(_ROWS[t][3]) + 1 if _ROWS[t][3] else None for t in TOPICS]
_COMPOSED = f"""{_TOPICAL}, fc AS (SELECT session, turn, g, j FROM sr WHERE place = 1 AND share >= 0.5),
go AS (SELECT ac.session, ac.turn, list(ac.g ORDER BY nth) AS g, list({_list([_ROWS[t][1] for t in TOPICS])}[ac.g] ORDER BY nth) AS ph, list(coalesce({_list([_SUBS[x][6] for x in SUBTOPICS])}[j], {_list(TOPICS)}[ac.g]) ORDER BY nth) AS sp, coalesce(list({_list(SUBTOPICS)}[j] ORDER BY nth) FILTER (WHERE j IS NOT NULL), []) AS chosen, coalesce(list({_list(_NAMED[1])}[j] ORDER BY nth) FILTER (WHERE j IS NOT NULL), []) AS names FROM ac LEFT JOIN fc ON fc.session = ac.session AND fc.turn = ac.turn AND fc.g = ac.g GROUP BY ALL),
ix AS (SELECT session, max(turn) AS turn FROM tu GROUP BY 1), al AS (SELECT ix.session, ix.turn, coalesce(g, []) AS g, coalesce(ph, []) AS ph, coalesce(sp, []) AS sp, coalesce(chosen, []) AS chosen, coalesce(names, []) AS names FROM ix LEFT JOIN go USING (session, turn)),
dm AS (SELECT *, list_filter(range(1, length(g) + 1), lambda i: {_list([_ROWS[t][2] for t in TOPICS])}[g[i]] = 'domain') AS dd, list_filter(range(1, length(g) + 1), lambda i: {_list([_ROWS[t][2] for t in TOPICS])}[g[i]] = 'format') AS ff FROM al),
nw AS (SELECT *, list_filter(dd, lambda i: coalesce(list_contains(list_transform(dd, lambda k: g[k]), {_list(_BROADER)}[g[i]]), false))[1] AS nar, list_filter(dd, lambda i: g[i] = {TOPICS.index('history') + 1})[1] AS fra FROM dm),
fd AS (SELECT *, CASE WHEN fra IS NOT NULL THEN list_filter(dd, lambda i: i <> fra)[1] END AS oth, {_list(TOPICS)}[{_list(_BROADER)}[g[nar]]] AS bro FROM nw),
cp AS (SELECT *, CASE WHEN length(g) = 0 THEN '' WHEN length(g) = 1 THEN sp[1] WHEN length(ff) > 0 AND length(dd) > 0 AND nar IS NOT NULL THEN bro || ' ' || ph[ff[1]] || ' about ' || ph[nar]
  WHEN length(ff) > 0 AND length(dd) > 0 THEN array_to_string(list_transform(dd[1:2], lambda i: ph[i]), ' and ') || ' ' || ph[ff[1]] WHEN nar IS NOT NULL THEN sp[nar] || ' (' || bro || ')'
  WHEN oth IS NOT NULL THEN 'history of ' || sp[oth] ELSE array_to_string(list_transform(dd[1:2], lambda i: sp[i]), ' and ') END AS phrase FROM fd),
cc AS (SELECT *, list_transform(CASE WHEN nar IS NULL THEN dd ELSE [nar] || list_filter(dd, lambda i: i <> nar) END, lambda i: sp[i]) AS cs FROM cp),
cq AS (SELECT *, list_filter(range(1, length(cs) + 1), lambda i: list_position(cs, cs[i]) = i AND cs[i] <> phrase) AS keep FROM cc), th AS (SELECT *, list_transform(keep, lambda i: cs[i]) AS concepts,
  CASE WHEN length(g) = 0 THEN '(no theme yet)' WHEN length(g) = 1 AND length(chosen) = 1 THEN {_list(_NAMED[0])}[g[1]] || ' > ' || names[1] ELSE array_to_string(list_transform(g, lambda i: {_list(_NAMED[0])}[i]), ' + ') END AS label FROM cq)"""


@R.register(f"{_COMPOSED} SELECT session, turn, label, phrase FROM th")
def q1_phrases(spark, d):
    """Label and phrase of every conversation's last theme."""
    return last_themes(spark, d).select("session", "turn", "theme.label", "theme.phrase")


@R.register(f"{_COMPOSED} SELECT session, array_to_string(chosen, '|') AS subtopics, array_to_string(concepts, '|') AS concepts FROM th")
def q2_concepts(spark, d):
    """The subtopics that stand for topics of every conversation's last theme, and the concepts behind its phrase."""
    return last_themes(spark, d).select("session", F.array_join("theme.subtopics", "|").alias("subtopics"), F.array_join("theme.concepts", "|").alias("concepts"))


_TRIED = "[trim(phrase || ' ' || kw), phrase] || concepts"


@R.register(f"""{_COMPOSED}, kd AS (SELECT th.*, coalesce((SELECT array_to_string(list_filter(regexp_extract_all(lower(line), '[a-z]+'), lambda x: length(x) >= 12)[1:1], ' ') FROM tu WHERE tu.session = th.session AND tu.turn = th.turn), '') AS kw FROM th), tr AS (SELECT session, phrase, {_TRIED} AS t FROM kd)
SELECT session, CASE WHEN phrase = '' THEN '' ELSE array_to_string(list_transform(list_filter(range(1, length(t) + 1), lambda i: list_position(t, t[i]) = i AND t[i] <> ''), lambda i: t[i])[1:4], '|') END AS queries FROM tr""")
def q4_queries(spark, d):
    """Queries for every conversation's last theme, with the first long word of the last turn as its keyword."""
    said = spoken(spark, d).select("session", "turn", F.slice(F.filter("words", lambda w: F.length(w) >= 12), 1, 1).alias("keywords"))
    rows = last_themes(spark, d).join(said, ["session", "turn"])
    return rows.select("session", F.array_join(conversation.search_queries(F.col("theme.phrase"), F.col("keywords"), F.col("theme.concepts")), "|").alias("queries"))


def messages(spark: SparkSession, d: str) -> DataFrame:
    """(session, at, text, status, probs, sub_probs): turns whose scores are flat are uncertain, short ones uninformative."""
    status = F.when(F.size("words") < 4, "uninformative").when(F.col("weight") > 0, "ok").otherwise("uncertain")
    return topical_turns(spark, d).select("session", F.col("turn").alias("at"), F.col("line").alias("text"), status.alias("status"), "probs", "sub_probs")


@R.register()
def v8_turns(spark, d):
    """Every message of every conversation as a session processes it: theme, phrase and queries after it."""
    words = profile.vocabulary(corpora.delivered(spark, d).where("s = 'train' and g is not null and text is not null"), "passage_id", "text", "g")
    out = conversation.processed(messages(spark, d), words, RULES)
    return out.select("session", "turn", "status", "expired", "label", "phrase", F.array_join("concepts", "|").alias("concepts"), F.array_join("queries", "|").alias("queries"))


_STORED = f"""{_TOPICAL}, ms AS (SELECT pq.session, pq.turn, pq.line, list_max(p) AS conf, {_list(TOPICS)}[list_position(p, list_max(p))] AS general, CASE WHEN list_max(p) >= 0.3 THEN 'ok' ELSE 'uncertain' END AS status FROM pq)"""


def stored_texts(spark: SparkSession, d: str) -> DataFrame:
    """The turns as rows of `texts`."""
    top = F.array_max(F.map_values("probs"))
    general = F.array_min(F.map_keys(F.map_filter("probs", lambda _, v: v == top)))
    rows = topical_turns(spark, d).withColumns({"confidence": top, "general": general}).withColumn("status", F.when(F.col("confidence") >= 0.3, "ok").otherwise("uncertain"))
    subs = F.transform(F.array_sort(F.map_keys(F.map_filter("sub_probs", lambda _, v: v >= 0.2))), lambda k: F.struct(k.alias("id"), F.col("sub_probs")[k].alias("probability")))
    return store.text_rows(rows.select("session", "turn", F.col("line").alias("text"), "status", "general", "confidence", subs.alias("subtopics"), F.col("probs").alias("general_probs")))


@R.register(f"{_STORED} SELECT session::VARCHAR AS session_id, turn, left(line, 10000) AS content, general AS general_topic, round(conf, 6) AS general_confidence, CASE WHEN status = 'ok' THEN 0 ELSE 1 END AS uncertain, status FROM ms")
def d3_texts(spark, d):
    """Every turn as it is stored: its content within the limit, topic, confidence and status."""
    return stored_texts(spark, d).select("session_id", "turn", "content", "general_topic", F.round("general_confidence", 6).alias("general_confidence"), "uncertain", "status")


@R.register(f"""{_STORED} SELECT session::VARCHAR AS session_id, turn, coalesce((SELECT string_agg({_list(SUBTOPICS)}[i] || printf(':%.4f', round_even(q[i], 4)), ' ' ORDER BY i) FROM (SELECT unnest(range(1, {_Q + 1})) AS i) WHERE q[i] >= 0.2), '') AS subtopics FROM pq""")
def d5_session_texts(spark, d):
    """The stored turns of every session in order, their JSON read again."""
    shown = F.array_join(F.transform("subtopics", lambda s: F.concat(s["id"], F.lit(":"), F.format_string("%.4f", s["probability"]))), " ")
    return store.session_texts(stored_texts(spark, d)).select("session_id", "turn", shown.alias("subtopics"))


@R.register(f"{_COMPOSED}, sc AS (SELECT session, turn, list_sum(list_transform(s, lambda x: round_even(x, 4))) AS total, length(list_filter(z, lambda x: x >= 0.01)) AS kept FROM st) SELECT th.session::VARCHAR AS session_id, th.turn, th.label, th.phrase, phrase AS query FROM th")
def d4_topics(spark, d):
    """The last theme of every session as a row of `conversation_topics`."""
    last = last_themes(spark, d)
    said = topical_turns(spark, d).select("session", "turn", F.col("probs").alias("scores"), "sub_probs")
    rows = last.join(said, ["session", "turn"]).select("session", "turn", "theme.label", "theme.phrase", "scores", "sub_probs", F.col("theme.phrase").alias("query")).withColumnRenamed("sub_probs", "sub_scores")
    return store.topic_rows(rows).select("session_id", "turn", "label", "phrase", "query")


@R.register(f"""{_TOPICAL}, ex AS (SELECT session, turn, CASE WHEN weight > 0 THEN {_list(TOPICS)}[{_ARG.format(v="p").replace("range(1, 5)", f"range(1, {_N + 1})")}] END AS expected FROM tu),
fo AS (SELECT session, turn, CASE WHEN dom > 0 THEN {_list(TOPICS)}[dom] END AS dominant FROM st WHERE turn > 0)
SELECT session AS "case", count(*) AS steps, CAST(sum(CASE WHEN dominant IS NOT DISTINCT FROM expected THEN 1 ELSE 0 END) AS BIGINT) AS passed, bool_and(dominant IS NOT DISTINCT FROM expected) AS ok FROM ex JOIN fo USING (session, turn) GROUP BY session""")
def e16_acceptance(spark, d):
    """Every conversation as a case: the dominant topic after each turn should be the one the turn votes for, none for a flat turn."""
    rows = topical_turns(spark, d)
    top = F.array_max(F.map_values("probs"))
    cases = rows.select(F.col("session").cast("string").alias("session"), "turn", F.col("session").alias("case"), F.when(F.col("weight") > 0, F.array_max(F.map_keys(F.map_filter("probs", lambda _, v: v == top)))).alias("expected"))
    return evaluation.accepted_cases(conversation.themes(rows, RULES), cases, ["session", "turn"], "dominant")


@R.register()
def x9_simulation(spark, d):
    """Generated conversations under a grid of rules: what each rule is worth, which are eligible, and the one chosen."""
    return simulation.chosen_rules(simulation.simulated(spark, simulation.grid(), simulation.pools(topical_turns(spark, d))))


@R.register(corpora.KEYWORDS_SQL)
def q3_keywords(spark, d):
    """The two most telling words of every question, but for those of its general topic."""
    words = profile.vocabulary(corpora.delivered(spark, d).where("s = 'train' and g is not null and text is not null"), "passage_id", "text", "g")
    messages = table(spark, d, "se_locked").groupBy("site", "question_id").agg(F.min("text").alias("text"), F.min(F.coalesce("general", F.lit(""))).alias("phrase"))
    found = conversation.salient_keywords(messages.select(F.concat_ws(":", "site", "question_id").alias("id"), "text", "phrase"), words)
    return found.select("id", F.array_join("keywords", "|").alias("keywords"))


@R.register("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def w4_latest(spark, d):
    """The latest event of every user, as an upsert keeps it."""
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type", "value", F.struct("ts", "event_id").alias("version"))
    empty = rows.limit(0)
    return store.upsert(empty, rows, ["user_id"], "version").select("user_id", "event_id", "event_type", "value")


@R.register("SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 2160 HOUR GROUP BY 1")
def w4_alive(spark, d):
    """Orders of the last ninety days, by customer: entries that have not outlived their time."""
    rows = table(spark, d, "orders").withColumn("fetched_at", F.col("o_orderdate").cast("timestamp"))
    newest = rows.agg(F.max("fetched_at").alias("now"))
    return store.cached(rows.crossJoin(F.broadcast(newest)), F.col("now"), 2160).groupBy("o_custkey").agg(F.count("*").alias("n"))


@R.register("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def d5_decoded(spark, d):
    """Events by a number inside their JSON."""
    rows = table(spark, d, "events").withColumn("k", F.from_json("props", "k bigint")["k"])
    return rows.groupBy("event_type", "k").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@R.register("SELECT l_orderkey, l_linenumber, o_orderstatus, l_quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey = (SELECT o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1)")
def d7_latest_session(spark, d):
    """The lines of the customer of the latest order, by a scalar subquery."""
    for name in ("orders", "lineitem"):
        table(spark, d, name).createOrReplaceTempView(f"d7_{name}")
    return spark.sql("SELECT l_orderkey, l_linenumber, o_orderstatus, l_quantity FROM d7_lineitem JOIN d7_orders ON o_orderkey = l_orderkey WHERE o_custkey = (SELECT o_custkey FROM d7_orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1)")


@R.register("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0")
def d1_insert_or_ignore(spark, d):
    """Orders with numbers by 3, then those by 2 that are new."""
    rows = table(spark, d, "orders").select("o_orderkey")
    return store.insert_or_ignore(rows.where("o_orderkey % 3 = 0"), rows.where("o_orderkey % 2 = 0"), ["o_orderkey"])


@R.register("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def d6_counts(spark, d):
    """Orders of every customer; the reference from orders to customers is checked first."""
    customers, orders = table(spark, d, "customer"), table(spark, d, "orders")
    store.require_reference(orders, "o_custkey", customers, "c_custkey")
    n = orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return customers.join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@R.register(r"SELECT wiki_id AS id, CAST(1 AS BIGINT) AS rank, left(title, 200) AS title FROM articles WHERE title IS NOT NULL AND trim(title) <> '' AND NOT regexp_matches(title, '[<&]|\s\s|^\s|\s$|[\x{00a0}]') AND length(title) <= 200")
def w1_parsed(spark, d):
    """Search payloads, made of the catalogue's plain titles, parsed again."""
    plain = table(spark, d, "articles").where(F.col("title").isNotNull() & (F.trim("title") != "") & ~F.col("title").rlike(r"[<&]|\s\s|^\s|\s$| ") & (F.length("title") <= 200))
    page = F.struct(F.lit(1).alias("index"), "title", F.lit("x").alias("extract"), F.lit("https://en.wikipedia.org/wiki/X").alias("fullurl"))
    payload = F.to_json(F.struct(F.struct(F.array(page).alias("pages")).alias("query")))
    return store.wikipedia_results(plain.select(F.col("wiki_id").alias("id"), payload.alias("payload"))).select("id", F.col("rank").cast("long").alias("rank"), "title")


@R.register("SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def s21_hourly(spark, d):
    """Events by hour, as the stream counts them."""
    return table(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@R.register("SELECT n_name, count(DISTINCT c_custkey) AS customers, count(*) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def h1_rollup(spark, d):
    """A roll-up along a two-level hierarchy: lines and revenue of each nation."""
    lines, orders, customers, nations = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation"))
    per_order = lines.groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    per_customer = per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.sum("lines").alias("lines"), F.sum("revenue").alias("revenue"))
    joined = per_customer.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("customers"), F.sum("lines").alias("lines"), F.round(F.sum("revenue"), 2).alias("revenue"))
