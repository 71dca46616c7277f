"""Rules for themes, tried on generated conversations.

Conversations are made of real turns: a conversation has segments on a topic, some turns
are tangents to another topic or off topic. Every choice is a hash of the seed, the
conversation and the turn, so they are the same at every run and on any number of
machines. Each of the rules of a grid follows every conversation; what it is worth is
counted in one aggregate over (rules, conversation).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.operators.conversation import Rules, State, active, advance
from lumenfold.operators.evaluation import best_by

#: Segments of a conversation, turns of one, shares of off-topic turns and of tangents, turns after which a theme must be gone.
SEGMENTS, SHORTEST, LONGEST, OFF_TOPIC, TANGENT, STALE, EARLY = 3, 3, 6, 0.1, 0.15, 6, 2
CONVERSATIONS = 400
#: What eligible rules reach.
LEAST_ACCUMULATED, MOST_STALE, MOST_EARLY, MOST_FALSE = 0.8, 0.05, 0.05, 0.2


def grid() -> list[Rules]:
    """Rules to try: decay, share, idle turns and confirmations by votes, and by scores."""
    return [Rules(decay, share, expire, confirm, votes) for decay in (0.5, 0.6, 0.7, 0.8) for share in (0.1, 0.15, 0.2) for expire in (0, 3, 4) for confirm in (1, 2, 3) for votes in (True, False) if votes or confirm < 3]


def pools(turns: DataFrame, most: int = 50) -> dict[str | None, list[dict[str, float]]]:
    """Of each general topic up to `most` turns that are surely about it, by hash; under None turns about nothing."""
    top = F.array_max(F.map_values("probs"))
    named = turns.select("probs", F.when(F.col("weight") > 0, F.array_max(F.map_keys(F.map_filter("probs", lambda _, v: v == top)))).alias("topic"), F.sha1("line").alias("h"))
    ranked = named.withColumn("n", F.row_number().over(Window.partitionBy("topic").orderBy("h"))).where(F.col("n") <= most)
    out: dict[str | None, list[dict[str, float]]] = {}
    for r in ranked.orderBy("topic", "n").toLocalIterator():  # at most `most` turns a topic
        out.setdefault(r.topic, []).append(dict(r.probs))
    return out


class Dice:
    """Choices that depend on nothing but their names."""

    def __init__(self, seed: int, conversation: int):
        self.base = f"{seed}:{conversation}:"

    def share(self, *name) -> float:
        return int(hashlib.md5((self.base + ":".join(map(str, name))).encode()).hexdigest()[:12], 16) / 16**12

    def pick(self, options: list, *name):
        return options[int(self.share(*name) * len(options))]


def follow(rules: Rules, number: int, by_topic: dict, seed: int) -> tuple:
    """What the rules make of one conversation: counts, in the order of COUNTS."""
    dice, topics = Dice(seed, number), sorted(k for k in by_topic if k is not None)
    nothing = by_topic.get(None) or [{}]
    hits = turns = tangents = kept = false = spurious = lag_sum = lags = 0
    state, before_topic = State(), None
    for segment in range(SEGMENTS):
        topic = dice.pick([t for t in topics if t != before_topic] or topics, "topic", segment)
        length, lag = SHORTEST + int(dice.share("length", segment) * (LONGEST - SHORTEST + 1)), None
        for turn in range(length):
            kind, before, other = dice.share("kind", segment, turn), state.dominant, None
            if kind < OFF_TOPIC:
                state = advance(state, dice.pick(nothing, "off", segment, turn), 0.0, rules)
            else:
                if kind < OFF_TOPIC + TANGENT and len(topics) > 1:
                    other = dice.pick([t for t in topics if t != topic], "tangent", segment, turn)
                state = advance(state, dice.pick(by_topic[other or topic], "turn", segment, turn), 1.0, rules)
            if lag is None and state.dominant == topic:
                lag = turn
            if turn:
                turns, hits = turns + 1, hits + (state.dominant == topic)
                spurious += len({k for k, _ in active(state.scores, rules.min_share, rules.topics)} - {topic, before_topic})
                if other is not None and before not in (None, other):
                    tangents, kept, false = tangents + 1, kept + (state.dominant == before), false + (state.dominant == other)
        if before_topic is not None:
            lags, lag_sum = lags + 1, lag_sum + (length if lag is None else lag)
        before_topic = topic
    # Three topics in turn should all be active; a theme that nothing is said about should go, but not at once.
    state, three = State(), []
    for n in range(3):
        three.append(dice.pick([t for t in topics if t not in three] or topics, "three", n))
        state = advance(state, dice.pick(by_topic[three[-1]], "three turn", n), 1.0, rules)
    gathered = set(three) <= {k for k, _ in active(state.scores, rules.min_share, rules.topics)}
    gone = None
    for n in range(1, STALE + 1):
        state = advance(state, dice.pick(nothing, "idle", n), 0.0, rules)
        gone = n if gone is None and state.expired else gone
    return hits, turns, kept, false, tangents, spurious, lag_sum, lags, int(gathered), int(gone is None), int(gone is not None and gone <= EARLY)


COUNTS = ["hits", "turns", "kept", "false", "tangents", "spurious", "lag_sum", "lags", "gathered", "stale", "early"]


def simulated(spark: SparkSession, rules: list[Rules], by_topic: dict, conversations: int = CONVERSATIONS, seed: int = 42) -> DataFrame:
    """One row a set of rules: theme_accuracy, switch_lag, tangent_robust, false_switch_rate, accumulation_3, spurious_topics, stale_theme_rate, premature_expiry."""
    if not [k for k in by_topic if k is not None]:
        rules = []
    numbered = spark.createDataFrame([(n, *r[:5]) for n, r in enumerate(rules)], "n int, decay double, min_share double, expire_after int, confirm_turns int, by_votes boolean")
    work = numbered.select("n").crossJoin(spark.range(conversations).select(F.col("id").alias("conversation"))).repartition("n", "conversation")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(n, *follow(rules[n], c, by_topic, seed)) for n, c in zip(batch["n"], batch["conversation"])], columns=["n", *COUNTS])

    sums = work.mapInPandas(run, "n int, " + ", ".join(f"{c} long" for c in COUNTS)).groupBy("n").agg(*(F.sum(c).alias(c) for c in COUNTS), F.count("*").alias("all"))
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)), 4)
    worth = [rate("hits", "turns").alias("theme_accuracy"), rate("lag_sum", "lags").alias("switch_lag"), rate("kept", "tangents").alias("tangent_robust"), rate("false", "tangents").alias("false_switch_rate"), rate("gathered", "all").alias("accumulation_3"), rate("spurious", "turns").alias("spurious_topics"), rate("stale", "all").alias("stale_theme_rate"), rate("early", "all").alias("premature_expiry")]
    return numbered.join(sums, "n").select("decay", "min_share", "expire_after", "confirm_turns", "by_votes", *worth)


def chosen_rules(found: DataFrame) -> DataFrame:
    """`found` with eligible and chosen: of the eligible rules the one of the best accuracy, ties to the least lag, then to the smaller numbers."""
    keys = ["decay", "min_share", "expire_after", "confirm_turns", "by_votes"]
    eligible = (F.col("accumulation_3") >= LEAST_ACCUMULATED) & (F.col("stale_theme_rate") <= MOST_STALE) & (F.col("premature_expiry") <= MOST_EARLY) & (F.col("false_switch_rate") <= MOST_FALSE)
    marked = found.withColumn("eligible", eligible)
    best = best_by(marked.where("eligible"), [], "theme_accuracy", ["switch_lag", *keys]).select(*keys, F.lit(True).alias("chosen"))
    return marked.join(F.broadcast(best), keys, "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))
