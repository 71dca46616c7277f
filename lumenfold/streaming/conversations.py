"""The conversation theme as a keyed stream, with the state machine of the batch fold."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenfold.operators.conversation import CHILDREN, TURN_COLUMNS, TURN_SQL, Rules, State, advance, turn_row

STATE_SQL = "labels array<string>, scores array<double>, subs array<string>, sub_scores array<double>, idle int, dominant string, rival string, streak int"


def streamed_themes(turns: DataFrame, rules: Rules = Rules(), idle_minutes: float | None = None, children: dict[str, tuple[str, ...]] = CHILDREN) -> DataFrame:
    """As `themes`, on a stream of (session, turn, probs, weight) and perhaps sub_probs.

    Turns of a session that come in one micro-batch are taken in the order of their number;
    across batches in the order of arrival. A theme ends by turns only; with `idle_minutes`
    the state of a session without a message for so long is dropped from the store, so a
    later message begins anew. A micro-batch's turns of one session are held together, which
    the limits of the source (files or offsets a trigger) bound.
    """
    rules.checked()

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = State()
        if state.exists:
            labels, scores, subs, sub_scores, idle, dominant, rival, streak = state.get
            now = State(dict(zip(labels, scores)), dict(zip(subs, sub_scores)), idle, dominant, rival, streak)
        own = sorted((int(t), n, dict(p or {}), float(w), dict(s or {})) for b in batches for n, (t, p, w, s) in enumerate(zip(b["turn"], b["probs"], b["weight"], b["sub_probs"])))
        rows = []
        for turn, _, probs, weight, subs in own:
            now = advance(now, probs, weight, rules, subs)
            rows.append(turn_row(key[0], turn, now, rules, children))
        labels, subs = sorted(now.scores), sorted(now.subs)
        state.update((labels, [now.scores[k] for k in labels], subs, [now.subs[k] for k in subs], now.idle, now.dominant, now.rival, now.streak))
        if idle_minutes is not None:
            state.setTimeoutDuration(int(idle_minutes * 60_000))
        yield pd.DataFrame(rows, columns=TURN_COLUMNS)

    limit = GroupStateTimeout.NoTimeout if idle_minutes is None else GroupStateTimeout.ProcessingTimeTimeout
    subs = F.col("sub_probs") if "sub_probs" in turns.columns else F.lit(None).cast("map<string,double>")
    keyed = turns.select(F.col("session").cast("string").alias("session"), F.col("turn").cast("long").alias("turn"), "probs", F.col("weight").cast("double").alias("weight"), subs.alias("sub_probs"))
    return keyed.groupBy("session").applyInPandasWithState(update, TURN_SQL, STATE_SQL, "append", limit)
