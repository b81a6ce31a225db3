"""Spaced repetition: a card's memory state as a fold over its answers, in order of time.

The fold is one SQL expression, so Spark runs it inside the JVM and any engine with lambdas can check it. State: phase
(0 new, 1 learning, 2 review, 3 relearning), step, stability s, difficulty d, and due and last in seconds.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The scheduler's 21 parameters, retention, steps in seconds, the longest interval in days, new words a day.
W = (0.212, 1.2931, 2.3065, 8.2956, 6.4133, 0.8334, 3.0194, 0.001, 1.8722, 0.1666, 0.796, 1.4835, 0.0614, 0.2629, 1.6483, 0.6014,
     1.8729, 0.5425, 0.0912, 0.0658, 0.1542)
RETENTION, LEARNING, RELEARNING, LONGEST, NEW_PER_DAY = 0.9, (60, 600), (600,), 36500, 20
DECAY = -W[20]
FACTOR = RETENTION ** (1 / DECAY) - 1


def _clamp(x: str, low: float, high: float) -> str:
    return f"least(greatest({x}, {low!r}e0), {high!r}e0)"


def step_sql(s: str, r: str, t: str, spark: bool) -> str:
    """The state after an answer: s is the state before, r the rating (1 again .. 4 easy), t its time in seconds."""
    n = [f"{x!r}e0" if "e" not in repr(x) else repr(x) for x in W]
    days = f"floor(greatest({t} - {s}.last, 0) / 86400)"
    recall = f"pow(1e0 + {FACTOR!r}e0 * {days} / {s}.s, {DECAY!r}e0)"
    first_d = f"({n[4]} - exp({n[5]} * ({r} - 1)) + 1e0)"
    easy_d = f"({n[4]} - exp({n[5]} * 3) + 1e0)"
    later_d = f"({n[7]} * {easy_d} + (1e0 - {n[7]}) * ({s}.d + (10e0 - {s}.d) * (-{n[6]} * ({r} - 3)) / 9e0))"
    d = f"CASE WHEN {s}.phase = 0 THEN {_clamp(first_d, 1, 10)} ELSE {_clamp(later_d, 1, 10)} END"
    first_s = f"CASE {r} WHEN 1 THEN {n[0]} WHEN 2 THEN {n[1]} WHEN 3 THEN {n[2]} ELSE {n[3]} END"
    growth = f"exp({n[17]} * ({r} - 3 + {n[18]})) * pow({s}.s, -{n[19]})"
    same_day = f"{s}.s * CASE WHEN {r} >= 2 THEN greatest({growth}, 1e0) ELSE {growth} END"
    lapse = f"least({n[11]} * pow({s}.d, -{n[12]}) * (pow({s}.s + 1e0, {n[13]}) - 1e0) * exp((1e0 - {recall}) * {n[14]}), {s}.s / {math.exp(W[17] * W[18])!r}e0)"
    bonus = f"CASE {r} WHEN 2 THEN {n[15]} WHEN 4 THEN {n[16]} ELSE 1e0 END"
    success = f"{s}.s * (1e0 + {math.exp(W[8])!r}e0 * (11e0 - {s}.d) * pow({s}.s, -{n[9]}) * (exp((1e0 - {recall}) * {n[10]}) - 1e0) * {bonus})"
    stability = f"greatest(CASE WHEN {s}.phase = 0 THEN {first_s} WHEN {days} < 1 THEN {same_day} WHEN {r} = 1 THEN {lapse} ELSE {success} END, 0.001e0)"
    rint = "rint({})" if spark else "round_even({}, 0)"
    whole = rint.format(f"({stability}) / {FACTOR!r}e0 * {RETENTION ** (1 / DECAY) - 1!r}e0")
    interval = f"CAST(least(greatest({whole}, 1e0), {LONGEST}e0) AS BIGINT) * 86400"
    steps = f"CASE WHEN {s}.phase = 3 THEN {len(RELEARNING)} ELSE {len(LEARNING)} END"
    graduates = f"({s}.phase = 2 AND {r} > 1) OR ({s}.phase <> 2 AND ({r} = 4 OR ({r} > 1 AND {s}.step >= {steps}) OR ({r} = 3 AND {s}.step + 1 >= {steps})))"
    current = f"CASE WHEN {s}.phase = 3 THEN {RELEARNING[0]} WHEN {s}.step = 0 THEN {LEARNING[0]} ELSE {LEARNING[1]} END"
    hard = f"CASE WHEN {s}.phase = 3 THEN {RELEARNING[0] * 3 // 2} WHEN {s}.step = 0 THEN {sum(LEARNING[:2]) // 2} ELSE {current} END"
    delay = f"CASE WHEN {graduates} THEN {interval} WHEN {r} = 1 THEN CASE WHEN {s}.phase IN (2, 3) THEN {RELEARNING[0]} ELSE {LEARNING[0]} END WHEN {r} = 2 THEN {hard} ELSE {LEARNING[1]} END"
    phase = f"CASE WHEN {graduates} THEN 2 WHEN {s}.phase IN (2, 3) THEN 3 ELSE 1 END"
    step = f"CASE WHEN {graduates} OR {r} = 1 THEN 0 WHEN {r} = 3 THEN {s}.step + 1 ELSE {s}.step END"
    return state_sql(phase, step, stability, d, f"{t} + {delay}", t, spark)


def state_sql(phase: str, step: str, s: str, d: str, due: str, last: str, spark: bool) -> str:
    parts = [("phase", phase, "BIGINT"), ("step", step, "BIGINT"), ("s", s, "DOUBLE"), ("d", d, "DOUBLE"), ("due", due, "BIGINT"),
         ("last", last, "BIGINT")]
    if spark:
        return "named_struct(" + ", ".join(f"'{k}', CAST({v} AS {t})" for k, v, t in parts) + ")"
    return "{" + ", ".join(f"'{k}': CAST({v} AS {t})" for k, v, t in parts) + "}"


NEW = ("0", "0", "0", "0", "0", "0")


def fold_sql(answers: str, spark: bool) -> str:
    """The state after all of `answers`, an ordered array of structs (last: seconds, uid, rating) for Spark, and of states
    whose phase is the rating and last the time elsewhere, where accumulator and elements must have one type."""
    if spark:
        return f"aggregate({answers}, {state_sql(*NEW, True)}, (s, x) -> {step_sql('s', 'x.rating', 'x.last', True)})"
    return f"list_reduce({answers}, lambda s, x: {step_sql('s', 'x.phase', 'x.last', False)}, {state_sql(*NEW, False)})"


def states(reviews: DataFrame) -> DataFrame:
    """(headword, x: the state after all answers, n: how many) for each headword of reviews (uid, headword, rating,
    reviewed_at). Rows of one uid count once. A headword's log is one learner's answers to one word, which is what bounds
    the array; ties in time go by uid. Ratings outside 1..4 and rows without a time are passed over."""
    seconds = F.unix_micros(F.col("reviewed_at").cast("timestamp")).cast("long")
    valid = reviews.filter("rating between 1 and 4 and reviewed_at is not null and headword is not null").dropDuplicates(["uid"])
    logs = valid.groupBy("headword").agg(F.array_sort(F.collect_list(F.struct(F.floor(seconds / 1_000_000).alias("last"), "uid",
         "rating"))).alias("log"))
    return logs.select("headword", F.expr(fold_sql("log", True)).alias("x"), F.size("log").cast("long").alias("n"))


def replay(reviews: DataFrame) -> DataFrame:
    """(headword, phase, step, stability, difficulty, due, last, n) for each headword: `states` spelled out."""
    return states(reviews).select("headword", "x.phase", "x.step", F.round("x.s", 5).alias("stability"), F.round("x.d",
        5).alias("difficulty"), "x.due", "x.last", "n")


def step(state: tuple, rating: int, t: int) -> tuple:
    """The state (phase, step, s, d, due, last) after one answer, for streams, which fold a few answers at a time."""
    phase, at, s, d, _, last = state
    difficulty = lambda r: W[4] - math.exp(W[5] * (r - 1)) + 1
    if phase == 0:
        s2, d2 = W[rating - 1], difficulty(rating)
    else:
        days = max(t - last, 0) // 86400
        forgotten = 1 - (1 + FACTOR * days / s) ** DECAY
        d2 = W[7] * difficulty(4) + (1 - W[7]) * (d + (10 - d) * -W[6] * (rating - 3) / 9)
        if days < 1:
            growth = math.exp(W[17] * (rating - 3 + W[18])) * s ** -W[19]
            s2 = s * (max(growth, 1) if rating > 1 else growth)
        elif rating == 1:
            s2 = min(W[11] * d ** -W[12] * ((s + 1) ** W[13] - 1) * math.exp(forgotten * W[14]), s / math.exp(W[17] * W[18]))
        else:
            bonus = {2: W[15], 4: W[16]}.get(rating, 1)
            s2 = s * (1 + math.exp(W[8]) * (11 - d) * s ** -W[9] * math.expm1(forgotten * W[10]) * bonus)
    s2, d2 = max(s2, 0.001), min(max(d2, 1.0), 10.0)
    steps, learning = (RELEARNING, 3) if phase in (2, 3) else (LEARNING, 1)
    if phase == 2 and rating > 1 or phase != 2 and (rating == 4 or rating > 1 and at + (rating == 3) >= len(steps)):
        days = min(max(round(s2 / FACTOR * (RETENTION ** (1 / DECAY) - 1)), 1), LONGEST)
        return 2, 0, s2, d2, t + days * 86400, t
    if rating == 1:
        return learning, 0, s2, d2, t + steps[0], t
    if rating == 3:
        return learning, at + 1, s2, d2, t + steps[at + 1], t
    hard = steps[at] if at else sum(steps[:2]) // 2 if len(steps) > 1 else steps[0] * 3 // 2
    return learning, at, s2, d2, t + hard, t


def preview_sql(state: str, now: str, spark: bool) -> list[str]:
    """Seconds until a card of a state is due again after each rating, 1 to 4, at `now`."""
    return [f"({step_sql(state, str(r), now, spark)}).due - {now}" for r in range(1, 5)]
