"""Spaced repetition: schedules folded from a review log, and the due queue.

A card's reviews are folded in time order inside one native ``aggregate`` with
a struct accumulator; nothing leaves the JVM. Cards are independent, so the
only shuffle groups the log by card.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AGAIN, HARD, GOOD, EASY = 1, 2, 3, 4
#: The published default weights of the memory model.
WEIGHTS = (0.4072, 1.1829, 3.1262, 15.4722, 7.2102, 0.5316, 1.0651, 0.0234, 1.616, 0.1544, 1.0824, 1.9813, 0.0953, 0.2975, 2.2042, 0.2407, 2.9466, 0.5034, 0.6567)
RETENTION = 0.9
#: Fixed values of the forgetting curve and the longest interval.
DECAY, FACTOR, LONGEST = -0.5, 19.0 / 81.0, 36500
#: The older rule has no longest interval; what passes an int, or the last date there is, stays there.
LAST_INTERVAL, LAST_DAY = (1 << 31) - 1, (1 << 31) - 2
STATE = "struct<stability:double,difficulty:double,interval:int,reps:int,lapses:int,last_review:date,next_review:date,ease:double>"


def retrievability(elapsed: Column, stability: Column) -> Column:
    """Probability of recall after ``elapsed`` days; 0 without stability."""
    days = F.greatest(elapsed.cast("double"), F.lit(0.0))
    return F.when(stability > 0, F.pow(F.lit(1.0) + F.lit(FACTOR) * days / stability, F.lit(DECAY))).otherwise(F.lit(0.0))


def next_interval(stability: Column, retention: float = RETENTION) -> Column:
    """Days until recall falls to ``retention``."""
    ideal = stability / F.lit(FACTOR) * F.lit(retention ** (1 / DECAY) - 1.0)
    return F.when(stability > 0, F.least(F.greatest(F.rint(ideal), F.lit(1.0)), F.lit(float(LONGEST))).cast("int")).otherwise(F.lit(0))


def retention_estimate(state: Column, today: Column) -> Column:
    """Recall probability of a card's state today; 0 for new cards."""
    known = ~is_new(state) & state["last_review"].isNotNull()
    return F.when(known, F.bround(retrievability(F.datediff(today, state["last_review"]), state["stability"]), 4)).otherwise(F.lit(0.0))


def is_new(state: Column) -> Column:
    return state.isNull() | (F.coalesce(state["reps"], F.lit(0)) <= 0) | (F.coalesce(state["stability"], F.lit(0.0)) <= 0)


def is_due(state: Column, today: Column) -> Column:
    """No state or no readable date counts as due."""
    return F.coalesce(state["next_review"].try_cast("date") <= today, F.lit(True))


def reviewable(notes: DataFrame) -> DataFrame:
    """Notes with a front or a back."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    return notes.filter(~(blank("anchor") & blank("note")))


def _bounded(d: Column) -> Column:
    return F.least(F.greatest(d, F.lit(1.0)), F.lit(10.0))


def _first_difficulty(grade: Column | int, w: tuple[float, ...]) -> Column:
    g = F.lit(grade) if isinstance(grade, int) else grade
    return _bounded(F.lit(w[4]) - F.exp(F.lit(w[5]) * (g - 1)) + 1.0)


def review_step(state: Column, day: Column, grade: Column, retention: float = RETENTION, w: tuple[float, ...] = WEIGHTS) -> Column:
    """The state after one review, rounded to four places as it is kept; the interval is that of the kept stability."""
    s, d = state["stability"], state["difficulty"]
    r = retrievability(F.datediff(day, state["last_review"]), s)
    eased = d - F.lit(w[6]) * (grade - 3) * ((F.lit(10.0) - d) / 9.0)
    difficulty = _bounded(F.lit(w[7]) * _first_difficulty(EASY, w) + F.lit(1.0 - w[7]) * eased)
    grown = s * (
        F.exp(F.lit(w[8])) * (F.lit(11.0) - d) * F.pow(s, F.lit(-w[9])) * (F.exp(F.lit(w[10]) * (F.lit(1.0) - r)) - 1.0)
        * F.when(grade == HARD, w[15]).otherwise(1.0) * F.when(grade == EASY, w[16]).otherwise(1.0) + 1.0
    )
    lapsed = F.lit(w[11]) * F.pow(d, F.lit(-w[12])) * (F.pow(s + 1.0, F.lit(w[13])) - 1.0) * F.exp(F.lit(w[14]) * (F.lit(1.0) - r))
    lapsed = F.greatest(F.least(lapsed, s), F.lit(0.1))
    new = (state["reps"] <= 0) | (s <= 0)
    seed = F.greatest(F.element_at(F.array(*map(F.lit, w[:4])), grade), F.lit(0.1))
    stability = F.bround(F.when(new, seed).when(grade == AGAIN, lapsed).otherwise(grown), 4)
    interval = F.when(grade == AGAIN, F.lit(1)).otherwise(next_interval(stability, retention))
    return F.struct(
        stability.alias("stability"),
        F.bround(F.when(new, _first_difficulty(grade, w)).otherwise(difficulty), 4).alias("difficulty"),
        interval.alias("interval"),
        (state["reps"] + 1).alias("reps"),
        (state["lapses"] + (grade == AGAIN).cast("int")).alias("lapses"),
        day.alias("last_review"),
        F.date_add(day, interval).alias("next_review"),
        state["ease"].alias("ease"),
    ).cast(STATE)


def review_step_sm2(state: Column, day: Column, grade: Column) -> Column:
    """One review by the older rule: fixed first intervals, then growth by ease."""
    reps, ease = state["reps"], F.coalesce(state["ease"], F.lit(2.5))
    interval = (
        F.when((grade == AGAIN) | (reps == 0), F.lit(1)).when(reps == 1, F.lit(6)).otherwise(F.least(F.greatest(F.rint(state["interval"] * ease), F.lit(1.0)), F.lit(float(LAST_INTERVAL))).cast("int"))
    )
    ahead = F.least(interval.cast("long"), F.lit(LAST_DAY).cast("long") - F.unix_date(day)).cast("int")
    q = grade + 1  # grades 1 to 4 are qualities 2 to 5
    eased = F.greatest(F.lit(1.3), ease + (F.lit(0.1) - (F.lit(5) - q) * (F.lit(0.08) + (F.lit(5) - q) * 0.02)))
    return F.struct(
        interval.cast("double").alias("stability"),
        F.bround(F.lit(6.0) - (eased - 1.3) / (2.5 - 1.3) * 5.0, 4).alias("difficulty"),
        interval.alias("interval"),
        (reps + 1).alias("reps"),
        (state["lapses"] + (grade == AGAIN).cast("int")).alias("lapses"),
        day.alias("last_review"),
        F.date_add(day, ahead).alias("next_review"),
        F.bround(eased, 4).alias("ease"),
    ).cast(STATE)


def new_state() -> Column:
    return F.struct(F.lit(0.0), F.lit(0.0), F.lit(0), F.lit(0), F.lit(0), F.lit(None).cast("date"), F.lit(None).cast("date"), F.lit(2.5)).cast(STATE)


def schedule_reviews(log: DataFrame, *, card: str = "card_id", day: str = "day", order: str = "event_id", grade: str = "grade", rule: str = "fsrs", retention: float = RETENTION) -> DataFrame:
    """Each card's state after all its reviews: (card, ``state``)."""
    step = review_step_sm2 if rule == "sm2" else lambda a, d, g: review_step(a, d, g, retention)
    reviews = F.array_sort(F.collect_list(F.struct(F.col(day).cast("date").alias("day"), F.col(order).alias("o"), F.col(grade).cast("int").alias("g"))))
    folded = F.aggregate("reviews", new_state(), lambda a, r: step(a, r["day"], r["g"]))
    return log.groupBy(card).agg(reviews.alias("reviews")).select(card, folded.alias("state"))


def due_queue(cards: DataFrame, today: str, *, doc: str = "doc", key: str = "id") -> DataFrame:
    """Due cards, most overdue first; cards without a date count as due today."""
    t = F.lit(today).cast("date")
    days = F.coalesce(F.datediff(F.col("state")["next_review"].try_cast("date"), t), F.lit(0))
    return cards.filter(is_due(F.col("state"), t)).withColumn("days_until_due", days).orderBy("days_until_due", doc, key)


def review_summary(cards: DataFrame, today: str) -> DataFrame:
    """One row: total, due, new and reviewed cards and their mean retention."""
    t, s = F.lit(today).cast("date"), F.col("state")
    return cards.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(is_due(s, t)).alias("due"),
        F.count_if(is_new(s)).alias("new"),
        F.count_if(~is_new(s)).alias("reviewed"),
        F.coalesce(F.bround(F.avg(F.when(~is_new(s), retention_estimate(s, t))), 4), F.lit(0.0)).alias("retention"),
    )


def apply_external_schedule(cards: DataFrame, exported: DataFrame, prefix: str = "card") -> DataFrame:
    """Cards whose id stands in an exported card's tags (``prefix::id``) take its schedule."""
    tag = F.get(F.filter("tags", lambda x: F.startswith(x, F.lit(prefix + "::"))), 0)
    found = exported.withColumn("_id", F.substring(tag, len(prefix) + 3, 1 << 20)).filter("_id is not null")
    found = found.groupBy("_id").agg(F.max_by(F.struct("interval", "factor", "reps", "lapses"), "reps").alias("_new"))
    s, n = F.col("state"), F.col("_new")
    updated = F.struct(
        n["interval"].cast("double").alias("stability"), s["difficulty"].alias("difficulty"), n["interval"].alias("interval"), n["reps"].alias("reps"), n["lapses"].alias("lapses"),
        s["last_review"].alias("last_review"), F.date_add(s["last_review"], n["interval"]).alias("next_review"), (n["factor"] / 1000.0).alias("ease"),
    ).cast(STATE)
    return cards.join(found, cards["id"].cast("string") == F.col("_id"), "left").withColumn("state", F.when(n.isNotNull(), updated).otherwise(s)).select(*cards.columns)
