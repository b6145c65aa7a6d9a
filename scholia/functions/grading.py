"""Grading and review scheduling as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholia.functions.numbers import add_days, days_between, round_away
from scholia.functions.tables import AGAIN_DAYS, LADDER, MASTERY_STEP, PRIORITY
from scholia.functions.text import grading as norm


def is_correct(kind: Column, correct: Column, given: Column) -> Column:
    """Choices and true/false: equal as multisets. Blanks: the first answer equals any accepted one. Other types need
    a person, so they are wrong. No answer is wrong."""
    a, b = F.transform(correct, norm), F.transform(given, norm)
    choice = F.sort_array(a) == F.sort_array(b)
    blank = F.array_contains(a, F.get(b, F.lit(0)))
    right = F.when(kind.isin("single_choice", "multiple_choice", "true_false"), choice).when(kind == "fill_blank", blank).otherwise(F.lit(False))
    return F.coalesce((F.size(given) > 0) & right, F.lit(False))


def score(kind: Column, correct: Column, given: Column) -> Column:
    return is_correct(kind, correct, given).cast("double")


def review(wrong: Column, correct: Column, reviews: Column, mastery: Column, difficulty: Column, last_review: Column, result: Column, as_of: Column) -> Column:
    """struct(interval_days, mastery, priority, next_review_at, status) after a review at `as_of`."""
    step = F.element_at(F.array(*(F.lit(x) for x in LADDER)), (F.least(reviews, F.lit(len(LADDER) - 1)) + 1).cast("int"))
    interval = F.when(result == "again", F.lit(AGAIN_DAYS)).when(result == "hard", F.greatest(F.lit(0.5), step * 0.5)).when(result == "easy", step * 2).otherwise(step)
    add = F.coalesce(F.create_map(*(F.lit(x) for kv in MASTERY_STEP.items() for x in kv))[result], F.lit(0.0))
    moved = F.greatest(F.lit(0.0), F.least(F.lit(100.0), mastery + add))
    moved = F.when(add == 0, mastery).otherwise(moved)
    moved = F.when(wrong > 1, F.greatest(F.lit(0.0), moved - (wrong - 1) * 3)).otherwise(moved)
    overdue = F.coalesce(days_between(last_review, as_of), F.lit(0.0))
    rank = (
        PRIORITY["wrong"] * F.least(F.lit(1.0), wrong / 10)
        + PRIORITY["overdue"] * F.least(F.lit(1.0), overdue / 7)
        + PRIORITY["difficulty"] * (difficulty - 1) / 4
        + PRIORITY["forgetting"] * (1 - F.least(F.lit(1.0), correct / 3))
        - PRIORITY["mastery"] * mastery / 100
    )
    status = F.when(result == "again", "learning").when((moved >= 80) & (reviews >= 2), "mastered").when(reviews > 0, "reviewing").otherwise("learning")
    return F.struct(
        interval.alias("interval_days"),
        round_away(moved, 1).alias("mastery"),
        round_away(F.greatest(F.lit(0.0), rank), 2).alias("priority"),
        add_days(as_of, interval).alias("next_review_at"),
        status.alias("status"),
    )
