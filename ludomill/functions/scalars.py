"""Column expressions for the scalar rules of the game pipeline.

"Unknown" has four spellings in the data: the empty string, zero, the empty
list and null.  The ``first_*`` functions skip all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NEUTRAL_RATING = 5.0


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def no_texts() -> Column:
    return F.expr("cast(array() as array<string>)")


def first_text(*values: Column | str) -> Column:
    """First text that is neither null nor empty, else the empty text."""
    return F.coalesce(*[F.nullif(_col(v), F.lit("")) for v in values], F.lit(""))


def first_positive(*values: Column | str) -> Column:
    """First number above zero, else 0.0.  NaN counts as unknown, although Spark sorts it highest."""
    numbers = [_col(v).cast("double") for v in values]
    return F.coalesce(*[F.when((n > 0) & ~F.isnan(n), n) for n in numbers], F.lit(0.0))


def first_list(*values: Column | str) -> Column:
    """First list with at least one element, else the empty list."""
    return F.coalesce(*[F.when(F.size(_col(v)) > 0, _col(v)) for v in values], no_texts())


def bag_concat(*values: Column | str) -> Column:
    """All lists joined end to end; repeats, nulls inside and empty texts stay, null lists are skipped."""
    return F.flatten(F.array(*[F.coalesce(_col(v), no_texts()) for v in values]))


def per_scale(value: Column | str, top: float) -> Column:
    """A rating on a 0..top scale as 0..1; unknown is 0.0."""
    return F.coalesce(_col(value).cast("double") / F.lit(float(top)), F.lit(0.0))


def score_ratio(score: Column | str, top: Column | str) -> Column:
    """score / top with a missing score as 0 and a missing top as 1; a zero top gives 0.0."""
    part = F.coalesce(_col(score).cast("double"), F.lit(0.0))
    whole = F.coalesce(_col(top).cast("double"), F.lit(1.0))
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def iso_from_datetime(value: Column | str) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` as ``yyyy-MM-dd``; anything unreadable is the empty text."""
    stamp = F.try_to_timestamp(_col(value), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.coalesce(F.date_format(stamp, "yyyy-MM-dd"), F.lit(""))


def iso_from_year(value: Column | str) -> Column:
    """A release year after 1920 as its first of January, else the empty text."""
    year = _col(value).cast("int")
    return F.when(year > 1920, F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-01-01"))).otherwise("")


def iso_from_epoch(value: Column | str) -> Column:
    """Seconds since the epoch as a UTC day; a missing value is the empty text."""
    day = F.date_from_unix_date(F.floor(_col(value).cast("long") / F.lit(86400)).cast("int"))
    return F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit(""))


def release_year(value: Column | str) -> Column:
    """Year of an ISO day, null when empty or malformed."""
    return F.year(F.try_to_date(_col(value), "yyyy-M-d"))


def close_release(left: Column | str, right: Column | str) -> Column:
    """True when both days are known and at most one calendar year apart."""
    return F.coalesce(F.abs(release_year(left) - release_year(right)) <= 1, F.lit(False))


def pluck(items: Column | str, *path: str) -> Column:
    """The field at ``path`` of every struct in a list; a missing list is empty."""

    def step(item: Column) -> Column:
        for name in path:
            item = item[name]
        return item

    return F.coalesce(F.transform(_col(items), step), no_texts())


def pluck_present(items: Column | str, outer: str, inner: str) -> Column:
    """``outer.inner`` of every struct whose ``outer`` is there."""
    return pluck(F.filter(_col(items), lambda item: item[outer].isNotNull()), outer, inner)


def pluck_role(items: Column | str, role_field: str, role: str, name: str) -> Column:
    """Names of the structs that play ``role``."""
    return pluck(F.filter(_col(items), lambda item: item[role_field] == role), name)


def keyword_bag(
    rawg_tags: Column,
    igdb_keywords: Column,
    themes: Column,
    game_modes: Column,
    perspectives: Column,
    esrb: Column,
    other_themes: Column,
) -> Column:
    """Every keyword-like list in its fixed order; an absent age rating adds an empty text."""
    age = F.array(F.coalesce(esrb, F.lit("")))
    return bag_concat(rawg_tags, igdb_keywords, themes, game_modes, perspectives, age, other_themes)


def scaled_reward(rating: Column | str) -> Column:
    """Rating 0..10 as reward -1..1, neutral at 5."""
    return (_col(rating).cast("double") - NEUTRAL_RATING) / NEUTRAL_RATING


def ternary_reward(rating: Column | str) -> Column:
    """1 liked, 0 neutral, -1 disliked."""
    return F.signum(_col(rating).cast("double") - NEUTRAL_RATING)


def playtime_reward(base: Column, played: Column, story: Column, weight: float) -> Column:
    """Base reward plus a saturating bonus for hours played, only on liked games."""
    bonus = F.lit(float(weight)) * F.tanh(F.try_divide(played.cast("double"), story.cast("double")))
    return base + F.when(base > 0, F.coalesce(bonus, F.lit(0.0))).otherwise(0.0)


def saturating_hours(hours: Column | str, scale: float = 50.0) -> Column:
    """tanh(hours / scale): near linear for short games, flat for endless ones."""
    return F.tanh(_col(hours).cast("double") / F.lit(scale))


def multi_hot(labels: Column | str, vocabulary: Sequence[str]) -> Column:
    """0/1 vector over ``vocabulary`` in its given order."""
    known = F.coalesce(_col(labels), no_texts())
    return F.array(*[F.array_contains(known, F.lit(term)).cast("double") for term in vocabulary]).cast("array<double>")


def one_hot(label: Column | str, vocabulary: Sequence[str]) -> Column:
    """0/1 vector with at most one 1; unseen labels give all zeros."""
    hits = [F.coalesce((_col(label) == F.lit(term)).cast("double"), F.lit(0.0)) for term in vocabulary]
    return F.array(*hits).cast("array<double>")


def as_floats(vector: Column | str) -> Column:
    return _col(vector).cast("array<float>")
