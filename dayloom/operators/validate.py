"""Row validation: each rule that a row breaks is named in ``violations``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CATEGORIES = ("need_to_do", "want_to_do", "reading_list")
COLORS = ("blue", "orange", "violet", "rose", "emerald")
UUID = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"


def violations(rules: dict[str, Column]) -> Column:
    """The names of the rules that don't hold; a rule that is null doesn't hold."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


def required(*names: str) -> dict[str, Column]:
    return {f"{n} is required": F.coalesce(F.btrim(F.col(n).cast("string")), F.lit("")) != "" for n in names}


def reminder_rules() -> dict[str, Column]:
    return {**required("title"), "energy_scale is from 1 to 10": F.col("energy_scale").between(1, 10), "category is known": F.col("category").isNull() | F.col("category").isin(*CATEGORIES)}


def event_rules(colors=COLORS, owner: str | None = None) -> dict[str, Column]:
    """Rules of a calendar event; ``owner`` names a column that must hold a UUID."""
    start, end = F.col("start"), F.col("end")
    return {
        **required("id", "title"),
        "start is a time": start.isNotNull(),
        "end is a time": end.isNotNull(),
        "end is not before start": end >= start,
        "color is known": F.col("color").isNull() | F.col("color").isin(*colors),
        **({f"{owner} is a UUID": F.col(owner).cast("string").rlike(UUID)} if owner else {}),
    }


def within_hours(lo: int = 0, hi: int = 24) -> dict[str, Column]:
    """Both ends' hours within bounds; the default ones hold any time of day."""
    return {f"hours are from {lo} to {hi}": (F.hour("start") >= lo) & (F.hour("start") <= hi) & (F.hour("end") >= lo) & (F.hour("end") <= hi)}


def post_rules() -> dict[str, Column]:
    """The eight fields that a post must have."""
    some = {"at least one tag is required": F.size(F.coalesce(F.col("tags"), F.array().cast("array<string>"))) > 0}
    return {**required("title", "slug", "excerpt", "meta_description", "published_at", "author_id"), **some, **required("featured_image")}


def check(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    return df.withColumn("violations", violations(rules))


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """The rows that pass, and the rejects with what they broke."""
    c = check(df, rules)
    return c.filter(F.size("violations") == 0).drop("violations"), c.filter(F.size("violations") > 0)


def missing_settings(settings: dict[str, str | None]) -> Column:
    """The names of unset settings."""
    return F.array_compact(F.array(*[F.lit(None if v else k).cast("string") for k, v in settings.items()]))


def unset(settings, names) -> Column:
    """Of a map of settings, the names that are missing, null or blank, in the order asked."""
    value = lambda n: F.btrim(F.coalesce(F.try_element_at(settings, F.lit(n)), F.lit("")))
    return F.array_compact(F.array(*[F.when(value(n) == "", F.lit(n)) for n in names]))
