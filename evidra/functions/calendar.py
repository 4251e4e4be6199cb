"""Agricultural years and seasons, event windows and their overlap with periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Months of each season; the agricultural year begins with the first of them. Dry months.
SEASONS = {"kharif": (6, 7, 8, 9), "rabi": (10, 11, 12, 1, 2), "summer": (3, 4, 5)}
DRY = (3, 4, 5, 6, 7, 8, 9)


def ag_year(day: Column) -> Column:
    """The year in which the agricultural year of a day began (June)."""
    return F.year(F.add_months(day, 1 - SEASONS["kharif"][0]))


def season(day: Column) -> Column:
    """kharif: June to September, rabi: October to February, summer: March to May."""
    month = F.month(day)
    return F.coalesce(*[F.when(month.isin(*months), F.lit(name)) for name, months in SEASONS.items()])


def season_window(year: Column, name: Column) -> Column:
    """struct(start, end): first and last day of a season, or of the whole agricultural year for any other name."""
    month = lambda y, m: F.make_date(y, F.lit(m), F.lit(1))
    first = F.when(name == "rabi", month(year, 10)).when(name == "summer", month(year + 1, 3)).otherwise(month(year, 6))
    last = F.when(name == "kharif", month(year, 9)).when(name == "rabi", month(year + 1, 2)).otherwise(month(year + 1, 5))
    return F.struct(first.alias("start"), F.last_day(last).alias("end"))


def season_end(year: Column, name: Column) -> Column:
    """Last day of a season."""
    return season_window(year, name)["end"]


def overlap_days(a: Column, b: Column, start: Column, end: Column) -> Column:
    """Days of [a, b] that lie in [start, end)."""
    return F.greatest(F.datediff(F.least(b, F.date_sub(end, 1)), F.greatest(a, start)) + 1, F.lit(0))


def event_windows(notice: Column, award: Column, possession: Column, today: Column) -> Column:
    """Dates out of order are an error. array of (name, start, end): the year before the notice, pending, after award, after possession; ends are exclusive."""
    one = lambda name, a, b: F.struct(F.lit(name).alias("name"), a.alias("start"), b.alias("end"))
    wrong = (award < notice) | (possession < award) | (possession < notice)
    notice = F.when(F.coalesce(wrong, F.lit(False)), F.raise_error(F.lit("event dates are out of order")).cast("date")).otherwise(notice)
    return F.array(one("pre", F.add_months(notice, -12), notice), one("pending", notice, award), one("post_award", award, possession), one("post_possession", possession, F.date_add(today, 1)))


def majority_window(a: Column, b: Column, windows: Column) -> Column:
    """Name of the window that holds more than half of the days of [a, b], or null."""
    scored = F.transform(windows, lambda w: F.struct(overlap_days(a, b, w["start"], w["end"]).alias("k"), w["name"].alias("name")))
    held = F.filter(scored, lambda s: s["k"] * 2 > F.datediff(b, a) + 1)
    return F.when(F.size(held) > 0, F.element_at(held, 1)["name"])
