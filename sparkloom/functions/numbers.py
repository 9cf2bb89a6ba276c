"""Number, date and bucket expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import BLANKS, bound, clean

UNITS = "%wW万亿kK"
# to the very end: `$` would let a line end follow
NUMBER = rf"^[+-]?(?:[0-9]++\.?[0-9]*+|\.[0-9]++)[{UNITS}]?\z"
DAY = r"^[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}\z"
TWO_DIGITS = [f"{n:02d}" for n in range(60)]
ALLOWED_SCORES = (0.0, 0.25, 0.5, 0.75, 1.0)


def _single(t: Column) -> Column:
    """One number with an optional percent sign or unit suffix, of text without blanks; null if it is none."""

    def value(unit: Column) -> Column:
        stem = F.substring(t, F.lit(1), F.length(t) - 1).cast("double")
        # divide for percent, so that 12.5% is exactly 12.5 / 100
        return F.when(unit == "%", stem / 100).when(unit.isin("w", "W", "万"), stem * 1e4).when(unit == "亿", stem * 1e8).when(unit.isin("k", "K"), stem * 1e3).otherwise(t.cast("double"))

    return F.when(t.rlike(NUMBER), bound(F.substring(t, -1, 1), value))


def parse_number(c: Column) -> Column:
    """Permissive: commas dropped, missing tokens null, a~b the mean of its parsable parts, % and unit suffixes."""

    def mean(parts: Column) -> Column:
        return F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / F.size(parts))

    def number(t: Column) -> Column:
        return F.when(t.contains("~"), bound(F.filter(F.transform(F.split(t, "~"), _single), lambda x: x.isNotNull()), mean)).otherwise(_single(t))

    # most numbers have neither commas nor blanks, and text without a digit is none; no missing token looks like a number
    spaced = lambda t: F.when(t.rlike("[0-9]"), bound(F.translate(t, ",，" + BLANKS, ""), number))
    return bound(c.cast("string"), lambda t: F.coalesce(_single(t), spaced(t)))


def ratio(a: Column, b: Column, empty: float | None = None) -> Column:
    out = F.try_divide(a, b)
    return out if empty is None else F.coalesce(out, F.lit(empty))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(x, F.lit(high)))


def log1p_or_zero(x: Column) -> Column:
    return F.when(x.isNull() | (x <= -1), F.lit(0.0)).otherwise(F.log1p(x))


def robust_scale(x: Column, p5: Column, p95: Column) -> Column:
    """(x - p5) / (p95 - p5) within [0, 1]; null or degenerate gives 0."""
    return F.when(x.isNull() | (p95 <= p5), F.lit(0.0)).otherwise(F.coalesce(clamp(F.try_divide(x - p5, p95 - p5)), F.lit(0.0)))


def duration_bucket(x: Column) -> Column:
    return F.when(x.isNull(), "unknown").when(x <= 30, "<=30").when(x <= 60, "<=60").when(x <= 120, "<=120").otherwise(">120")


def tertile_band(x: Column, low: Column, high: Column) -> Column:
    return F.when(x.isNull(), "unknown").when(x <= low, "low").when(x <= high, "medium").otherwise("high")


def rate_band(x: Column, q25: Column, q75: Column) -> Column:
    return F.when(x.isNull(), "unknown").when(x <= q25, "slow").when(x >= q75, "fast").otherwise("medium")


def quartile_label(x: Column, cuts: list[Column], labels: tuple[str, str, str, str]) -> Column:
    return F.when(x.isNull() | cuts[0].isNull(), "unknown").when(x <= cuts[0], labels[0]).when(x <= cuts[1], labels[1]).when(x <= cuts[2], labels[2]).otherwise(labels[3])


def _dated(t: Column, sign: str) -> Column:
    """A date with this sign between its parts, else null. Only text of that shape is parsed: a failed parse costs an exception for each row."""
    return F.when(t.rlike(rf"{re.escape(sign)}[0-9]{{2}}{re.escape(sign)}[0-9]{{2}}$"), F.try_to_date(t, sign.join(("yyyy", "MM", "dd"))))


def _plain_day(t: Column) -> Column:
    """yyyy-MM-dd of a date with a year of four digits and one sign between its parts, else null; a cast takes a tenth of a formatter's time."""
    dashed = F.concat(F.substring(t, 1, 4), F.lit("-"), F.substring(t, 6, 2), F.lit("-"), F.substring(t, 9, 2))
    return F.when(t.rlike(DAY) & dashed.try_cast("date").isNotNull(), dashed)


def iso_week(c: Column) -> Column:
    """First ten characters as a date to YYYY-Www, else unknown."""

    def week(day: Column) -> Column:
        year, n = F.extract(F.lit("YEAROFWEEK"), day), F.weekofyear(day)
        plain = F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-W"), F.lpad(n.cast("string"), 2, "0"))
        return F.when(day.isNull(), "unknown").when(year < 0, F.format_string("%04d-W%02d", year, n)).otherwise(plain)

    # ten characters with two dashes leave four for the year
    dated = lambda t: F.when(t.rlike(DAY) & t.contains("-"), t.try_cast("date"))
    return bound(bound(F.substring(c.cast("string"), 1, 10), dated), week)


def parse_date(c: Column) -> Column:
    """Spreadsheet serials count from 1899-12-30; four written forms; other text stays."""

    def written(t: Column) -> Column:
        plain = F.when(t.rlike(r"^[+-]?[0-9]{8,}$"), F.try_to_date(t, "yyyyMMdd"))
        return F.coalesce(F.coalesce(*[_dated(t, sign) for sign in "-/."], plain).cast("string"), t)

    counted = lambda n: F.when(n.isNotNull(), F.date_add(F.lit("1899-12-30").cast("date"), n.cast("int")).cast("string"))
    # no plain day is a number
    quick = lambda t: F.coalesce(_plain_day(t), bound(parse_number(t), counted))
    return F.coalesce(bound(c.cast("string"), quick), bound(clean(c), written))


def parse_time(c: Column) -> Column:
    """Day fractions to H:MM:SS (24:00 wraps), written times normalised, else empty."""

    def clock(seconds: Column) -> Column:
        two = lambda n: F.get(F.array(*[F.lit(x) for x in TWO_DIGITS]), n.cast("int"))
        return F.concat_ws(":", two(seconds / 3600), two(seconds % 3600 / 60), two(seconds % 60))

    def counted(fraction: Column) -> Column:
        seconds = F.pmod(F.round((fraction - F.floor(fraction)) * 86_400).cast("bigint"), F.lit(86_400))
        return F.when(fraction.isNotNull(), bound(seconds, clock))

    written = lambda t: F.when(t.rlike(r"^\d{1,2}:\d{2}:\d{2}$"), t).when(t.rlike(r"^\d{1,2}:\d{2}$"), F.concat(t, F.lit(":00")))
    # no written time is a number
    return F.coalesce(bound(parse_number(c), counted), bound(clean(c), written), F.lit(""))


def confidence(c: Column) -> Column:
    """A label or a number; percentages are scaled; out of range is 0."""
    named = lambda label: F.when(label == "high", 0.9).when(label == "medium", 0.7).when(label == "low", 0.5)
    scaled = lambda x: F.when((x > 1) & (x <= 100), x / 100).otherwise(x)
    within = lambda x: F.when(x.between(0, 1), x).otherwise(0.0)
    return bound(bound(F.coalesce(bound(F.lower(clean(c)), named), parse_number(c)), scaled), within)


def allowed_score(x: Column) -> Column:
    """The allowed score within 1e-9, else null."""
    return F.coalesce(*[F.when(F.abs(x - a) < 1e-9, F.lit(a)) for a in ALLOWED_SCORES])


def judge_score(correctness: Column, grounding: Column, completeness: Column) -> Column:
    """Weighted sum snapped to the nearest allowed score (ties go down), capped by the weaker of the first two."""
    raw = 0.4 * correctness + 0.4 * grounding + 0.2 * completeness
    snapped = F.array_min(F.array(*[F.struct(F.round(F.abs(raw - a), 9).alias("d"), F.lit(a).alias("a")) for a in ALLOWED_SCORES]))["a"]
    weakest = F.least(correctness, grounding)
    return F.when(weakest == 0, F.least(snapped, F.lit(0.25))).when(weakest == 0.25, F.least(snapped, F.lit(0.5))).otherwise(snapped)


def number_token(x: Column) -> Column:
    return F.when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def frame_grid(duration: Column, total: int = 16, hook_s: float = 3.0, hook: int = 3) -> Column:
    """Midpoints of `hook` parts of the first seconds, then of the rest; at most the end less 0.1 s; rounded."""
    t = F.greatest(duration, F.lit(0.0))
    head = F.least(F.lit(hook_s), t)
    first = F.transform(F.sequence(F.lit(0), F.lit(hook - 1)), lambda i: F.round((i + 0.5) * head / hook, 2))
    rest = F.transform(F.sequence(F.lit(0), F.lit(total - hook - 1)), lambda i: F.round(F.least(head + (i + 0.5) * (t - head) / (total - hook), t - 0.1), 2))
    return F.when(t <= 0, F.array(F.lit(0.0))).when(t <= head, first).otherwise(F.concat(first, rest))
