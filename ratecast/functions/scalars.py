"""Scalar column functions (survey F1-F25, P12).

All of these build JVM-side Catalyst expressions; none is a Python UDF,
so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the source project's for the same results)
# ---------------------------------------------------------------------------
# Weekday names, Sunday first.
WEEKDAYS_HE = ["ראשון", "שני", "שלישי", "רביעי", "חמישי", "שישי", "שבת"]
# Daypart labels, in order: morning 06-09, noon 10-13, afternoon 14-17,
# prime time 18-21, night 22-01, late night 02-05.
DAYPART_LABELS = [
    "1. בוקר 06–09",
    "2. צהריים 10–13",
    '3. אחה"צ 14–17',
    "4. פריים-טיים 18–21",
    "5. לילה 22–01",
    "6. לילה מאוחר 02–05",
]
# Status rules, highest precedence first: (substrings, label); fallback label last.
STATUS_RULES_HE = [
    (["מיוחד", "מבזק"], "מיוחד/מבזק"),
    (["לקט"], "לקט"),
    (["חג"], "חג"),
    (["ש.ח"], "שידור חוזר"),
]
STATUS_DEFAULT_HE = "שידור חי"
RERUN_PATTERN = r"ש\.ח|לקט"
RERUN_SUFFIX = r"\s*ש\.ח\s*$"
# Reception ramp: 0.65 at 2025-05 rising to 0.90 at 2026-04; caps 0.90 / 0.95.
RECEPTION_START = "2025-05-01"
RECEPTION_END_MONTH = "2026-04-01"
RECEPTION_END_DAY = "2026-04-30"
RECEPTION_START_PCT = 0.65
RECEPTION_END_PCT = 0.90
RECEPTION_CAP = 0.95
# Viewer conversion: households per rating point, viewers per household.
HH_PER_POINT = 25000
VIEWERS_PER_HH = 2.3
DEFAULT_HOUR = 20
DEFAULT_DURATION_MIN = 130
NO_TAG = "—"
# ---------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# F1 ------------------------------------------------------------------------
_HMS = r"^\s*(\d+):(\d{1,2}):(\d{1,2}(?:\.\d+)?)\s*$"


def hms_to_minutes(c) -> Column:
    """``HH:MM:SS`` text to minutes as double; hours above 23 allowed,
    anything malformed becomes null."""
    s = _c(c).cast("string")
    ok = s.rlike(_HMS)
    h = F.regexp_extract(s, _HMS, 1).try_cast("double")
    m = F.regexp_extract(s, _HMS, 2).try_cast("double")
    sec = F.regexp_extract(s, _HMS, 3).try_cast("double")
    return F.when(ok, h * 60 + m + sec / 60)


# F2 ------------------------------------------------------------------------
def time_of_day(c) -> Column:
    """``HH:MM:SS`` text to a time-of-day string with the hour taken mod 24."""
    s = _c(c).cast("string")
    ok = s.rlike(_HMS)
    h = F.regexp_extract(s, _HMS, 1).try_cast("int") % 24
    m = F.regexp_extract(s, _HMS, 2).try_cast("int")
    sec = F.floor(F.regexp_extract(s, _HMS, 3).try_cast("double")).cast("int")
    return F.when(ok, F.format_string("%02d:%02d:%02d", h, m, sec))


# T6-T8 ---------------------------------------------------------------------
def hour_of(c, variant: str = "floor", default: int = DEFAULT_HOUR) -> Column:
    """Start hour from ``HH:MM:SS`` text.

    ``floor``: floor(minutes / 60), keeps 24/25;  ``strict``: only 00-23
    parse, else default;  ``mod24``: hour mod 24.  Null -> ``default``.
    """
    mins = hms_to_minutes(c)
    if variant == "floor":
        h = F.floor(mins / 60).cast("int")
    elif variant == "strict":
        t = F.try_to_timestamp(_c(c).cast("string"), F.lit("HH:mm:ss"))
        h = F.hour(t)
    elif variant == "mod24":
        h = (F.floor(mins / 60) % 24).cast("int")
    else:
        raise ValueError(f"unknown hour variant {variant!r}")
    return F.coalesce(h, F.lit(default))


# F3 ------------------------------------------------------------------------
def daypart(h, labels: Sequence[str] = DAYPART_LABELS) -> Column:
    """Hour to daypart; 22..25 and 0..1 are night, 2..5 late night."""
    h = _c(h)
    return (F.when(h.between(6, 9), labels[0])
            .when(h.between(10, 13), labels[1])
            .when(h.between(14, 17), labels[2])
            .when(h.between(18, 21), labels[3])
            .when((h >= 22) | (h <= 1), labels[4])
            .otherwise(labels[5]))


# F4 ------------------------------------------------------------------------
def status_of(c, rules=STATUS_RULES_HE, default: str = STATUS_DEFAULT_HE) -> Column:
    """First rule whose any substring occurs in the text wins."""
    s = F.coalesce(_c(c).cast("string"), F.lit("None"))
    out = None
    for needles, label in rules:
        cond = None
        for n in needles:
            cond = s.contains(n) if cond is None else cond | s.contains(n)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(default) if out is not None else F.lit(default)


# F5 ------------------------------------------------------------------------
def is_rerun(c, pattern: str = RERUN_PATTERN) -> Column:
    return F.coalesce(_c(c).cast("string").rlike(pattern), F.lit(False))


def source_name(c, suffix: str = RERUN_SUFFIX) -> Column:
    return F.trim(F.regexp_replace(_c(c).cast("string"), suffix, ""))


# F6 ------------------------------------------------------------------------
def reception(d, variant: str = "monthly_clamped") -> Column:
    """Panel reception share by date.

    ``monthly_clamped``: monthly ramp, clamped to the end value.
    ``monthly_extrapolated``: monthly ramp continued, capped at 0.95.
    ``daily``: daily linear ramp continued, capped at 0.95, rounded to 3.
    """
    d = F.to_date(_c(d))
    span = RECEPTION_END_PCT - RECEPTION_START_PCT
    if variant in ("monthly_clamped", "monthly_extrapolated"):
        steps = F.months_between(F.lit(RECEPTION_END_MONTH).cast("date"),
                                 F.lit(RECEPTION_START).cast("date"))
        step = F.months_between(F.trunc(d, "month"), F.lit(RECEPTION_START).cast("date"))
        v = F.lit(RECEPTION_START_PCT) + F.lit(span) * step / steps
        cap = RECEPTION_END_PCT if variant == "monthly_clamped" else RECEPTION_CAP
        return F.when(d.isNull(), None).when(step <= 0, RECEPTION_START_PCT).otherwise(
            F.least(v, F.lit(cap)))
    if variant == "daily":
        total = F.datediff(F.lit(RECEPTION_END_DAY).cast("date"), F.lit(RECEPTION_START).cast("date"))
        frac = F.datediff(d, F.lit(RECEPTION_START).cast("date")) / total
        v = F.lit(RECEPTION_START_PCT) + F.lit(span) * frac
        return F.when(d.isNull(), None).when(d <= F.lit(RECEPTION_START).cast("date"), RECEPTION_START_PCT).otherwise(
            F.round(F.least(v, F.lit(RECEPTION_CAP)), 3))
    raise ValueError(f"unknown reception variant {variant!r}")


def adjusted(value, rec) -> Column:
    return F.try_divide(_c(value), _c(rec))


# F7, F8 ----------------------------------------------------------------------
def weekday_name(d, names: Sequence[str] = WEEKDAYS_HE) -> Column:
    """Spark's dayofweek is 1 = Sunday, so a Sunday-first list indexes directly."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.dayofweek(_c(d)))


def calendar_parts(d) -> dict[str, Column]:
    d = _c(d)
    return {"month": F.month(d), "day": F.dayofmonth(d), "iso_week": F.weekofyear(d)}


# F9 ------------------------------------------------------------------------
def peer_mean(cols: Sequence[str]) -> Column:
    """Row mean skipping nulls (null when all are null)."""
    s = sum(F.coalesce(F.col(c), F.lit(0.0)) for c in cols)
    n = sum(F.col(c).isNotNull().cast("int") for c in cols)
    return F.when(n > 0, F.try_divide(s, n))


def peer_sum(cols: Sequence[str]) -> Column:
    """Row sum skipping nulls (0 when all are null)."""
    return sum(F.coalesce(F.col(c), F.lit(0.0)) for c in cols)


def advantage(value, cols: Sequence[str]) -> Column:
    return _c(value) - peer_mean(cols)


def hut(value, cols: Sequence[str]) -> Column:
    """Peers' null-skipping sum plus the value; a null value propagates."""
    return peer_sum(cols) + _c(value)


# F10 -----------------------------------------------------------------------
def slot_key(*cols) -> Column:
    """Concatenate keys with '_'; null renders as 'nan' like the source."""
    return F.concat_ws("_", *[F.coalesce(_c(c).cast("string"), F.lit("nan")) for c in cols])


# F11 -----------------------------------------------------------------------
def duration_wrap(start, end, default: int = DEFAULT_DURATION_MIN) -> Column:
    """Minutes from start to end ``HH:MM[:SS]`` crossing midnight; null end -> default."""
    def hm(c):
        s = _c(c).cast("string")
        return (F.regexp_extract(s, r"^(\d{1,2}):(\d{2})", 1).try_cast("int") * 60
                + F.regexp_extract(s, r"^(\d{1,2}):(\d{2})", 2).try_cast("int"))
    d = hm(end) - hm(start)
    return F.when(_c(end).isNull(), F.lit(default)).when(d < 0, d + 1440).otherwise(d)


# F12 (T31: banker's rounding) ---------------------------------------------------
def households(rating, per_point: int = HH_PER_POINT) -> Column:
    return F.bround(_c(rating) * per_point, 0).cast("bigint")


def viewers(rating, per_point: int = HH_PER_POINT, per_hh: float = VIEWERS_PER_HH) -> Column:
    return F.bround(households(rating, per_point) * per_hh, 0).cast("bigint")


# F13, F14, F15 -------------------------------------------------------------
def trend_scale(pred, trend, days_ahead, max_months: float = 6.0) -> Column:
    months = F.least(_c(days_ahead) / 30.0, F.lit(max_months))
    scaled = F.when(_c(days_ahead) > 0, _c(pred) * F.pow(1 + _c(trend), months)).otherwise(_c(pred))
    return F.greatest(scaled, F.lit(0.0))


def interval_low(pred, half) -> Column:
    return F.greatest(_c(pred) - _c(half), F.lit(0.0))


def interval_high(pred, half) -> Column:
    return _c(pred) + _c(half)


def reliability(n, high: int = 20, medium: int = 5) -> Column:
    return (F.when(_c(n) >= high, "high").when(_c(n) >= medium, "medium")
            .otherwise("cold_start"))


# F16 -----------------------------------------------------------------------
_DOW = ["SU", "MO", "TU", "WE", "TH", "FR", "SA"]


def next_weekday(today, dow_sunday_first: int) -> Column:
    """Strictly-after-today date of the given weekday (0 = Sunday)."""
    return F.next_day(_c(today), _DOW[dow_sunday_first])


# F21 -----------------------------------------------------------------------
def fmt_num(c, digits: int = 2, missing: str = NO_TAG) -> Column:
    return F.coalesce(F.format_number(_c(c), digits), F.lit(missing))


def fmt_pct(c, digits: int = 1, missing: str = NO_TAG) -> Column:
    return F.coalesce(F.concat(F.format_number(_c(c) * 100, digits), F.lit("%")), F.lit(missing))


# F23 -----------------------------------------------------------------------
def fourier(t, period: float = 7.0, k: int = 3, prefix: str = "f") -> dict[str, Column]:
    import math
    out = {}
    for i in range(1, k + 1):
        ang = F.lit(2 * math.pi * i / period) * _c(t)
        out[f"{prefix}_sin{i}"] = F.sin(ang)
        out[f"{prefix}_cos{i}"] = F.cos(ang)
    return out


# F25 -----------------------------------------------------------------------
def one_hot(c, levels: Sequence[str], prefix: str | None = None) -> dict[str, Column]:
    name = prefix or (c if isinstance(c, str) else "cat")
    return {f"{name}_{lv}": (F.coalesce(_c(c) == F.lit(lv), F.lit(False))).cast("int") for lv in levels}


# P12 -----------------------------------------------------------------------
def safe_div(num, den) -> Column:
    """num / den only where den > 0, else null (ANSI-safe)."""
    return F.when(_c(den) > 0, F.try_divide(_c(num), _c(den)))


def div0(num, den) -> Column:
    """num / den, null when den is 0 or null (ANSI-safe)."""
    return F.try_divide(_c(num), _c(den))
