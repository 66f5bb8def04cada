"""Text parsing on string columns (survey F17-F20, F24, S16).

Everything is a JVM expression (``contains``, ``regexp_extract``,
``try_to_timestamp``, ``get_json_object``), applied to whole texts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ratecast.functions.scalars import WEEKDAYS_HE

# ---------------------------------------------------------------------------
# Keyword lists of the free-text question parser
# ---------------------------------------------------------------------------
WORD_TOMORROW = "מחר"
WORD_TODAY = "היום"
WORD_WEEK = "שבוע"
WORD_MONTH = "חודש"
WORDS_NEXT = ["הקרוב", "הבא"]
PROGRAM_WORDS = ["קבינט", "שישי"]
SCENARIO_WORDS = ["אירוע", "מבזק", "ברייקינג", "פיגוע", "מבצע", "מלחמה", "הסלמה", "טילים"]
# ---------------------------------------------------------------------------

_DATE_RE = r"(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{2,4})"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def explicit_date(c) -> Column:
    """First ``d/m/y`` (or ``-`` / ``.``) date in the text; 2-digit years
    get +2000; impossible dates (31/02) are null."""
    s = _c(c)
    d = F.regexp_extract(s, _DATE_RE, 1)
    m = F.regexp_extract(s, _DATE_RE, 2)
    y = F.regexp_extract(s, _DATE_RE, 3).try_cast("int")
    y = F.when(y < 100, y + 2000).otherwise(y)
    txt = F.concat_ws("-", y.cast("string"), m, d)
    return F.when(s.rlike(_DATE_RE), F.to_date(F.try_to_timestamp(txt, F.lit("y-M-d"))))


def text_date(c, today, weekdays: Sequence[str] = WEEKDAYS_HE) -> Column:
    """relative words first (tomorrow, today, week, month), then a
    weekday name with a "next" marker (or the name prefixed by ב), then an
    explicit date; else null.  ``today`` is a date column or literal."""
    s = F.trim(_c(c))
    t = F.to_date(today) if isinstance(today, Column) else F.lit(today).cast("date")
    e = (F.when(s.contains(WORD_TOMORROW), F.date_add(t, 1))
         .when(s.contains(WORD_TODAY), t)
         .when(s.contains(WORD_WEEK), F.date_add(t, 7))
         .when(s.contains(WORD_MONTH), F.date_add(t, 30)))
    nxt = None
    for w in WORDS_NEXT:
        nxt = s.contains(w) if nxt is None else nxt | s.contains(w)
    dows = ["SU", "MO", "TU", "WE", "TH", "FR", "SA"]
    # of several weekday names the first from Sunday on counts
    for i, name in enumerate(weekdays):
        e = e.when(s.contains(name) & (nxt | s.contains("ב" + name)), F.next_day(t, dows[i]))
    return e.otherwise(explicit_date(s))


def has_any(c, words: Sequence[str]) -> Column:
    s = F.coalesce(_c(c), F.lit(""))
    cond = F.lit(False)
    for w in words:
        cond = cond | s.contains(w)
    return cond


def text_program(c, words: Sequence[str] = PROGRAM_WORDS, program: str = "קבינט שישי") -> Column:
    """the supported program when any keyword occurs, else null."""
    return F.when(has_any(c, words), F.lit(program))


def text_scenario(c, words: Sequence[str] = SCENARIO_WORDS) -> Column:
    """``special_event`` when any event word occurs, else ``routine``."""
    return F.when(has_any(c, words), "special_event").otherwise("routine")


def confidence(c, program_col, weekdays: Sequence[str] = WEEKDAYS_HE) -> Column:
    """high with a program and a day word (tomorrow, today, week or a
    weekday), medium with a program alone, else low; a bare date counts for
    neither."""
    day = has_any(c, [WORD_TOMORROW, WORD_TODAY, WORD_WEEK, *weekdays])
    return F.when(program_col.isNotNull() & day, "high").when(program_col.isNotNull(), "medium").otherwise("low")


def json_field(c, path: str) -> Column:
    """a JSON field from text that is pure JSON or JSON embedded in
    prose (first ``{`` to last ``}``)."""
    s = _c(c)
    inner = F.regexp_extract(s, r"(?s)\{.*\}", 0)
    return F.coalesce(F.get_json_object(s, path), F.get_json_object(inner, path))


def pub_date(c, today, fmt: str = "d MMM yyyy HH:mm:ss") -> Column:
    """the day of an RSS publication date (``Tue, 05 Mar 2024 10:00:00``,
    as written, a zone after it does not shift it), default ``today``.  The
    weekday name and the zone are dropped before parsing (Spark parses no
    weekday names)."""
    t = F.to_date(today) if isinstance(today, Column) else F.lit(today).cast("date")
    body = F.regexp_replace(F.regexp_replace(_c(c), r"^\s*[A-Za-z]{3},\s*", ""), r"\s+([+-]\d{4}|[A-Z]{1,4})?\s*$", "")
    return F.coalesce(F.to_date(F.try_to_timestamp(body, F.lit(fmt))), t)


def coalesce_text(*cols) -> Column:
    """first non-null, non-empty value."""
    return F.coalesce(*[F.nullif(_c(c), F.lit("")) for c in cols])


def link_items(c, limit: int | None = None) -> tuple[Column, Column]:
    """(href, text) arrays of the ``<a href="..">..</a>`` items of a page,
    optionally the first ``limit``."""
    pat = r'<a href="([^"]*)">([^<]*)</a>'
    href = F.regexp_extract_all(_c(c), F.lit(pat), 1)
    txt = F.regexp_extract_all(_c(c), F.lit(pat), 2)
    if limit:
        href, txt = F.slice(href, 1, limit), F.slice(txt, 1, limit)
    return href, txt


_ITEM = "array<struct<title:string,pubDate:string>>"


def feed_items(c, today, limit: int | None = None) -> Column:
    """The items of an XML feed (RSS: ``channel/item``; RDF: ``item``
    beside the channel) as an array of (title, pub_date) in the feed's
    order: titles trimmed, items without one left out, then the first
    ``limit`` of the whole feed or all.  A missing or unreadable date is
    ``today``; text that is no well-formed XML has no items."""
    feed = F.from_xml(_c(c), F.lit(f"channel struct<item:{_ITEM}>, item {_ITEM}"), {"mode": "PERMISSIVE", "attributePrefix": "_"})
    empty = F.array().cast(_ITEM)
    items = F.concat(F.coalesce(feed["channel"]["item"], empty), F.coalesce(feed["item"], empty))
    titled = F.filter(F.transform(items, lambda i: F.struct(F.trim(i["title"]).alias("title"), pub_date(i["pubDate"], today).alias("pub_date"))),
                      lambda i: F.coalesce(i["title"] != "", F.lit(False)))
    return F.slice(titled, 1, limit) if limit else titled
