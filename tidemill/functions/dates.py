"""Dates and times on columns. Naive times are timestamp_ntz; nothing here depends on the session's time zone but to_timestamp and from_timestamp."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The formats that are tried, in order, as patterns and as what a text must look like.
FORMATS = [
    (r"\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}", "y-M-d H:m:s"),
    (r"\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}", "y/M/d H:m:s"),
    (r"\d{1,2}-\d{1,2}-\d{4} \d{1,2}:\d{1,2}:\d{1,2}", "d-M-y H:m:s"),
    (r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}", "d/M/y H:m:s"),
    (r"\d{4}-\d{1,2}-\d{1,2}", "y-M-d"),
    (r"\d{4}/\d{1,2}/\d{1,2}", "y/M/d"),
    (r"\d{1,2}-\d{1,2}-\d{4}", "d-M-y"),
    (r"\d{1,2}/\d{1,2}/\d{4}", "d/M/y"),
    (r"[A-Za-z]{3} \d{1,2}, \d{4}", "MMM d, y"),
    (r"[A-Za-z]{3,9} \d{1,2}, \d{4}", "MMMM d, y"),
    (r"\d{4}年\d{1,2}月\d{1,2}日", "y年M月d日"),
    (r"\d{4}年\d{1,2}月\d{1,2}日 \d{1,2}时\d{1,2}分\d{1,2}秒", "y年M月d日 H时m分s秒"),
    (r"[A-Za-z]{3} [A-Za-z]{3} \d{1,2} \d{1,2}:\d{1,2}:\d{1,2} \d{4}", "MMM d H:m:s y"),
    (r"[A-Za-z]{3}, \d{1,2} [A-Za-z]{3} \d{4} \d{1,2}:\d{1,2}:\d{1,2}", "d MMM y H:m:s"),
    (r"\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}\.\d{1,6}", "y-M-d'T'H:m:s.[SSSSSS][SSSSS][SSSS][SSS][SS][S]"),
    (r"\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}", "y-M-d'T'H:m:s"),
]
#: More ways to write a time: without seconds, on a twelve-hour clock, the day before the month's name, dots, or digits only.
MORE_FORMATS = [
    (r"\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}", "y-M-d H:m"),
    (r"\d{4}-\d{1,2}-\d{1,2}[Tt]\d{1,2}:\d{1,2}", "y-M-d'T'H:m"),
    (r"\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{1,2}", "y/M/d H:m"),
    (r"\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}\.\d{1,6}", "y-M-d H:m:s.[SSSSSS][SSSSS][SSSS][SSS][SS][S]"),
    (r"\d{4}\.\d{1,2}\.\d{1,2}", "y.M.d"),
    (r"\d{1,2}\.\d{1,2}\.\d{4}", "d.M.y"),
    (r"\d{8}", "yyyyMMdd"),
    (r"\d{14}", "yyyyMMddHHmmss"),
    (r"\d{1,2} [A-Za-z]{3} \d{4}", "d MMM y"),
    (r"\d{1,2} [A-Za-z]{4,9} \d{4}", "d MMMM y"),
    (r"[A-Za-z]{3} \d{1,2}, \d{4} \d{1,2}:\d{1,2} [AaPp][Mm]", "MMM d, y h:m a"),
    (r"[A-Za-z]{4,9} \d{1,2}, \d{4} \d{1,2}:\d{1,2} [AaPp][Mm]", "MMMM d, y h:m a"),
    (r"[A-Za-z]{3} \d{1,2},? \d{4},? \d{1,2}:\d{1,2}(:\d{1,2})?", "MMM d[,] y[,] H:m[:s]"),
    (r"[A-Za-z]{4,9} \d{1,2},? \d{4},? \d{1,2}:\d{1,2}(:\d{1,2})?", "MMMM d[,] y[,] H:m[:s]"),
    (r"\d{1,2} [A-Za-z]{3} \d{4},? \d{1,2}:\d{1,2}(:\d{1,2})?", "d MMM y[,] H:m[:s]"),
    (r"\d{1,2} [A-Za-z]{4,9} \d{4},? \d{1,2}:\d{1,2}(:\d{1,2})?", "d MMMM y[,] H:m[:s]"),
    (r"[A-Za-z]{3} \d{1,2} \d{4}", "MMM d y"),
    (r"[A-Za-z]{4,9} \d{1,2} \d{4}", "MMMM d y"),
    (r"\d{4}年\d{1,2}月\d{1,2}日 ?\d{1,2}:\d{1,2}(:\d{1,2})?", "y年M月d日[ ]H:m[:s]"),
    (r"\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2} [AaPp][Mm]", "y-M-d h:m a"),
]
OFFSET = r"(\d{4}-\d{1,2}-\d{1,2}[Tt ]\d{1,2}:\d{1,2}(?::\d{1,2}(?:\.\d{1,6})?)?) ?([Zz]|[+-]\d{2}:?\d{2})"
SECONDS = {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86400}
LOCAL_ZONE = "Asia/Shanghai"


#: Of a unit of time, in English and Chinese: months, seconds.
UNITS = [
    (r"(?:years?|yrs?|年)", 12, 0), (r"(?:months?|mos?|个?月)", 1, 0), (r"(?:weeks?|wks?|周|个?星期)", 0, 604_800), (r"(?:days?|天|日)", 0, 86_400), (r"(?:hours?|hrs?|h|个?小时)", 0, 3600), (r"(?:minutes?|mins?|分钟?)", 0, 60), (r"(?:seconds?|secs?|秒钟?)", 0, 1),
]
_UNIT = "(?:" + "|".join(u for u, _, _ in UNITS) + ")"
_AMOUNT = rf"(?:\d+|an?|one|half an?|半) ?{_UNIT}"
_SPAN = rf"{_AMOUNT}(?:(?:,? and |, ?| )?{_AMOUNT})*"
#: Days from now.
DAYS = [(r"(?:the )?day before yesterday|前天", -2), (r"yesterday|昨天", -1), (r"today|今天", 0), (r"(?:the )?day after tomorrow|后天", 2), (r"tomorrow|明天", 1)]
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
_CLOCK = r"(?:(?: at)? (\d{1,2}):(\d{2})(?::(\d{2}))? ?([ap]m)?)?"


def _relative(plain: Column, now: Column) -> Column:
    """Times by their distance from now: "3 days ago", "in 2 weeks", "1 hour, 20 minutes ago", "yesterday 17:05", "last month", "last monday", "5分钟前"; null for anything else."""
    low = F.lower(plain)
    now = now.cast("timestamp_ntz")
    fits = lambda pattern: F.rlike(low, F.lit(rf"\A(?:{pattern})\z"))

    def moved(months: Column, seconds: Column) -> Column:
        return F.timestamp_add("SECOND", seconds, F.timestamp_add("MONTH", months, now))

    def amount(part: Column) -> Column:
        half = F.rlike(part, F.lit("half|半"))
        return F.when(half, F.lit(0.5)).otherwise(F.coalesce(F.nullif(F.regexp_extract(part, r"^(\d{1,6})", 1), F.lit("")).cast("double"), F.lit(1.0)))

    def counted(which: int, sign: Column) -> Column:
        total = F.lit(0.0)
        for unit, *sizes in UNITS:
            of = F.regexp_extract_all(low, F.lit(rf"({_AMOUNT})"), F.lit(1))
            total = total + F.aggregate(_with_unit(of, unit), F.lit(0.0), lambda s, x: s + amount(x)) * sizes[which]
        return (total * sign).cast("long")

    ago, later = fits(rf"{_SPAN} ?(?:ago|before|前)"), fits(rf"in {_SPAN}|{_SPAN} ?(?:later|from now|后)")
    sign = F.when(ago, -1).otherwise(1)
    out = F.when(ago | later, moved(counted(0, sign).cast("int"), counted(1, sign).cast("int"))).when(fits("now|just now|刚刚|现在|刚才"), now)
    for word, way in (("last", -1), ("next", 1)):
        for unit, months, seconds in UNITS[:4]:
            out = out.when(fits(rf"{word} {unit}"), moved(F.lit(way * months), F.lit(way * seconds)))
    midnight = F.date_trunc("day", now).cast("timestamp_ntz")
    for k, name in enumerate(WEEKDAYS):
        back, ahead = F.pmod(F.weekday(now) - k - 1, F.lit(7)) + 1, F.pmod(F.lit(k - 1) - F.weekday(now), F.lit(7)) + 1
        out = out.when(fits(rf"(?:last )?{name}"), F.timestamp_add("DAY", -back, midnight)).when(fits(rf"next {name}"), F.timestamp_add("DAY", ahead, midnight))
    for pattern, days in DAYS:
        clock = rf"\A(?:{pattern}){_CLOCK}\z"
        part = lambda i, c=clock: F.coalesce(F.nullif(F.regexp_extract(low, c, i), F.lit("")).cast("int"), F.lit(0))
        half = F.regexp_extract(low, clock, 4)
        hour = F.when(half == "", part(1)).otherwise(part(1) % 12 + F.when(half == "pm", 12).otherwise(0))
        valid = (hour < 24) & (part(2) < 60) & (part(3) < 60)
        bare = F.regexp_extract(low, clock, 1) == ""
        # a day without a time is that day, now
        at = F.when(bare, F.timestamp_add("DAY", F.lit(days), now)).otherwise(F.timestamp_add("SECOND", (hour * 3600 + part(2) * 60 + part(3)).cast("int"), F.timestamp_add("DAY", F.lit(days), midnight)))
        out = out.when(F.rlike(low, F.lit(clock)) & valid, at)
    return out


def _with_unit(parts: Column, unit: str) -> Column:
    return F.filter(parts, lambda x: F.rlike(x, F.lit(rf"\A(?:\d+|an?|one|half an?|半) ?{unit}\z")))


def parse_time(text: Column, now: Column | None = None) -> Column:
    """The first of FORMATS, then of MORE_FORMATS, that fits the stripped text, as timestamp_ntz; then the same without ordinal endings, "of" and "at"; then, if now is given, a distance from it; null if none does.

    Names of weekdays are not checked. Times with an offset or Z are turned into UTC. now: what distances count from; F.localtimestamp() is the session's local time.
    """

    def read(plain: Column) -> Column:
        spoken = F.regexp_replace(F.regexp_replace(plain, r"(?i)(?<=\d)(?:st|nd|rd|th)\b| of\b(?= [A-Za-z])| at\b(?= \d)", ""), r"(?i)\A(?:mon|tues|wednes|thurs|fri|satur|sun)day,? (?=\w)", "")
        written = F.coalesce(_parsed(plain), F.when(spoken != plain, _parsed(spoken)))
        return written if now is None else F.coalesce(written, _relative(plain, now))

    # the stripped text is made once, as the element of an array, and each format reads that
    return F.transform(F.array(F.trim(F.regexp_replace(text, r"\s+", " "))), read)[0]


def _parsed(plain: Column) -> Column:
    # patterns want names as they are written in full text, and no weekday
    body = F.regexp_replace(plain, r"^[A-Za-z]{3},? (?=[A-Za-z]{3} \d|\d)", "")
    tried = []
    for like, pattern in FORMATS + MORE_FORMATS:
        source = body if like.startswith("[A-Za-z]{3} [A-Za-z]") or like.startswith("[A-Za-z]{3},") else plain
        named = F.initcap(source) if "MMM" in pattern else F.upper(source) if "a" in pattern else source
        tried.append(F.when(F.rlike(plain, F.lit(rf"\A{like}\z")), F.try_to_timestamp(named, F.lit(pattern)).cast("timestamp_ntz")))
    # what has an offset: the time as it is written, less the offset
    parts = F.regexp_extract(plain, OFFSET, 1), F.regexp_extract(plain, OFFSET, 2)
    sign = F.when(F.startswith(parts[1], F.lit("-")), 1).otherwise(-1)
    minutes = F.when(F.lower(parts[1]) == "z", 0).otherwise(sign * (F.substring(parts[1], 2, 2).cast("int") * 60 + F.right(parts[1], F.lit(2)).cast("int")))
    written = F.try_to_timestamp(F.replace(F.upper(parts[0]), F.lit("T"), F.lit(" ")), F.lit("y-M-d H:m[:s][.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]")).cast("timestamp_ntz")
    tried.append(F.when(F.rlike(plain, F.lit(rf"\A{OFFSET}\z")), F.timestamp_add("MINUTE", minutes, written)))
    return F.coalesce(*tried)


def format_time(time: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(time, pattern)


def strftime_pattern(fmt: str) -> str:
    """A strftime format as a date_format pattern, for the directives that both know."""
    known = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "f": "SSSSSS", "y": "yy", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "I": "hh", "p": "a", "j": "DDD", "%": "%"}
    out, i = "", 0
    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            out += known[fmt[i + 1]]
            i += 2
        else:
            out += f"'{fmt[i]}'" if fmt[i].isalpha() else "''" if fmt[i] == "'" else fmt[i]
            i += 1
    return out


def to_timestamp(time: Column) -> Column:
    """Seconds since 1970 as double, a naive time being in the session's zone."""
    return F.unix_micros(time.cast("timestamp")) / 1e6


def from_timestamp(seconds: Column) -> Column:
    return F.timestamp_micros((seconds * 1_000_000).cast("long")).cast("timestamp_ntz")


def time_diff(start: Column, end: Column, unit: str = "seconds") -> Column:
    """The absolute difference in whole units; an unknown unit counts seconds."""
    micros = F.abs(F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp")))
    return F.floor(micros / (SECONDS.get(unit, 1) * 1_000_000)).cast("long")


def add(time: Column, days: int = 0, months: int = 0) -> Column:
    """Days, then months, with the day clipped to the month's last."""
    moved = time + F.make_dt_interval(F.lit(days))
    return moved + F.make_ym_interval(F.lit(0), F.lit(months)) if months else moved


def iso_format(time: Column) -> Column:
    """ISO 8601, with six digits of a second only if they are not zero."""
    plain = F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(time, "SSSSSS")
    return F.when(micros == "000000", plain).otherwise(F.concat(plain, F.lit("."), micros))


def to_timezone(time: Column, zone: str, source: str = "UTC") -> Column:
    """A naive time of zone source as a naive time of zone."""
    return F.convert_timezone(F.lit(source), F.lit(zone), time)


def to_utc(time: Column, source: str = "UTC") -> Column:
    return to_timezone(time, "UTC", source)


def to_local(time: Column, source: str = "UTC") -> Column:
    return to_timezone(time, LOCAL_ZONE, source)


def from_timestamp_with_tz(seconds: Column, zone: str | None = None) -> Column:
    """The naive time of seconds with a zone's name put to it and nothing converted: struct(time, zone)."""
    return F.struct(from_timestamp(seconds).alias("time"), F.lit(zone).alias("zone"))


def date_range(start: Column, end: Column, pattern: str = "yyyy-MM-dd") -> Column:
    """All days from start to end as texts; none if end is before start or either is null."""
    first, last = start.cast("date"), end.cast("date")
    days = F.when(first <= last, F.sequence(first, last, F.expr("interval 1 day")))
    return F.coalesce(F.transform(days, lambda d: F.date_format(d, pattern)), F.array().cast("array<string>"))


def is_recent(time: Column, days: int = 7, now: Column | None = None) -> Column:
    """Whether fewer than so many whole days have passed; times to come are recent, null is not."""
    now = F.current_timestamp() if now is None else now
    passed = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(time.cast("timestamp"))) / 86_400_000_000)
    return F.coalesce(passed < days, F.lit(False))


def truncate(time: Column, unit: str = "day") -> Column:
    """To the hour, day or month; another unit changes nothing."""
    return F.date_trunc(unit, time).cast("timestamp_ntz") if unit in ("hour", "day", "month") else time


def format_duration(seconds: Column) -> Column:
    """Two largest units in Chinese; a zero second unit is left out."""

    # fixed values: the names of the units
    def shown(unit: int, name: str, lower: int, lower_name: str) -> Column:
        rest = F.floor(seconds % unit / lower)
        return F.concat(F.floor(seconds / unit).cast("string"), F.lit(f" {name}"), F.when(rest > 0, F.concat(F.lit(" "), rest.cast("string"), F.lit(f" {lower_name}"))).otherwise(""))

    return (
        F.when(seconds < 60, F.concat(seconds.cast("long").cast("string"), F.lit(" 秒")))
        .when(seconds < 3600, shown(60, "分钟", 1, "秒"))
        .when(seconds < 86400, shown(3600, "小时", 60, "分钟"))
        .otherwise(shown(86400, "天", 3600, "小时"))
    )


CRON_PART = r"(?:\d+(?:-\d+)?(?:/\d+)?|\*(?:/\d+)?)"


CRON_FIELDS = ((0, 59), (0, 59), (0, 23), (1, 31), (1, 12), (0, 7))
CRON_DAYS = 367


def _cron_values(text: str, low: int, high: int) -> list[int]:
    """The values of a cron field, in order; none where it can't be read. Lists of numbers, ranges, * and steps; a step of * counts from 0, one of a number or range from there."""
    if not re.fullmatch(rf"{CRON_PART}(,{CRON_PART})*", text, re.ASCII):
        return []
    found: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        by = max(int(step or 1), 1)
        if span == "*":
            found.update(v for v in range(low, high + 1) if v % by == 0)
        else:
            first, _, last = span.partition("-")
            end = int(last) if last else high if step else int(first)
            found.update(v for v in range(low, min(end, high) + 1) if v >= int(first) and (v - int(first)) % by == 0)
    return sorted(found)


def _cron_read(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Seconds of a day at which a cron text runs, in order, and by number which days, months and weekdays (from Sunday) it runs on."""
    parts = re.split(r"[ \t\n\x0b\f\r]+", text.strip(" "))
    fields = [_cron_values(x, *b) for x, b in zip(["0"] * (len(parts) == 5) + parts, CRON_FIELDS, strict=False)]
    if len(parts) not in (5, 6) or not all(fields):
        return None
    second, minute, hour = (np.array(f) for f in fields[:3])
    times = (hour[:, None, None] * 3600 + minute[:, None] * 60 + second).reshape(-1)
    days, months, weekdays = (np.isin(np.arange(n), f) for n, f in zip((32, 13, 8), fields[3:], strict=True))
    weekdays[0] |= weekdays[7]
    return times, days, months, weekdays


def _cron_after(cron: str, micros: np.ndarray) -> np.ndarray:
    """Seconds since 1970 of the next runs after times in microseconds since 1970; -1 << 62 where none comes within CRON_DAYS."""
    out = np.full(len(micros), -1 << 62)
    if (read := _cron_read(cron)) is None:
        return out
    times, days, months, weekdays = read
    start = micros // 1_000_000 + 1
    today, second = start // 86400, start % 86400
    # which of the days that may be asked for it runs on; places of these, and for each day the first on or after it
    asked = np.unique(np.unique(today)[:, None] + np.arange(CRON_DAYS + 1)) if len(np.unique(today)) < 1000 else np.arange(today.min(), today.max() + CRON_DAYS + 1)
    month_start = asked.astype("datetime64[D]").astype("datetime64[M]")
    day = (asked.astype("datetime64[D]") - month_start.astype("datetime64[D]")).astype(np.int64) + 1
    runs = asked[days[day] & months[month_start.astype(np.int64) % 12 + 1] & weekdays[(asked + 4) % 7]]
    if not len(runs):
        return out
    at = np.searchsorted(runs, today)
    here = np.append(runs, runs[-1])[at] == today
    nth = np.searchsorted(times, second)
    now = here & (nth < len(times))
    later = at + (here & ~now)
    next_ = np.where(now, today * 86400 + times[np.minimum(nth, len(times) - 1)], runs[np.minimum(later, len(runs) - 1)] * 86400 + times[0])
    good = (now | (later < len(runs))) & (next_ * 1_000_000 <= micros + CRON_DAYS * 86_400_000_000)
    return np.where(good, next_, out)


@F.pandas_udf(T.LongType())
def _cron_seconds(cron: pd.Series, micros: pd.Series) -> pd.Series:
    """A cron text is read once for all rows of a batch that have it."""
    out = np.full(len(cron), -1 << 62)
    known = (cron.notna() & micros.notna()).to_numpy()
    times = micros.fillna(0).to_numpy().astype(np.int64)
    codes, texts = pd.factorize(cron)
    order = np.argsort(codes, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1):
        rows = rows[known[rows]]
        if len(rows):
            out[rows] = _cron_after(texts[codes[rows[0]]], times[rows])
    return pd.Series(out, dtype="Int64").mask(out == -1 << 62)


def cron_next(cron: Column, after: Column) -> Column:
    """The next run after a time, within 367 days, of a cron text of five fields, or six with seconds first; null for one that can't be read."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("SECOND", _cron_seconds(cron, F.timestamp_diff("MICROSECOND", start, after.cast("timestamp_ntz"))), start)


def cron_matches(cron: Column, time: Column) -> Column:
    second = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(1))
    return F.coalesce(cron_next(cron, time - second) == F.date_trunc("second", time).cast("timestamp_ntz"), F.lit(False))


def next_job_run(cron: Column, scheduled: Column, now: Column) -> Column:
    """The next run after the scheduled time, whenever that run ended; if it is past already, the next from now."""
    planned = cron_next(cron, scheduled)
    return F.when(planned <= now, cron_next(cron, now)).otherwise(planned)


def report_date(time: Column) -> Column:
    """The last end of a quarter on or before a date."""
    quarter = F.date_trunc("quarter", time).cast("date")
    end = F.date_sub(F.add_months(quarter, 3), 1)
    return F.when(end == time.cast("date"), end).otherwise(F.date_sub(quarter, 1))
