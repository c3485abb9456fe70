"""Column expressions that the analytics operators share; all of them native functions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Click-through rate by position, 1 to 20; later positions have CTR_BEYOND.
CTR_BY_POSITION = (0.28, 0.15, 0.1, 0.07, 0.05, 0.04, 0.033, 0.028, 0.024, 0.021, 0.018, 0.016, 0.014, 0.012, 0.011, 0.01, 0.009, 0.008, 0.007, 0.006)
CTR_BEYOND = 0.005
# Lower bounds of keyword difficulty tiers.
DIFFICULTY_BOUNDS = (20, 35, 50, 65, 80)


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_up(c, digits: int = 0) -> Column:
    """Round halves toward plus infinity on the binary value, unlike ``F.round``."""
    factor = float(10**digits)
    return F.floor(col(c) * F.lit(factor) + F.lit(0.5)) / F.lit(factor)


def clamp01(c) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), col(c)))


def all_of(*conditions: Column | None) -> Column:
    """Conjunction of the conditions given; none is true."""
    out = F.lit(True)
    for c in conditions:
        if c is not None:
            out = out & c
    return out


def range_filter(c, low=None, high=None, nulls: str = "sql") -> Column | None:
    """low <= c <= high; ``nulls``: 'zero' counts null as 0, 'fail' and 'pass' decide, 'sql' leaves it unknown."""
    if low is None and high is None:
        return None
    value = F.coalesce(col(c), F.lit(0)) if nulls == "zero" else col(c)
    test = all_of(None if low is None else value >= F.lit(low), None if high is None else value <= F.lit(high))
    if nulls == "fail":
        return col(c).isNotNull() & test
    if nulls == "pass":
        return col(c).isNull() | test
    if nulls in ("zero", "sql"):
        return test
    raise ValueError(f"nulls: zero, fail, pass or sql, not {nulls!r}")


def position_filter(c, low=None, high=None) -> Column | None:
    """Ranks within bounds; a high bound of 0 asks for unranked ones only."""
    if high == 0:
        return col(c).isNull()
    return range_filter(c, low, high, "fail")


def split_terms(text: str | None, separators: str = "[,+]") -> list[str]:
    """Lower-case search terms of an input, blanks left out, first occurrences kept in order."""
    found = (t.strip().lower() for t in re.split(separators, text or ""))
    return list(dict.fromkeys(t for t in found if t))


def text_filter(c, include: Iterable[str] = (), exclude: Iterable[str] = (), mode: str = "all") -> Column | None:
    """Literal substrings in lower case: ``all`` or ``any`` of include, none of exclude."""
    haystack = F.lower(col(c))
    include, exclude = list(include), list(exclude)
    hits = [haystack.contains(t) for t in include]
    test = None
    if hits:
        test = hits[0]
        for h in hits[1:]:
            test = test & h if mode == "all" else test | h
    for t in exclude:
        test = ~haystack.contains(t) if test is None else test & ~haystack.contains(t)
    return test


def ctr(position) -> Column:
    """Click-through rate of a position: 0 if null or below 1."""
    p = col(position).cast("int")
    curve = F.array(*(F.lit(x) for x in CTR_BY_POSITION))
    return F.when(p.isNull() | (p < 1), 0.0).when(p > len(CTR_BY_POSITION), CTR_BEYOND).otherwise(F.element_at(curve, F.greatest(F.least(p, F.lit(20)), F.lit(1))))


def intent(c) -> Column:
    """Search intent by substring of a provider's label."""
    text = F.lower(F.coalesce(col(c), F.lit("")))
    out = F.when(text.contains("inform"), "informational").when(text.contains("commerc"), "commercial")
    return out.when(text.contains("transact"), "transactional").when(text.contains("navig"), "navigational").otherwise("unknown")


def difficulty_tier(c) -> Column:
    """0 (easiest) to 5; null for null."""
    out = F.when(col(c).isNull(), F.lit(None).cast("int"))
    for tier, bound in enumerate(DIFFICULTY_BOUNDS):
        out = out.when(col(c) < bound, tier)
    return out.otherwise(len(DIFFICULTY_BOUNDS))


def short_id(*parts) -> Column:
    """The first 36 hex digits of SHA-256 of the parts joined by a pipe."""
    return F.substring(F.sha2(F.concat_ws("|", *(col(p).cast("string") for p in parts)), 256), 1, 36)


def digest_id(domain: str, version: str, *parts) -> Column:
    """A SHA-256 id over length-delimited parts, so that no two tuples share an encoding."""
    pieces = [F.lit(domain), F.lit(version), *(F.coalesce(col(p).cast("string"), F.lit("")) for p in parts)]
    text = F.concat_ws("|", *(F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in pieces))
    return F.concat(F.lit(f"{domain}_"), F.sha2(text, 256))


def normal_keyword(c) -> Column:
    return F.lower(F.trim(col(c)))


def micros(c) -> Column:
    """Microseconds since the epoch, of timestamps with or without a zone."""
    return F.unix_micros(col(c).cast("timestamp"))


def collapse_space(c) -> Column:
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def truncated(c, size: int) -> Column:
    return F.substring(col(c), 1, size)


def middle_cut(c, size: int) -> Column:
    """At most ``size`` characters: the first and last ones about an ellipsis."""
    head = (size - 1) - (size - 1) // 2
    return F.when(F.length(col(c)) <= size, col(c)).otherwise(F.concat(F.substring(col(c), 1, head), F.lit("…"), F.right(col(c), F.lit((size - 1) // 2))))


def strip_html(c) -> Column:
    """Tags as spaces, the five common character references decoded, white space collapsed."""
    text = F.regexp_replace(col(c), r"<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;|&#x27;", "'"), ("&amp;", "&")):
        text = F.regexp_replace(text, name, char)
    return collapse_space(text)


def percent(c) -> Column:
    """A score of 0 to 1 as whole percent; null and NaN are null."""
    return F.when(col(c).isNull() | F.isnan(col(c).cast("double")), F.lit(None)).otherwise(half_up(col(c) * 100).cast("int"))


def freshness(published, now, full_days: int = 7, zero_days: int = 90, baseline=None) -> Column:
    """1 within ``full_days``, linear to 0 at ``zero_days``, four decimals; baseline and unknown dates are 0."""
    age = F.greatest(F.lit(0.0), (micros(now) - micros(published)) / F.lit(86_400_000_000.0))
    decay = half_up((F.lit(float(zero_days)) - age) / F.lit(float(zero_days - full_days)), 4)
    value = F.when(age <= full_days, 1.0).when(age >= zero_days, 0.0).otherwise(decay)
    missing = col(published).isNull() if baseline is None else col(published).isNull() | F.coalesce(col(baseline), F.lit(False))
    return F.when(missing, 0.0).otherwise(value)


def hours_between(a, b) -> Column:
    """Absolute hours between timestamps; infinite if one is missing."""
    gap = F.abs(micros(a) - micros(b)) / F.lit(3_600_000_000.0)
    return F.coalesce(gap, F.lit(float("inf")))


def brand_pattern(brand: str) -> str:
    """A Java pattern that finds a brand as a whole word, also where it begins or ends in a sign."""
    first, last = re.escape(brand[0]), re.escape(brand[-1])
    lead = r"\b" if re.match(r"\w", brand[0]) else f"(?<!{first})"
    tail = r"\b" if re.match(r"\w", brand[-1]) else f"(?!{last})"
    return f"(?i){lead}{re.escape(brand)}{tail}"


def host_matches(host, domain) -> Column:
    """Host equals the domain or is under it; a leading ``www.`` counts for nothing."""
    h = F.regexp_replace(F.lower(col(host)), r"^www\.", "")
    d = F.regexp_replace(F.lower(col(domain)), r"^www\.", "")
    return (h == d) | h.endswith(F.concat(F.lit("."), d))


def previous_period(start, end) -> tuple[Column, Column]:
    """The period of the same length that ends the day before ``start``."""
    length = F.greatest(F.datediff(col(end), col(start)), F.lit(0))
    return F.date_sub(col(start), length + 1), F.date_sub(col(start), 1)


def report_range(today, name: str = "last_28_days", lag_days: int = 3, floor_months: int = 16) -> tuple[Column, Column]:
    """A named range that ends ``lag_days`` ago and begins no earlier than ``floor_months`` ago; months clamp the day."""
    end = F.date_sub(col(today), lag_days)
    number, unit = re.fullmatch(r"last_(\d+)_(days|months)", name).groups()
    start = F.date_sub(end, int(number)) if unit == "days" else F.add_months(end, -int(number))
    return F.greatest(start, F.add_months(col(today), -floor_months)), end


def next_check(anchor, now, interval: str) -> Column:
    """The first of anchor + k steps after ``now`` (k >= 1): days, weeks, or ends of month at the anchor's time."""
    a, n = col(anchor), col(now)
    if interval in ("daily", "weekly"):
        days = 1 if interval == "daily" else 7
        step = days * 86_400_000_000
        steps = F.floor(F.greatest(F.lit(0), micros(n) - micros(a)) / step) + 1
        return F.timestamp_micros((micros(a) + steps * F.lit(step)).cast("long"))
    if interval != "monthly":
        raise ValueError(f"interval: daily, weekly or monthly, not {interval!r}")
    clock = micros(a) - micros(F.date_trunc("day", a))
    at = lambda k: F.timestamp_micros(micros(F.last_day(F.add_months(F.trunc(a, "month"), k))) + clock)
    months = F.greatest(F.floor(F.months_between(F.trunc(n, "month"), F.trunc(a, "month"))).cast("int"), F.lit(1))
    return F.when(at(months) > n, at(months)).otherwise(at(months + 1))


def severity_rank(c) -> Column:
    """0 for critical, 1 for warning, 2 for info, 3 otherwise."""
    return F.when(col(c) == "critical", 0).when(col(c) == "warning", 1).when(col(c) == "info", 2).otherwise(3)


def table_cell(c, kind: str) -> Column:
    """A value as table text: a dash for null, integers as they are, other numbers with two decimals."""
    if kind in ("double", "float"):
        rounded = half_up(c, 2)
        return F.when(col(c).isNull(), "—").when(col(c) == F.floor(col(c)), F.floor(col(c)).cast("string")).otherwise(F.format_string("%.2f", rounded))
    return F.coalesce(col(c).cast("string"), F.lit("—"))


def csv_cell(c, kind: str) -> Column:
    """A value for CSV: numbers with at most two decimals, texts that a sheet would run as formulas quoted."""
    if kind in ("double", "float"):
        return half_up(c, 2).cast("string")
    text = F.coalesce(col(c).cast("string"), F.lit(""))
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text) if kind == "string" else text
