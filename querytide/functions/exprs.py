"""Column functions of the typed layer: null tokens, casts, durations, categories. No UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR_SECONDS = 31_536_000
# Spellings of "no key" by call site.
MISSING_SORTKEY_SQL = ["", "NONE", "NULL", "N/A", "NA", "-", "AUTO(SORTKEY)", "AUTO(SORTKEY(NONE))", "AUTO(NONE)"]
MISSING_KEY_META = ["", "none", "null", "nan", "n/a", "na", "-", "auto", "auto(sortkey)", "auto(none)", "auto(even)", "auto(all)", "even", "all", "unknown"]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def token(c: Column | str) -> Column:
    """Trimmed text; the tokens for null become null."""
    t = F.trim(col(c).cast("string"))
    return F.when(~t.isin("", "None", "NULL"), t)


def fragment(c: Column | str) -> Column:
    """As token(), but the text keeps its blanks."""
    s = col(c).cast("string")
    return F.when(~F.trim(s).isin("", "None", "NULL"), s)


# A cast of text that does not fit costs an exception, some thousand times a cast that does; so only what has the form of a
# number or a moment is cast. The forms let through all that the casts take: outer blanks, suffixes, hexadecimal numbers, words.
_BLANKS = r"[\x00-\x20\x7f]*"
INTEGER = rf"^{_BLANKS}[+-]?[0-9]+{_BLANKS}$"
NUMBER = rf"^{_BLANKS}[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?[fFdD]?|0[xX][0-9a-fA-F]*\.?[0-9a-fA-F]*[pP][+-]?[0-9]+[fFdD]?|(?i:inf|infinity|nan)){_BLANKS}$"
MOMENT = rf"^{_BLANKS}[+-]?[Tt]?[0-9]"


def whole(c: Column | str) -> Column:
    """Text to bigint; fractions and exponents round half away from zero."""
    t = F.trim(col(c).cast("string"))
    real = t.try_cast("double")
    fits = ~F.isnan(real) & (F.abs(real) < 9.2e18)
    return F.when(t.rlike(INTEGER), t.try_cast("bigint")).when(t.rlike(NUMBER), F.when(fits, F.round(real).cast("bigint")))


def real(c: Column | str) -> Column:
    t = F.trim(col(c).cast("string"))
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def moment(c: Column | str) -> Column:
    t = F.trim(col(c).cast("string"))
    return F.when(t.rlike(MOMENT), t.try_cast("timestamp_ntz"))


def missing_sortkey(c: Column | str) -> Column:
    """The SQL vocabulary: upper case without blanks."""
    t = F.regexp_replace(F.upper(F.trim(F.coalesce(col(c), F.lit("")))), r"\s+", "")
    return t.isin(MISSING_SORTKEY_SQL)


def missing_key(c: Column | str) -> Column:
    """The wider vocabulary of the advice operators."""
    t = F.regexp_replace(F.lower(F.trim(F.coalesce(col(c), F.lit("")))), r"\s+", "")
    return t.isin(MISSING_KEY_META)


def duration_seconds(c: Column | str) -> Column:
    """Guesses the unit of a duration: the first of micro-, nano-, milliseconds and seconds that stays within a year."""
    v = col(c).cast("double")
    out = F.lit(None).cast("double")
    for scale in (1.0, 1e3, 1e9, 1e6):
        out = F.when(F.abs(v) / scale <= YEAR_SECONDS, v / scale).otherwise(out)
    return F.when(v.isNotNull(), out)


def millis_between(start: Column | str, end: Column | str) -> Column:
    """Milliseconds between two moments by whole-millisecond boundaries."""
    micros = lambda c: F.unix_micros(col(c).cast("timestamp"))
    return F.floor(micros(end) / 1000) - F.floor(micros(start) / 1000)


def elapsed_seconds(start: Column | str, end: Column | str) -> Column:
    """Seconds between two moments; null if negative or beyond a year."""
    s = millis_between(start, end) / 1000.0
    return F.when((s >= 0) & (s <= YEAR_SECONDS), s)


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null unless b is positive."""
    return F.when(col(b) > 0, col(a).cast("double") / col(b))


def zero(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(0))


def user_label(raw: Column | str, looked_up: Column | str, user_id: Column | str) -> Column:
    """A non-numeric raw name, else the looked-up name, else the id."""
    t = token(raw)
    return F.coalesce(F.when(~t.rlike("^[0-9]+$"), t), token(looked_up), col(user_id).cast("string"))


STEP_KINDS = (("join", ("join", "nestloop", "nested")), ("aggregate", ("aggr", "group", "unique")), ("redistribute", ("dist", "bcast", "broadcast")), ("sort", ("sort", "merge")), ("scan", ("scan",)))


def step_category(c: Column | str) -> Column:
    name, out = F.lower(F.coalesce(col(c), F.lit(""))), F.lit("other")
    for kind, words in reversed(STEP_KINDS):
        hit = F.lit(False)
        for w in words:
            hit = hit | name.contains(w)
        out = F.when(hit, F.lit(kind)).otherwise(out)
    return out


def distkey(c: Column | str) -> Column:
    """Column of KEY(column), or null."""
    found = F.regexp_extract(F.lower(F.coalesce(col(c), F.lit(""))), r"key\s*\(?\s*([a-z_][a-z0-9_$]*)", 1)
    return F.when(found != "", found)


def impact_band(c: Column | str) -> Column:
    v = col(c)
    return F.when(v >= 90, "severe").when(v >= 75, "high").when(v >= 50, "medium").otherwise("low")


def identifier(c: Column | str) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), '"', "")))


def bare_column(c: Column | str) -> Column:
    return F.substring_index(F.lower(F.trim(col(c))), ".", -1)


def split_names(c: Column | str) -> Column:
    """Names of a list separated by commas, semicolons or bars, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), r"[,;|]\s*"), lambda x: F.trim(x)), lambda x: x != "")


def planned_rows(c: Column | str) -> Column:
    return F.regexp_extract(F.coalesce(col(c), F.lit("")), r"\brows=(\d+)", 1).try_cast("bigint")


def email(c: Column | str) -> Column:
    found = F.regexp_extract(F.coalesce(col(c), F.lit("")), r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})", 1)
    return F.when(found != "", F.lower(found))


def glob_like(column: Column | str, pattern: str) -> Column:
    """A shell pattern (* and ?) as LIKE; its other characters stand for themselves."""
    text = pattern.lower().replace("!", "!!").replace("%", "!%").replace("_", "!_").replace("*", "%").replace("?", "_")
    return F.expr(f"lower(trim({column if isinstance(column, str) else column._jc.toString()})) like '{text.replace(chr(39), chr(39) * 2)}' escape '!'")
