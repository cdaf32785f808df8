"""Statement shapes by column expressions: literal-free text, tokens, tables, call keys. No UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A quoted string. Java matches a repeated group by recursion, which long texts overflow, unless it is possessive;
#: the second form is for a text that ends inside its string.
QUOTED = r"'(?:[^']++|'')*+'|'(?:[^']++|'')*'"
TOKEN = r"[a-z_][a-z0-9_$]*|\?|<=|>=|<>|!=|[(),.=+*/%-]"
TABLE = r"\b(?:from|join|update|into)\s+([a-z_#][a-z0-9_$#]*(?:\s*\.\s*[a-z_][a-z0-9_$#]*){0,2})"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _chain(c: Column, *steps: tuple[str, str]) -> Column:
    for pattern, new in steps:
        c = F.regexp_replace(c, pattern, new)
    return c


def decoded(c: Column | str) -> Column:
    """Escaped white space as white space."""
    return _chain(F.coalesce(_c(c), F.lit("")), (r"\\r\\n|\\n|\\r", "\n"), (r"\\t", "\t"))


def collapsed(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_c(c), r"\s+", " "))


def regex_shape(c: Column | str, run_suffix: bool = True) -> Column:
    """Literal-free text: comments go; dollar-quoted and quoted strings, numbers and value lists become ?;
    a stem with a numeric run suffix becomes stem_#; lower case; single blanks."""
    t = _chain(decoded(c), (r"(?s)/\*.*?\*/", " "), (r"--[^\n]*", " "), (r"(?s)\$([A-Za-z_]*)\$.*?\$\1\$", "?"), (QUOTED, "?"))
    t = F.lower(t)
    if run_suffix:
        t = F.regexp_replace(t, r"\b([a-z_][a-z0-9_$]*?)_\d{3,}\b", "$1_#")
    t = _chain(t, (r"(?<![a-z0-9_$#])\d+(?:\.\d+)?(?:e[+-]?\d+)?\b", "?"), (r"\(\s*\?(?:\s*,\s*\?)++\s*\)", "(?)"))
    return collapsed(t)


def values_tail(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), r"(values\s*\(\?\))(?:\s*,\s*\(\?\))+", "$1")


def simple_shape(c: Column | str) -> Column:
    t = _chain(F.coalesce(_c(c), F.lit("")), (r"(?s)/\*.*?\*/", " "), (r"--[^\n]*", " "), (r"'(?:[^']|'')*'", "?"), (r"\b\d+(?:\.\d+)?\b", "?"))
    return F.lower(collapsed(t))


def text_shape(c: Column | str) -> Column:
    """The plain twin of regex_shape for texts that do not parse: run suffixes and dollar quotes stay, signs go with their numbers."""
    t = _chain(F.coalesce(_c(c), F.lit("")), (r"(?s)/\*.*?\*/", " "), (r"--[^\r\n]*", " "), (QUOTED, "?"))
    return collapsed(_chain(F.lower(t), (r"(?<![a-z0-9_$])[-+]?\d+(?:\.\d+)?(?![a-z0-9_$])", "?"), (r"\(\s*\?(?:\s*,\s*\?)++\s*\)", "(?)")))


def joined_sorted(c: Column | str, limit: int) -> Column:
    """Aggregate: distinct non-blank values in order, the first `limit`."""
    text = _c(c).cast("string")
    return F.array_join(F.slice(F.array_sort(F.collect_set(F.when(F.trim(text) != "", text))), 1, limit), ", ")


def text_key(c: Column | str) -> Column:
    return collapsed(F.lower(decoded(c)))


def without_leading_comments(c: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(_c(c), F.lit("")), r"(?s)^(?:\s+|--[^\n]*(?:\n|$)|/\*.*?(?:\*/|$))+", "")


def unloaded(c: Column | str, bare: bool = False) -> Column:
    """The inner statement of UNLOAD ('…'), else the text. bare: the text has no leading comments any more."""
    t = _c(c) if bare else without_leading_comments(c)
    found = [F.regexp_extract(t, rf"(?i)^unload\s*\(\s*'((?:[^']++|'')*{more})'", 1) for more in ("+", "")]  # as in QUOTED
    whole, cut = (F.when(x != "", F.replace(x, F.lit("''"), F.lit("'"))) for x in found)
    return F.coalesce(whole, cut, t)


def call_key(c: Column | str, database: Column | str) -> Column:
    """database.schema.procedure of a CALL; null for other statements; a bare name leaves the schema open."""
    return key_of_called(called(without_leading_comments(c)), database)


def called(bare: Column | str) -> Column:
    """The procedure's name as a CALL writes it, from a text without leading comments; '' for other statements."""
    return F.regexp_extract(F.lower(_c(bare)), r'^call\s+([a-z0-9_$."]+)\s*\(', 1)


def key_of_called(called: Column | str, database: Column | str) -> Column:
    name = _c(called)
    parts = F.split(F.regexp_replace(name, '"', ""), r"\.")
    db = F.lower(F.coalesce(_c(database), F.lit("")))
    return F.when(name == "", None).when(F.size(parts) >= 3, F.array_join(F.slice(parts, -3, 3), ".")).when(F.size(parts) == 2, F.concat_ws(".", db, parts[0], parts[1])).otherwise(F.concat_ws(".", db, F.lit(""), parts[0]))


def tokens(shape: Column | str) -> Column:
    return F.regexp_extract_all(_c(shape), F.lit(TOKEN), F.lit(0))


def tables(shape: Column | str) -> Column:
    """Referenced tables in the order of their first mention."""
    found = F.regexp_extract_all(F.lower(_c(shape)), F.lit(TABLE), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"\s+", "")))


def predicate_operators(shape: Column | str) -> Column:
    t = F.concat(F.lit(" "), F.lower(_c(shape)), F.lit(" "))
    tests = [("between", " between "), ("ilike", " ilike "), ("in", " in "), ("is", " is "), ("like", " like "), ("exists", " exists "), ("neq", "<>"), ("gte", ">="), ("lte", "<="), ("eq", " = ")]
    return F.array_compact(F.array(*[F.when(t.contains(text), F.lit(name)) for name, text in tests]))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(1.0))


def digest(c: Column, prefix: str = "G", width: int = 12) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(c, 256), 1, width))


def procedure_body(c: Column | str) -> Column:
    found = F.regexp_extract(F.coalesce(_c(c), F.lit("")), r"(?is)\bbegin\b.*\bend\b\s*;?", 0)
    return F.when(found != "", found)
