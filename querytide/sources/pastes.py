"""Pasted and delimited text as tables, read by Spark line by line.

What a text is like (its delimiter, whether it has a header, what its columns hold) is read off aggregates of its lines and
cells; only those, and the first line, come to the driver. A quoted cell ends with its line.
"""

from __future__ import annotations

import csv
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import token, whole
from .storage import Files

NULLS = ("", "NULL", "null", "None", "NaN", "<null>")
# The two paste contracts in the order in which the warehouse's views have their columns, with their types.
STEP_COLUMNS = dict(x.split(":") for x in """user_id:long query_id:long transaction_id:long session_id:long database_name:string parent_query_id:long
 child_query_sequence:long start_time:timestamp_ntz end_time:timestamp_ntz elapsed_time:long aborted:long step_name:string table_id:long table_name:string
 schema_name:string input_bytes:long input_rows:long output_bytes:long output_rows:long query_text:string source_query_id:long redshift_version:string
 result_cache_hit:boolean step_id:long stream_id:long is_rrscan:boolean segment_id:long is_child:boolean source_type:string query_blocks_read:long
 spilled_block_local_disk:long spilled_block_remote_disk:long data_skewness:double time_skewness:double is_delayed_scan:boolean delayed_scan_rows:long
 join_type:string alert_type:string""".split())  # fmt: skip
TABLE_COLUMNS = dict(x.split(":") for x in """database:string schema:string table_id:long table:string encoded:string diststyle:string sortkey1:string max_varchar:long
 sortkey1_enc:string sortkey_num:long size:long pct_used:double empty:long unsorted:double stats_off:double tbl_rows:long skew_sortkey1:double skew_rows:double
 estimated_visible_rows:long risk_event:string vacuum_sort_benefit:double create_time:timestamp_ntz""".split())  # fmt: skip
# Other names of the columns.
STEP_ALIASES = dict(x.split(":") for x in """userid:user_id queryid:query_id xid:transaction_id pid:session_id database:database_name parent_queryid:parent_query_id
 child_query_seq:child_query_sequence duration:elapsed_time operation:step_name tableid:table_id tbl_name:table_name schema:schema_name bytes:input_bytes
 rows:input_rows out_bytes:output_bytes out_rows:output_rows sql:query_text source_queryid:source_query_id rs_version:redshift_version
 cache_hit:result_cache_hit stepid:step_id streamid:stream_id rrscan:is_rrscan segmentid:segment_id child:is_child srctype:source_type
 blocks_read:query_blocks_read spill_local:spilled_block_local_disk spill_remote:spilled_block_remote_disk skewness_data:data_skewness
 skewness_time:time_skewness delayed_scan:is_delayed_scan delayed_rows:delayed_scan_rows jointype:join_type alert:alert_type""".split())  # fmt: skip
TABLE_ALIASES = dict(x.split(":") for x in """db:database schemaname:schema tableid:table_id tbl:table tablename:table dist_style:diststyle sort_key:sortkey1
 sortkey:sortkey1 sort_key_num:sortkey_num size_mb:size pct:pct_used empty_blocks:empty unsorted_pct:unsorted stats_stale:stats_off rows:tbl_rows
 row_count:tbl_rows skew:skew_rows est_rows:estimated_visible_rows risk:risk_event vacuum_benefit:vacuum_sort_benefit created:create_time""".split())  # fmt: skip
# How headerless columns are named by the shape of their values, first fit first.
NUMBER, MOMENT, STEP_WORD = r"-?\d[\d,.eE+\-]*", r"\d{4}-\d{2}-\d{2}", r"(?i)\b(scan|hash|join|aggregate|sort|dist|bcast|broadcast|merge|limit|project|filter)\b"
SMALL_NUMBERS = ("step_id", "stream_id", "segment_id", "aborted")
LARGE_NUMBERS = ("elapsed_time", "input_rows", "output_rows", "input_bytes", "output_bytes", "query_id", "transaction_id")
WORDS = ("table_name", "schema_name", "database_name", "join_type", "alert_type", "source_type")
#: Separators that are tried, the first of equals; runs of blanks where none stands in the first line.
SEPARATORS, BLANKS = ("\t", "|", ";", ","), r"\s{2,}"
#: Lines that a separator is chosen by, and values that tell what a column holds.
HEAD, PROFILE, STEP_PROFILE = 40, 80, 10
#: Bytes of a file that tell its encoding and separator.
PROBE = 1 << 16


# Lines -----------------------------------------------------------------------------------------
def lines_of(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(re.split("\r\n|\r|\n", text))), "no long, line string")


def content(lines: DataFrame) -> DataFrame:
    """(no, line) without drawn and blank lines, enclosing bars and row numbers."""
    framed, numbered = r"^\s*\|(.*)\|$", r"^\s*\d+\s*[:|]\s+"
    plain = F.translate(F.regexp_replace("line", r"\s+$", ""), "│║", "||")
    kept = lines.select("no", plain.alias("line")).where(~F.col("line").rlike(r"^[\s\u2500-\u257F\-=+_|`~*]*$"))
    return kept.select("no", F.regexp_replace(F.regexp_replace("line", framed, "$1"), numbered, "").alias("line"))


def separator(lines: DataFrame) -> str:
    """The separator with the most fields of the first line times the lines of the head that have as many."""
    head = lines.orderBy("no").limit(HEAD)
    tries = F.explode(F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(s).alias("sep")) for k, s in enumerate(SEPARATORS)]))
    found = head.select("no", "line", tries.alias("t")).select("no", "t.*", (F.length("line") - F.length(F.replace("line", "t.sep"))).alias("n"))
    per = found.groupBy("rank", "sep").agg(F.min_by("n", "no").alias("first"), F.collect_list("n").alias("all"))
    scored = per.withColumn("score", F.col("first") * F.size(F.filter("all", lambda n: n == F.col("first"))))
    best = scored.where("score > 0").orderBy(F.desc("score"), "rank").first()
    return best["sep"] if best else BLANKS


def fields(line: str, sep: str) -> list[str]:
    return re.split(sep, line.strip()) if sep == BLANKS else next(csv.reader([line], delimiter=sep, skipinitialspace=True))


def cells(lines: DataFrame, sep: str, width: int) -> DataFrame:
    """(no, cells): `width` cells a line, the missing ones null; lines that have more are no rows. Tokens for null are null."""
    if sep == BLANKS:
        found = F.split(F.trim("line"), sep)
        parts, fits = [F.get(found, k) for k in range(width)], F.size(found) <= width
    else:
        names = [f"c{k}" for k in range(width + 1)]
        row = F.from_csv("line", ", ".join(f"{n} string" for n in names), {"sep": sep, "escape": '"', "ignoreLeadingWhiteSpace": "true"})
        lines = lines.withColumn("row", row)
        parts, fits = [F.col("row")[n] for n in names[:-1]], F.col(f"row.c{width}").isNull()
    clean = lambda c: F.when(~F.trim(c).isin(*NULLS), F.trim(c))
    return lines.where(fits).select("no", F.array(*[clean(c) for c in parts]).alias("cells"))


# What columns are called -----------------------------------------------------------------------
def column_name(cell: str | None) -> str:
    return "_".join(x for x in re.split(r"[\W_]+", (cell or "").lower()) if x)


def is_header(first: list[str | None], known: set[str]) -> bool:
    """Whether a first row names columns: two fifths of it are known names, or any is and no cell is empty, a number or a moment."""
    names = sum(column_name(x) in known for x in first)
    data = any(x is None or re.fullmatch(NUMBER, x) or re.search(MOMENT, x) for x in first)
    return bool(names) and (5 * names >= 2 * len(first) or not data)


def profile(rows: DataFrame) -> dict[int, dict]:
    """By column what its first PROFILE values are: shares of numbers and moments, whether few differ, and whether a step is named early.

    Each task keeps the first values of every column, so the exchange carries no more than those."""
    values = rows.select("no", F.posexplode("cells").alias("place", "value")).where("value is not null")
    first = values.withColumn("rn", F.row_number().over(W.partitionBy("place").orderBy("no"))).where(F.col("rn") <= PROFILE)
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    v = F.col("value")
    per = first.groupBy("place").agg(
        share(F.replace(v, F.lit(",")).rlike(f"^(?:{NUMBER})$")).alias("numbers"), share(v.rlike(MOMENT)).alias("moments"),
        (F.countDistinct("value") <= F.greatest(F.lit(5), F.floor(F.count("*") / 10))).alias("few"), F.max((F.col("rn") <= STEP_PROFILE) & v.rlike(STEP_WORD)).alias("step"),
    )
    return {r["place"]: r.asDict() for r in per.collect()}


#: What a column may be called by its profile, in this order; each name once.
CHOICES = (
    (lambda p: p["moments"] > 0.5, lambda contract: [c for c, kind in contract.items() if kind == "timestamp_ntz"]),
    (lambda p: p["step"], lambda _: ["step_name"]),
    (lambda p: p["numbers"] > 0.8 and p["few"], lambda _: SMALL_NUMBERS),
    (lambda p: p["numbers"] > 0.8, lambda _: LARGE_NUMBERS),
    (lambda p: p["numbers"] < 0.2, lambda _: WORDS),
)
_EMPTY = {"numbers": 0.0, "moments": 0.0, "few": True, "step": False}


def named_by_values(rows: DataFrame, width: int, contract: dict[str, str]) -> list[str]:
    """Names for a headerless table: by place where it is as wide as the contract, else by what its columns hold."""
    if width == len(contract):
        return list(contract)
    profiles, free, out = profile(rows), dict.fromkeys(contract), []
    for k in range(width):
        p = profiles.get(k, _EMPTY)
        name = next((c for test, choice in CHOICES if test(p) for c in choice(contract) if c in free), f"col_{k}")
        free.pop(name, None)
        out.append(name)
    return out


# Tables ----------------------------------------------------------------------------------------
def typed(df: DataFrame, contract: dict[str, str]) -> DataFrame:
    """The contract's columns by name, cast; missing ones are null, unknown ones go."""

    def one(name: str, kind: str) -> Column:
        if name not in df.columns:
            return F.lit(None).cast(kind).alias(name)
        v = token(name)
        if kind == "boolean":
            low = F.lower(v)
            return F.when(low.isin("t", "true", "1", "y", "yes"), True).when(low.isin("f", "false", "0", "n", "no"), False).alias(name)
        return (v if kind == "string" else whole(name) if kind == "long" else v.try_cast(kind)).alias(name)

    return df.select(*[one(n, k) for n, k in contract.items()])


def read(lines: DataFrame, contract: dict[str, str], aliases: dict[str, str], needed: str, order: list[str] = ()) -> DataFrame:
    """Lines (no, line) as a table in its contract's columns; a value that does not fit its type becomes null. Of columns with one name the first counts."""
    kept = content(lines)
    top = kept.orderBy("no").first()
    if top is None:
        raise ValueError("nothing to read")
    sep = separator(kept)
    first = [None if x.strip() in NULLS else x.strip() for x in fields(top["line"], sep)]
    rows = cells(kept, sep, len(first))
    if is_header(first, set(contract) | set(aliases)):
        names, rows = [column_name(x) for x in first], rows.where(F.col("no") > top["no"])
    else:
        names = named_by_values(rows, len(first), contract)
    names = [n if n in contract else aliases.get(n, n) for n in names]
    if needed not in names:
        raise ValueError(f"no column {needed}")
    places = {n: k for k, n in reversed(list(enumerate(names))) if n in contract}
    out = typed(rows.select(*[F.get("cells", k).alias(n) for n, k in places.items()]), contract)
    return out.orderBy(*[F.asc_nulls_last(c) for c in order]) if order else out


def pasted(spark: SparkSession, text: str, contract: dict[str, str], aliases: dict[str, str], needed: str, order: list[str] = ()) -> DataFrame:
    return read(lines_of(spark, text), contract, aliases, needed, order)


def pasted_steps(spark: SparkSession, text: str) -> DataFrame:
    return pasted(spark, text, STEP_COLUMNS, STEP_ALIASES, "step_name", ["stream_id", "segment_id", "step_id"])


def pasted_tables(spark: SparkSession, text: str) -> DataFrame:
    return pasted(spark, text, TABLE_COLUMNS, TABLE_ALIASES, "table")


# Files -----------------------------------------------------------------------------------------
#: What the bytes 128 to 159 stand for in Windows files; the reader knows them as control characters only.
_CONTROLS = "".join(chr(c) for c in range(0x80, 0xA0))
_WINDOWS = "".join(bytes([c]).decode("cp1252", "replace") for c in range(0x80, 0xA0))


def probed(head: bytes) -> tuple[str, str]:
    """(encoding, text) of a file's first bytes: UTF-16 by its mark, UTF-8, else Windows-1252 (which is read as ISO-8859-1)."""
    if head[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "UTF-16", head.decode("utf-16", "ignore")
    try:
        return "UTF-8", head.decode("utf-8-sig")
    except UnicodeDecodeError as error:
        if len(head) == PROBE and error.start > PROBE - 4:  # a character that the probe cuts
            return "UTF-8", head.decode("utf-8-sig", "ignore")
        return "ISO-8859-1", head.decode("cp1252", "ignore")


def imported(spark: SparkSession, path: str) -> DataFrame:
    """A delimited file with a header, all columns text; its first PROBE bytes tell encoding and separator, and no more of it is read for that."""
    encoding, sample = probed(Files(spark).head(path, PROBE))
    sep = separator(lines_of(spark, sample).where("trim(line) <> ''"))
    windows = (lambda t: t.translate(str.maketrans(_CONTROLS, _WINDOWS))) if encoding == "ISO-8859-1" else (lambda t: t)
    value = (lambda c: F.translate(token(c), _CONTROLS, _WINDOWS)) if encoding == "ISO-8859-1" else token
    if sep == BLANKS:
        lines = spark.read.csv(path, schema="line string", sep="\u0001", quote="", encoding=encoding, multiLine=encoding == "UTF-16").withColumn("no", F.monotonically_increasing_id())
        lines = lines.select("no", F.regexp_replace("line", "^\ufeff", "").alias("line")).where("trim(line) <> ''")
        top = lines.orderBy("no").first()
        names = fields(top["line"], sep)
        rows = cells(lines.where(F.col("no") > top["no"]), sep, len(names))
        return rows.select(*[value(F.get("cells", k)).alias(windows(n).strip().lower()) for k, n in enumerate(names)])
    df = spark.read.csv(path, sep=sep, header=True, inferSchema=False, encoding=encoding, mode="DROPMALFORMED", multiLine=encoding == "UTF-16")
    return df.select(*[value(f"`{c}`").alias(windows(c).strip("\ufeff ").lower()) for c in df.columns])
