r"""Secret scans with multipart credential linking, in DataFrame functions only.

Every kind's pattern is matched with regexp_extract_all and split: matches and the gaps between
them alternate, so a running sum of their lengths (a window over one row's matches) gives code
point positions. Base kinds are reported as they are: assign, access and hex. Weak kinds are parts
that mean little alone: ident (a user or client name), bare (a long mixed token) and endpoint (a
URL or host and port). A weak part is reported only where complementary parts stand within
`SCOPE` code points of it: a bare token near an identifier or an endpoint, an identifier or an
endpoint near a secret. The link is an interval join: strong and weak parts meet in the bins of
`SCOPE` code points that they reach, as a left semi join, which returns each part at most once a
bin however many partners it has; parts of any length stand in all bins they reach. Weak parts that
overlap a base span give way to it.

Only matches are shuffled, never texts. Defined results: null is the empty text. Rows that share a
doc_id are told apart by their text; equal rows give equal results. Other columns are ignored. An
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tables

SCOPE = 300
# kind -> (pattern, group whose length counts, least length, role); fixed values of the contract for the first three
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, "secret"),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20, "ident"),  # shorter runs fail as a whole, so asking for the length finds the same matches
    "hex": (r"[0-9a-f]{24,}", 0, 24, "secret"),
}
WEAK = {
    "ident": (r"""(?i)\b(?:client_?id|user_?name|user|login|account|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+_.-]{3,})""", 0, 1, "ident"),
    "bare": (r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{32,}+={0,2}(?![A-Za-z0-9+/_=-])", 0, 32, "secret"),
    "endpoint": (r"""(?i)\b(?:https?|ftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]{3,}""", 0, 1, "endpoint"),
}
KINDS = {**BASE, **WEAK}
NUMBER = {k: i for i, k in enumerate(KINDS)}


def _matches(kind: str) -> Column:
    """array<struct<kind, place, gap, hit, counted>> of a text's matches of one kind, in lengths of code points."""
    pattern, group, _, _ = KINDS[kind]
    p = F.lit(pattern)
    hits = F.zip_with(F.regexp_extract_all("text", p, F.lit(0)), F.regexp_extract_all("text", p, F.lit(group)), lambda h, g: F.struct(F.length(h).alias("hit"), F.length(g).alias("counted")))
    pairs = F.zip_with(hits, F.split("text", pattern, -1), lambda h, gap: F.struct(h.alias("h"), F.length(gap).alias("gap")))
    rows = F.transform(
        F.filter(pairs, lambda x: x["h"].isNotNull()),
        lambda x, i: F.struct(F.lit(NUMBER[kind]).alias("kind"), i.alias("place"), x["gap"].alias("gap"), x["h"]["hit"].alias("hit"), x["h"]["counted"].alias("counted")),
    )
    empty = F.array().cast("array<struct<kind:int,place:int,gap:int,hit:int,counted:int>>")
    return F.when(F.col("text").rlike(pattern), rows).otherwise(empty)


def parts(docs: DataFrame, key: list[str]) -> DataFrame:
    """key, kind, start, end of every match of every kind that passes its length rule."""
    found = docs.select(*key, F.explode(F.concat(*[_matches(k) for k in KINDS])).alias("m")).select(*key, "m.*")
    if "_tag" in key:  # equal rows give equal matches: their places must count once
        found = found.distinct()
    run = W.partitionBy(*key, "kind").orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = found.withColumn("end", F.sum(F.col("gap") + F.col("hit")).over(run)).withColumn("start", F.col("end") - F.col("hit"))
    passes = F.lit(False)
    for k, (_, _, least, _) in KINDS.items():
        passes = passes | ((F.col("kind") == NUMBER[k]) & (F.col("counted") >= least))
    return placed.where(passes).select(*key, "kind", "start", "end")


def _bins(low: Column, high: Column) -> Column:
    """The bins of SCOPE code points from low to high."""
    return F.explode(F.sequence(F.floor(low / SCOPE), F.floor(high / SCOPE)))


def _kinds(*roles: str, among: dict | None = None) -> list[int]:
    return [NUMBER[k] for k, v in (among or KINDS).items() if v[3] in roles]


def linked(found: DataFrame, key: list[str]) -> DataFrame:
    """Base parts, and the weak parts with complementary parts in scope."""
    base = found.where(F.col("kind") < len(BASE))
    part = [*key, "kind", "start", "end"]
    reached = lambda parts, more=0: parts.withColumn("bin", _bins(F.col("start") - more, F.col("end") + more))
    same = F.lit(True)
    for k in [*key, "bin"]:
        same = same & (F.col(f"w.{k}") == F.col(f"b.{k}"))
    weak = found.where(F.col("kind") >= len(BASE))
    over = (F.col("w.start") < F.col("b.end")) & (F.col("b.start") < F.col("w.end"))
    # parts grow with the corpus: sort-merge joins at every size
    covered = reached(weak).alias("w").join(reached(base).alias("b").hint("merge"), same & over, "left_semi").select(*part).distinct()
    weak = weak.join(covered.hint("merge"), part, "left_anti")
    partners = reached(base.unionByName(weak), SCOPE)
    near = (F.col("w.start") - F.col("b.end") <= SCOPE) & (F.col("b.start") - F.col("w.end") <= SCOPE)
    fits = (F.col("w.kind").isin(_kinds("secret", among=WEAK)) & F.col("b.kind").isin(_kinds("ident", "endpoint"))) | (F.col("w.kind").isin(_kinds("ident", "endpoint", among=WEAK)) & F.col("b.kind").isin(_kinds("secret")))
    kept = reached(weak).alias("w").join(partners.alias("b").hint("merge"), same & near & fits, "left_semi").select(*part).distinct()
    return base.unionByName(kept)


def _listed(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _counted(kind: int) -> Column:
    return F.size(F.filter("all", lambda s: s["kind"] == kind)).cast("long")


def secrets(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row."""
    docs, key = tables.keyed(documents, "text")
    found = tables.written(parts(docs, key), "parts")
    spans = linked(found, key).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("all"))
    every = docs.select(*key).join(spans.hint("merge"), key, "left").withColumn("all", F.coalesce("all", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")))
    count = [_counted(NUMBER[k]).alias(f"n_{k}") for k in BASE]
    base = F.filter("all", lambda s: s["kind"] < len(BASE))
    return every.select(tables.doc_id(), *count, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("all")).alias("spans"))


def op8_secret_linking(spark, sf_dir: str) -> DataFrame:
    return secrets(tables.table(spark, sf_dir, "documents"))
