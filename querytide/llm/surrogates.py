r"""PII surrogates, in DataFrame functions only.

Entities: email addresses, phone numbers, IPv4 addresses, payment card numbers, IBANs and persons
after an honorific. Each becomes a replacement of its own kind, drawn from a keyed SHA-256 stream
over (key, kind, normal form, attempt): digits stay digits, letters stay letters of the same case,
punctuation stays; a card keeps its first digit and its valid check digit; an IBAN keeps its country
and gets the check digits of its new account; a phone number of over ten digits keeps the first, which
opens the country code; an address keeps four octets; a person keeps the honorific and gets names of
its script, with an ending of its gender. A full name that an honorific has told is replaced in the
rest of its document too, where it stands without one.

The normal form (lower case, digits only, single blanks) decides the replacement, so one entity gets
one replacement everywhere, in whatever format it is written. Distinct entities are checked for
collisions, on the table of distinct normal forms, not on texts: a candidate that equals an entity of
the corpus, an assigned replacement or another candidate is drawn again with the next attempt, except
the least of equal candidates. Rounds go on until none is left; after `ROUNDS` (a format whose space
is full) the rest are widened by a suffix from their own hash, checked in the same way, and so leave
their format: a document collection with more entities of a short format than free values has no
other distinct surrogates.

The key comes from the session's setting `spark.querytide.surrogateKey`; without it a fixed key of the
package is taken, which anyone can repeat, so real corpora need the setting.

Texts are matched twice, by regexp_extract_all and split: entities and the gaps between them
alternate, so a text is put together again from its gaps and the replacements. Only texts that hold
an entity are joined with replacements; all others pass unchanged.

Defined results: null stays null; a text without entities stays as it is; rows that share a doc_id
are told apart by their text; all other columns pass through unchanged, those named like the
operator's own included (a column n_entities of the input gives way to the count, if that is asked
for). An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tables

#: Stands in where the session names no key.
KEY, KEY_SETTING = "corpus-surrogates", "spark.querytide.surrogateKey"
ROUNDS = 8
# Honorifics and the gender they tell (f, m or n for neither).
HONORIFICS = {
    "Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Don": "m", "г-н": "m", "Господин": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Madam": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mlle": "f", "Señora": "f", "Señorita": "f", "Sra": "f", "Doña": "f", "г-жа": "f", "Госпожа": "f",
    "Dr": "n", "Prof": "n", "Professor": "n",
}
_NAME = r"\p{Lu}(?:['’]\p{Lu})?[\p{Ll}\p{M}]+(?:['’-]\p{Lu}[\p{Ll}\p{M}]+)?"
#: A look at the first letter comes before the alternatives, which most positions of a text then skip.
_TITLE = f"(?=[{''.join(sorted({x[0] for x in HONORIFICS}))}])(?:{'|'.join(sorted(HONORIFICS, key=len, reverse=True))})"
#: What is no phone number though its digits suffice: dates and spans of years, and numbers whose digits stand in threes.
_YEAR, _MONTH, _DAY = r"(?:19|20)\d\d", r"(?:0?[1-9]|1[0-2])", r"(?:0?[1-9]|[12]\d|3[01])"
_DATE = rf"(?:{_YEAR}[ .-]{_MONTH}[ .-]{_DAY}(?!\d)|{_DAY}[ .-]{_MONTH}[ .-]{_YEAR}(?!\d)|{_YEAR}[ -]{_YEAR}(?!\d))"
_GROUPED = r"[1-9]\d{0,2}(?:[ .]\d{3})+(?!\d|[ .-]\d)"
#: A phone number has a plus sign, a bracketed area code, or nine digits or more in groups that form neither of those.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?\.)+\p{L}{2,}",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d|\.\d)",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}.])\d(?:[ -]?\d){12,18}(?![\p{L}\p{N}])",
    "phone": rf"(?<![\p{{L}}\p{{N}}])(?:(?=\+(?:\D{{0,2}}\d){{8}})\+\d{{1,3}}[ .-]?(?:\(\d{{1,4}}\)[ .-]?)?\d{{2,4}}(?:[ .-]?\d{{2,4}}){{1,3}}|\+\d{{8,15}}|\(\d{{1,4}}\)[ .-]?\d{{2,4}}[ .-]?\d{{2,4}}(?:[ .-]?\d{{2,4}})?|(?<!\d[.-])(?!{_DATE}|{_GROUPED})(?=(?:\d[ .-]?){{9}})\d{{2,4}}[ .-]\d{{2,4}}[ .-]?\d{{2,4}}(?:[ .-]?\d{{2,4}}){{0,2}})(?![\p{{L}}\p{{N}}]|\.\d)",
    "person": rf"(?<![\p{{L}}\p{{N}}]){_TITLE}\.?\x20{_NAME}(?:\x20{_NAME}){{0,2}}",
}
_ANY = "|".join(PATTERNS.values())
_MAYBE = rf"[@\d]|{_TITLE}\.?\x20\p{{Lu}}"
# Syllables and gender endings of made-up names, by script.
SYLLABLES = {"latin": "ba be bi bo da de di do fa fe ga ge ka ke ki ko la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si so ta te ti to va ve vi vo".split(), "cyrillic": "ба бе би бо да де ди до га ге ка ке ки ко ла ле ли ло ма ме ми мо на не ни но па пе ра ре ри ро са се си со та те ти то ва ве ви во".split()}
ENDINGS = {"latin": {"m": "rdo", "f": "lia", "n": "ren"}, "cyrillic": {"m": "рдо", "f": "лия", "n": "рен"}}


def _kind(hit: Column) -> Column:
    out = F.lit("phone")
    for k in ("person", "card", "iban", "ip", "email"):
        out = F.when(hit.rlike(rf"^(?:{PATTERNS[k]})$"), F.lit(k)).otherwise(out)
    return out


def _normal(kind: Column, hit: Column) -> Column:
    digits = F.regexp_replace(hit, r"\D", "")
    return F.when(kind.isin("card", "phone"), digits).when(kind == "iban", F.regexp_replace(hit, " ", "")).when(kind == "email", F.lower(hit)).otherwise(F.regexp_replace(hit, r"\x20+", " "))


def _stream(key: str, kind: Column, normal: Column, attempt: Column) -> Column:
    """128 hex digits of the entity's keyed stream."""
    seed = F.concat_ws("\u0001", F.lit(key), kind, normal, attempt.cast("string"))
    return F.concat(F.sha2(F.concat(seed, F.lit("\u0001a")), 256), F.sha2(F.concat(seed, F.lit("\u0001b")), 256))


def _byte(stream: Column, i: Column) -> Column:
    """Byte i (from 0, around after 62) as a number below 65536: two bytes, so small ranges come out even."""
    return F.conv(F.substring(stream, F.pmod(i, F.lit(62)) * 2 + 1, F.lit(4)), 16, 10).cast("int")


def _of(letters: str, n: Column) -> Column:
    return F.substring(F.lit(letters), F.pmod(n, F.lit(len(letters))) + 1, F.lit(1))


def _same_class(text: Column, stream: Column, shift: int = 0) -> Column:
    """Each digit becomes a digit and each letter a letter of its script and case; the rest stays."""

    def one(c: Column, i: Column) -> Column:
        n = _byte(stream, i + F.lit(shift))
        return (
            F.when(c.rlike(r"^\d$"), F.pmod(n, F.lit(10)).cast("string"))
            .when(c.rlike(r"^\p{IsCyrillic}$"), F.when(c == F.lower(c), _of("абвгдежзиклмнопрстуфхцчшэюя", n)).otherwise(_of("АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", n)))
            .when(c.rlike(r"^\p{L}$"), F.when(c == F.lower(c), _of("abcdefghijklmnopqrstuvwxyz", n)).otherwise(_of("ABCDEFGHIJKLMNOPQRSTUVWXYZ", n)))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: F.length(c) > 0), one), "")


def _luhn(digits: Column, doubled: int) -> Column:
    """Weighted digit sum from the right; the rightmost digit is doubled if `doubled` is 0."""

    def weight(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(F.pmod(i, F.lit(2)) == doubled, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: F.length(c) > 0), weight), F.lit(0), lambda a, x: a + x)


def _mod97(text: Column) -> Column:
    """Remainder by 97 of the number that digits and letters (A is 10) spell."""

    def step(rest: Column, c: Column) -> Column:
        n = F.conv(c, 36, 10).cast("int")
        return F.pmod(rest * F.when(n > 9, 100).otherwise(10) + n, F.lit(97))

    return F.aggregate(F.filter(F.split(text, ""), lambda c: F.length(c) > 0), F.lit(0), step)


def _candidate(key: str, kind: Column, normal: Column, attempt: Column) -> Column:
    stream = _stream(key, kind, normal, attempt)
    local, domain = F.substring_index(normal, "@", 1), F.substring_index(normal, "@", -1)
    top = F.substring_index(domain, ".", -1)
    host = F.expr("1") * F.length(domain) - F.length(top) - 1
    hosts = _stream(key, F.lit("host"), domain, F.lit(0))
    email = F.concat(_same_class(local, stream), F.lit("@"), _same_class(F.substring(domain, F.lit(1), host), hosts), F.lit("."), top)
    ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.pmod(_byte(stream, i * 2), F.lit(254)) + 1).cast("string")), ".")
    body = F.concat(F.substring(normal, 1, 1), _same_class(F.substring(normal, F.lit(2), F.length(normal) - 2), stream))
    valid = F.pmod(_luhn(normal, 1), F.lit(10)) == 0
    check = F.pmod(F.lit(10) - F.pmod(_luhn(body, 0), F.lit(10)), F.lit(10)).cast("string")
    card = F.concat(body, F.when(valid, check).otherwise(F.pmod(_byte(stream, F.lit(60)), F.lit(10)).cast("string")))
    country, account = F.substring(normal, 1, 2), _same_class(F.substring(normal, F.lit(5), F.length(normal)), stream)
    iban = F.concat(country, F.lpad((F.lit(98) - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0"), account)
    return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "iban", iban).when(kind == "person", _person(normal, key, attempt)).when(F.length(normal) > 10, F.concat(F.substring(normal, 1, 1), _same_class(F.substring(normal, F.lit(2), F.length(normal)), stream))).otherwise(_same_class(normal, stream))


def _person(normal: Column, key: str, attempt: Column) -> Column:
    """The honorific, then a made-up name for each name; the last is a family name and has no gender."""
    words = F.split(normal, " ")
    title = F.element_at(words, 1)
    gender = F.element_at(F.create_map(*[F.lit(x) for kv in HONORIFICS.items() for x in kv]), F.regexp_replace(title, r"\.$", ""))
    names = F.slice(words, F.lit(2), F.size(words) - 1)

    def made(script: str, word: Column, stream: Column, last: Column) -> Column:
        table = F.array(*[F.lit(x) for x in SYLLABLES[script]])
        piece = [F.element_at(table, F.pmod(_byte(stream, F.lit(4 * i)), F.lit(len(SYLLABLES[script]))) + 1) for i in range(3)]
        ending = F.lit("")
        for g, e in ENDINGS[script].items():
            ending = F.when(gender == g, F.lit(e)).otherwise(ending)
        return F.initcap(F.concat(*piece, F.when(last, F.lit("")).otherwise(ending)))

    def one(word: Column, i: Column) -> Column:
        last = i == F.size(words) - 2
        # a name's stream depends on the name itself, so it stays the same in every company
        stream = _stream(key, F.when(last, F.lit("family")).otherwise(gender), F.lower(word), attempt)
        return F.when(word.rlike(r"\p{IsCyrillic}"), made("cyrillic", word, stream, last)).otherwise(made("latin", word, stream, last))

    return F.concat_ws(" ", title, F.array_join(F.transform(names, one), " "))


def assigned(entities: DataFrame, key: str = KEY, rounds: int = ROUNDS) -> DataFrame:
    """kind, normal, surrogate: distinct replacements of distinct entities (kind, normal), none of which is an entity."""
    entities = tables.written(entities.distinct(), "entities")
    taken = entities.select("kind", F.col("normal").alias("surrogate"))
    done, rest = None, entities
    for attempt in range(rounds + 1):
        made = _candidate(key, F.col("kind"), F.col("normal"), F.lit(attempt))
        if attempt == rounds:  # the format is full: widen it
            widened = F.substring(_stream(key, F.col("kind"), F.col("normal"), F.lit("wide")), 1, 16)
            made = F.when(F.col("kind").isin("card", "phone", "ip"), F.concat(made, F.conv(widened, 16, 10))).when(F.col("kind") == "email", F.concat(widened, made)).otherwise(F.concat(made, F.translate(widened, "0123456789", "ghijklmnop")))
        drawn = tables.written(rest.withColumn("surrogate", made), f"drawn{attempt}")
        least = drawn.groupBy("kind", "surrogate").agg(F.min("normal").alias("first"))
        blocked = taken if done is None else taken.unionByName(done.select("kind", "surrogate"))
        free = least.join(blocked, ["kind", "surrogate"], "left_anti")
        good = drawn.join(free, ["kind", "surrogate"]).where("normal = first").select("kind", "normal", "surrogate")
        good = tables.written(good, f"good{attempt}")
        done = good if done is None else done.unionByName(good)
        rest = drawn.select("kind", "normal").join(good, ["kind", "normal"], "left_anti")
        if rest.isEmpty():
            break
    return done


def _rendered(kind: Column, hit: Column, surrogate: Column) -> Column:
    """The replacement in the hit's own format."""
    chars = F.filter(F.split(hit, ""), lambda c: F.length(c) > 0)

    def fill(pattern: str) -> Column:
        step = F.aggregate(
            chars,
            F.struct(F.lit(1).alias("at"), F.lit("").alias("out")),
            lambda s, c: F.when(c.rlike(pattern), F.struct((s["at"] + 1).alias("at"), F.concat(s["out"], F.substring(surrogate, s["at"], F.lit(1))).alias("out"))).otherwise(F.struct(s["at"].alias("at"), F.concat(s["out"], c).alias("out"))),
        )
        return F.concat(step["out"], F.substring(surrogate, step["at"], F.length(surrogate)))

    letters = F.filter(F.split(surrogate, ""), lambda c: F.length(c) > 0)
    cased = F.array_join(F.zip_with(letters, chars, lambda new, old: F.when((old == F.upper(old)) & (old != F.lower(old)), F.upper(new)).otherwise(new)), "")
    same_length = (kind == "email") & (F.length(hit) == F.length(surrogate))
    return F.when(kind.isin("card", "phone"), fill(r"^\d$")).when(kind == "iban", fill(r"^[A-Z0-9]$")).when(same_length, cased).otherwise(surrogate)


def _names(kind: Column, hit: Column, new: Column) -> Column:
    """struct(pattern, name) that replaces the full name of a person without the honorific; null for one name alone and for other kinds."""
    bare = lambda text: F.regexp_extract(text, r"^\S+\x20+(.*)$", 1)
    old = F.regexp_replace(bare(hit), r"\x20+", r"\\x20+")
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), old, F.lit(r")(?![\p{L}\p{N}])"))
    return F.when((kind == "person") & (F.size(F.split(bare(hit), r"\x20+")) > 1), F.struct(pattern.alias("pattern"), bare(new).alias("name")))


def replaced(documents: DataFrame, key: str | None = None, counted: bool = True) -> DataFrame:
    """All columns of `documents` with surrogates in `text`, and n_entities (long) if `counted`."""
    key = key or documents.sparkSession.conf.get(KEY_SETTING, KEY)
    names = [c for c in documents.columns if not (counted and c == "n_entities")]
    rows = tables.whole(documents)
    hits = F.when(F.col("text").rlike(_MAYBE), F.regexp_extract_all("text", F.lit(_ANY), F.lit(0)))
    marked = rows.withColumn("_hits", F.coalesce(hits, F.array().cast("array<string>")))
    found = rows.select(F.explode(hits).alias("hit")).distinct()
    found = tables.written(found.withColumn("kind", _kind(F.col("hit"))).withColumn("normal", _normal(F.col("kind"), F.col("hit"))), "hits")
    chosen = assigned(found.select("kind", "normal"), key)
    new = F.coalesce(_rendered(F.col("kind"), F.col("hit"), F.col("surrogate")), F.raise_error(F.concat(F.lit("no surrogate for a "), F.col("kind"))).cast("string"))
    made = found.join(chosen, ["kind", "normal"], "left").select("kind", "hit", new.alias("new"))
    by_hit = tables.written(made.select("hit", F.struct("new", _names(F.col("kind"), F.col("hit"), F.col("new")).alias("bare")).alias("new")), "surrogates")
    plain = marked.where(F.size("_hits") == 0).select("_row", F.lit(0).cast("long").alias("n"))
    same = F.sha2(F.concat_ws("\u0001", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"), 256)
    some = marked.where(F.size("_hits") > 0).withColumn("_same", same)
    ordered = some.select("_same", F.posexplode("_hits").alias("at", "hit")).distinct().join(by_hit.hint("merge"), "hit").groupBy("_same").agg(F.array_sort(F.collect_list(F.struct("at", "new"))).alias("_new"))
    told = F.array_distinct(F.filter(F.transform("_new", lambda n: n["new"]["bare"]), lambda b: b.isNotNull()))
    gap = lambda g: F.aggregate(told, g, lambda text, b: F.regexp_replace(text, b["pattern"], b["name"]))
    put = F.array_join(F.zip_with(F.split("text", _ANY, -1), F.col("_new"), lambda g, n: F.concat(F.when(F.size(told) > 0, gap(g)).otherwise(g), F.coalesce(n["new"]["new"], F.lit("")))), "")
    some = some.join(ordered, "_same").select(F.col("_row").withField("text", put).alias("_row"), F.size("_new").cast("long").alias("n"))
    out = plain.unionByName(some)
    columns = [F.col("_row").getField(c).alias(c) for c in names]
    return out.select(*columns, F.col("n").alias("n_entities")) if counted else out.select(*columns)


def op4_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    return replaced(tables.table(spark, sf_dir, "documents")).select("doc_id", "text", "n_entities")
