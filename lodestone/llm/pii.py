"""Surrogates for personal data, in DataFrame operations only.

Detected entities (e-mail and IP addresses, phone, card, account and social security numbers,
secrets, persons' names) are replaced by others of the same type and format.  A replacement is a
keyed bijection of the entity's canonical form within its format: characters keep their kind
(digit, hex digit, vowel or consonant of their script, case), and each is shifted within its kind by
a hash of the key, the format and all characters before it, forwards and then backwards.  So

* different entities of a format have different surrogates, and the same entity has the same one
  everywhere, however it is written (letter case, punctuation of numbers): coreference holds, and a
  surname alone matches the surname of the full name;
* card numbers keep their Luhn status, account numbers their country and whether their check number is
  right, secrets their prefix, addresses their top-level domain, numbers their country code,
  IP addresses stay in range (or in their groups), names keep gender (first names are exchanged within the list of their
  gender and script; the end of a surname stays) and script.

The collision check runs over the distinct entities of the whole corpus, in canonical form (persons
by their surname), so that surrogates are distinct and none is a real entity of the corpus, itself
included.  Those of the bijection that are get another one by entity, see `resolved`.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.sequences import numbered
from .common import free_name, sized, written

#: A format of which the corpus holds more than 1 in so many values is enumerated.
ROOM = 8
FORMAT = ["kind", "head", "tail", "shape"]
# First names by gender and script.
MALE = ["James", "John", "Robert", "Michael", "William", "David", "Thomas", "Daniel", "Peter", "Hans", "Klaus", "Jürgen", "Stefan", "Pierre", "Jacques", "François", "Philippe", "Carlos", "José", "Juan", "Miguel", "Pedro"]
FEMALE = ["Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Susan", "Sarah", "Emma", "Anna", "Julia", "Ursula", "Sabine", "Petra", "Marie", "Sophie", "Camille", "Nathalie", "Carmen", "María", "Lucía", "Isabel", "Teresa"]
MALE_CYRILLIC = ["Иван", "Пётр", "Сергей", "Алексей", "Дмитрий", "Николай", "Михаил", "Андрей"]
FEMALE_CYRILLIC = ["Анна", "Мария", "Елена", "Ольга", "Наталья", "Татьяна", "Ирина", "Светлана"]
MALE_GREEK = ["Γιώργος", "Δημήτρης", "Νίκος", "Κώστας", "Γιάννης"]
FEMALE_GREEK = ["Μαρία", "Ελένη", "Κατερίνα", "Βασιλική", "Σοφία"]
NAMES = [MALE, FEMALE, MALE_CYRILLIC, FEMALE_CYRILLIC, MALE_GREEK, FEMALE_GREEK]
TITLES = ["Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora"]
#: Characters that may replace each other.
KINDS = ["0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "àâäéèêëîïôöùûüáíóú", "ñçß", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "άέήίόύώ"]
HEX = ["0123456789abcdef"]

_FIRST = "(?:" + "|".join(n for names in NAMES for n in names) + ")"
_SURNAME = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"
#: The first that matches at a place wins; none begins or ends within a word or number.
PATTERNS = {
    "email": r"[\p{L}\p{N}._%+-]{1,64}@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){1,8}",
    "secret": r"(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|sk-[A-Za-z0-9]{20,64}|gh[pousr]_[A-Za-z0-9]{36,64})(?![\p{L}\p{N}])",
    "ipv6": r"(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])",
    "ip": r"(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "phone": r"(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|\d{3}-\d{4})(?!\d)",
    "ssn": r"\d{3}-\d{2}-\d{4}(?!\d)",
    "card": r"\d(?:[ -]?\d){12,18}(?!\d)",
    "person": rf"(?:(?:{'|'.join(TITLES)})\.? (?:{_FIRST} )?{_SURNAME}|{_FIRST} {_SURNAME})(?!\p{{L}})",
}
ANY = r"(?<![\p{L}\p{N}])(?:" + "|".join(PATTERNS.values()) + ")"
_MARK = "\x01"


def pieces(text: Column) -> Column:
    """The text in turns of plain text and entity, beginning with plain text."""
    marked = F.split(F.regexp_replace(text, f"({ANY})", f"{_MARK}$1{_MARK}"), _MARK)
    # A text with the mark in it is cut by the pattern itself.
    plain, found = F.split(text, ANY), F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1))
    slow = F.flatten(F.zip_with(plain, found, lambda p, e: F.when(e.isNull(), F.array(p)).otherwise(F.array(p, e))))
    return F.when(F.instr(text, _MARK) > 0, slow).otherwise(marked)


def kind_of(entity: Column) -> Column:
    out = None
    for kind, pattern in PATTERNS.items():
        test = entity.rlike(f"^(?:{pattern})$")
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("other")


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _one_way(entity: Column, characters: Column, label: str) -> Column:
    """Shifts each character within its kind by a hash of what stands before it; one of no kind stays."""
    start = F.struct(F.lit("").alias("seen"), F.lit("").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        kind = F.get(F.filter(entity["kinds"], lambda k: F.instr(k, c) > 0), F.lit(0))
        hashed = F.pmod(F.xxhash64(entity["key"], F.lit(label), entity["shape"], acc["seen"]), F.length(kind))
        moved = F.substring(kind, (F.pmod(F.instr(kind, c) - 1 + hashed, F.length(kind)) + 1).cast("int"), F.lit(1))
        return F.struct(F.concat(acc["seen"], c).alias("seen"), F.concat(acc["out"], F.coalesce(moved, c)).alias("out"))

    return F.aggregate(characters, start, step, lambda acc: acc["out"])


def _like(original: Column, lower: Column) -> Column:
    """lower in the letter case of original, character by character, where they are equally long."""
    cased = F.zip_with(_characters(original), _characters(lower), lambda o, c: F.when(o != F.lower(o), F.upper(c)).otherwise(c))
    return F.when(F.length(original) == F.length(lower), F.array_join(cased, "")).otherwise(lower)


def _number(entity: Column, digits: Column) -> Column:
    """entity with its digits replaced in turn by the characters of digits."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        digit = F.instr(F.lit(KINDS[0]), c) > 0
        put = F.when(digit, F.substring(digits, acc["at"] + 1, F.lit(1))).otherwise(c)
        return F.struct((acc["at"] + digit.cast("int")).alias("at"), F.concat(acc["out"], put).alias("out"))

    return F.aggregate(_characters(entity), start, step, lambda acc: acc["out"])


def _filled(text: Column, characters: Column) -> Column:
    """text with all but its spaces replaced in turn by the characters."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        put = F.when(c == " ", c).otherwise(F.substring(characters, acc["at"] + 1, F.lit(1)))
        return F.struct((acc["at"] + (c != " ").cast("int")).alias("at"), F.concat(acc["out"], put).alias("out"))

    return F.aggregate(_characters(text), start, step, lambda acc: acc["out"])


def _account_check(account: Column, country: Column) -> Column:
    """The right check number of an account in a country: 98 less the number that they spell, modulo 97."""

    def step(rest: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), F.pmod(rest * 10 + F.ascii(c) - 48, F.lit(97))).otherwise(F.pmod(rest * 100 + F.ascii(c) - 55, F.lit(97)))

    return 98 - F.aggregate(_characters(F.concat(F.upper(account), country, F.lit("00"))), F.lit(0), step)


def _account(middle: Column) -> Column:
    """An account number without spaces and check number, from what follows its country."""
    bare = F.replace(middle, F.lit(" "), F.lit(""))
    return F.substring(bare, F.lit(3), F.length(bare))


def _luhn(digits: Column) -> Column:
    """The check digit that would follow digits."""
    doubled = F.transform(F.reverse(_characters(digits)), lambda c, i: F.when(i % 2 == 0, 2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.pmod(-F.aggregate(doubled, F.lit(0), lambda s, x: s + x), F.lit(10))


def _first_names(key: str) -> dict[str, str]:
    """Each list is turned by a keyed number of places, so no name stays and all stay distinct."""
    out = {}
    for names in NAMES:
        turn = 1 + int.from_bytes(hashlib.sha256((key + names[0]).encode()).digest()[:8], "big") % (len(names) - 1)
        out |= {n: names[(i + turn) % len(names)] for i, n in enumerate(names)}
    return out


def _kinds(kind: Column) -> Column:
    return F.when(kind.isin("ip", "ipv6", "hex"), F.array(*map(F.lit, HEX))).otherwise(F.array(*map(F.lit, KINDS)))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def _canonical(found: Column, key: str) -> Column:
    """An array of entities in steps, each an array of structs.

    head and tail stay; body, the canonical form between them, goes through the bijection of its
    shape and kinds.
    """
    hexed = lambda o: F.lower(F.lpad(F.hex(o.cast("int")), 2, "0"))

    def typed(e: Column) -> Column:
        kind = kind_of(e)
        in_range = F.forall(F.split(e, r"\."), lambda o: o.cast("int") < 256)
        return F.struct(e.alias("old"), F.when((kind == "secret") & e.rlike("^[0-9a-fA-F]+$"), "hex").when((kind == "ip") & ~in_range, "version").otherwise(kind).alias("kind"))

    def split(e: Column) -> Column:
        old, kind = e["old"], e["kind"]
        surname = F.element_at(F.split(old, " "), -1)
        head = F.when(kind == "phone", F.regexp_extract(old, r"^\+\d{1,3}(?=[ .(-])", 0)).when(kind == "secret", F.regexp_extract(old, "^(?:AKIA|sk-|gh[pousr]_)", 0)).when(kind == "iban", F.substring(old, F.lit(1), F.lit(2))).when(kind == "person", F.substring(old, F.lit(1), F.length(old) - F.length(surname))).otherwise("")
        tail = F.when(kind == "email", F.lower(F.regexp_extract(old, r"\.[^.]+$", 0))).when(kind == "person", F.substring(surname, F.greatest(F.length(surname) - 2, F.lit(1)) + 1, F.length(surname))).when(kind == "card", F.substring(_digits(old), -1, 1)).when(kind == "iban", F.lpad(F.pmod(F.substring(old, F.lit(3), F.lit(2)).cast("int") - _account_check(_account(F.substring(old, F.lit(3), F.length(old))), F.substring(old, F.lit(1), F.lit(2))), F.lit(97)).cast("string"), 2, "0")).otherwise("")
        kept = F.when(kind.isin("email", "person"), F.length(tail)).otherwise(0)
        middle = F.substring(old, F.length(head) + 1, F.length(old) - F.length(head) - kept)
        return F.struct(old.alias("old"), kind.alias("kind"), head.alias("head"), tail.alias("tail"), middle.alias("middle"))

    def canonical(e: Column) -> Column:
        kind, middle = e["kind"], e["middle"]
        body = F.when(kind.isin("phone", "ssn"), _digits(middle)).when(kind == "card", F.substring(_digits(middle), F.lit(1), F.length(_digits(middle)) - 1)).when(kind == "ip", F.array_join(F.transform(F.split(middle, r"\."), hexed), "")).when(kind == "iban", F.lower(_account(middle))).otherwise(F.lower(middle))
        shape = F.when(kind.isin("ip", "hex"), F.length(body).cast("string")).when(kind == "ipv6", F.regexp_replace(body, "[0-9a-f]", "0")).otherwise(F.translate(body, "".join(KINDS), "".join(k[0] * len(k) for k in KINDS)))
        return F.struct(*[e[c].alias(c) for c in ("old", "kind", "head", "tail", "middle")], body.alias("body"), _kinds(kind).alias("kinds"), shape.alias("shape"), F.concat(F.lit(key), kind).alias("key"))

    return F.transform(F.transform(F.transform(found, typed), split), canonical)


def _bijection(steps: Column, fields: list[str]) -> Column:
    """Structs of fields with new, their body moved within its shape and kinds."""

    def moved(e: Column, source: str, label: str) -> Column:
        out = F.reverse(_one_way(e, _characters(e[source]), label))
        return F.struct(*[e[c].alias(c) for c in fields], out.alias("new"))

    return F.transform(F.transform(steps, lambda e: moved(e, "body", ">")), lambda e: moved(e, "new", "<"))


def _finished(steps: Column, key: str) -> Column:
    """The new entities, each put together from new in the format of the old one."""

    def made(e: Column) -> Column:
        kind, new, known = e["kind"], e["new"], F.create_map(*[F.lit(x) for pair in _first_names(key).items() for x in pair])
        last = F.pmod(_luhn(new) + e["tail"].cast("int") - _luhn(e["body"]), F.lit(10)).cast("string")
        octets = F.array_join(F.transform(F.array(*map(F.lit, (1, 3, 5, 7))), lambda i: F.conv(F.substring(new, i, F.lit(2)), 16, 10)), ".")
        # The least right check number is 2, and there are 97 of them.
        check = F.lpad((F.pmod(_account_check(new, e["head"]) + F.when(kind == "iban", e["tail"]).cast("int") - 2, F.lit(97)) + 2).cast("string"), 2, "0")
        names = F.array_join(F.transform(F.split(e["head"], " "), lambda p: F.coalesce(known[p], p)), " ")
        return (
            F.when(kind == "phone", F.concat(e["head"], _number(e["middle"], new)))
            .when(kind == "ssn", _number(e["old"], new))
            .when(kind == "card", _number(e["old"], F.concat(new, last)))
            .when(kind == "ip", octets)
            .when(kind == "person", F.concat(names, _like(e["middle"], new), e["tail"]))
            .when(kind == "email", _like(e["old"], F.concat(new, e["tail"])))
            .when(kind.isin("hex", "ipv6"), _like(e["old"], new))
            .when(kind == "secret", F.concat(e["head"], _like(e["middle"], new)))
            .when(kind == "iban", F.concat(e["head"], _filled(e["middle"], F.concat(check, F.upper(new)))))
            .otherwise(e["old"])
        )

    return F.transform(steps, made)


FIELDS = ["old", "kind", "head", "tail", "middle", "body", "kinds", "shape", "key"]


def surrogates(found: Column, key: str) -> Column:
    """The surrogates of an array of entities by the bijection alone."""
    return _finished(_bijection(_canonical(found, key), FIELDS), key)


def _values(found: DataFrame, key: str) -> DataFrame:
    """entity and its value: FORMAT and body.  Entities that are kept on purpose have none."""
    e = F.col("e")
    # The check digit of a card is made of its body and what that leaves over, which stays.
    over = F.pmod(e["tail"].cast("int") - _luhn(e["body"]), F.lit(10)).cast("string")
    head = F.when(e["kind"] == "person", "").otherwise(e["head"])
    tail = F.when(e["kind"] == "card", over).otherwise(F.lower(e["tail"]))
    rows = found.select("entity", F.get(_canonical(F.array("entity"), key), F.lit(0)).alias("e"))
    return rows.where(~e["kind"].isin("version", "other")).select("entity", e["kind"].alias("kind"), head.alias("head"), tail.alias("tail"), e["shape"].alias("shape"), e["body"].alias("body"))


def _turned(values: DataFrame, key: str) -> DataFrame:
    """values with new, their body through the bijection of key."""
    e = F.struct("body", "shape", _kinds(F.col("kind")).alias("kinds"), F.concat(F.lit(key), "kind").alias("key"))
    return values.withColumn("new", F.get(_bijection(F.array(e), ["body", "shape", "kinds", "key"]), F.lit(0))["new"])


def _room(body: Column, kind: Column) -> Column:
    """How many values the format of a body has."""
    size = lambda c: F.coalesce(F.length(F.get(F.filter(_kinds(kind), lambda k: F.instr(k, c) > 0), F.lit(0))), F.lit(1))
    return F.aggregate(_characters(body), F.lit(1.0), lambda acc, c: acc * size(c))


def _nth(body: Column, kind: Column, n: Column) -> Column:
    """The n-th value of the format of a body, as digits of mixed radix."""

    def step(acc: Column, c: Column) -> Column:
        own = F.coalesce(F.get(F.filter(_kinds(kind), lambda k: F.instr(k, c) > 0), F.lit(0)), c)
        put = F.substring(own, (F.pmod(acc["rest"], F.length(own)) + 1).cast("int"), F.lit(1))
        return F.struct(F.floor(acc["rest"] / F.length(own)).cast("bigint").alias("rest"), F.concat(acc["out"], put).alias("out"))

    return F.aggregate(_characters(body), F.struct(n.cast("bigint").alias("rest"), F.lit("").alias("out")), step, lambda acc: acc["out"])


def _ranked(values: DataFrame, key: str) -> DataFrame:
    """FORMAT, body and its rank from 0 within the format, in the order of a hash."""
    rows = written(numbered(values.select(*FORMAT, "body", F.xxhash64(F.lit(key), "body").alias("_hash")), [*FORMAT, "_hash", "body"]), "pii-ranks")
    first = rows.groupBy(*FORMAT).agg(F.min("nth").alias("_first"))
    return rows.join(first, FORMAT).select(*FORMAT, "body", (F.col("nth") - F.col("_first")).alias("rank"))


def _enumerated(values: DataFrame, tight: DataFrame, key: str) -> DataFrame:
    """values of tight formats with new: the free values of the format are dealt out in the order of a hash.

    Where there are fewer of them than real ones, the last real ones take each other's values in a
    round (a last single one takes that of the first): distinct, and itself only if the format has
    no other value.
    """
    values = values.join(tight.select(*FORMAT), FORMAT, "left_semi")
    place = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("room").cast("bigint") - 1))
    every = tight.select(*FORMAT, "sample", place.alias("n")).select(*FORMAT, _nth(F.col("sample"), F.col("kind"), F.col("n")).alias("body"))
    free = _ranked(every.join(values, [*FORMAT, "body"], "left_anti"), key).withColumnRenamed("body", "new")
    real = written(_ranked(values, key), "pii-real")
    dealt = real.join(free, [*FORMAT, "rank"]).select(*FORMAT, "body", "new")
    left = real.join(tight.select(*FORMAT, "held", (F.col("room") - F.col("held")).cast("bigint").alias("free")), FORMAT).where("rank >= free")
    back = F.when(F.col("held") - F.col("free") > 1, F.col("free")).otherwise(0)
    left = left.select(*FORMAT, "body", F.when(F.col("rank") + 1 < F.col("held"), F.col("rank") + 1).otherwise(back).alias("rank"))
    return dealt.unionByName(left.join(real.withColumnRenamed("body", "new"), [*FORMAT, "rank"]).select(*FORMAT, "body", "new"))


def resolved(values: DataFrame, key: str) -> DataFrame:
    """The distinct values (FORMAT, body) whose surrogate isn't that of the bijection, with their new body.

    A value whose surrogate is a real one of the corpus goes through the bijections of further keys
    until one gives a value that is neither real nor taken.  A format of which the corpus holds
    more than one in ROOM values is enumerated instead, so each round settles most of what is left.
    """
    # The bijection is dear and its rows are short: they are dealt to all tasks.
    tasks = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = written(_turned(values.select(*FORMAT, "body").distinct().repartition(tasks, "body"), f"{key}/0/"), "pii-values")
    counted = made.groupBy(*FORMAT).agg(F.count("*").alias("held"), F.min("body").alias("sample"))
    tight = written(counted.withColumn("room", _room(F.col("sample"), F.col("kind"))).where(F.col("held") * ROOM > F.col("room")), "pii-tight")
    whole, at = [*FORMAT, "body"], [*FORMAT, "new"]
    real, taken = made.select(*FORMAT, F.col("body").alias("new")), made.select(*at)
    left = written(made.join(real, at, "left_semi").join(tight, FORMAT, "left_anti").select(*whole), "pii-left")
    out = written(_enumerated(made.select(*whole), tight, key), "pii-enumerated") if not tight.isEmpty() else left.withColumn("new", F.col("body")).limit(0)
    step = 0
    while not left.isEmpty():
        step += 1
        tried = _turned(left, f"{key}/{step}/")
        good = written(tried.join(real, at, "left_anti").join(taken, at, "left_anti").select(*whole, "new"), "pii-settled")
        out, taken = out.unionByName(good), taken.unionByName(good.select(*at))
        left = written(left.join(good, whole, "left_anti"), "pii-left")
    return out


def exceptions(found: DataFrame, key: str) -> DataFrame:
    """entity and made, for the entities whose surrogate isn't that of the bijection."""
    values = written(_values(found, key), "pii-entities")
    rows = values.join(resolved(values, key), [*FORMAT, "body"]).select("entity", "new")
    step = F.transform(_canonical(F.array("entity"), key), lambda e: F.struct(*[e[c].alias(c) for c in FIELDS], F.col("new").alias("new")))
    return written(rows.select("entity", F.get(_finished(step, f"{key}/0/"), F.lit(0)).alias("made")), "pii-exceptions")


def pseudonymise(docs: DataFrame, key: str, count: str | None = "n_entities") -> DataFrame:
    """docs with the entities in text replaced, and their number added in a column named by count, which
    replaces one of that name.

    All other columns stay as they are, in their order, whatever their names; rows stay as they come, and
    repeated ones come out equal.  A null text stays null with no entity; texts without an entity, empty
    ones among them, stay the same; of very long texts all is read.  Where entities overlap, the first
    and of those at one place the first kind in PATTERNS is taken.  An empty table gives no rows.
    """
    kept = [c for c in docs.columns if c != count]
    row, parts, fix, found = (free_name(docs.columns, x) for x in ("_pii_row", "_pii_pieces", "_pii_fix", "_pii_new"))
    others = [F.col(f"`{c}`") for c in kept if c != "text"]
    rows = written(docs.select(*others, F.monotonically_increasing_id().alias(row), pieces(F.col("text")).alias(parts)), "pii-pieces")
    entity = F.filter(parts, lambda p, i: i % 2 == 1)
    made = exceptions(rows.select(F.explode(entity).alias("entity")).distinct(), key)
    new = surrogates(entity, f"{key}/0/")
    if n := made.count():
        places = rows.select(row, F.posexplode(entity).alias("at", "entity")).join(sized(made, n, 512), "entity")
        fixes = written(places.groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct("at", "made"))).alias(fix)), "pii-fixes")
        held = fixes.agg(F.sum(F.size(fix))).first()[0] or 0
        rows = rows.join(sized(fixes, held, 512), row, "left")
        new = F.when(F.col(fix).isNull(), new).otherwise(F.transform(new, lambda s, i: F.coalesce(F.try_element_at(fix, i), s)))
    rows = rows.withColumn(found, new)
    text = F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.get(F.col(found), F.floor(i / 2).cast("int"))).otherwise(p)), "")
    out = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in kept]
    return rows.select(*out, *([F.greatest(F.coalesce(F.size(found), F.lit(0)), F.lit(0)).alias(count)] if count else []))
