"""Personal data and secrets replaced by keyed surrogates of the same kind.

Entities are found by pattern: e-mail addresses of any script, phone numbers, IPv4 and IPv6 addresses,
bank accounts (IBAN), payment cards, social security numbers, named persons after a title, access keys
and assigned secrets.  Every distinct entity (its canonical value: an address in lower case, a number's
digits, a phone's country code and number, one name) gets one surrogate, drawn from a keyed hash of (kind, value, attempt), so all mentions of an entity stay
mentions of one entity and nobody without the key can undo or guess a draw.  A surrogate keeps the
kind and the form: length, letter case, separators and country code; a card keeps its
issuer digit and a valid check digit, an account its country and valid check digits; an IP address stays
one of its version; a name keeps its script (a script without an alphabet here lends the name's own
letters).  A given name, which has another name behind it, takes the gender of its titles if they agree;
a family name is the same for all who bear it, in Cyrillic with the ending's gender.  An initial
becomes another letter of its alphabet, by a keyed permutation, so different initials stay different.

A phone number without a country code counts as one of ``HOME``.  The key is a parameter, by default the
session's ``impressa.surrogate.key``; ``TEST_KEY`` stands in where neither is given and protects nothing.

A name found after a title is replaced everywhere in its document, also where a capitalised mention has
no title; such mentions are not counted in ``n_entities``.  Numbers of 13 to 19 digits that are not
grouped in fours are cards only if their check digit is right.

Distinct entities stay distinct: a draw that equals another entity's surrogate or any original
value is refused, the smallest value keeps a contested draw, and the others draw again with the
next attempt until none is left.  This runs on the table of distinct entities, by joins and
aggregations, and a round handles only what the last one refused.

Only DataFrame functions run.  Documents without an entity never enter a shuffle; a much repeated
entity meets partial aggregates and a join that Spark can split.

Defined cases: null and empty texts stay as they are; an entity repeated in a text or in many is
replaced alike everywhere; equal rows are replaced alike; an empty table gives no rows; extra
columns pass through (names that begin with two underscores are reserved, and a column ``n_entities`` is
replaced).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from impressa.llm.exprs import let
from impressa.llm.registry import query, table
from impressa.session import cut_lineage

KEY_CONF = "impressa.surrogate.key"
TEST_KEY = "surrogate-key-1"
HOME = "1"  # country code of phone numbers that show none
MAX_ATTEMPTS = 64
MALE, FEMALE, ANY = "Mr|Herr|Monsieur|Señor|Sr|Г-н|Господин", "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Г-жа|Госпожа", "Dr|Prof"
EMAIL = r"[\p{L}\p{M}\p{N}._%+-]+@[\p{L}\p{M}\p{N}-]+(?:\.[\p{L}\p{M}\p{N}-]+)*\.\p{L}{2,}"
SECRET = r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\s*[=:]\s*[\"']?[A-Za-z0-9+/_.-]{8,}"
ACCESS = r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)"
HEX = "[0-9A-Fa-f]{1,4}"
IP6 = (rf"(?<![\w:.])(?:(?:{HEX}:){{7}}{HEX}|(?=[0-9A-Fa-f:]*[0-9])[0-9A-Fa-f]{{2,4}}(?::{HEX}){{0,5}}::(?:{HEX}(?::{HEX}){{0,5}})?)(?![\w:])")
IBAN = r"\b[A-Z]{2}\d{2}(?=(?:[A-Z ]{0,6}\d){8})(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"
CARD = r"(?<!\d)\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}(?!\d)"
LONG_CARD = r"(?<![\d+])(?:\d{4}[ -]\d{6}[ -]\d{4,5}|\d{13,19})(?!\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)|\d{3})[ .-]\d{3}[ .-]\d{4}(?!\d)"
ABROAD = r"(?<![\w+])\+(?=(?:[ .()-]{0,2}\d){8,15}(?!\d))\d{1,3}(?:[ .-]?\(?\d{1,8}\)?){1,6}(?!\d)"
COUNTRY = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
# A title, then names and initials; a line may break behind the title and behind an initial.
FULL = r"\p{Lu}[\p{L}\p{M}'’-]+"
NAME = rf"\b(?:{MALE}|{FEMALE}|{ANY})\.?[ \t]*(?:[ \t]|\r?\n)[ \t]*(?:\p{{Lu}}\.(?:[ \t]*\r?\n)?[ \t]*){{0,3}}{FULL}(?: (?:\p{{Lu}}\. )?{FULL}){{0,2}}"
# Alphabets of initials.
ALPHABETS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝŁŚŠŻŽČĆĐ")
KINDS = {"email": EMAIL, "secret": SECRET, "access": ACCESS, "iban": IBAN, "ip6": IP6, "ip": IP, "ssn": SSN, "card": CARD.replace(r"\1", "[ -]?").replace("([ -]?)", "[ -]?"),
         "phone": PHONE, "abroad": ABROAD, "long": LONG_CARD, "name": NAME}
ENTITY = "|".join(f"(?:{p})" for p in KINDS.values())
# Cheap test that every text with an entity passes.
HINT = rf"[0-9@]|(?i:password|passwd|pwd|secret|token|key)|\b(?:{MALE}|{FEMALE}|{ANY})\b"


def has_entity(text: Column) -> Column:
    return F.coalesce(text.rlike(HINT) & text.rlike(ENTITY), F.lit(False))


def parts(match: Column) -> Column:
    """Array of (before, raw, kind, value, gender): what a match consists of; ``before`` is kept."""
    form = F.coalesce(*[F.when(match.rlike(f"^(?:{p})$"), k) for k, p in KINDS.items()])
    number = F.regexp_replace(match, "[^0-9]", "")
    valid = _luhn(F.substring(number, F.lit(1), F.length(number) - 1)) == F.right(number, F.lit(1))
    kind = F.when(form == "abroad", "phone").when(form == "long", F.when(valid, "card").otherwise("plain")).otherwise(form)
    before = F.when(kind == "secret", F.regexp_extract(match, r"^(\w+[^=:]*[=:]\s*[\"']?)", 1)).otherwise(F.lit(""))

    def simple(kind: Column, before: Column) -> Column:
        raw = F.substring(match, F.length(before) + 1, F.length(match))
        digits = F.regexp_replace(raw, "[^0-9]", "")
        ten = raw.rlike(f"^(?:{PHONE})$")
        national = F.when(ten, F.right(digits, F.lit(10))).otherwise(F.regexp_replace(digits, COUNTRY, ""))
        country = F.when(ten & (F.length(digits) == 10), F.lit(HOME)).when(ten, F.substring(digits, F.lit(1), F.length(digits) - 10)) \
            .otherwise(F.regexp_extract(digits, COUNTRY, 0))
        value = F.when(kind.isin("email", "ip6"), F.lower(raw)).when(kind == "phone", F.concat_ws("-", country, national)) \
            .when(kind.isin("card", "ssn"), digits).when(kind == "iban", F.replace(raw, F.lit(" "), F.lit(""))).otherwise(raw)
        return F.array(F.struct(before.alias("before"), raw.alias("raw"), kind.alias("kind"), value.alias("value"),
                                F.lit(None).cast("string").alias("gender")))

    title = F.regexp_extract(match, r"^([^ \t\r\n]+)", 1)
    gender = F.when(title.rlike(rf"^(?:{MALE})\.?$"), "m").when(title.rlike(rf"^(?:{FEMALE})\.?$"), "f")
    # the title, then pieces of white space and a name or initial
    pieces = F.regexp_extract_all(F.substring(match, F.length(title) + 1, F.length(match)), F.lit(rf"[ \t\r\n]*(?:{FULL}|\p{{Lu}}\.)"), F.lit(0))

    def piece(x: Column, i: Column, n: Column) -> Column:
        gap = F.regexp_extract(x, r"^([ \t\r\n]*)", 1)
        raw = F.substring(x, F.length(gap) + 1, F.length(x))
        short = raw.endswith(".")
        return F.struct(F.when(i == 0, F.concat(title, gap)).otherwise(gap).alias("before"), raw.alias("raw"),
                        F.when(short, "initial").otherwise("name").alias("kind"), F.lower(raw).alias("value"),
                        F.when(~short & (i < n - 1), gender).alias("gender"))

    named = let(pieces, lambda p: F.transform(p, lambda x, i: piece(x, i, F.size(p))))
    return F.when(kind == "name", named).otherwise(let(kind, lambda k: let(before, lambda b: simple(k, b))))


def _draw(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), kind, value, attempt.cast("string")), 512)


def _byte(h: Column, i: Column) -> Column:
    return F.conv(F.substring(h, (F.pmod(i, F.lit(64)) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _pick(alphabet: str, b: Column) -> Column:
    return F.substring(F.lit(alphabet), F.pmod(b, F.lit(len(alphabet))) + 1, F.lit(1))


def _redraw(raw: Column, h: Column, hexadecimal: Column | None = None) -> Column:
    """``raw`` with every letter and digit drawn anew from its own class."""
    def char(c: Column, i: Column) -> Column:
        b = _byte(h, i)
        low = _pick("abcdefghijklmnopqrstuvwxyz", b)
        if hexadecimal is not None:
            low = F.when(hexadecimal, _pick("abcdef", b)).otherwise(low)
        return F.when(c.rlike("[0-9]"), _pick("0123456789", b)).when(c.rlike("[a-z]"), low) \
            .when(c.rlike("[A-Z]"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", b)).when(c.rlike(r"\p{IsCyrillic}"), _pick("абвгдежзиклмнопрстуфхцчшэюя", b)) \
            .when(c.rlike(r"\p{IsGreek}"), _pick("αβγδεζηθικλμνξοπρστυφχψω", b)).when(c.rlike(r"\p{IsLatin}"), _pick("àáâäçèéêëíîïñóôöøúûü", b)).otherwise(c)
    return F.array_join(F.transform(F.split(raw, ""), char), "")


def _with_chars(raw: Column, new: Column, kind: str = "[0-9]") -> Column:
    """``raw`` with its last characters of a class replaced by ``new``; earlier ones and separators stay."""
    skip = F.length(F.regexp_replace(raw, f"[^{kind[1:]}", "")) - F.length(new)
    walked = F.aggregate(F.split(raw, ""), F.struct(F.lit("").alias("s"), F.lit(0).alias("n")), lambda acc, c: F.when(
        c.rlike(kind), F.struct(F.concat(acc["s"], F.when(acc["n"] < skip, c).otherwise(
            F.substring(new, acc["n"] - skip + 1, F.lit(1)))).alias("s"), (acc["n"] + 1).alias("n")))
        .otherwise(F.struct(F.concat(acc["s"], c).alias("s"), acc["n"].alias("n"))))
    return walked["s"]


def _account_check(country: Column, account: Column) -> Column:
    """The two check digits of an IBAN: 98 minus the number's remainder by 97, letters counting 10 to 35."""
    rest = F.aggregate(F.split(F.concat(account, country, F.lit("00")), ""), F.lit(0), lambda r, c: F.when(
        c.rlike("[0-9]"), (r * 10 + c.cast("int")) % 97).when(c.rlike("[A-Z]"), (r * 100 + F.ascii(c) - 55) % 97).otherwise(r))
    return F.lpad((F.lit(98) - rest).cast("string"), 2, "0")


def _luhn(body: Column) -> Column:
    """Check digit of a number without one."""
    total = F.aggregate(F.transform(F.split(F.reverse(body), ""), lambda c, i: let(
        c.cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d))), F.lit(0), lambda s, d: s + d)
    return F.pmod(F.lit(10) - total % 10, F.lit(10)).cast("string")


def canonical_surrogate(kind: Column, value: Column, gender: Column, attempt: Column, key: str) -> Column:
    """The surrogate of an entity's canonical value."""
    def made(h: Column) -> Column:
        domain = F.regexp_extract(value, r"@(.*)\.\p{L}+$", 1)
        email = F.concat(_redraw(F.regexp_extract(value, "^([^@]+)@", 1), h), F.lit("@"),
                         let(_draw(F.lit("domain"), domain, F.lit(0), key), lambda d: _redraw(domain, d)),
                         F.regexp_extract(value, r"(\.\p{L}+)$", 1))
        ip = F.concat_ws(".", (F.pmod(_byte(h, F.lit(0)), F.lit(222)) + 1).cast("string"), *[
            _byte(h, F.lit(i)).cast("string") for i in (1, 2, 3)])
        drawn = _redraw(value, h)
        card = let(F.concat(F.substring(value, 1, 1), F.substring(drawn, F.lit(2), F.length(value) - 2)),
                   lambda body: F.concat(body, _luhn(body)))
        country, national = F.regexp_extract(value, "^([0-9]*)-", 1), F.regexp_extract(value, "-([0-9]*)$", 1)
        number = let(_redraw(national, h), lambda d: F.concat(country, F.lit("-"), F.concat(
            _pick("23456789", _byte(h, F.lit(0))), F.substring(d, 2, 2),
            _pick("23456789", _byte(h, F.lit(3))), F.substring(d, F.lit(5), F.length(d)))))
        account = let(F.substring(drawn, F.lit(5), F.length(value)), lambda a: F.concat(
            F.substring(value, 1, 2), _account_check(F.substring(value, 1, 2), a), a))
        name = lambda cons, vowels, male, female: F.initcap(F.concat(
            F.array_join(F.transform(F.sequence(F.lit(1), 2 + F.floor(attempt / 2).cast("int")), lambda i: F.concat(
                _pick(cons, _byte(h, 2 * i)), _pick(vowels, _byte(h, 2 * i + 1)))), ""),
            F.when((gender == "f") | (gender.isNull() & value.rlike(r"\p{IsCyrillic}.*[ая]$")), F.element_at(F.array(*map(F.lit, female)), F.pmod(_byte(h, F.lit(0)), F.lit(len(female))) + 1))
            .otherwise(F.element_at(F.array(*map(F.lit, male)), F.pmod(_byte(h, F.lit(0)), F.lit(len(male))) + 1))))
        latin = name("bdfgklmnprstvz", "aeiou", ["n", "r", "s", "k"], ["na", "ra", "sia", "la"])
        cyrillic = name("бвгдзклмнпрст", "аеиоу", ["н", "р", "в", "к"], ["на", "ра", "ва", "ия"])
        greek = name("βγδκλμνπρστφ", "αειου", ["ος", "ης", "ας", "ις"], ["να", "ρα", "κη", "λη"])
        armenian = name("բգդկլմնպրստ", "աեիոու", ["ն", "ր", "ս", "կ"], ["նա", "րա", "նե", "սա"])
        other = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(3), F.length(value)) + attempt), lambda i: F.substring(
            value, F.pmod(_byte(h, i), F.length(value)) + 1, F.lit(1))), "")
        in_script = F.when(value.rlike(r"\p{IsCyrillic}"), cyrillic).when(value.rlike(r"\p{IsGreek}"), greek) \
            .when(value.rlike(r"\p{IsArmenian}"), armenian).when(value.rlike(r"\p{IsLatin}"), latin).otherwise(other)
        return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", number) \
            .when(kind == "name", F.lower(in_script)).when(kind == "iban", account) \
            .when(kind == "ip6", _redraw(value, h, F.lit(True))) \
            .when(kind == "access", F.concat(F.substring(value, 1, 4), F.substring(drawn, F.lit(5), F.length(value)))) \
            .when(kind == "secret", _redraw(value, h, value.rlike("^[0-9a-f]+$"))).otherwise(drawn)
    return let(_draw(kind, value, attempt, key), made)


def in_form_of(raw: Column, kind: Column, surrogate: Column) -> Column:
    """A mention of the surrogate in the form of the mention it replaces."""
    cased = F.when((raw == F.upper(raw)) & (raw != F.lower(raw)), F.upper(surrogate))
    return F.when(kind.isin("card", "ssn"), _with_chars(raw, surrogate)).when(kind == "iban", _with_chars(raw, surrogate, "[0-9A-Z]")) \
        .when(kind == "phone", _with_chars(raw, F.regexp_extract(surrogate, "-([0-9]*)$", 1))) \
        .when(kind.isin("email", "ip6"), F.coalesce(cased, surrogate)) \
        .when(kind == "name", F.coalesce(F.when(F.length(raw) > 1, cased), F.initcap(surrogate))).otherwise(surrogate)


def initial(raw: Column, key: str) -> Column:
    """``raw`` with every capital moved to the next one in a keyed order of its alphabet."""
    old = new = ""
    for letters in ALPHABETS:
        order = sorted(letters, key=lambda c: hashlib.sha256(f"{key}|initial|{c}".encode()).digest())
        old, new = old + "".join(order), new + "".join(order[1:] + order[:1])
    return F.translate(raw, old, new)


def assign(entities: DataFrame, key: str = TEST_KEY) -> DataFrame:
    """(kind, value, surrogate) of distinct entities (kind, value, gender), distinct within a kind
    and never an original value."""
    originals = entities.select("kind", F.col("value").alias("surrogate"))
    left, done, attempt = entities, None, 0
    while True:
        drawn = left.withColumn("surrogate", canonical_surrogate(F.col("kind"), F.col("value"), F.col("gender"), F.lit(attempt), key))
        free = drawn.join(originals, ["kind", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = free.groupBy("kind", "surrogate").agg(F.min("value").alias("value")).select("kind", "value", "surrogate")
        done = cut_lineage(won if done is None else done.unionByName(won))
        left = cut_lineage(left.join(done.select("kind", "value"), ["kind", "value"], "left_anti"))
        attempt += 1
        if left.isEmpty():
            return done
        if attempt == MAX_ATTEMPTS:
            raise RuntimeError("a kind has more entities than surrogates of its form")


def replace_entities(docs: DataFrame, key: str | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text`` and the number of replaced entities, ``n_entities``."""
    key = key or docs.sparkSession.conf.get(KEY_CONF, TEST_KEY)
    found = docs.where(has_entity(F.col("text"))).withColumn(
        "__k", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"))
    mentions = cut_lineage(found.select("__k", F.posexplode(F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0))).alias("at", "match"))
                           .distinct().select("__k", "at", F.posexplode(parts(F.col("match"))).alias("sub", "p"))
                           .select("__k", "at", "sub", "p.*"))
    entities = cut_lineage(mentions.where("kind not in ('plain', 'initial')").groupBy("kind", "value").agg(
        F.when(F.min("gender") == F.max("gender"), F.min("gender")).alias("gender")))
    chosen = mentions.join(assign(entities, key), ["kind", "value"], "left") \
        .withColumn("s", F.concat("before", F.when(F.col("kind") == "plain", F.col("raw")).when(F.col("kind") == "initial", initial(F.col("raw"), key)).otherwise(
            in_form_of(F.col("raw"), F.col("kind"), F.col("surrogate")))))
    per = chosen.groupBy("__k").agg(
        F.array_sort(F.collect_list(F.struct("at", "sub", "s"))).alias("all"),
        F.countDistinct(F.when(F.col("kind") != "plain", F.col("at"))).alias("__n"),
        F.map_from_entries(F.collect_set(F.when(F.col("kind") == "name", F.struct("value", "surrogate")))).alias("__names"))
    new = per.select("__k", "__n", "__names", F.transform(
        F.array_distinct(F.col("all.at")), lambda a: F.array_join(F.transform(
            F.filter("all", lambda x: x["at"] == a), lambda x: x["s"]), "")).alias("__s"))

    def untitled(gap: Column) -> Column:
        """``gap`` with the names of the document replaced."""
        def one(w: Column) -> Column:
            name = F.try_element_at("__names", F.lower(w))
            return F.when((F.substring(w, 1, 1) != F.lower(F.substring(w, 1, 1))) & name.isNotNull(), in_form_of(w, F.lit("name"), name)) \
                .otherwise(w)
        words = F.regexp_extract_all(gap, F.lit(r"\p{L}+(?:[-'’]\p{L}{2,})*|[^\p{L}]+"), F.lit(0))
        return F.when(F.size("__names") > 0, F.array_join(F.transform(words, one), "")).otherwise(gap)

    gaps = F.split("text", ENTITY, -1)
    text = let(gaps, lambda g: F.array_join(F.transform(g, lambda t, i: F.concat(untitled(t), F.coalesce(F.get("__s", i), F.lit("")))), ""))
    changed = found.join(new, "__k").withColumn("n_entities", F.col("__n")).withColumn("text", text)
    same = docs.where(~has_entity(F.col("text"))).withColumn("n_entities", F.lit(0).cast("long"))
    columns = [c for c in docs.columns if c != "n_entities"] + ["n_entities"]
    return changed.select(*columns).unionByName(same.select(*columns))


@query("op2_keyed_surrogates")
def op2(spark, sf_dir):
    return replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"))
