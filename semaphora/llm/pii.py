"""Format-preserving pseudonyms for personal data.

Payment cards (Luhn), IBANs (mod 97), IPv4 addresses, social security numbers, phone numbers, calendar dates and
e-mail names are found, validated, and replaced by a keyed Feistel permutation within their format: digits stay
digits, letters stay letters, check digits are right again, dates stay dates. The permutation depends on the key,
the kind and the value alone, so equal values stay linked across documents, and restore() turns pseudonyms back.
What can't be valid is permuted again until it is (cycle walking). The domain of an e-mail address stays as it is.

The key never stands in a plan: a key of each kind is derived from it (HMAC-SHA256), and those reach the executors as
the one row of a scalar subquery. All of it is DataFrame functions.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .expressions import gaps, let, matches, starts

ROUNDS = 8
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# The forms in which personal data stand in text, and the days of the years 1900 to 2099.
EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}+@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63})+"
IPV4 = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
DATE = r"(?<![0-9./\-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.(?:19|20)[0-9]{2}|[0-9]{2}/[0-9]{2}/(?:19|20)[0-9]{2})(?![0-9/\-]|\.[0-9])"
SSN = r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])"
CARD = r"(?<![0-9])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9])"
PHONE = r"(?:\+[0-9]{1,3}[ .\-]?)?\([0-9]{3}\)[ .\-]?[0-9]{3}[ .\-][0-9]{4}(?![0-9])|(?<![0-9])\+[0-9]{1,3}(?:[ .\-]?[0-9]{2,4}){2,5}(?![0-9])|(?<![0-9.\-])[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4}(?![0-9\-]|\.[0-9])"
# An IBAN or card reaches over all words or numbers that follow it, so that what a match takes in can be tried whole.
IBAN_RUN, CARD_RUN = rf"{IBAN}(?: [A-Z0-9]++(?![A-Za-z]))*+", r"(?<![0-9])[0-9](?:[ \-]?[0-9]){12,}+"
CANDIDATE = "|".join((EMAIL, IBAN_RUN, IPV4, DATE, SSN, PHONE, CARD_RUN))
# Lengths of IBANs by country, and the numbers that card issuers give.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
ISSUED = r"^(?:4[0-9]{15}|4[0-9]{12}|5[1-5][0-9]{14}|2[2-7][0-9]{14}|6[0-9]{15}|3[47][0-9]{13}|3[0689][0-9]{12}|35[0-9]{14})$"
#: More characters than any value that a run can hold, with the character before it.
WINDOW = 100
FIRST_DAY, DAY_PARTS = "1900-01-01", (17, 4297)
#: Most steps of a walk to a valid value; a step ends it with a chance of three in five (dates) or nine in ten (SSNs).
WALK = 40
NO_SSN = "^(000|666|9)|^.{3}00|0000$"
KINDS = ("email", "iban", "ipv4", "date", "ssn", "card", "phone")


def _byte(hex_: Column, i: Column | int) -> Column:
    """Byte i of a digest in hex, for i from 0 to 31, around again beyond."""
    at = F.pmod(F.lit(i) if isinstance(i, int) else i, F.lit(32)) * 2 + 1
    return F.conv(hex_.substr(at.cast("int"), F.lit(2)), 16, 10).cast("int")


def _moved(ch: Column, by: Column) -> Column:
    """The character by places on in its own class; others stay."""
    out = ch
    for letters in (_UPPER, _LOWER, _DIGITS):
        n = len(letters)
        at = F.instr(F.lit(letters), ch)
        out = F.when(at > 0, F.lit(letters).substr((F.pmod(at - 1 + by, F.lit(n)) + 1).cast("int"), F.lit(1))).otherwise(out)
    return out


def keyed(spark: SparkSession, key: str) -> Column:
    """The keys of all kinds, derived from key, as a column: for each kind the inner and outer block of its HMAC.

    It is a subquery of one row, so it may stand in a select() but not inside a function of an array."""
    blocks = []
    for kind in KINDS:
        own = hmac.digest(key.encode(), kind.encode(), hashlib.sha256).ljust(64, b"\0")
        blocks.append((bytearray(x ^ 0x36 for x in own), bytearray(x ^ 0x5C for x in own)))
    rows = spark.createDataFrame([tuple(blocks)], ", ".join(f"{kind} struct<inner:binary,outer:binary>" for kind in KINDS))
    return rows.select(F.struct(*KINDS).alias("keys")).scalar()


def _salted(keys: Column, kind: str, round_: Column, half: Column) -> Column:
    """HMAC-SHA256 of 'round|half' under the kind's key, in hex."""
    said = F.concat_ws("|", round_.cast("string"), half.cast("string")).cast("binary")
    return F.sha2(F.concat(keys[kind]["outer"], F.unhex(F.sha2(F.concat(keys[kind]["inner"], said), 256))), 256)


def permuted(value: Column, keys: Column, kind: str, back: bool = False) -> Column:
    """A Feistel permutation of strings of one format: each character stays in its class (A-Z, a-z, 0-9, other)."""
    n = F.length(value)
    half = F.floor(n / 2).cast("int")
    start = F.struct(value.substr(F.lit(1), half).alias("l"), value.substr(half + 1, n).alias("r"))
    sign = -1 if back else 1

    def step(acc: Column, i: Column) -> Column:
        same, other = (acc["l"], acc["r"]) if not back else (acc["r"], acc["l"])

        def with_stream(h: Column) -> Column:
            return F.array_join(F.transform(F.split(same, ""), lambda ch, k: _moved(ch, _byte(h, k) * sign)), "")

        moved = F.when(F.length(same) > 0, let(_salted(keys, kind, i, other), with_stream)).otherwise(same)
        return F.struct(other.alias("l"), moved.alias("r")) if not back else F.struct(moved.alias("l"), other.alias("r"))

    rounds = F.sequence(F.lit(1), F.lit(ROUNDS)) if not back else F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1))
    return F.aggregate(rounds, start, step, lambda acc: F.concat(acc["l"], acc["r"]))


def permuted_number(x: Column, a: int, b: int, keys: Column, kind: str, back: bool = False) -> Column:
    """A Feistel permutation of 0 to a*b-1: two parts to the moduli a and b, each moved by a digest of the other."""
    start = F.struct(F.floor(x / b).cast("long").alias("l"), F.pmod(x, F.lit(b)).cast("long").alias("r"))
    sign = -1 if back else 1
    draw = lambda i, half: F.conv(_salted(keys, kind, i, half).substr(1, 12), 16, 10).cast("long")

    def step(acc: Column, i: Column) -> Column:
        left = lambda r: F.pmod(acc["l"] + F.pmod(draw(i, r), F.lit(a)) * sign, F.lit(a))
        right = lambda l: F.pmod(acc["r"] + F.pmod(draw(-i, l), F.lit(b)) * sign, F.lit(b))
        if back:
            return let(right(acc["l"]), lambda r: F.struct(left(r).alias("l"), r.alias("r")))
        return let(left(acc["r"]), lambda l: F.struct(l.alias("l"), right(l).alias("r")))

    rounds = F.sequence(F.lit(1), F.lit(ROUNDS // 2)) if not back else F.sequence(F.lit(ROUNDS // 2), F.lit(1), F.lit(-1))
    return F.aggregate(rounds, start, step, lambda acc: acc["l"] * b + acc["r"])


def _only(value: Column, kept: str) -> Column:
    return F.regexp_replace(value, f"[^{kept}]", "")


def _laid_over(form: Column, chars: Column, kept: str) -> Column:
    """form with its characters of the class kept replaced, one after the other, by those of chars."""
    step = lambda acc, ch: F.when(ch.rlike(f"[{kept}]"), F.struct(F.concat(acc["t"], chars.substr(acc["i"], F.lit(1))).alias("t"), (acc["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(acc["t"], ch).alias("t"), acc["i"].alias("i")))
    return F.aggregate(F.split(form, ""), F.struct(F.lit("").alias("t"), F.lit(1).alias("i")), step, lambda acc: acc["t"])


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Sum of digits from the right, every second one doubled; doubled: whether the last one is (0) or the one before (1)."""
    digit = lambda ch, i: let(ch.cast("int") * F.when(F.pmod(i, F.lit(2)) == doubled, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d))
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), digit), F.lit(0), lambda s, d: s + d)


def luhn(digits: Column) -> Column:
    return F.pmod(_luhn_sum(digits, 1), F.lit(10)) == 0


def _with_check_digit(payload: Column) -> Column:
    return F.concat(payload, F.pmod(-_luhn_sum(payload, 0), F.lit(10)).cast("string"))


def _mod97(value: Column) -> Column:
    """Letters count as 10 to 35, their digits joined, modulo 97."""
    step = lambda s, ch: let(F.conv(ch, 36, 10).cast("int"), lambda v: F.pmod(s * F.when(v > 9, 100).otherwise(10) + v, F.lit(97)))
    return F.aggregate(F.split(value, ""), F.lit(0), step)


def iban_valid(value: Column) -> Column:
    bare = _only(value, "A-Z0-9")
    return F.length(bare).between(15, 34) & (_mod97(F.concat(bare.substr(F.lit(5), F.length(bare)), bare.substr(1, 4))) == 1)


def _date(value: Column) -> Column:
    """The date that value names, null if none. Of dd/mm and mm/dd, what is possible counts, dd/mm first."""
    at = lambda form, text=value: F.try_to_timestamp(text, F.lit(form)).cast("date")
    return F.when(value.contains("-"), at("yyyy-MM-dd")).when(value.contains("."), at("dd.MM.yyyy")).otherwise(F.coalesce(at("dd/MM/yyyy"), at("MM/dd/yyyy")))


def _date_form(value: Column, date: Column) -> Column:
    day_first = F.try_to_timestamp(value, F.lit("dd/MM/yyyy")).isNotNull()
    return F.when(value.contains("-"), F.date_format(date, "yyyy-MM-dd")).when(value.contains("."), F.date_format(date, "dd.MM.yyyy")).when(day_first, F.date_format(date, "dd/MM/yyyy")).otherwise(F.date_format(date, "MM/dd/yyyy"))


def _octet(value: Column, k: int) -> Column:
    return F.get(F.split(value, r"\."), F.lit(k)).cast("long")


def kind_of(value: Column) -> Column:
    """The kind of a candidate, null if it isn't valid."""
    digits = _only(value, "0-9")
    octets = [_octet(value, k) for k in range(4)]
    is_ = lambda pattern: value.rlike(f"^(?:{pattern})$")
    return (
        F.when(value.contains("@"), F.lit("email"))
        .when(is_(IPV4), F.when((octets[0] <= 255) & (octets[1] <= 255) & (octets[2] <= 255) & (octets[3] <= 255), F.lit("ipv4")))
        .when(is_(IBAN), F.when(iban_valid(value), F.lit("iban")))
        .when(is_(DATE), F.when(_date(value).isNotNull(), F.lit("date")))
        .when(is_(SSN), F.when(~digits.rlike(NO_SSN), F.lit("ssn")))
        .when(is_(PHONE), F.when(F.length(digits).between(8, 15), F.lit("phone")))
        .when(is_(CARD), F.when(luhn(digits) & ~digits.rlike("^0+$"), F.lit("card")))
    )


def _walked(first: Column, step, ok) -> Column:
    """first, or what step makes of it, again and again, until it is ok. A step permutes, so the way back is as sure."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda acc, _: F.when(ok(acc), acc).otherwise(step(acc)))


def _swapped(value: Column, kind: Column, keys: Column, back: bool) -> Column:
    digits, bare = _only(value, "0-9"), _only(value, "A-Z0-9")
    card = let(digits, lambda d: _with_check_digit(permuted(d.substr(F.lit(1), F.length(d) - 1), keys, "card", back)))
    country = F.regexp_extract(value, r"^\+[0-9]{1,3}(?=[ .\-(])", 0)
    local = value.substr(F.length(country) + 1, F.length(value))
    phone = F.concat(country, _laid_over(local, permuted(_only(local, "0-9"), keys, "phone", back), "0-9"))

    def iban(b: Column) -> Column:
        land, body = b.substr(1, 2), permuted(b.substr(F.lit(5), F.length(b)), keys, "iban", back)
        check = lambda x: F.lpad((F.lit(98) - _mod97(F.concat(x, land, F.lit("00")))).cast("string"), 2, "0")
        return let(body, lambda x: F.concat(land, check(x), x))

    days = lambda d: F.datediff(d, F.lit(FIRST_DAY).cast("date")).cast("long")
    dated = lambda x: F.date_add(F.lit(FIRST_DAY).cast("date"), x.cast("int"))
    other = lambda x: permuted_number(x, *DAY_PARTS, keys, "date", back)
    # a date that only mm/dd/yyyy can mean stays one: the permutation goes on until the day is over 12
    walk = lambda x: _walked(other(x), other, lambda day: F.dayofmonth(dated(day)) > 12)
    month_first = value.contains("/") & F.try_to_timestamp(value, F.lit("dd/MM/yyyy")).isNull()
    date = dated(let(days(_date(value)), lambda x: F.when(month_first, walk(x)).otherwise(other(x))))
    next_ssn = lambda d: permuted(d, keys, "ssn", back)
    ssn = _walked(next_ssn(digits), next_ssn, lambda d: ~d.rlike(NO_SSN))
    number = _octet(value, 0) * (1 << 24) + _octet(value, 1) * (1 << 16) + _octet(value, 2) * (1 << 8) + _octet(value, 3)
    octets = lambda x: (F.shiftright(x, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0))
    ip = let(permuted_number(number, 1 << 16, 1 << 16, keys, "ipv4", back), lambda x: F.concat_ws(".", *octets(x)))
    name = F.regexp_extract(value, "^([^@]*)@", 1)
    return (
        F.when(kind == "email", F.concat(permuted(name, keys, "email", back), value.substr(F.length(name) + 1, F.length(value))))
        .when(kind == "ipv4", ip)
        .when(kind == "iban", _laid_over(value, let(bare, iban), "A-Z0-9"))
        .when(kind == "date", _date_form(value, date))
        .when(kind == "ssn", _laid_over(value, ssn, "0-9"))
        .when(kind == "card", _laid_over(value, card, "0-9"))
        .when(kind == "phone", phone)
    )


def pseudonym(value: Column, kind: Column, keys: Column) -> Column:
    """The pseudonym of a value of a kind; keys: a column of keyed()."""
    return _swapped(value, kind, keys, False)


def restore(value: Column, kind: Column, keys: Column) -> Column:
    """The value that a pseudonym of that kind stands for."""
    return _swapped(value, kind, keys, True)


def _at_start(window: Column) -> Column:
    """(sure, maybe): the value that stands right behind the first character of window, each null if there is none.

    Sure are an IBAN of its country's length, a card as issuers number them, a date, a number that stands alone; maybe
    are any other valid IBAN and card. The longest counts."""
    get = lambda pattern: F.regexp_extract(window, f"^.({pattern})", 1)
    first = lambda values, ok: F.get(F.filter(values, lambda v: (v != "") & ok(v)), F.lit(0))
    by_country = "|".join(f"(?:{'|'.join(lands.split())})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, lands in IBAN_LENGTHS.items())
    iban = F.array(get(rf"(?:{by_country})(?![A-Za-z0-9])"))
    other = F.array(*map(get, (IPV4, DATE, SSN, PHONE)))
    cards = F.when(window.rlike("^.[0-9]"), F.array(*(get(rf"[0-9](?:[ \-]?[0-9]){{{n - 1}}}(?![0-9])") for n in range(19, 12, -1))))
    ibans = F.when(window.rlike("^.[A-Z]{2}[0-9]{2}"), F.array(*(get(rf"[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in range(34, 14, -1))))
    is_card = lambda v: let(_only(v, "0-9"), lambda d: luhn(d) & ~d.rlike("^0+$"))
    known = lambda v: kind_of(v).isNotNull()
    sure = F.coalesce(first(iban, iban_valid), first(cards, lambda v: _only(v, "0-9").rlike(ISSUED) & is_card(v)), first(other, known))
    return F.struct(sure.alias("sure"), F.coalesce(first(cards, is_card), first(ibans, iban_valid)).alias("maybe"))


def _inside(run: Column) -> Column:
    """The valid values inside a run that is none as a whole, as (before, value): what stands before each, and the value;
    at the end (the rest, '').

    From each word or number on, left to right: what is sure counts; what is only maybe a value counts unless it
    reaches into one that is sure."""
    words = F.split(run, r"[ \-]")
    ats = F.aggregate(words, F.array(F.lit(0)), lambda acc, w: F.array_append(acc, F.element_at(acc, -1) + F.length(w) + 1), lambda acc: F.slice(acc, 1, F.size(acc) - 1))
    padded = F.concat(F.lit(" "), run)
    options = F.transform(ats, lambda at: let(_at_start(padded.substr(at + 1, F.lit(WINDOW))), lambda o: F.struct(at.alias("at"), o["sure"].alias("sure"), o["maybe"].alias("maybe"))))

    def scan(options: Column) -> Column:
        sure = F.filter(options, lambda o: o["sure"].isNotNull())
        reaches = lambda o: F.exists(sure, lambda x: (x["at"] > o["at"]) & (x["at"] < o["at"] + F.length(o["maybe"])))
        value = lambda o: F.coalesce(o["sure"], F.when(o["maybe"].isNotNull() & ~reaches(o), o["maybe"]))
        chosen = F.filter(F.transform(options, lambda o: F.struct(o["at"].alias("at"), value(o).alias("value"))), lambda o: o["value"].isNotNull())
        start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<before:string,value:string>>").alias("out"))
        before = lambda acc, at: run.substr(acc["end"] + 1, at - acc["end"])
        piece = lambda before, value: F.struct(before.alias("before"), value.alias("value"))
        add = lambda acc, o: F.when(o["at"] < acc["end"], acc).otherwise(F.struct((o["at"] + F.length(o["value"])).alias("end"), F.array_append(acc["out"], piece(before(acc, o["at"]), o["value"])).alias("out")))
        return F.aggregate(chosen, start, add, lambda acc: F.array_append(acc["out"], piece(before(acc, F.length(run)), F.lit(""))))

    return let(options, scan)


def _found(text: Column, keys: Column) -> Column:
    """For each match in text its pieces (before, value, kind, pseudonym); a value that isn't valid has no kind and stays.

    A match is one piece, but an invalid one of several words or numbers is tried again in parts."""
    swapped = lambda before, v, k: F.struct(before.alias("before"), v.alias("value"), k.alias("kind"), F.when(k.isNotNull(), pseudonym(v, k, keys)).alias("pseudonym"))
    whole = lambda m: F.array(F.struct(F.lit("").alias("before"), m.alias("value")))
    again = lambda m: m.rlike("^[A-Z0-9 -]*[ -][A-Z0-9 -]*$") & ~m.rlike(f"^(?:{DATE}|{SSN}|{PHONE})$")
    pieces = lambda m: let(kind_of(m), lambda k: F.when(k.isNull() & again(m), _inside(m)).otherwise(whole(m)))
    one = lambda m: F.transform(pieces(m), lambda p: let(kind_of(p["value"]), lambda k: swapped(p["before"], p["value"], k)))
    none = F.array().cast("array<array<struct<before:string,value:string,kind:string,pseudonym:string>>>")
    return F.when(text.rlike("[0-9@]"), F.transform(matches(text, CANDIDATE), one)).otherwise(none)


def _between(text: Column) -> Column:
    return F.when(text.rlike("[0-9@]"), gaps(text, CANDIDATE)).otherwise(F.array(text))


def _joined(pieces: Column, new: bool) -> Column:
    """The text of a match, as it was or with its pseudonyms."""
    return F.array_join(F.transform(pieces, lambda p: F.concat(p["before"], F.coalesce(p["pseudonym"], p["value"]) if new else p["value"])), "")


def _rewritten(text: Column, found: Column) -> Column:
    parts = lambda between: F.array_join(F.concat(F.transform(found, lambda f, i: F.concat(F.get(between, i), _joined(f, True))), F.array(F.element_at(between, -1))), "")
    return F.when(F.exists(found, lambda f: F.exists(f, lambda p: p["kind"].isNotNull())), let(_between(text), parts)).otherwise(text)


def _looked_into(docs: DataFrame, key: str) -> DataFrame:
    """_row (a struct of all columns of docs, so that no name of theirs can clash with one used here) and _found."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), keyed(docs.sparkSession, key).alias("_keys"))
    return rows.select("_row", _found(F.col("_row.text"), F.col("_keys")).alias("_found"))


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """docs with every valid value in text replaced by its pseudonym; all rows and columns stay, in order.

    A null text stays null, a text without personal data unchanged; repeated rows change alike."""
    text = _rewritten(F.col("_row.text"), F.col("_found"))
    return _looked_into(docs, key).select(*(text.alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))


def findings(docs: DataFrame, key: str) -> DataFrame:
    """A row for each valid value: doc_id, kind, start (characters before it), length, value_sha256, pseudonym.

    Whole texts; null and empty texts give no row; ids pass through, nulls too."""
    rows = _looked_into(docs.select("doc_id", "text"), key).filter(F.size("_found") > 0)
    at = starts(F.transform("_found", lambda f: _joined(f, False)), _between(F.col("_row.text")))
    inner = lambda f, i: F.length(_joined(F.slice(f, F.lit(1), i), False)) + F.length(F.get(f, i)["before"])
    rows = rows.select("_row.doc_id", F.explode(F.arrays_zip(F.col("_found").alias("found"), at.alias("start"))).alias("m"))
    placed = F.transform(F.col("m.found"), lambda p, i: F.struct(p.alias("found"), (F.col("m.start") + inner(F.col("m.found"), i)).alias("start")))
    rows = rows.select("doc_id", F.explode(placed).alias("f")).filter("f.found.kind is not null")
    value = F.col("f.found.value")
    return rows.select(
        "doc_id", F.col("f.found.kind").alias("kind"), F.col("f.start").cast("long").alias("start"), F.length(value).cast("long").alias("length"),
        F.sha2(value, 256).alias("value_sha256"), F.col("f.found.pseudonym").alias("pseudonym"),
    )


def summarised(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, n_found, kinds (sorted, each once), clean_text for every document; nulls as in pseudonymised()."""
    valid = F.filter(F.flatten("_found"), lambda f: f["kind"].isNotNull())
    kinds = F.array_sort(F.array_distinct(F.transform(valid, lambda f: f["kind"])))
    clean = _rewritten(F.col("_row.text"), F.col("_found"))
    n = F.coalesce(F.size(valid), F.lit(0)).cast("long")
    return _looked_into(docs.select("doc_id", "text"), key).select("_row.doc_id", n.alias("n_found"), kinds.alias("kinds"), clean.alias("clean_text"))
