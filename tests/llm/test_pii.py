import datetime
import hashlib
import hmac
import random
import re
import string
from collections import defaultdict

from pyspark.sql import functions as F

from semaphora.llm import pii
from semaphora.llm.queries import pii_query

from .helpers import empty, hard

VALUES = {
    "email": ["bosbt.42@mail8.example.com", "A_b+c@x-y.org"], "ipv4": ["42.144.35.254", "0.0.0.0", "255.255.255.255"], "iban": ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"],
    "date": ["1987-02-28", "29.02.2000", "31/12/1999", "12/31/1999"], "ssn": ["123-45-6789"], "card": ["4111111111111111", "5500 0000 0000 0004", "3782-822463-10005"], "phone": ["+1 (988) 555-2485", "(212) 555-0100", "+49 30 1234567", "212-555-0199"],
}
NOT = ["4111111111111112", "300.1.2.3", "DE89370400440532013001", "1987-02-30", "000-45-6789", "12.5", "2026", "1.2.3.4.5"]


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def mod97(iban):
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def shape(x):
    return re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", x)))


def swapped(spark, df):
    """df (kind, value) with the kind found, the pseudonym, the way back, and the pseudonym of another key."""
    df = df.select("*", pii.keyed(spark, "k").alias("k1"), pii.keyed(spark, "k2").alias("k2")).withColumn("found", pii.kind_of(F.col("value")))
    df = df.withColumn("p", pii.pseudonym(F.col("value"), F.col("kind"), F.col("k1"))).withColumn("other", pii.pseudonym(F.col("value"), F.col("kind"), F.col("k2")))
    return df.withColumn("back", pii.restore(F.col("p"), F.col("kind"), F.col("k1")))


def digest(kind, round_, half):
    own = hmac.digest(b"k", kind.encode(), hashlib.sha256)
    return hmac.digest(own, f"{round_}|{half}".encode(), hashlib.sha256)


def feistel(value, kind):
    """The permutation of strings, as the docstring says it: each half moves the other by a keyed stream."""
    left, right = value[: len(value) // 2], value[len(value) // 2 :]
    for i in range(1, 9):
        stream, out = digest(kind, i, right), ""
        for k, ch in enumerate(left):
            letters = next((x for x in (string.ascii_uppercase, string.ascii_lowercase, string.digits) if ch in x), None)
            out += letters[(letters.index(ch) + stream[k % 32]) % len(letters)] if letters else ch
        left, right = right, out
    return left + right


def numbers(x, a, b, kind):
    left, right = divmod(x, b)
    for i in range(1, 5):
        left = (left + int(digest(kind, i, right).hex()[:12], 16) % a) % a
        right = (right + int(digest(kind, -i, left).hex()[:12], 16) % b) % b
    return left * b + right


def check_digit(payload):
    return next(d for d in string.digits if luhn(payload + d))


def by_hand(kind, value):
    digits = re.sub(r"\D", "", value)
    over = lambda chars, kept: "".join(chars.pop(0) if re.match(kept, c) else c for c in value)
    if kind == "email":
        name, at, domain = value.partition("@")
        return feistel(name, kind) + at + domain
    if kind == "card":
        body = feistel(digits[:-1], kind)
        return over([*body, check_digit(body)], "[0-9]")
    if kind == "ssn":
        out = feistel(digits, kind)
        while re.search("^(000|666|9)|^...00|0000$", out):
            out = feistel(out, kind)
        return over([*out], "[0-9]")
    if kind == "iban":
        bare = value.replace(" ", "")
        body = feistel(bare[4:], kind)
        check = next(f"{c:02d}" for c in range(2, 99) if mod97(f"{bare[:2]}{c:02d}{body}") == 1)
        return over([*bare[:2], *check, *body], "[A-Z0-9]")
    if kind == "ipv4":
        n = numbers(int.from_bytes(bytes(map(int, value.split("."))), "big"), 1 << 16, 1 << 16, kind)
        return ".".join(map(str, n.to_bytes(4, "big")))
    if kind == "date" and "-" in value:
        first = datetime.date(1900, 1, 1)
        return str(first + datetime.timedelta(numbers((datetime.date.fromisoformat(value) - first).days, 17, 4297, kind)))
    return None


def test_equals_the_permutation_by_hand(spark):
    draw = random.Random(2)
    number = lambda n: "".join(draw.choice(string.digits) for _ in range(n))
    rows = [(k, v) for k, vs in VALUES.items() for v in vs]
    rows += [("ssn", f"{draw.choice(['001', '665', '899', '123'])}-{draw.randrange(1, 100):02d}-{draw.randrange(1, 10000):04d}") for _ in range(300)]
    rows += [("email", f"{draw.choice('aBz_9')}{number(draw.randrange(9))}@x.org") for _ in range(50)]
    rows += [("ipv4", ".".join(str(draw.randrange(256)) for _ in range(4))) for _ in range(50)]
    rows += [("card", p + check_digit(p)) for p in ("4" + number(14) for _ in range(50))]
    rows += [("date", str(datetime.date(1900, 1, 1) + datetime.timedelta(draw.randrange(73049)))) for _ in range(50)]
    seen = 0
    for r in swapped(spark, spark.createDataFrame(rows, "kind string, value string")).withColumn("again", pii.kind_of(F.col("p"))).collect():
        want = by_hand(r["kind"], r["value"])
        assert want in (None, r["p"]) and r["back"] == r["value"] and r["again"] == r["kind"], r
        seen += want is not None
    assert seen > 500


def test_the_key_is_in_no_plan(spark):
    docs = spark.createDataFrame([(1, "at 10.1.2.3 or a@b.org")], "doc_id long, text string")
    out = pii.pseudonymised(docs, "quite-secret-key")
    assert out.first()["text"] != "at 10.1.2.3 or a@b.org"
    plan = out._jdf.queryExecution().toString()
    own = hmac.digest(b"quite-secret-key", b"email", hashlib.sha256)
    block = bytes(x ^ 0x36 for x in own.ljust(64, b"\0")).hex()
    assert "quite-secret" not in plan and block[:20] not in plan.lower().replace(" ", "")


def test_formats_hold_and_pseudonyms_come_back(spark):
    rows = [(k, v) for k, vs in VALUES.items() for v in vs]
    df = swapped(spark, spark.createDataFrame(rows, "kind string, value string"))
    for r in df.collect():
        assert r["found"] == r["kind"] and r["back"] == r["value"], r
        assert r["p"] != r["value"] and r["other"] != r["p"], r
        if r["kind"] == "card":
            assert shape(r["p"]) == shape(r["value"]) and luhn(re.sub(r"\D", "", r["p"]))
        elif r["kind"] == "iban":
            assert shape(r["p"]) == shape(r["value"]) and mod97(r["p"].replace(" ", "")) == 1
        elif r["kind"] != "ipv4":
            assert shape(r["p"]) == shape(r["value"])
    again = df.select(pii.kind_of(F.col("p")).alias("k"), "kind").collect()
    assert all(r["k"] == r["kind"] for r in again)


def test_permutation_is_one_to_one(spark):
    ranged = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("v"), "id")
    given = ranged.select("*", pii.keyed(spark, "k").alias("keys"))
    out = given.select(pii.permuted(F.col("v"), F.col("keys"), "card").alias("p"), pii.permuted_number(F.col("id"), 25, 40, F.col("keys"), "date").alias("n"))
    assert out.select("p").distinct().count() == 1000 and out.agg(F.countDistinct("n"), F.min("n"), F.max("n")).first()[:] == (1000, 0, 999)


def test_texts(spark):
    text = "mail " + " and ".join(v for vs in VALUES.values() for v in vs) + ". not " + ", ".join(NOT) + "."
    docs = spark.createDataFrame([(1, text), (2, f"again {VALUES['card'][0]}, {VALUES['email'][0]}."), (3, "none")], "doc_id long, text string")
    rows = pii.findings(docs, "k").collect()
    by = defaultdict(list)
    for r in rows:
        source = text if r["doc_id"] == 1 else f"again {VALUES['card'][0]}, {VALUES['email'][0]}."
        by[r["doc_id"], r["kind"]].append((source[r["start"] : r["start"] + r["length"]], r["pseudonym"]))
    assert {k: sorted(v for v, _ in by[1, k]) for k in VALUES} == {k: sorted(v) for k, v in VALUES.items()}
    assert set(by[2, "card"]) <= set(by[1, "card"]) and set(by[2, "email"]) <= set(by[1, "email"])
    new = {r["doc_id"]: r["text"] for r in pii.pseudonymised(docs, "k").collect()}
    for pairs in by.values():
        for value, other in pairs:
            text = text.replace(value, other)
    assert new[1] == text and new[3] == "none"


def test_values_beside_short_words_and_numbers(spark):
    cases = [
        ("ES9121000418450200051332 BIC", ["ES9121000418450200051332"]), ("AT611904300234573201 EUR", ["AT611904300234573201"]), ("4111111111111111 123", ["4111111111111111"]),
        ("4111 1111 1111 1111 12/27", ["4111 1111 1111 1111"]), ("12 4111 1111 1111 1111", ["4111 1111 1111 1111"]), ("1234 4111 1111 1111 1111 9", ["4111 1111 1111 1111"]),
        ("7 4111 1111 1111 1111 2024-01-05 x", ["4111 1111 1111 1111", "2024-01-05"]), ("ES91 2100 0418 4502 0005 1332 4111 1111 1111 1111", ["ES91 2100 0418 4502 0005 1332", "4111 1111 1111 1111"]),
        ("4111-1111-1111-1111-123", ["4111-1111-1111-1111"]), ("4111 1111 1111 1112 2", []), ("12 " * 3000, None),
    ]
    docs = spark.createDataFrame([(i, f"a: {t} b") for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got, new = {i: [] for i in range(len(cases))}, {r["doc_id"]: r["text"] for r in pii.pseudonymised(docs, "k").collect()}
    for r in sorted(pii.findings(docs, "k").collect(), key=lambda r: r["start"]):
        text = f"a: {cases[r['doc_id']][0]} b"
        got[r["doc_id"]].append(text[r["start"] : r["start"] + r["length"]])
        assert new[r["doc_id"]][r["start"] : r["start"] + r["length"]] == r["pseudonym"]
    for i, (text, values) in enumerate(cases):
        assert values is None or got[i] == values, (text, got[i])
        assert len(new[i]) == len(text) + 5 and not any(v in new[i] for v in values or [])


def test_query_leaves_no_value(spark, sf):
    rows = pii_query(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    n = 0
    for r in rows:
        for m in re.finditer(r"[a-z]+\.\d+@mail\d\.example\.com|\+1 \(\d{3}\) \d{3}-\d{4}", texts[r["doc_id"]] or ""):
            n += 1
            assert m[0] not in r["clean_text"] and r["n_found"] > 0
    assert n > 0 and all((r["n_found"] == 0) == (r["clean_text"] == texts[r["doc_id"]]) for r in rows)


def test_hard_rows(spark):
    out = pii.pseudonymised(hard(spark), "k")
    assert out.columns == hard(spark).columns and sorted(map(str, out.collect())) == sorted(map(str, hard(spark).collect()))
    assert pii.findings(hard(spark), "k").count() == 0 and pii.summarised(empty(spark), "k").count() == 0
    assert pii.summarised(hard(spark), "k").filter("n_found is null or kinds is null").count() == 0
