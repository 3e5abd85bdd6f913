import hashlib
import random
import re

from pyspark.sql import functions as F

from barlake.llm import pseudonyms, queries

TEXTS = [
    "mail fakol.33@mail7.example.com, 54.158.173.199, +1 (555) 123-4567 card 4088495698897153 or 4088-4956-9889-7153 end",
    "card 4088495698897154 bad; 2024-02-30 bad; 2024-02-29 ok 29.02.2024 and 02/29/2024 ok 31/12/1999.",
    None,
    "",
    "123-45-6789 000-12-3456 999.1.1.1 v1.2.3.4.5 +49 30 1234567 555-123-4567 a@b",
    "same fakol.33@mail7.example.com 4088495698897153 54.158.173.199",
    "Price 12,345.67 in 2024; 12:30 x 1234567890123 and é 😀",
    "4405935324758010 16.120.181.235",
    "x" * 200_000 + " a.b@c.org",
]


def luhn(digits):
    total = 0
    for place, digit in enumerate(reversed(digits)):
        worth = int(digit) * (1 + place % 2)
        total += worth - 9 * (worth > 9)
    return total % 10 == 0


def replaced(spark, texts, key="k"):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS n_card", "'x' AS r")
    return {r.doc_id: r for r in pseudonyms.with_pseudonyms(docs, key).collect()}


def test_formats_are_kept_and_equal_values_linked(spark):
    got = replaced(spark, TEXTS)
    first, linked = got[0].text, got[5].text
    shape = re.compile(r"mail ([a-z]{5}\.\d\d@mail7\.example\.com), (\d+\.\d+\.\d+\.\d+), (\+1 \(\d{3}\) \d{3}-\d{4}) card (\d{16}) or (\d{4}(?:-\d{4}){3}) end")
    email, address, phone, card, dashed = shape.fullmatch(first).groups()
    assert luhn(card) and dashed.replace("-", "") == card
    assert all(int(part) < 256 for part in address.split("."))
    assert linked == f"same {email} {card} {address}"
    assert not set(TEXTS[0].split()) & {email, address, card, dashed}
    assert (got[0].n_email, got[0].n_address, got[0].n_phone, got[0].n_card) == (1, 1, 1, 2)


def test_only_valid_values_are_replaced(spark):
    got = replaced(spark, TEXTS)
    assert got[1].text.startswith("card 4088495698897154 bad; 2024-02-30 bad; ") and got[1].n_date == 4
    iso, dotted, slashed = re.search(r"bad; (\d{4}-\d\d-\d\d) ok (\d\d\.\d\d\.\d{4}) and (\d\d/\d\d/\d{4}) ok", got[1].text.split("; ", 1)[1]).groups()
    assert dotted.split(".")[::-1] == iso.split("-") and [slashed.split("/")[k] for k in (2, 0, 1)] == iso.split("-")
    assert "000-12-3456 999.1.1.1 v1.2.3.4.5" in got[4].text and got[4].text.endswith("a@b") and "123-45-6789" not in got[4].text
    assert got[6].text == TEXTS[6] and got[2].text is None and got[3].text == ""
    assert "4405935324758010" not in got[7].text and "16.120.181.235" not in got[7].text
    assert got[8].text[:200_001] == TEXTS[8][:200_001] and got[8].n_email == 1
    assert replaced(spark, []) == {}


def test_keys_matter(spark):
    assert replaced(spark, TEXTS, "k")[0].text != replaced(spark, TEXTS, "other")[0].text


def test_permutations(spark):
    low, high = pseudonyms.DAYS
    days = spark.range(low * high).select(pseudonyms.feistel(F.col("id"), low, high, "k", "date").alias("p"))
    assert tuple(days.selectExpr("count(distinct p)", "min(p)", "max(p)").first()) == (low * high, 0, low * high - 1)
    digits = spark.range(1000).select(pseudonyms.permuted_digits(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "t").alias("p"))
    assert tuple(digits.selectExpr("count(distinct p)", "min(length(p))", "max(length(p))").first()) == (1000, 3, 3)
    letters = spark.range(26**3).select(F.concat(*(F.char(97 + (F.col("id") / 26**k).cast("long") % 26) for k in range(3))).alias("x"))
    moved = letters.select(pseudonyms.permuted_letters(F.col("x"), "k", "t").alias("p"))
    assert tuple(moved.selectExpr("count(distinct p)", "min(p)", "max(p)").first()) == (26**3, "aaa", "zzz")


def permuted(value, low, high):
    """The Feistel network in whole numbers, with the key `k` and the tweak `t`."""
    prf = lambda turn, x: int(hashlib.sha256(f"k|t|{turn}|{x}".encode()).hexdigest()[:13], 16)
    left, right = divmod(value, high)
    for turn in range(pseudonyms.ROUNDS):
        if turn % 2 == 0:
            left = (left + prf(turn, right)) % low
        else:
            right = (right + prf(turn, left)) % high
    return left * high + right


def test_long_runs_are_permuted_exactly(spark):
    draw = random.Random(8)
    runs = ["".join(draw.choice(pseudonyms.LETTERS) for _ in range(size)) for size in (10, 11, 12, 12) for _ in range(300)] + ["z" * 12, "a" * 12]
    numbers = ["".join(draw.choice("0123456789") for _ in range(size)) for size in (15, 17, 18, 18) for _ in range(300)] + ["9" * 18, "0" * 18]
    rows = spark.createDataFrame(list(zip(runs, numbers, strict=True)), "x string, y string")
    moved = [pseudonyms.permuted_letters(F.col("x"), "k", "t").alias("letters"), pseudonyms.permuted_digits(F.col("y"), "k", "t").alias("digits")]
    for r in rows.select("x", "y", *moved).collect():
        size = len(r.x)
        number, value = 0, sum(26**k * (ord(c) - 97) for k, c in enumerate(reversed(r.x)))
        for c in r.letters:
            number = number * 26 + ord(c) - 97
        assert len(r.letters) == size and number == permuted(value, 26 ** (size // 2), 26 ** (size - size // 2)), r.x
        size = len(r.y)
        assert len(r.digits) == size and int(r.digits) == permuted(int(r.y), 10 ** (size // 2), 10 ** (size - size // 2)), r.y


def test_query_against_patterns(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in queries.table(spark, sf, "documents").collect()}
    private = re.compile(r"[\w.+-]+@[\w-]+\.[\w.]+\w|(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w])|\+1 \(\d{3}\) \d{3}-\d{4}|(?<![\w])\d{16}(?!\w)")
    seen = 0
    for r in queries.op10_pseudonyms(spark, sf).collect():
        values = [v for v in private.findall(texts[r.doc_id]) if not v.isdigit() or luhn(v)]
        seen += len(values)
        assert not any(v in r.text for v in values)
        assert r.n_email + r.n_address + r.n_phone + r.n_card == len(values)
        if not values:
            assert r.text == texts[r.doc_id]
    assert seen > 50


def test_plan_runs_no_python(spark):
    plan = queries.op10_pseudonyms(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
