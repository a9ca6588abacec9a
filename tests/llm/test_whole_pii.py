"""IBANs are found whatever follows them; pseudonyms can be undone and equal an independent Feistel network."""

import hashlib
import random

from tessera.llm import pii

IBANS = ["ES91 2100 0418 4502 0005 1332", "ES9121000418450200051332", "AT61 1904 3002 3457 3201", "DE89 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 19", "SE45 5000 0000 0583 9825 7466", "NO93 8601 1117 947", "PL61 1090 1014 0000 0712 1981 2874"]
AFTER = ["", " EUR", " BIC", " 2024", " 2024-01-05", " BIC COBADEFF", " 12", ", A"]


def test_iban_before_capitals_and_digits(spark):
    pairs = [(x, a) for x in IBANS for a in AFTER]
    rows = [(i, f"pay {x}{a}") for i, (x, a) in enumerate(pairs)]
    for r in pii.pseudonyms(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        iban, after = pairs[r.doc_id]
        assert r.pii[0].kind == "iban" and iban not in r.text, r.text
        assert len(r.text) == len(f"pay {iban}{after}")
        if after == " 2024-01-05":
            assert [p.kind for p in r.pii] == ["iban", "date"]
        else:
            assert r.text.endswith(after) and len(r.pii) == 1


def values(seed=3, n=40):
    r = random.Random(seed)
    digits = lambda k: "".join(str(r.randrange(10)) for _ in range(k))

    def luhn(body):
        total = sum((2 * int(c) % 10 + int(c) // 5) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body)))
        return body + str(-total % 10)

    for _ in range(n):
        card = luhn(digits(15))
        yield r.choice([card, f"{card[:4]} {card[4:8]} {card[8:12]} {card[12:]}", luhn(digits(r.randint(12, 18)))])
        yield r.choice(["({}) {}-{}", "{}-{}-{}", "+1 {} {} {}"]).format(r.randint(200, 999), r.randint(200, 999), digits(4))
        yield "+44 20 " + digits(4) + " " + digits(4)
        yield f"{r.choice([1, 665, 667, 899])}".zfill(3) + f"-{r.randint(1, 99):02}-{r.randint(1, 9999):04}"
        yield ".".join(str(r.randrange(256)) for _ in range(4))
        y, m, d = r.randint(1900, 2099), r.randint(1, 12), r.randint(1, 28)
        yield r.choice([f"{y}-{m:02}-{d:02}", f"{d:02}.{m:02}.{y}"])
        yield r.choice(["Jane.Doe", "x_y+z9", "A1"]) + f"@Mail{r.randrange(99)}.example.org"
    yield from IBANS
    yield from ("2000-02-29", "1600-01-01", "0.0.0.0", "255.255.255.255", "001-01-0001", "899-99-9999")


def test_pseudonyms_are_undone(spark):
    every = list(values())
    rows = [(i, f"a {v}, b") for i, v in enumerate(every)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hidden = {r.doc_id: r.text for r in pii.pseudonyms(docs, "k1").collect()}
    assert sum(hidden[i] == t for i, t in rows) <= 1  # a value may be its own pseudonym, by chance
    back = pii.pseudonyms(spark.createDataFrame(list(hidden.items()), "doc_id long, text string"), "k1", undo=True).collect()
    assert {r.doc_id: r.text for r in back} == dict(rows)


def test_an_independent_feistel_network(spark):
    def prf(key, kind, turn, x):
        return int(hashlib.sha256(f"{key}|{kind}|{turn}|{x}".encode()).hexdigest()[:15], 16)

    def feistel(a, b, n, m, key, kind):
        for turn in range(8):
            if turn % 2 == 0:
                a = (a + prf(key, kind, turn, b) % n) % n
            else:
                b = (b + prf(key, kind, turn, a) % m) % m
        return a, b

    r = random.Random(8)
    ips = [tuple(r.randrange(256) for _ in range(4)) for _ in range(50)]
    want = []
    for a, b, c, d in ips:
        x, y = feistel(a * 256 + b, c * 256 + d, 65_536, 65_536, "k", "ip")
        want.append(f"{x // 256}.{x % 256}.{y // 256}.{y % 256}")
    rows = [(i, ".".join(map(str, p))) for i, p in enumerate(ips)]
    got = pii.pseudonyms(spark.createDataFrame(rows, "doc_id long, text string"), "k").orderBy("doc_id").collect()
    assert [x.text for x in got] == want
    phones = [(r.randint(200, 999), r.randint(200, 999), r.randrange(10_000)) for _ in range(50)]
    want = []
    for area, exchange, line in phones:
        x, y = feistel(area - 200, (exchange - 200) * 10_000 + line, 800, 8_000_000, "k", "phone")
        want.append(f"{x + 200}-{y // 10_000 + 200}-{y % 10_000:04}")
    rows = [(i, "{}-{}-{:04}".format(*p)) for i, p in enumerate(phones)]
    got = pii.pseudonyms(spark.createDataFrame(rows, "doc_id long, text string"), "k").orderBy("doc_id").collect()
    assert [x.text for x in got] == want


def test_addresses_keep_their_case(spark):
    rows = [(1, "Jane.Doe@Example.org jane.doe@example.org JANE.DOE@EXAMPLE.ORG")]
    a, b, c = pii.pseudonyms(spark.createDataFrame(rows, "doc_id long, text string")).first().text.split(" ")
    assert a.lower() == b == c.lower() and [x.isupper() for x in a] == [x.isupper() for x in "Jane.Doe@Example.org"] and b != "jane.doe@example.org"


def test_an_input_column_of_the_name_stays_if_asked(spark):
    docs = spark.createDataFrame([(1, "host 79.197.74.40", "mine")], "doc_id long, text string, pii string")
    got = pii.pseudonyms(docs, found_as=None)
    assert got.columns == docs.columns and got.first().pii == "mine"


def test_long_runs_of_address_characters(spark):
    text = "a.b-c" * 400_000 + "@example.org 79.197.74.40"
    r = pii.pseudonyms(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [p.kind for p in r.pii] == ["ip"] and len(r.text) > 2_000_000
