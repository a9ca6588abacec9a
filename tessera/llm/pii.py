"""PII: validated numbers and dates become keyed pseudonyms of the same format; equal values get equal pseudonyms everywhere.

One expression finds candidates, leftmost first; each is validated (check digits, octets, number plan, calendar) and permuted by
a Feistel network inside the set of valid values of its format: halves of sizes a and b in turn are shifted, modulo their size, by a
keyed hash of the other half. With the key, each round is undone by pseudonyms(..., undo=True), so different values stay different. What fails validation stays as it was.

  card     13 to 19 digits with a right Luhn digit: the digits before it are permuted and a right one is appended
  phone    ten-digit numbers of the North American plan (area and exchange from 200): 800 x 8,000,000; others with + and country code: digits after the code
  ssn      ddd-dd-dddd with a valid area, group and serial: 88,902 x 9,999
  ip       dotted quads: 65,536 x 65,536
  date     yyyy-mm-dd, dd.mm.yyyy, dd/mm/yyyy (or mm/dd/yyyy if only that is a date): a day among the 146,097 = 189 x 773 of its 400 years
  iban     of its country's length, right modulo 97: characters after the check digits are permuted within their kind, check digits are made right
  email    letters and digits before the top-level domain (64 at most before the @) are permuted within their kind; case stays, and addresses that differ in it alone stay linked

All of it is DataFrame and SQL functions, and each row is changed on its own.

Defined results: a null text stays null; texts without candidates are unchanged; U+0001 in a text is kept; null doc_ids, repeated rows and
other columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: For tests and the registered query; give your own, secret key.
KEY = "tessera-example-key"
ROUNDS = 8
MARK, ESCAPED = "\x01\x02", "\x01\x03"
_LEFT, _RIGHT = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: characters of an IBAN by country
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ DZ ES MD PK RO SA SE SK TN VG YE", 25: "AO CV GW LY MZ PT ST", 26: "IR IS TR", 27: "BI CF CG CM DJ FR GA GR IT KM MC MG SM TD",
    28: "AL AZ BF BJ BY CI CY DO GQ GT HN HU LB ML MA NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
#: the country's length first, so that what follows is left to others; any length where that doesn't end at a word's end
_IBANS = "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") + _RIGHT for n, c in IBAN_LENGTHS.items())
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "iban": rf"{_LEFT}(?=[A-Z]{{2}}[0-9]{{2}})(?:{_IBANS}|[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?{_RIGHT})",
    "ip": rf"(?<![0-9A-Za-z])(?<![0-9]\.){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9A-Za-z])(?!\.[0-9])",
    "card": rf"{_LEFT}(?:[0-9]{{13,19}}|[0-9]{{4}}(?:[ -][0-9]{{4}}){{2}}[ -][0-9]{{1,7}}|[0-9]{{4}}[ -][0-9]{{6}}[ -][0-9]{{5}}){_RIGHT}",
    "ssn": rf"{_LEFT}(?<!-)[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?!-){_RIGHT}",
    "date": rf"{_LEFT}(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{2}}\.[0-9]{{2}}\.[0-9]{{4}}|[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}){_RIGHT}",
    "phone": rf"(?<![0-9A-Za-z+])(?:(?:\+?1[ .-]?)?(?:\([2-9][0-9]{{2}}\) ?|[2-9][0-9]{{2}}[ .-])[2-9][0-9]{{2}}[ .-][0-9]{{4}}|\+[1-9][0-9]{{0,2}}(?:[ .-]?[0-9]{{2,4}}){{2,5}}){_RIGHT}",
}
ANY = "|".join(PATTERNS.values())


def _prf(key: str, kind: str, turn: Column, *parts: Column) -> Column:
    """60 keyed bits, as a long."""
    message = F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.sha2(message, 256), 1, 15), 16, 10).cast("long")


def _rounds(rounds: int, undo: bool) -> Column:
    return F.sequence(F.lit(rounds - 1), F.lit(0), F.lit(-1)) if undo else F.sequence(F.lit(0), F.lit(rounds - 1))


def feistel(left: Column, right: Column, a: Column | int, b: Column | int, key: str, kind: str, undo: bool = False, rounds: int = ROUNDS) -> Column:
    """struct<a, b>: a permutation of pairs (left < a, right < b), or its inverse."""
    sign = -1 if undo else 1
    a, b = (F.lit(x) if isinstance(x, int) else x for x in (a, b))

    def turn(acc, r):
        x = F.pmod(acc["a"] + sign * F.pmod(_prf(key, kind, r, acc["b"]), a), a)
        return F.when(r % 2 == 0, F.struct(x.alias("a"), acc["b"].alias("b"))).otherwise(F.struct(acc["a"].alias("a"), F.pmod(acc["b"] + sign * F.pmod(_prf(key, kind, r, acc["a"]), b), b).alias("b")))

    return F.aggregate(_rounds(rounds, undo), F.struct(left.cast("long").alias("a"), right.cast("long").alias("b")), turn)


def permuted(text: Column, key: str, kind: str, undo: bool = False, rounds: int = ROUNDS) -> Column:
    """Letters a-z, A-Z and digits of a string, each within its kind: halves in turn are shifted by a keyed hash of the other (or shifted back)."""
    sign = -1 if undo else 1

    def shifted(half: Column, other: Column, r: Column) -> Column:
        def one(c, i):
            v, code = _prf(key, kind, r, i, other), F.ascii(c)
            out = c
            for low, high in ((48, 57), (65, 90), (97, 122)):
                out = F.when(code.between(low, high), F.chr(low + F.pmod(code - low + sign * F.pmod(v, F.lit(high - low + 1)), F.lit(high - low + 1)))).otherwise(out)
            return out

        return F.when(F.length(half) == 0, half).otherwise(F.array_join(F.transform(F.split(half, ""), one), ""))

    def turn(acc, r):
        h = F.floor(F.length(acc) / 2).cast("int")
        left, right = F.substring(acc, F.lit(1), h), F.substring(acc, h + 1, F.length(acc))
        return F.when(r % 2 == 0, F.concat(shifted(left, right, r), right)).otherwise(F.concat(left, shifted(right, left, r)))

    return F.aggregate(_rounds(rounds, undo), text, turn)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _pad(x: Column, n: Column | int) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def _into(shape: Column, digits: Column, keep: Column | int = 0) -> Column:
    """`shape` with its digits after the first `keep` replaced, in order, by `digits`."""
    keep = F.lit(keep) if isinstance(keep, int) else keep

    def one(c, i):
        at = F.length(_digits(F.substring(shape, F.lit(1), i + 1))) - keep
        return F.when(c.rlike("[0-9]") & (at > 0), F.substring(digits, at, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(shape, ""), one), "")


def _luhn(digits: Column, odd: int) -> Column:
    """The sum of digits, every second doubled, where `odd` is 0 if the last isn't, 1 if it is."""
    return F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1 - odd, F.pmod(c.cast("int") * 2, F.lit(10)) + F.floor(c.cast("int") / 5).cast("int")).otherwise(c.cast("int"))),
        F.lit(0),
        lambda acc, x: acc + x,
    )


def _mod97(x: Column) -> Column:
    return F.aggregate(F.split(x, ""), F.lit(0), lambda acc, c: F.when(c.rlike("[0-9]"), F.pmod(acc * 10 + F.ascii(c) - 48, F.lit(97))).otherwise(F.pmod(acc * 100 + F.ascii(c) - 55, F.lit(97))))


def _halves(digits: Column, key: str, kind: str, undo: bool) -> Column:
    """Digits, at most 18, permuted in the set of as many digits."""
    n = F.length(digits)
    h = F.floor(n / 2).cast("int")
    a, b = F.pow(F.lit(10.0), h).cast("long"), F.pow(F.lit(10.0), n - h).cast("long")
    out = feistel(F.substring(digits, F.lit(1), h).cast("long"), F.substring(digits, h + 1, n).cast("long"), a, b, key, kind, undo)
    return F.concat(_pad(out["a"], h), _pad(out["b"], n - h))


def _card(x: Column, key: str, undo: bool = False) -> Column:
    d = _digits(x)
    body = _halves(F.substring(d, F.lit(1), F.length(d) - 1), key, "card", undo)
    check = F.pmod(10 - F.pmod(_luhn(body, 1), F.lit(10)), F.lit(10)).cast("string")
    return F.when(F.length(d).between(13, 19) & (_luhn(d, 0) % 10 == 0), _into(x, F.concat(body, check)))


def _phone(x: Column, key: str, undo: bool = False) -> Column:
    d = _digits(x)
    last = F.substring(d, -10, 10)
    area, rest = F.substring(last, 1, 3).cast("long") - 200, (F.substring(last, 4, 3).cast("long") - 200) * 10_000 + F.substring(last, 7, 4).cast("long")
    out = feistel(area, rest, 800, 8_000_000, key, "phone", undo)
    own = F.concat((out["a"] + 200).cast("string"), (F.floor(out["b"] / 10_000) + 200).cast("string"), _pad(out["b"] % 10_000, 4))
    plan = F.length(d).isin(10, 11) & ((F.length(d) == 10) | d.startswith("1")) & (area >= 0) & (F.substring(last, 4, 1) >= "2")
    code = F.length(F.regexp_extract(x, r"^\+([0-9]{1,3})", 1))
    other = x.startswith("+") & F.length(d).between(8, 15)
    return F.when(plan, _into(x, own, F.length(d) - 10)).when(other, _into(x, _halves(F.substring(d, code + 1, F.length(d)), key, "phone", undo), code))


def _ssn(x: Column, key: str, undo: bool = False) -> Column:
    area, group, serial = (F.substring(x, i, n).cast("long") for i, n in ((1, 3), (5, 2), (8, 4)))
    out = feistel((area - 1 - F.when(area > 666, 1).otherwise(0)) * 99 + group - 1, serial - 1, 898 * 99, 9_999, key, "ssn", undo)
    index = F.floor(out["a"] / 99)
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    return F.when(valid, F.concat_ws("-", _pad(index + 1 + F.when(index + 1 >= 666, 1).otherwise(0), 3), _pad(out["a"] % 99 + 1, 2), _pad(out["b"] + 1, 4)))


def _ip(x: Column, key: str, undo: bool = False) -> Column:
    o = F.transform(F.split(x, r"\."), lambda c: c.cast("long"))
    out = feistel(F.get(o, F.lit(0)) * 256 + F.get(o, F.lit(1)), F.get(o, F.lit(2)) * 256 + F.get(o, F.lit(3)), 65_536, 65_536, key, "ip", undo)
    return F.concat_ws(".", F.floor(out["a"] / 256), out["a"] % 256, F.floor(out["b"] / 256), out["b"] % 256)


def _date(x: Column, key: str, undo: bool = False) -> Column:
    out = F.lit(None).cast("string")
    days = 146_097  # of 400 years
    for shape, written in (("[0-9]{2}/[0-9]{2}/[0-9]{4}", "MM/dd/yyyy"), ("[0-9]{2}/[0-9]{2}/[0-9]{4}", "dd/MM/yyyy"), (r"[0-9]{2}\.[0-9]{2}\.[0-9]{4}", "dd.MM.yyyy"), ("[0-9]{4}-[0-9]{2}-[0-9]{2}", "yyyy-MM-dd")):
        date = F.try_to_date(x, written)
        day = F.datediff(date, F.lit("1600-01-01").cast("date")).cast("long")
        era, within = F.floor(day / days), F.pmod(day, F.lit(days))
        moved = feistel(F.floor(within / 773), within % 773, 189, 773, key, "date", undo)
        new = F.date_add(F.lit("1600-01-01").cast("date"), (era * days + moved["a"] * 773 + moved["b"]).cast("int"))
        usable = x.rlike(f"^{shape}$") & date.isNotNull() & (F.year(date).between(1600, 9599))
        out = F.when(usable, F.date_format(new, written)).otherwise(out)
    return out


def _iban(x: Column, key: str, undo: bool = False) -> Column:
    flat = F.regexp_replace(x, " ", "")
    country, rest = F.substring(flat, 1, 2), F.substring(flat, F.lit(5), F.length(flat))
    moved = permuted(rest, key, "iban", undo)
    check = _pad(98 - _mod97(F.concat(moved, country, F.lit("00"))), 2)
    whole = F.concat(country, check, moved)
    spaced = F.array_join(F.transform(F.split(x, ""), lambda c, i: F.when(c == " ", c).otherwise(F.substring(whole, F.length(F.regexp_replace(F.substring(x, F.lit(1), i + 1), " ", "")), F.lit(1)))), "")
    return F.when(F.length(flat).between(15, 34) & (_mod97(F.concat(rest, F.substring(flat, 1, 4))) == 1), spaced)


def _email(x: Column, key: str, undo: bool = False) -> Column:
    low = F.lower(x)
    top = F.substring_index(low, ".", -1)
    moved = F.concat(permuted(F.substring(low, F.lit(1), F.length(low) - F.length(top)), key, "email", undo), top)
    # addresses that differ in case alone stay linked; each letter keeps its case
    return F.array_join(F.zip_with(F.split(x, ""), F.split(moved, ""), lambda was, now: F.when(was.rlike("[A-Z]"), F.upper(now)).otherwise(now)), "")


MAKERS = {"email": _email, "iban": _iban, "ip": _ip, "card": _card, "ssn": _ssn, "date": _date, "phone": _phone}


def pseudonyms(documents: DataFrame, key: str = KEY, text: str = "text", found_as: str | None = "pii", undo: bool = False) -> DataFrame:
    """`documents` with `text` rewritten, and a column `found_as` (None: without it; an input column of that name is replaced): array<struct<kind, value>> of the
    pseudonyms put in, in order of place. undo: from pseudonyms back to the values, with the same key."""

    def found(piece):
        out = F.struct(F.lit(None).cast("string").alias("kind"), piece.alias("value"))
        # of two kinds whose expressions both match the piece, the one that validates first in order of PATTERNS is taken
        for kind, make in reversed(MAKERS.items()):
            new = make(piece, key, undo)
            out = F.when(piece.rlike(f"^(?:{PATTERNS[kind]})$") & new.isNotNull(), F.struct(F.lit(kind).alias("kind"), new.alias("value"))).otherwise(out)
        return out

    source = documents[text].cast("string")
    marked = F.regexp_replace(F.replace(source, F.lit("\x01"), F.lit(ESCAPED)), f"({ANY})", f"{MARK}$1{MARK}")
    pieces = F.when(source.rlike("[0-9@]"), F.transform(F.split(marked, MARK), lambda p, i: F.when(i % 2 == 1, found(p)).otherwise(F.struct(F.lit(None).cast("string").alias("kind"), p.alias("value")))))
    name = "_pieces"
    while name in documents.columns:
        name += "_"
    held = documents.withColumn(name, pieces)
    made = F.when(F.size(name) > 1, F.replace(F.array_join(F.transform(name, lambda p: p["value"]), ""), F.lit(ESCAPED), F.lit("\x01"))).otherwise(held[text])
    pii = F.coalesce(F.filter(name, lambda p: p["kind"].isNotNull()), F.array().cast("array<struct<kind:string,value:string>>"))
    kept = [made.alias(text) if c == text else held[c] for c in documents.columns if c != found_as]
    return held.select(*kept, *([] if found_as is None else [pii.alias(found_as)]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every document."""
    found = pseudonyms(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(pii, p -> p.kind = '{k}')) AS long)").alias(f"n_{k}") for k in PATTERNS]
    return found.select("doc_id", "text", *counts, F.size("pii").cast("long").alias("n_pii"))
