"""Format-preserving Feistel pseudonyms for personal data.

Values are found by pattern and validated (Luhn and issuer for cards, mod 97
for IBANs, octets, calendar dates, social security areas); what fails stays
as it is. A valid value is replaced by a keyed permutation of the values of
its format, so equal values get equal pseudonyms in every document, distinct
ones stay distinct, and the pseudonym passes the same validation.

* Numbers and addresses: an alternating Feistel network over the characters
  that may vary. Each keeps its class (digit, upper case, lower case); the
  characters at even places are shifted by a keyed hash of those at odd
  places, then the other way round, for ``ROUNDS`` rounds.
* Pairs (dates, IPv4, social security numbers): the same over two integers
  ``Z_a x Z_b`` whose product is the exact number of valid values.
* Check digits (Luhn, mod 97) are computed anew.

All of it is Spark expressions. Texts without a digit, ``@`` or key prefix
are passed through after one scan.

Kept as they are: issuer digit and check rule of a card, country code of a
phone number, country of an IBAN, the domain of an e-mail address, separators
everywhere. Dates are permuted from 1900-01-01 on for 81,000 days.

Defined results: null text stays null, with no values found; repeated rows
and repeated values get the same pseudonyms; values touching others without
a separator are taken as one longer, mostly invalid, value; an empty table
gives no rows; other columns are untouched.

Values beside each other: a match is tried at every place a value may start,
as its first word alone, then whole, then one word shorter each time, and the
leftmost valid one is taken. A group of digits that begins a date, social
security number, address, fraction or card in its usual groups is part of no
number before it. Digits that fit the number before them belong to it: a
grouped card of 16 digits and a number of 3 that make a valid one of 19, or a
plain number behind a grouped phone number whose country has no fixed length.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
_CARD = (r"(?:4\d{12}(?:\d{3}){0,2}|5[1-5]\d{14}|2(?:22[1-9]|2[3-9]\d|[3-6]\d\d|7[01]\d|720)\d{12}|3[47]\d{13}"
         r"|3(?:0[0-5]|[68]\d)\d{11}|35(?:2[89]|[3-8]\d)\d{12}|6(?:011\d\d|5\d{4}|4[4-9]\d{3}|2\d{4})\d{10})")
#: What a group of digits behind a blank may begin instead of going on with the number before it.
_DATE = r"\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4}"
_OTHER = (rf"(?!(?:{_DATE})(?![\d/-])|\d{{3}}-\d{{2}}-\d{{4}}(?![\d-])|\d{{1,3}}(?:\.\d{{1,3}}){{3}}(?![\w])(?!\.\d)|\d{{1,2}}/\d)")
_NO_CARD = r"(?!(?:\d{4}[ -]){3}\d{1,4}(?!\d)|3\d{3}[ -]\d{6}[ -]\d{4,5}(?!\d)|\d{13,19}(?!\d))"
#: National digits of countries where all numbers have the same length.
_NATIONAL = {11: "86", 10: "1|7|44|52|91", 9: "31|33|34|41|48|61", 8: "45|47"}
_PHONE = "|".join(
    [rf"\+(?:{cc})(?:(?: {_OTHER}|[ .-]?\(|\)[ .-]?|[.-])?\d){{{n}}}(?![.-]?\d)" for n, cc in _NATIONAL.items()]
    # At most 15 digits; whatever has more is cut at a group.
    + [rf"\+\d{{1,3}}[ .-]?(?:\(\d{{1,4}}\)[ .-]?)?\d{{2,4}}(?:(?: {_OTHER}{_NO_CARD}|[.-])?\d{{2,4}}){{1,3}}(?!\d)(?<!" + 16 * r"\d[ .()-]{0,2}" + ")",
       r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\d)"])
#: Found values by kind; bounded repetitions only, so matching takes no stack.
PATTERNS: dict[str, str] = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![\d./-])(?:" + _DATE + r")(?![\d/-])(?!\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w])(?!\.\d)",
    "phone": rf"(?<![\w+])(?:{_PHONE})" r"|(?<![\w(])\(\d{3}\) \d{3}-\d{4}(?!\d)",
    "card": rf"(?<![\w.-])(?:\d{{4}}(?:[ -]\d{{4}}){{3}}(?:[ -]\d{{3}})?|\d(?:(?: {_OTHER}{_NO_CARD}|-)?\d){{12,18}})(?![\d])(?![.-]\d)",
    "key": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "token": r"(?<=(?:token|secret|password|api_key) ?[=:] ?[\"'])[A-Za-z0-9]{16,64}(?=[\"'])",
}
ANY = "|".join(PATTERNS.values())
#: Characters of an IBAN by country.
IBAN_CHARS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV",
    22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC",
    32: "LC", 33: "RU"}
_CHARS = r"\A(?:" + "|".join(rf"(?:{w.replace(' ', '|')}).{{{n - 2}}}" for n, w in IBAN_CHARS.items()) + "|(?!" + "|".join(
    " ".join(IBAN_CHARS.values()).split()) + r").*)\z"
_HINT = r"[0-9@]|AKIA|(?:token|secret|password|api_key) ?[=:]"
#: Days from 1900-01-01 as 300 x 270; social security areas but 000, 666 and 900-999, times the rest.
_DAYS, _IP, _SSN = (300, 270), (65536, 65536), (898, 99 * 9999)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _prf(h: Column, i: Column, modulus: Column) -> Column:
    """A pseudo-random number below the modulus from a hash and a place."""
    return (F.conv(F.substring(F.sha2(F.concat(h, F.lit(":"), i.cast("string")), 256), 1, 12), 16, 10).cast("long") % modulus)


def _pair(key: str, kind: str, u: Column, v: Column, mods: tuple[int, int]) -> Column:
    """Feistel network on Z_a x Z_b; returns struct(u, v) of longs."""
    a, b = (F.lit(m).cast("long") for m in mods)

    def turn(s: Column, r: Column) -> Column:
        h = F.concat(F.lit(f"{key}|{kind}|"), r.cast("string"), F.lit("|"))
        return _let((s["u"] + _prf(F.concat(h, s["v"].cast("string")), F.lit(0), a)) % a, lambda u2: F.struct(
            u2.alias("u"), ((s["v"] + _prf(F.concat(h, u2.cast("string")), F.lit(1), b)) % b).alias("v")))

    start = F.struct(u.cast("long").alias("u"), v.cast("long").alias("v"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), start, turn)


def _letters(key: str, kind: str, s: Column, nonzero_first: bool = False, lower: int = 26) -> Column:
    """Feistel network over the letters and digits of ``s``, each within its
    class. With ``nonzero_first`` a leading 0 stays and a leading 1-9 stays
    one; ``lower`` is the size of the lower-case class (6: hexadecimal)."""
    varies = lambda c: c.between(48, 57) | c.between(65, 90) | c.between(97, 122)

    def shape(c: Column, i: Column) -> Column:
        base = F.when(c >= 97, F.lit(97)).when(c >= 65, F.lit(65)).otherwise(F.lit(48))
        radix = F.when(c >= 97, F.lit(lower)).when(c >= 65, F.lit(26)).otherwise(F.lit(10))
        if nonzero_first:
            lead = (i == 0) & (c < 65)
            base = F.when(lead & (c > 48), F.lit(49)).otherwise(base)
            radix = F.when(lead, F.when(c > 48, F.lit(9)).otherwise(F.lit(1))).otherwise(radix)
        return F.struct(base.alias("base"), radix.cast("long").alias("radix"))

    def run(values: Column, shapes: Column) -> Column:
        def turn(vs: Column, r: Column) -> Column:
            fixed = F.filter(vs, lambda v, i: i % 2 != r % 2)
            h = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), F.size(vs).cast("string"), r.cast("string"),
                                   F.array_join(F.transform(fixed, lambda v: v.cast("string")), ",")), 256)
            return _let(h, lambda h: F.transform(vs, lambda v, i: F.when(
                i % 2 == r % 2, (v + _prf(h, i, F.get(shapes, i)["radix"])) % F.get(shapes, i)["radix"]).otherwise(v)))

        done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), values, turn)
        return F.transform(done, lambda v, i: F.char(v + F.get(shapes, i)["base"]))

    def permuted(cs: Column) -> Column:
        return _let(F.transform(cs, shape), lambda shapes: run(
            F.transform(cs, lambda c, i: (c - F.get(shapes, i)["base"]).cast("long")), shapes))

    def whole(codes: Column) -> Column:
        places = F.filter(F.transform(codes, lambda c, i: F.when(varies(c), i)), lambda i: i.isNotNull())
        # Varying characters go back to their places; the others stand where they stood.
        return _let(places, lambda ps: _let(permuted(F.filter(codes, varies)), lambda new: F.array_join(F.transform(
            codes, lambda c, i: F.when(varies(c), F.get(new, F.array_position(ps, i).cast("int") - 1)).otherwise(F.char(c))), "")))

    return _let(F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.ascii(c)), whole)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn_sum(digits: Column, skip: int) -> Column:
    """Luhn sum of a digit string that lacks its last ``skip`` digits."""
    ds = F.reverse(F.split(digits, ""))
    ds = F.transform(F.filter(ds, lambda c: c != ""), lambda c: c.cast("int"))
    doubled = F.transform(ds, lambda d, i: F.when((i + skip) % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x)


def _mod97(s: Column) -> Column:
    """Remainder of the number that the letters (A = 10 ...) and digits spell."""
    cs = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.ascii(c))
    return F.aggregate(cs, F.lit(0), lambda a, c: F.when(c >= 65, (a * 100 + c - 55) % 97).otherwise((a * 10 + c - 48) % 97))


def _like(s: Column, digits: Column) -> Column:
    """``s`` with its digits replaced, in order, by those of ``digits``."""
    cs = F.filter(F.split(s, ""), lambda c: c != "")
    nth = lambda i: F.length(F.regexp_replace(F.substring(s, F.lit(1), i + 1), "[^0-9]", ""))
    return F.array_join(F.transform(cs, lambda c, i: F.when(c.between("0", "9"), F.substring(digits, nth(i), F.lit(1))).otherwise(c)), "")


def _card(key: str, m: Column) -> Column:
    d = _digits(m)
    valid = d.rlike(rf"\A{_CARD}\z") & (_luhn_sum(d, 0) % 10 == 0)
    # The first digit (issuer class) stays; of issuers with longer prefixes, four.
    keep = F.when(d.startswith("4"), F.lit(1)).otherwise(F.lit(4))
    body = F.substring(d, F.lit(1), F.length(d) - 1)
    new = F.concat(F.substring(d, F.lit(1), keep), _letters(key, "card", F.substring(body, keep + 1, F.length(body))))
    check = (10 - _luhn_sum(new, 1) % 10) % 10
    return F.when(valid, _like(m, F.concat(new, check.cast("string"))))


def _iban(key: str, m: Column) -> Column:
    flat = F.replace(m, F.lit(" "), F.lit(""))
    body, country = F.substring(flat, F.lit(5), F.length(flat)), F.substring(flat, 1, 2)
    valid = _mod97(F.concat(body, F.substring(flat, 1, 4))) == 1
    valid = valid & F.length(flat).between(15, 34) & F.substring(flat, 3, 2).between("02", "98") & flat.rlike(_CHARS)
    new = _letters(key, "iban", body)
    check = F.lpad((98 - _mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
    # Groups of four keep their blanks.
    spaced = F.concat(country, check, new)
    cs = F.filter(F.split(m, ""), lambda c: c != "")
    place = lambda i: F.length(F.replace(F.substring(m, F.lit(1), i + 1), F.lit(" "), F.lit("")))
    return F.when(valid, F.array_join(F.transform(cs, lambda c, i: F.when(c == " ", c).otherwise(F.substring(spaced, place(i), F.lit(1)))), ""))


def _date(key: str, m: Column) -> Column:
    iso = m.rlike(r"\A\d{4}-")
    sep = F.substring(m, 3, 1)
    text = F.when(iso, m).otherwise(F.concat(F.substring(m, 7, 4), F.lit("-"), F.substring(m, 4, 2), F.lit("-"), F.substring(m, 1, 2)))
    day = F.datediff(F.try_to_date(text, "yyyy-MM-dd"), F.lit("1900-01-01").cast("date"))
    p = _pair(key, "date", F.floor(day / _DAYS[1]), day % _DAYS[1], _DAYS)
    new = F.date_add(F.lit("1900-01-01").cast("date"), (p["u"] * _DAYS[1] + p["v"]).cast("int"))
    back = F.when(iso, F.date_format(new, "yyyy-MM-dd")).otherwise(
        F.concat(F.date_format(new, "dd"), sep, F.date_format(new, "MM"), sep, F.date_format(new, "yyyy")))
    return F.when(day.between(0, _DAYS[0] * _DAYS[1] - 1), back)


def _ip(key: str, m: Column) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    valid = F.forall(F.split(m, r"\."), lambda x: (x.cast("int") <= 255) & ((F.length(x) == 1) | ~x.startswith("0")))
    p = _pair(key, "ip", F.get(o, F.lit(0)) * 256 + F.get(o, F.lit(1)), F.get(o, F.lit(2)) * 256 + F.get(o, F.lit(3)), _IP)
    parts = [F.floor(p["u"] / 256), p["u"] % 256, F.floor(p["v"] / 256), p["v"] % 256]
    return F.when(valid, F.concat_ws(".", *[x.cast("string") for x in parts]))


def _ssn(key: str, m: Column) -> Column:
    area, group, serial = (F.substring(m, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    u = F.when(area > 666, area - 2).otherwise(area - 1)
    p = _pair(key, "ssn", u, (group - 1) * 9999 + serial - 1, _SSN)
    new_area = F.when(p["u"] + 1 >= 666, p["u"] + 2).otherwise(p["u"] + 1)
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return F.when(valid, F.concat_ws("-", pad(new_area, 3), pad(F.floor(p["v"] / 9999) + 1, 2), pad(p["v"] % 9999 + 1, 4)))


def _phone(key: str, m: Column) -> Column:
    head = F.regexp_extract(m, r"\A(?:\+\d{1,3}(?=\D)|\+\d{1,2}|)", 0)
    rest = F.substring(m, F.length(head) + 1, F.length(m))
    return F.when(F.length(_digits(m)).between(7, 15), F.concat(head, _letters(key, "phone", rest, nonzero_first=True)))


def _email(key: str, m: Column) -> Column:
    at = F.instr(m, "@")
    return F.concat(_letters(key, "email", F.substring(m, F.lit(1), at - 1)), F.substring(m, at, F.length(m)))


def _key(key: str, m: Column) -> Column:
    return F.concat(F.substring(m, 1, 4), _letters(key, "key", F.substring(m, 5, 16)))


def _token(key: str, m: Column) -> Column:
    return F.when(m.rlike(r"\A[0-9a-f]+\z"), _letters(key, "hex", m, lower=6)).otherwise(_letters(key, "token", m))


_MAKE = {"email": _email, "iban": _iban, "date": _date, "ssn": _ssn, "ip": _ip, "phone": _phone, "card": _card, "key": _key,
         "token": _token}
#: How a found value is told apart from those of other kinds.
_SHAPE = {
    "email": r"@", "iban": r"\A[A-Z]{2}\d\d(?!.*@)", "date": r"\A(?:\d{4}-\d\d-\d\d|\d\d/\d\d/\d{4}|\d\d\.\d\d\.\d{4})\z", "ssn": r"\A\d{3}-\d\d-\d{4}\z",
    "ip": r"\A\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\z", "phone": r"\A[+(]", "card": r"\A\d[\d -]{11,}\d\z", "key": r"\AAKIA[A-Z0-9]{16}\z", "token": r"",
}


def pseudonym(match: Column, secret: str) -> Column:
    """struct(kind, text) for one found value; kind is null if it is not valid
    and text then the value itself."""
    key = hashlib.sha256(f"pseudonyms:{secret}".encode()).hexdigest()
    kind = made = F.lit(None).cast("string")
    # The kinds are tried in the order of PATTERNS.
    for name in reversed(PATTERNS):
        shaped = match.rlike(_SHAPE[name])
        kind, made = F.when(shaped, F.lit(name)).otherwise(kind), F.when(shaped, _MAKE[name](key, match)).otherwise(made)
    return _let(F.struct(kind.alias("kind"), made.alias("text")), lambda p: F.struct(
        F.when(p["text"].isNotNull(), p["kind"]).alias("kind"), F.coalesce(p["text"], match).alias("text")))


def first_valid(match: Column, secret: str) -> Column:
    """struct(kind, text, size) of the value that ``match`` begins with, size
    being its length: its first word, all of it, or the longest part valid."""
    none = F.lit(None).cast("struct<kind:string,text:string,size:int>")

    def tried(words: Column) -> Column:
        n = F.size(words)
        order = F.when(n > 1, F.concat(F.array(F.lit(1)), F.sequence(n, F.lit(2), F.lit(-1)))).otherwise(F.array(F.lit(1)))
        parts = F.transform(order, lambda k: F.array_join(F.slice(words, F.lit(1), k), " "))
        # Only kinds with blanks have shorter parts. A phone number's first word may be a piece of it, unless it has a whole number's digits.
        parts = F.filter(parts, lambda p: (p == match) | p.rlike(_SHAPE["iban"]) | p.rlike(_SHAPE["card"])
                         | p.startswith("+") & (p.contains(" ") | (F.length(_digits(p)) >= 11)))
        return F.aggregate(parts, none, lambda done, p: F.when(done.isNotNull(), done).otherwise(_let(
            pseudonym(p, secret), lambda r: F.when(r["kind"].isNotNull(), F.struct(
                r["kind"].alias("kind"), r["text"].alias("text"), F.length(p).alias("size"))))))

    return _let(F.split(match, " ", -1), tried)


def _joined(pieces: Column, found: Column) -> Column:
    """The text as an array of struct(kind, text); kind is null for what
    stays. ``pieces`` is the text cut before every match."""
    ahead = F.size(pieces) - F.size(found)
    part = lambda kind, text: F.struct(kind.cast("string").alias("kind"), text.alias("text"))
    kept = lambda text: part(F.lit(None), text)
    state = lambda out, skip: F.struct(out.alias("out"), skip.cast("int").alias("skip"))

    def turn(s: Column, i: Column) -> Column:
        piece, v = F.get(pieces, i + ahead), F.get(found, i)
        tail = lambda n: F.substring(piece, n + 1, F.length(piece))
        # A value taken before may reach over this piece.
        inside = state(F.concat(s["out"], F.array(kept(tail(s["skip"])))), F.greatest(s["skip"] - F.length(piece), F.lit(0)))
        stays = state(F.concat(s["out"], F.array(kept(piece))), F.lit(0))
        taken = state(F.concat(s["out"], F.array(part(v["kind"], v["text"]), kept(tail(v["size"])))), F.greatest(v["size"] - F.length(piece), F.lit(0)))
        return F.when(s["skip"] > 0, inside).when(v.isNull(), stays).otherwise(taken)

    start = state(F.when(ahead > 0, F.array(kept(F.get(pieces, F.lit(0))))).otherwise(F.array().cast("array<struct<kind:string,text:string>>")), F.lit(0))
    return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, turn, lambda s: s["out"])


def pseudonymise(docs: DataFrame, *, text_col: str = "text", secret: str = "pseudonyms", found_col: str | None = None) -> DataFrame:
    """``docs`` with the values of ``text_col`` replaced; ``found_col`` (if
    named) receives the kinds of the replaced values in order."""
    taken = {c.lower() for c in docs.columns}
    values, new = "_values", "_new"
    while {values, new} & taken:
        values, new = "_" + values, "_" + new
    text = F.col(f"`{text_col}`")
    # One match for every place that a value may start at; they may overlap.
    some = F.when(text.rlike(_HINT), F.regexp_extract_all(text, F.lit(f"(?=({ANY}))"), F.lit(1)))
    df = docs.withColumn(values, some)
    made = _let(F.transform(values, lambda m: first_valid(m, secret)), lambda found: _let(
        F.split(text, f"(?={ANY})", -1), lambda pieces: _joined(pieces, found)))
    df = df.withColumn(new, F.when(F.size(values) > 0, made))
    out = df.withColumn(text_col, F.when(F.col(new).isNotNull(), F.array_join(F.transform(new, lambda x: x["text"]), "")).otherwise(text))
    if found_col:
        out = out.withColumn(found_col, F.coalesce(F.filter(F.transform(new, lambda x: x["kind"]), lambda k: k.isNotNull()), F.array().cast("array<string>")))
    return out.drop(values, new)
