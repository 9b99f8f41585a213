"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Finds e-mail addresses, IP addresses, phone and card numbers, bank accounts, social security
numbers, dates and secrets assigned to names, validates them (check digits, ranges), and replaces
each by a keyed permutation of itself within its own format. The permutation is a Feistel
network over the value's digits and letters, so it is one-to-one: equal values get equal
pseudonyms in every document, different values never collide, and whoever holds the key can
link or undo them. Separators, letter case and length stay; check digits are made right again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

# Kinds in order of precedence; one alternative each. No group captures, so that a match is one piece.
_NOT_BEFORE, _NOT_AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    # the whole run, whatever its length or what follows; an address is left to its own kind
    "secret": r"(?i:token|secret|api[_-]?key|password|passwd|pwd)[ \t]{0,3}+[:=][ \t]{0,3}+[\"']?+"
              r"(?![A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24})[A-Za-z0-9+/_.=-]{8,}+",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
    "ipv6": r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
            r"|(?<!::)(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?"
            r"|::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})(?!:[0-9A-Fa-f:])(?!\.[0-9])",
    "ipv4": r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.[0-9])",
    "date": r"(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./](?:19|20)[0-9]{2}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "phone": r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{1,4}(?:[ .-]?[0-9]{2,4}){1,4}"
             r"|\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}",
    "card": r"[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -][0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}",
}
# a sign before a number belongs to a phone only
_AHEAD = {"phone": r"(?<![\p{L}\p{N}_+])", "ipv4": r"(?<![\p{L}\p{N}_])(?<![0-9]\.)"}
_BEHIND = {"secret": ""}  # a run is taken up to its end
ANY = "|".join(f"{_AHEAD.get(kind, _NOT_BEFORE)}(?:{p}){_BEHIND.get(kind, _NOT_AFTER)}" for kind, p in PATTERNS.items())
#: Days of the years 1900 to 2099, 17 x 4297 of them: the domain that dates are permuted in.
FIRST_DAY, DAY_SIZES = "1900-01-01", (17, 4297)


# -- Feistel network over characters ------------------------------------------------


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _radix(c: Column, letters: int = 26) -> Column:
    """Alphabet size of an ASCII character: digits 10, letters 26 (6 for hexadecimals), else 1 (stays)."""
    code = F.ascii(c)
    digit = (code >= 48) & (code <= 57)
    letter = ((code >= 65) & (code <= 90)) | ((code >= 97) & (code <= 122))
    return F.when(digit, 10).when(letter, letters).otherwise(1)


def _digit(c: Column) -> Column:
    code = F.ascii(c)
    return F.when((code >= 48) & (code <= 57), code - 48).when((code >= 65) & (code <= 90), code - 65).when(
        (code >= 97) & (code <= 122), code - 97
    ).otherwise(0)


def _char(digit: Column, like: Column) -> Column:
    """The character of the same class and case as ``like`` with value ``digit``."""
    code = F.ascii(like)
    return F.when((code >= 48) & (code <= 57), F.char(digit + 48)).when(
        (code >= 65) & (code <= 90), F.char(digit + 65)
    ).when((code >= 97) & (code <= 122), F.char(digit + 97)).otherwise(like)


def _short(text: Column) -> Column:
    """A digest in place of a text that is long, as it goes into every place's number."""
    return F.when(F.length(text) > 2048, F.sha2(text, 256)).otherwise(text)


def _stream(key: str, turn: Column, tweak: Column, half: Column, i: Column) -> Column:
    """A keyed pseudo-random number for place ``i``, from the other half of the value."""
    mac = F.sha2(F.concat_ws("|", F.lit(key), turn.cast("string"), tweak, half, i.cast("string")), 256)
    return F.conv(F.substring(mac, 1, 12), 16, 10).cast("bigint")


def permute(values: Column, sizes: Column, tweak: Column, key: str, sign: int = 1) -> Column:
    """Keyed permutation of an array of numbers, place i below ``sizes[i]``; ``sign`` -1 undoes it.

    Even places are shifted by a function of the odd ones and the other way round, in turns.
    """

    def half(xs: Column, odd: int) -> Column:
        return F.filter(xs, lambda x, i: i % 2 == odd)

    def shift(xs: Column, turn: Column) -> Column:
        other = F.when(turn % 2 == 0, half(xs, 1)).otherwise(half(xs, 0))
        other = F.array_join(F.transform(other, lambda d: d.cast("string")), ",")
        return let(F.struct(_short(other).alias("other"), _short(tweak).alias("tweak")), lambda s: F.transform(xs, lambda x, i: F.when(
            i % 2 == turn % 2,
            F.pmod(x + sign * F.pmod(_stream(key, turn, s["tweak"], s["other"], i), sizes[i].cast("bigint")), sizes[i].cast("bigint")),
        ).otherwise(x)))

    turns = range(ROUNDS) if sign > 0 else range(ROUNDS - 1, -1, -1)
    turns = F.array(*(F.lit(t) for t in turns))
    return F.aggregate(turns, F.transform(values, lambda v: v.cast("bigint")), lambda xs, t: shift(xs, t))


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _placed(chars: Column, moved: Column, letters: int) -> Column:
    """Characters with the moving ones replaced, in order, by ``moved``."""
    return let(moved, lambda m: F.aggregate(
        chars,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda s, c: F.struct(
            F.when(_radix(c, letters) > 1, s["at"] + 1).otherwise(s["at"]).alias("at"),
            F.concat(s["out"], F.when(_radix(c, letters) > 1, _char(F.get(m, s["at"]).cast("int"), c)).otherwise(c)).alias("out"),
        ),
    )["out"])


def permute_text(text: Column, key: str, kind: str, sign: int = 1, letters: int = 26) -> Column:
    """Permute the ASCII digits and letters of a text within their classes; the rest stays in place."""
    def moved(chars: Column) -> Column:
        return let(F.filter(chars, lambda c: _radix(c, letters) > 1), lambda moving: let(
            F.transform(moving, lambda c: _radix(c, letters)),
            lambda sizes: permute(
                F.transform(moving, _digit), sizes,
                F.concat_ws("|", F.lit(kind), F.array_join(F.transform(sizes, lambda n: n.cast("string")), ".")), key, sign,
            ),
        ))

    return let(_chars(text), lambda chars: _placed(chars, moved(chars), letters))


# -- kinds ---------------------------------------------------------------------------


def _digits(text: Column) -> Column:
    return F.transform(_chars(F.regexp_replace(text, "[^0-9]", "")), lambda c: c.cast("int"))


def luhn(digits: Column, doubled: int) -> Column:
    """Sum of digits from the right, every second doubled, starting with place ``doubled``."""
    return F.aggregate(
        F.transform(F.reverse(digits), lambda d, i: (
            F.when(i % 2 == doubled, F.pmod(2 * d, F.lit(10)) + (d >= 5).cast("int")).otherwise(d)).cast("bigint")),
        F.lit(0).cast("bigint"), lambda a, b: a + b,
    )


def mod97(text: Column) -> Column:
    """Remainder of a bank account (letters as two digits, first four characters last)."""
    return F.aggregate(
        _chars(F.concat(F.substring(text, 5, 64), F.substring(text, 1, 4))), F.lit(0),
        lambda a, c: F.when(_radix(c) == 10, (a * 10 + _digit(c)) % 97).otherwise((a * 100 + _digit(c) + 10) % 97),
    )


def _date(m: Column) -> Column:
    """Day of a date: year first; else day first where that is a date, otherwise month first."""
    iso = F.try_to_date(m, "yyyy-MM-dd")
    plain = F.regexp_replace(m, "[./]", "-")
    return F.when(F.rlike(m, F.lit(r"\A[0-9]{4}-")), iso).otherwise(
        F.coalesce(F.try_to_date(plain, "dd-MM-yyyy"), F.try_to_date(plain, "MM-dd-yyyy"))
    )


def _date_made(m: Column, day: Column) -> Column:
    plain = F.regexp_replace(m, "[./]", "-")
    first = F.when(F.try_to_date(plain, "dd-MM-yyyy").isNotNull(), F.date_format(day, "dd-MM-yyyy")).otherwise(
        F.date_format(day, "MM-dd-yyyy")
    )
    return F.when(F.rlike(m, F.lit(r"\A[0-9]{4}-")), F.date_format(day, "yyyy-MM-dd")).otherwise(
        F.replace(first, F.lit("-"), F.substring(m, 3, 1))
    )


def valid_kind(m: Column) -> Column:
    """Kind of a match that passes its validation, or null: such text is left alone."""
    shape = {k: F.rlike(m, F.lit(rf"\A(?:{p})\z")) for k, p in PATTERNS.items()}
    digits = _digits(m)
    n = F.size(digits)
    parts = F.transform(F.split(m, r"\."), lambda x: x.try_cast("int"))
    tests = {
        "email": F.lit(True), "secret": F.lit(True),
        # two colons stand for a group of zeros at least
        "ipv6": ~F.contains(m, F.lit("::")) | (F.size(F.filter(F.split(m, ":"), lambda x: x != "")) <= 7),
        "iban": let(F.replace(m, F.lit(" "), F.lit("")), lambda x: F.length(x).between(15, 34) & (mod97(x) == 1)),
        "ipv4": F.forall(parts, lambda x: x <= 255),
        "date": _date(m).isNotNull(),
        "ssn": ~F.rlike(m, F.lit(r"\A(?:000|666|9)|-00-|-0000\z")),
        "phone": n.between(7, 15),
        "card": n.between(13, 19) & (luhn(digits, 1) % 10 == 0) & F.exists(digits, lambda d: d > 0),
    }
    kind = F.lit(None).cast("string")
    for k in reversed(PATTERNS):
        kind = F.when(shape[k] & tests[k], F.lit(k)).otherwise(kind)
    return kind


def _ssn(m: Column, key: str, sign: int) -> Column:
    area = F.substring(m, 1, 3).cast("int")
    values = F.array(F.when(area > 666, area - 2).otherwise(area - 1), F.substring(m, 5, 2).cast("int") - 1, F.substring(m, 8, 4).cast("int") - 1)

    def made(v: Column) -> Column:
        a = v[0] + 1
        return F.concat_ws("-", F.lpad(F.when(a >= 666, a + 1).otherwise(a).cast("string"), 3, "0"),
                           F.lpad((v[1] + 1).cast("string"), 2, "0"), F.lpad((v[2] + 1).cast("string"), 4, "0"))

    return let(permute(values, F.array(F.lit(898), F.lit(99), F.lit(9999)), F.lit("ssn"), key, sign), made)


def _card(m: Column, key: str, sign: int) -> Column:
    def made(payload: Column) -> Column:
        # a check digit makes the sum a multiple of ten
        check = (10 - luhn(payload, 0) % 10) % 10
        return _placed(_chars(m), F.concat(payload, F.array(check.cast("bigint"))), 26)

    def moved(digits: Column) -> Column:
        n = F.size(digits) - 1
        sizes = F.transform(F.slice(digits, F.lit(1), n), lambda d: F.lit(10))
        return permute(F.slice(digits, F.lit(1), n), sizes, F.concat_ws("|", F.lit("card"), n.cast("string")), key, sign)

    return let(let(_digits(m), moved), made)


def _iban(m: Column, key: str, sign: int) -> Column:
    plain = F.replace(m, F.lit(" "), F.lit(""))

    def made(account: Column) -> Column:
        rest = F.concat(F.substring(m, 1, 2), F.lit("00"), account)
        check = F.lpad((98 - mod97(rest)).cast("string"), 2, "0")
        return let(_chars(F.concat(F.substring(m, 1, 2), check, account)), lambda cs: F.aggregate(
            _chars(m), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
            lambda s, c: F.when(c == " ", F.struct(s["at"].alias("at"), F.concat(s["out"], c).alias("out"))).otherwise(
                F.struct((s["at"] + 1).alias("at"), F.concat(s["out"], F.get(cs, s["at"])).alias("out"))),
        )["out"])

    return let(permute_text(F.substring(plain, 5, 64), key, "iban", sign), made)


def _days(m: Column, key: str, sign: int) -> Column:
    first, (a, b) = F.to_date(F.lit(FIRST_DAY)), DAY_SIZES
    day = F.datediff(_date(m), first)
    made = lambda v: _date_made(m, F.date_add(first, (v[0] * b + v[1]).cast("int")))
    return let(permute(F.array((day / b).cast("int"), day % b), F.array(F.lit(a), F.lit(b)), F.lit("date"), key, sign), made)


def pseudonym(m: Column, kind: Column, key: str, sign: int = 1) -> Column:
    """The pseudonym of a match of a known kind; ``sign`` -1 gives the value back."""
    four = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    ipv4 = F.array_join(F.transform(
        permute(four, F.array(*[F.lit(256)] * 4), F.lit("ipv4"), key, sign), lambda x: x.cast("string")), ".")
    head = lambda pattern: F.regexp_extract(m, pattern, 0)  # noqa: E731  what stays in front
    behind = lambda pattern: F.substring(m, F.length(head(pattern)) + 1, F.length(m))
    tld, secret, country = r"\.[A-Za-z]+\z", r"\A[A-Za-z_-]+[ \t]*[:=][ \t]*[\"']?", r"\A(?:\+[0-9])?"
    return (
        F.when(kind == "email", F.concat(permute_text(F.regexp_replace(m, tld, ""), key, "email", sign), head(tld)))
        .when(kind == "secret", F.concat(head(secret), permute_text(behind(secret), key, "secret", sign)))
        .when(kind == "iban", _iban(m, key, sign))
        .when(kind == "ipv6", permute_text(m, key, "ipv6", sign, 6))
        .when(kind == "ipv4", ipv4)
        .when(kind == "date", _days(m, key, sign))
        .when(kind == "ssn", _ssn(m, key, sign))
        .when(kind == "phone", F.concat(head(country), permute_text(behind(country), key, "phone", sign)))
        .when(kind == "card", _card(m, key, sign))
        .otherwise(m)
    )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", id_col: str = "doc_id", undo: bool = False) -> DataFrame:
    """Per row: ``doc_id, text, n_found, kinds``: the text with pseudonyms, what was replaced, per kind.

    ``kinds`` lists the kind of each replacement in order of place. Matches that fail their
    validation stay as they are. A null text stays null with nothing found, an empty text empty.
    Repeated rows are treated alike, other columns are not read. With ``undo`` the same key gives
    the original texts back: pseudonyms are valid values of their kind.
    """
    sign = -1 if undo else 1
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # a cheap look first: every kind has a digit, an @ or an assignment
    some = F.rlike("text", F.lit("[0-9@:=]"))
    found = F.when(some, F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))

    def one(m: Column) -> Column:
        return let(valid_kind(m), lambda k: F.struct(k.alias("kind"), pseudonym(m, k, key, sign).alias("new")))

    rows = rows.withColumn("found", F.when(some, F.transform(F.coalesce(found, F.array().cast("array<string>")), one)))
    between = F.split("text", ANY, -1)
    merged = F.array_join(F.zip_with(
        between, F.transform("found", lambda f: f["new"]), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    hits = F.filter(F.transform("found", lambda f: f["kind"]), lambda k: k.isNotNull())
    hits = F.coalesce(hits, F.array().cast("array<string>"))
    return rows.select(
        "doc_id", F.when(F.size("found") > 0, merged).otherwise(F.col("text")).alias("text"),
        F.size(hits).cast("long").alias("n_found"), hits.alias("kinds"),
    )
