"""Format-preserving pseudonyms for personal numbers and dates; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10

#: In this order; what one finds the later ones do not look at.
KINDS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9]|[./-][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9+])\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|(?<![0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{1,4}){1,5}(?![0-9])"
    r"|(?<![0-9(])\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9]|[.-][0-9])|(?<![0-9.-])[0-9]{3}\.[0-9]{3}\.[0-9]{4}(?![0-9]|[.-][0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})(?![0-9])",
}
#: Country calling codes: fixed values of the international numbering plan, by their first digits.
CALLING_CODE = "^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _random(key: Column, tweak: Column, i: Column, x: Column) -> Column:
    """A keyed random number below 2^56."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", key, tweak, i.cast("string"), x.cast("string")), 256), 1, 14), 16, 10).cast("long")


def feistel(left: Column, right: Column, size_left: Column, size_right: Column, key: Column, tweak: Column) -> Column:
    """A keyed permutation of pairs below (size_left, size_right), which need not be equal: the rounds add a random
    function of one part to the other, in turn, so each can be taken back."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def turn(s: Column, i: Column) -> Column:
        return F.when(
            i % 2 == 0, F.struct(((s["l"] + _random(key, tweak, i, s["r"]) % size_left) % size_left).alias("l"), s["r"].alias("r"))
        ).otherwise(F.struct(s["l"].alias("l"), ((s["r"] + _random(key, tweak, i, s["l"]) % size_right) % size_right).alias("r")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def permute_digits(d: Column, key: Column, tweak: Column) -> Column:
    """A permutation of the digit strings of a length, from 2 to 30."""
    n = F.length(d)
    u = F.floor(n / 2).cast("int")
    pow10 = lambda k: F.pow(F.lit(10.0), k).cast("long")
    mixed = feistel(F.substring(d, F.lit(1), u).cast("long"), F.substring(d, u + 1, n - u).cast("long"), pow10(u), pow10(n - u), key, F.concat_ws(":", tweak, n.cast("string")))
    return _let(mixed, lambda m: F.concat(F.lpad(m["l"].cast("string"), u, "0"), F.lpad(m["r"].cast("string"), n - u, "0")))


def _refill(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced in order."""
    return F.array_join(F.zip_with(F.split(form, "[0-9]"), F.split(digits, ""), lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")


def luhn_digit(d: Column) -> Column:
    """The check digit after the digits ``d``."""
    back = F.split(F.reverse(d), "")
    total = F.aggregate(
        F.transform(F.filter(back, lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, (c.cast("int") * 2) % 10 + (c.cast("int") * 2 / 10).cast("int")).otherwise(c.cast("int"))),
        F.lit(0), lambda a, b: a + b,
    )
    return ((10 - total % 10) % 10).cast("string")


def _mod97(text: Column) -> Column:
    """A string of digits and capital letters (A is 10) as a number, mod 97."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def _card(m: Column, key: Column) -> Column:
    d = _digits(m)
    n = F.length(d)
    body = lambda x: F.substring(x, F.lit(1), F.length(x) - 1)
    valid = (luhn_digit(body(d)) == F.substring(d, n, F.lit(1))) & ~d.rlike("^0+$")
    front = F.concat(F.substring(d, 1, 1), permute_digits(F.substring(d, F.lit(2), n - 2), key, F.concat(F.lit("card"), F.substring(d, 1, 1))))
    return F.when(valid, _let(front, lambda f: _refill(m, F.concat(f, luhn_digit(f)))))


def _iban(m: Column, key: Column) -> Column:
    """Of a number in printed groups the groups at the end may be words of what follows: the longest valid beginning counts."""
    cut = lambda x: F.regexp_replace(x, " [A-Z0-9]+$", "")

    def valid(p: Column) -> Column:
        c = F.replace(p, F.lit(" "), F.lit(""))
        bban = F.substring(c, F.lit(5), F.length(c) - 4)
        return F.length(c).between(15, 34) & (_mod97(F.concat(bban, F.substring(c, 1, 4))) == 1) & (F.length(_digits(bban)) >= 2)

    def written(p: Column) -> Column:
        country, rest = F.substring(p, 1, 2), F.substring(p, F.lit(5), F.length(p) - 4)
        new = _refill(rest, permute_digits(_digits(rest), key, F.concat(F.lit("iban"), country)))
        check = lambda b: F.lpad((98 - _mod97(F.concat(F.replace(b, F.lit(" "), F.lit("")), country, F.lit("00")))).cast("string"), 2, "0")
        return _let(new, lambda b: F.concat(country, check(b), b, F.substring(m, F.length(p) + 1, F.length(m))))

    return _let(F.try_element_at(F.filter(F.array(m, cut(m), cut(cut(m))), valid), F.lit(1)), lambda p: F.when(p.isNotNull(), written(p)))


def _ssn(m: Column, key: Column) -> Column:
    part = lambda i: F.element_at(F.split(m, "-"), i).cast("int")
    area, group, serial = part(1), part(2), part(3)
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    at = F.when(area > 666, area - 2).otherwise(area - 1)
    mixed = feistel(at * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), key, F.lit("ssn"))

    def written(x: Column) -> Column:
        a = F.floor(x["l"] / 99)
        return F.concat_ws("-", F.lpad((a + 1 + (a >= 665).cast("int")).cast("string"), 3, "0"), F.lpad((x["l"] % 99 + 1).cast("string"), 2, "0"), F.lpad((x["r"] + 1).cast("string"), 4, "0"))

    return F.when(valid, _let(mixed, written))


def _ip(m: Column, key: Column) -> Column:
    parts = F.split(m, r"\.")
    valid = F.forall(parts, lambda p: (p.cast("int") <= 255) & (p == p.cast("int").cast("string")))
    b = lambda i: F.element_at(parts, i).cast("long")
    mixed = feistel(b(1) * 256 + b(2), b(3) * 256 + b(4), F.lit(65536), F.lit(65536), key, F.lit("ip"))
    return F.when(valid, _let(mixed, lambda x: F.concat_ws(".", F.floor(x["l"] / 256).cast("string"), (x["l"] % 256).cast("string"), F.floor(x["r"] / 256).cast("string"), (x["r"] % 256).cast("string"))))


def _area(a: Column) -> Column:
    """(index, count, usable) of an area code: those that can be dialled are 2 to 9 and two digits, but not 11."""
    h, r = F.floor(a / 100), a % 100
    usable = (a >= 200) & (r != 11)
    other = F.when(a < 200, a).otherwise(198 + h)
    return F.struct(F.when(usable, (h - 2) * 99 + r - (r > 11).cast("int")).otherwise(other).alias("i"), F.when(usable, 792).otherwise(208).alias("n"), usable.alias("ok"))


def _north_american(d: Column, key: Column) -> Column:
    """Ten digits; area codes and exchanges that can be dialled stay such."""
    area, exchange, line = (F.substring(d, a, n).cast("int") for a, n in ((1, 3), (4, 3), (7, 4)))
    good = exchange >= 200
    right, size = F.when(good, exchange - 200).otherwise(exchange) * 10_000 + line, F.when(good, 8_000_000).otherwise(2_000_000)

    def permuted(x: Column) -> Column:
        mixed = feistel(x["i"], right, x["n"], size, key, F.concat(F.lit("phone+1:"), x["n"].cast("string"), F.lit(":"), size.cast("string")))

        def written(y: Column) -> Column:
            h, r = F.floor(y["l"] / 99), y["l"] % 99
            a = F.when(x["ok"], (h + 2) * 100 + r + (r >= 11).cast("int")).when(y["l"] < 200, y["l"]).otherwise((y["l"] - 198) * 100 + 11)
            return F.concat(F.lpad(a.cast("string"), 3, "0"), F.lpad((y["r"] + F.when(good, 2_000_000).otherwise(0)).cast("string"), 7, "0"))

        return _let(mixed, written)

    return _let(_area(area), permuted)


def _phone(m: Column, key: Column) -> Column:
    """A number's digits after its calling code are permuted, however it is written; without a code it is North American."""
    d, plus = _digits(m), m.startswith("+")
    code = F.when(plus, F.regexp_extract(d, CALLING_CODE, 0)).otherwise(F.lit("1"))
    rest = F.when(plus, F.substring(d, F.length(code) + 1, F.length(d))).otherwise(d)
    new = F.when((code == "1") & (F.length(rest) == 10), _north_american(rest, key)).otherwise(permute_digits(rest, key, F.concat(F.lit("phone+"), code)))
    return F.when(F.length(d).between(8, 15) & (F.length(rest) >= 4), _refill(m, F.concat(F.when(plus, code).otherwise(F.lit("")), new)))


def _date(m: Column, key: Column) -> Column:
    sep = F.regexp_extract(m, "[^0-9]", 0)
    p = F.split(m, "[^0-9]")
    at = lambda i: F.element_at(p, i)
    day_first = (sep == ".") | ((sep == "/") & (at(1).cast("int") > 12))
    year = F.when(sep == "-", at(1)).otherwise(at(3))
    month = F.when(sep == "-", at(2)).when(day_first, at(2)).otherwise(at(1))
    day = F.when(sep == "-", at(3)).when(day_first, at(1)).otherwise(at(2))
    iso = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))

    def moved(d: Column) -> Column:
        start = (F.floor(F.year(d) / 100) * 100).cast("int")
        long = start % 400 == 0
        first = F.make_date(start, F.lit(1), F.lit(1))
        n, left, right = F.datediff(d, first), F.when(long, 75).otherwise(92), F.when(long, 487).otherwise(397)
        mixed = feistel(F.floor(n / right), n % right, left, right, key, F.concat(F.lit("date"), start.cast("string")))
        new = F.date_add(first, (mixed["l"] * right + mixed["r"]).cast("int"))
        wide = F.length(m) == 10
        dd, mm, yy = (F.date_format(new, x) for x in ("dd", "MM", "yyyy"))
        thin = lambda x: F.when(wide, x).otherwise(x.cast("int").cast("string"))
        us = F.concat_ws("/", thin(mm), thin(dd), yy)
        # a day up to 12 in front would be read as a month: month first then, as for other dates with slashes
        return F.when(sep == "-", F.concat_ws("-", yy, mm, dd)).when(sep == ".", F.concat_ws(".", thin(dd), thin(mm), yy)).when(day_first & (F.dayofmonth(new) > 12), F.concat_ws("/", thin(dd), thin(mm), yy)).otherwise(us)

    parsed = iso.try_cast("date")
    return F.when(parsed.isNotNull() & year.cast("int").between(1000, 2999), _let(parsed, moved))


def _email(m: Column, key: Column) -> Column:
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat(key, F.lit("|email|"), F.lower(m)), 256), 1, 32), F.substring(m, F.instr(m, "@"), F.length(m)))


_NEW = {"email": _email, "iban": _iban, "date": _date, "ssn": _ssn, "ip": _ip, "phone": _phone, "card": _card}


def _pseudonym(m: Column, key: Column) -> Column:
    """struct(kind, new) of a match; both null if it isn't valid."""
    whole = {k: m.rlike(f"^(?:{p})$") for k, p in KINDS.items()}
    kind = F.coalesce(*[F.when(whole[k], F.lit(k)) for k in KINDS])

    def known(k: Column) -> Column:
        new = F.lit(None).cast("string")
        for name in reversed(KINDS):
            new = F.when(k == name, _NEW[name](m, key)).otherwise(new)
        return F.struct(k.alias("kind"), new.alias("new"))

    return _let(kind, known)


def pseudonymize(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_replaced, kinds) of every row: valid personal numbers and dates replaced within their format.

    Cards that pass the Luhn test keep length, separators and first digit and pass it again; IBANs, in one run or in
    groups, keep country and letters and pass mod 97; social security numbers stay in the valid ranges; IPv4 addresses,
    phone numbers (the calling code stays, and an area code that can be dialled becomes another) and calendar dates (in
    their century, written the same way) stay valid. Each is a keyed Feistel permutation of its format, so equal values are
    equal again in all documents, however they are spaced, different values stay different, and who has the key can go back.
    E-mail addresses have no such format: the local part becomes 128 bits of a keyed hash, the domain stays. What looks like
    a number of a kind and is not valid is left alone, and so are IPv6 addresses, phone numbers of blanks only without a
    calling code ("555 123 4567"), and dates with names of months.

    The key comes as a one-row subquery: it is no literal of the plan, so neither plans nor event logs show it.

    Whole texts, narrow, no shuffle. Null text gives null text and 0 replaced, empty text stays empty; ids go
    through, null or repeated; an empty table gives no rows; other columns are ignored. kinds holds the kind of
    each replacement in the order of the text.
    """
    secret = F.col("__key")
    t = F.col("__t")
    held = docs.sparkSession.createDataFrame([(key,)], "key string").scalar()
    base = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t"), held.alias("__key"))
    found = F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0))
    marked = base.withColumn("__m", found).withColumn("__n", F.transform("__m", lambda m: _pseudonym(m, secret)))
    gaps = F.split(t, PATTERN)
    filled = F.zip_with(F.arrays_zip(F.col("__m").alias("m"), F.col("__n").alias("n")), gaps, lambda a, g: F.concat(F.coalesce(g, F.lit("")), F.coalesce(a["n"]["new"], a["m"], F.lit(""))))
    done = F.when(F.size("__m") > 0, F.array_join(filled, "")).otherwise(t)
    kinds = F.transform(F.filter("__n", lambda n: n["new"].isNotNull()), lambda n: n["kind"])
    return marked.select(F.col("__id").alias(id_col), done.alias("text"), F.coalesce(F.size(kinds), F.lit(0)).cast("long").alias("n_replaced"), F.coalesce(kinds, F.array().cast("array<string>")).alias("kinds")).withColumn("n_replaced", F.greatest("n_replaced", F.lit(0)).cast("long"))
