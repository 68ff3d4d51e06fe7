"""Format-preserving pseudonyms for personal data, with DataFrame functions alone.

Every value that passes its format's check is permuted within the format by a
keyed Feistel network, so a value gets the same pseudonym in every document, two
values never get the same one, and the result passes the same check:

* card numbers (Luhn) and IBANs (mod 97): digits permuted, check digits made anew
* telephone numbers: digits permuted, the country code stays
* social security numbers and IPv4 addresses: permuted among the valid ones
* dates of 1900 to 2099: permuted among the days of these years that the same written form can stand for
* e-mail addresses: letters and digits of the local part permuted, case and domain stay; accented letters are
  exchanged among themselves, letters of other scripts stay

Numbers that fail their check aren't personal data and stay as they are.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
MOST_LETTERS, MOST_DIGITS = 26, 36  # of a block; 26 ** 13 and 10 ** 18 still fit a long

_DATE = r"(?<![\w./-])(?:(?:19|20)\d\d-\d\d-\d\d|(?:19|20)\d\d/\d\d/\d\d|\d{1,2}[./]\d{1,2}[./](?:19|20)\d\d)(?!(?!T\d\d)\w|[./-]\d)"
_IP = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)"
_SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
#: Values that a longer one before them leaves alone; cards as they are written in fours or in one.
_OWN = rf"(?!{_DATE}|{_IP}|{_SSN})"
_NO_CARD = r"(?!(?<!\d)(?:\d{4}(?: \d{4}){2} \d{1,7}|\d{4}(?:-\d{4}){2}-\d{1,7}|\d{13,19})(?!\w))"
#: Formats, tried in this order at each place (fixed patterns).
FORMATS = {
    "date": _DATE,
    "ip": _IP,
    "ssn": _SSN,
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "email": r"(?<![\p{L}\p{N}_.+%-])[\p{L}\p{N}._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,}",
    "phone": rf"(?<!\w)\+1[ .-]?(?:\(\d{{3}}\)|\d{{3}})[ .-]?\d{{3}}[ .-]?\d{{4}}(?!\w|\.\d)|(?<!\w)\+\d{{1,3}}[ .-]?(?:\(\d{{1,4}}\)[ .-]?)?\d{{2,4}}(?:[ .-]?{_OWN}{_NO_CARD}\d{{2,4}}){{1,4}}(?!\w|\.\d)|(?<![\w.-])00[1-9]\d{{0,2}}[ .-](?:\(\d{{1,4}}\)[ .-]?)?\d{{2,4}}(?:[ .-]?{_OWN}{_NO_CARD}\d{{2,4}}){{1,4}}(?!\w|\.\d)|(?<!\w)\(\d{{3}}\) ?\d{{3}}[ .-]\d{{4}}(?!\w)|(?<![\w.-])\d{{3}}[ .-]\d{{3}}[ .-]\d{{4}}(?!\w|[.-]\d)",
    "card": rf"(?<![\w.-])\d(?:(?:[ -]{_OWN})?\d){{12,18}}(?!\w|[.-]\d)",
}
ANY = "|".join(FORMATS.values())
FIRST_YEAR, YEARS = 1900, 200
#: Valid area numbers of social security numbers; groups times serials.
AREAS, SERIALS = 898, 99 * 9999


def feistel(left: Column, right: Column, sizes: tuple[Column, Column], key: str, tweak: Column) -> Column:
    """Struct ``(a, b)``: the keyed permutation of (left, right) in the product of the two ranges."""
    a_size, b_size = (s.cast("long") for s in sizes)

    def f(i: Column, x: Column, size: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), x.cast("string")), 256)
        return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), size)

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        a = F.when(even, F.pmod(s["a"] + f(i, s["b"], a_size), a_size)).otherwise(s["a"])
        b = F.when(even, s["b"]).otherwise(F.pmod(s["b"] + f(i, s["a"], b_size), b_size))
        return F.struct(a.alias("a"), b.alias("b"))

    start = F.struct(left.cast("long").alias("a"), right.cast("long").alias("b"))
    return F.aggregate(F.array(*map(F.lit, range(ROUNDS))), start, step)


def _power(base: int, n: Column, most: int) -> Column:
    return F.element_at(F.array(*[F.lit(base**i).cast("long") for i in range(most + 1)]), n.cast("int") + 1)


def shuffled(one: Column, alphabet: str, key: str, tweak: Column) -> Column:
    """The keyed shuffle of the alphabet, for a single character: a Feistel network with an empty half only adds a constant."""
    order = F.transform(F.array(*map(F.lit, alphabet)), lambda c: F.struct(F.sha2(F.concat_ws("|", F.lit(key), tweak, F.lit("one"), c), 256).alias("h"), c.alias("c")))
    return F.element_at(F.array_sort(order), F.ascii(one) - ord(alphabet[0]) + 1)["c"]


def permute_digits(digits: Column, key: str, tweak: str | Column) -> Column:
    """The keyed permutation of strings of as many digits, up to 36."""
    tweak = F.lit(tweak) if isinstance(tweak, str) else tweak
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    left, right = (F.coalesce(F.substring(digits, at, size).try_cast("long"), F.lit(0)) for at, size in ((F.lit(1), u), (u + 1, n)))
    out = feistel(left, right, (_power(10, u, 18), _power(10, n - u, 18)), key, F.concat(tweak, n.cast("string")))
    both = F.transform(F.array(out), lambda s: F.concat(F.when(u > 0, F.lpad(s["a"].cast("string"), u, "0")).otherwise(F.lit("")), F.lpad(s["b"].cast("string"), n - u, "0")))
    return F.when(n == 1, shuffled(digits, "0123456789", key, tweak)).when(n > 1, both[0]).otherwise(digits)


def _blocks(value: Column, most: int, permuted, tweak: str) -> Column:
    """``value`` permuted in blocks of ``most`` characters; if there are several, the tweak has their number and the total length."""
    n = F.length(value)

    def block(i: Column) -> Column:
        own = F.when(n <= most, F.lit(tweak)).otherwise(F.concat_ws("-", F.lit(tweak), i.cast("string"), n.cast("string"), F.lit("")))
        return permuted(F.substring(value, i * most + 1, F.lit(most)), own)

    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.greatest(n, F.lit(1)) - 1) / most).cast("int")), block), "")


def permute_letters(letters: Column, key: str, tweak: str) -> Column:
    """The keyed permutation of strings of as many letters a-z, by blocks of 26."""
    return _blocks(letters, MOST_LETTERS, lambda x, own: _permute_letters(x, key, own), tweak)


def _permute_letters(letters: Column, key: str, tweak: Column) -> Column:
    head, n = letters, F.length(letters)
    u = F.floor(n / 2).cast("int")

    def number(s: Column) -> Column:
        return F.aggregate(F.split(s, ""), F.lit(0).cast("long"), lambda x, c: F.when(c == "", x).otherwise(x * 26 + F.ascii(c) - 97))

    def text(x: Column, k: Column) -> Column:
        start = F.struct(x.alias("x"), F.lit("").alias("s"))
        done = F.aggregate(F.sequence(F.lit(1), k), start, lambda s, _: F.struct((s["x"] - s["x"] % 26).cast("decimal(20,0)").__truediv__(F.lit(26).cast("decimal(20,0)")).cast("long").alias("x"), F.concat(F.char(F.lit(97) + s["x"] % 26), s["s"]).alias("s")))
        return F.when(k > 0, done["s"]).otherwise(F.lit(""))

    out = feistel(number(F.substring(head, F.lit(1), u)), number(F.substring(head, u + 1, n)), (_power(26, u, 13), _power(26, n - u, 13)), key, F.concat(tweak, n.cast("string")))
    both = F.transform(F.array(out), lambda s: F.concat(text(s["a"], u), text(s["b"], n - u)))
    return F.when(n == 1, shuffled(letters, "abcdefghijklmnopqrstuvwxyz", key, tweak)).when(n > 1, both[0]).otherwise(letters)


def refill(value: Column, kind: str, replacement: Column) -> Column:
    """``value`` with its characters of ``kind`` (a class) replaced in order; upper case stays upper case."""
    start = F.struct(F.lit(1).alias("k"), F.lit("").alias("s"))

    def step(s: Column, c: Column) -> Column:
        hit = c.rlike(f"^{kind}$")
        r = F.substring(replacement, s["k"], F.lit(1))
        return F.struct((s["k"] + hit.cast("int")).alias("k"), F.concat(s["s"], F.when(hit, F.when(c == F.lower(c), r).otherwise(F.upper(r))).otherwise(c)).alias("s"))

    return F.aggregate(F.split(value, ""), start, step)["s"]


def _only(value: Column, others: str) -> Column:
    return F.regexp_replace(value, others, "")


def luhn_digit(payload: Column) -> Column:
    """The check digit that makes payload and digit valid."""
    n = F.length(payload)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(payload, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)
    return F.pmod(F.lit(10) - total % 10, F.lit(10)).cast("string")


def mod97(text: Column) -> Column:
    """Rest by 97 of digits and letters A-Z, letters as 10 to 35."""

    def add(x: Column, c: Column) -> Column:
        return F.when(c == "", x).when(c.rlike("[0-9]"), (x * 10 + c.cast("int")) % 97).otherwise((x * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def _card(v: Column, key: str) -> Column:
    """The longest run of digit groups that passes, the first of equal ones; the groups around it stay."""
    parts = F.split(v, "[ -]")
    groups = F.sequence(F.lit(1), F.size(parts))

    def end(i: Column) -> Column:
        return F.length(F.array_join(F.slice(parts, F.lit(1), i), " "))

    def span(i: Column, j: Column) -> Column:
        at = F.when(i == 1, 1).otherwise(end(i - 1) + 2)
        value = F.substring(v, at, end(j) - at + 1)
        return F.struct((-F.length(_only(value, "[^0-9]"))).alias("less"), at.alias("at"), value.alias("value"), _only(value, "[^0-9]").alias("digits"))

    spans = F.flatten(F.transform(groups, lambda i: F.transform(F.filter(groups, lambda j: j >= i), lambda j: span(i, j))))
    passed = F.filter(spans, lambda s: F.length(s["digits"]).between(13, 19) & (luhn_digit(F.substring(s["digits"], F.lit(1), F.length(s["digits"]) - 1)) == F.substring(s["digits"], -1, 1)))

    def made(s: Column) -> Column:
        payload = permute_digits(F.substring(s["digits"], F.lit(1), F.length(s["digits"]) - 1), key, "card")
        new = F.transform(F.array(payload), lambda p: refill(s["value"], "[0-9]", F.concat(p, luhn_digit(p))))[0]
        return F.concat(F.substring(v, F.lit(1), s["at"] - 1), new, F.substring(v, s["at"] + F.length(s["value"]), F.length(v)))

    return F.get(F.transform(F.slice(F.array_sort(passed), 1, 1), made), 0)


def _iban(v: Column, key: str) -> Column:
    """The most groups from the first on that pass; what follows them stays."""
    parts = F.split(v, " ")
    spans = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), " "))

    def passes(s: Column) -> Column:
        plain = _only(s, " ")
        return F.length(plain).between(15, 34) & (mod97(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))) == 1)

    def made(s: Column) -> Column:
        plain = _only(s, " ")
        country, bank = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))

        def rebuilt(b: Column) -> Column:
            check = F.lpad((F.lit(98) - mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0")
            return refill(s, "[A-Z0-9]", F.concat(country, check, b))

        new = F.transform(F.array(refill(bank, "[0-9]", permute_digits(_only(bank, "[^0-9]"), key, "iban"))), rebuilt)[0]
        return F.concat(new, F.substring(v, F.length(s) + 1, F.length(v)))

    return F.get(F.transform(F.slice(F.filter(spans, passes), 1, 1), made), 0)


def _ip(v: Column, key: str) -> Column:
    parts = F.transform(F.split(v, r"\."), lambda x: x.cast("int"))
    new = F.transform(F.array(feistel(parts[0] * 256 + parts[1], parts[2] * 256 + parts[3], (F.lit(65536), F.lit(65536)), key, F.lit("ip"))), lambda s: F.concat_ws(".", F.floor(s["a"] / 256), s["a"] % 256, F.floor(s["b"] / 256), s["b"] % 256))[0]
    return F.when(F.forall(parts, lambda x: x <= 255), new)


def _ssn(v: Column, key: str) -> Column:
    area, group, serial = (F.substring(v, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    place = area - 1 - (area > 666).cast("int")
    out = feistel(place, (group - 1) * 9999 + serial - 1, (F.lit(AREAS), F.lit(SERIALS)), key, F.lit("ssn"))

    def written(s: Column) -> Column:
        a = s["a"] + 1 + (s["a"] >= 665).cast("int")
        return F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"), F.lpad((F.floor(s["b"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((s["b"] % 9999 + 1).cast("string"), 4, "0"))

    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    return F.when(valid, F.transform(F.array(out), written)[0])


def _days(first: int, second: int, month_first: bool) -> list[str]:
    """``MM-DD`` of all days that a written form with so many digits can stand for, but for the 29th of February."""
    months, days = (first, second) if month_first else (second, first)
    ends = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
    return [f"{m:02}-{d:02}" for m in range(1, 10 if months == 1 else 13) for d in range(13 if month_first else 1, 10 if days == 1 else ends[m - 1] + 1)]


def _date(v: Column, key: str) -> Column:
    """Within the written form: order, separator, number of digits. A date whose second number is over 12 has the month first, and so has its pseudonym."""
    iso = v.rlike(r"^\d{4}[-/]")
    mark = F.when(v.contains("."), F.lit(".")).otherwise(F.lit("/"))
    parts = F.split(v, "[-./]")
    first, second = parts[0].cast("int"), parts[1].cast("int")
    month_first = ~iso & (second > 12)  # else the day comes first
    year = F.when(iso, parts[0]).otherwise(parts[2]).cast("int")
    month = F.when(iso, second).when(month_first, first).otherwise(second)
    day = F.when(iso, parts[2].cast("int")).when(month_first, second).otherwise(first)
    place = F.concat_ws("-", F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))

    # the days of each written form: as text, cut apart once
    forms = [(i, j, f) for i in (1, 2) for j in (1, 2) for f in (False, True) if j == 2 or not f]
    names = ["date", *(f"date{i}{j}{'m' if f else 'd'}" for i, j, f in forms)]
    days = [_days(2, 2, False), *(_days(*form) for form in forms)]
    form = F.when(iso, F.lit("date")).otherwise(F.concat(F.lit("date"), F.length(parts[0]).cast("string"), F.length(parts[1]).cast("string"), F.when(month_first, "m").otherwise("d")))
    listed = F.split(F.element_at(F.array(*(F.lit(" ".join(d)) for d in days)), F.array_position(F.array(*map(F.lit, names)), form).cast("int")), " ")

    def written(years: Column, md: Column) -> Column:
        month_text, day_text = (F.substring(md, F.lit(at + 2) - n, n) for at, n in ((1, F.length(F.when(month_first, parts[0]).otherwise(parts[1]))), (4, F.length(F.when(month_first, parts[1]).otherwise(parts[0])))))
        short = F.when(month_first, F.concat(month_text, mark, day_text)).otherwise(F.concat(day_text, mark, month_text))
        return F.when(iso, F.when(v.contains("/"), F.concat_ws("/", years.cast("string"), F.substring(md, 1, 2), F.substring(md, 4, 2))).otherwise(F.concat_ws("-", years.cast("string"), md))).otherwise(F.concat(short, mark, years.cast("string")))

    def usual(d: Column) -> Column:
        out = feistel(year - FIRST_YEAR, F.array_position(d, place) - 1, (F.lit(YEARS), F.size(d)), key, form)
        return F.transform(F.array(out), lambda s: written(s["a"] + FIRST_YEAR, F.element_at(d, (s["b"] + 1).cast("int"))))[0]

    # the 29ths of February of 1904 to 2096, 7 times 7
    number = F.floor(year / 4) - 476
    leaps = feistel(F.floor(number / 7), number % 7, (F.lit(7), F.lit(7)), key, F.concat(form, F.lit("leap")))
    leaps = F.transform(F.array(leaps), lambda s: written((s["a"] * 7 + s["b"] + 476) * 4, F.lit("02-29")))[0]
    usual_made = F.transform(F.array(listed), lambda d: F.when(F.array_contains(d, place), usual(d)))[0]
    return F.when((place == "02-29") & leap & (year != 1900), leaps).otherwise(usual_made)


def _phone(v: Column, key: str) -> Column:
    code = F.regexp_extract(v, r"^(\+\d{1,3}|00[1-9]\d{0,2}(?=[ .-]))?", 0)
    rest = F.substring(v, F.length(code) + 1, F.length(v))
    digits = _only(rest, "[^0-9]")
    return F.when(F.length(digits).between(7, 14), F.concat(code, refill(rest, "[0-9]", permute_digits(digits, key, "phone"))))


#: Letters of European languages beyond a-z, in lower and upper case.
ACCENTED = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþāăąćčďđēĕęěğģīķĺļľłńňőœŕřśşšťţůűźżž"
_UPPER = ACCENTED.upper()


def _accents(value: Column, key: str) -> Column:
    """Letters beyond a-z, each for another one of them by a keyed shuffle; case stays."""
    order = "".join(sorted(ACCENTED, key=lambda c: hashlib.sha256(f"{key}|email|accents|{c}".encode()).digest()))
    return F.translate(value, ACCENTED + _UPPER, order + order.upper())


def _email(v: Column, key: str) -> Column:
    local = F.substring_index(v, "@", 1)
    letters, digits = _only(F.lower(local), "[^a-z]"), _only(local, "[^0-9]")
    numbers = _blocks(digits, MOST_DIGITS, lambda x, own: permute_digits(x, key, own), "email")
    new = refill(refill(_accents(local, key), "[A-Za-z]", permute_letters(letters, key, "email")), "[0-9]", numbers)
    return F.concat(new, F.substring(v, F.length(local) + 1, F.length(v)))


_PERMUTED = {"date": _date, "ip": _ip, "ssn": _ssn, "iban": _iban, "email": _email, "phone": _phone, "card": _card}


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    """The pseudonym of a value of a kind, null where the value fails its format's check."""
    out = None
    for name, made in _PERMUTED.items():
        out = F.when(kind == name, made(value, key)) if out is None else out.when(kind == name, made(value, key))
    return out


def pseudonymize(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, key: str) -> DataFrame:
    """One row for each input row: ``doc_id, text, n_values, kinds``.

    ``text`` has every valid value replaced, ``n_values`` counts them and
    ``kinds`` names them in order. Null texts stay null with no values; empty
    texts and texts without values stay as they are. Null identifiers and
    repeated rows are rows like any other; an empty table gives an empty result;
    further columns are ignored.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # most texts have no digit and no @: one cheap scan spares them the formats
    found = F.when(F.col("text").rlike("[0-9@]"), F.regexp_extract_all("text", F.lit(ANY), 0))
    source = source.withColumn("found", found)

    def kind_of(v: Column) -> Column:
        out = None
        for name, pattern in FORMATS.items():
            hit = v.rlike("^(?:" + pattern + ")$")
            out = F.when(hit, name) if out is None else out.when(hit, name)
        return out

    some = F.size("found") > 0
    source = source.withColumn("values", F.when(some, F.transform("found", lambda v: F.struct(v.alias("v"), kind_of(v).alias("kind")))))
    source = source.withColumn("values", F.when(some, F.transform("values", lambda x: F.struct(x["v"].alias("v"), x["kind"].alias("kind"), pseudonym(x["v"], x["kind"], key).alias("new")))))
    between = F.split("text", ANY, -1)
    heads = F.slice(between, F.lit(1), F.size("found"))
    joined = F.concat(F.array_join(F.zip_with("values", heads, lambda x, b: F.concat(b, F.coalesce(x["new"], x["v"]))), ""), F.element_at(between, -1))
    valid = F.filter("values", lambda x: x["new"].isNotNull())
    return source.select(
        "doc_id",
        F.when(some, joined).otherwise(F.col("text")).alias("text"),
        F.when(some, F.size(valid)).otherwise(0).alias("n_values"),
        F.when(some, F.transform(valid, lambda x: x["kind"])).otherwise(F.array().cast("array<string>")).alias("kinds"),
    )
