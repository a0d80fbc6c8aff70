"""Format-preserving pseudonyms of personal numbers and dates by keyed Feistel permutations. Built-in functions only.

Found in texts: e-mail addresses, IPv4 addresses, payment cards (Luhn), North American phone numbers, other phone
numbers with a country code, social security numbers, IBANs (mod 97) and dates. A value that passes its kind's
validation is permuted within the kind's set of valid values and put back in its own layout, so equal values get equal
pseudonyms in all documents, whatever their layout, and different values of a kind different ones. (Equal means: the
same number, date or address. Capitals of an address, zeros before a number and a phone's country code 1 don't count.)

The permutation is an alternating Feistel network on Z_a x Z_b: in turn L = (L + F(R)) mod a and R = (R + F(L)) mod b,
with F from HMAC-SHA-256 under the key. With a * b the size of the set no cycle has to be walked: phone numbers have 800
area codes by 800 * 10,000 numbers. Dates of 400 years are permuted within classes by how their day and month are
written (one digit, two, or a day that can't be a month), so a text keeps its widths and stays as unambiguous as it was.

The key reaches the executors as a value of a one-row table; plans show neither it nor anything derived from it.

Defined results: null text stays null with no values found; a null doc_id and repeated rows are kept as rows; an empty
table gives an empty result; a value that fails validation stays as it is; only doc_id and text are read.

Cards are sought in runs of digit groups, however long: a card is a stretch of whole groups, parted by single blanks or
hyphens, with 13 to 19 digits that passes Luhn, so an expiry date, a security code or a number beside it doesn't hide it. Of stretches that overlap, one in
a layout of cards goes first, then the earlier, then the longer. The other kinds are sought in the text between cards.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
#: Dates of the 400 years from this one on are valid.
FIRST_YEAR, YEARS = 1800, 400
#: Days after the 12th before each month, of the months to September and of those from October, but for 29 February.
LATE_DAYS = ((0, 19, 35, 54, 72, 91, 109, 128, 147, 165), (0, 19, 37, 56))
#: Sizes of the halves for dates by (month of two digits, days: to 9, to 12, later); their product is the class's size.
DATE_HALVES = {(0, 0): (180, 180), (1, 0): (100, 108), (0, 1): (100, 108), (1, 1): (60, 60), (0, 2): (250, 264), (1, 2): (140, 160)}
LEAP_DAYS = 97

_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"
_IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_PHONE = r"(?<![0-9A-Za-z])(?:\+?1[-. ]?)?(?:\([2-9][0-9]{2}\)[-. ]?|[2-9][0-9]{2}[-. ])[2-9][0-9]{2}[-. ][0-9]{4}(?![0-9])"
_ABROAD = r"(?<![0-9A-Za-z])\+[1-9][0-9]{0,2}(?:[-. ]?\(?[0-9]{1,4}\)?){2,5}(?![0-9])"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_DATE = r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9]|[./-][0-9])"
# One character class, so that the matcher loops over a run of any length; blanks and hyphens in a row are judged later.
_RUN = r"(?<![0-9A-Za-z])[0-9][0-9 -]{11,}[0-9](?![0-9A-Za-z])"
#: In this order the first that fits at a place is taken.
KINDS = {"email": _EMAIL, "ip": _IP, "iban": _IBAN, "phone": _PHONE, "abroad": _ABROAD, "ssn": _SSN, "date": _DATE, "card": _RUN}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
OTHERS = "|".join(f"(?:{p})" for k, p in KINDS.items() if k != "card")
#: Layouts that cards are written in.
_LAYOUT = r"^(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -][0-9]{3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})$"


def hmac_pads(key: str) -> tuple[bytes, bytes]:
    """The key, padded for the inner and the outer hash of HMAC-SHA-256."""
    raw = key.encode()
    block = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    return bytes(x ^ 0x36 for x in block), bytes(x ^ 0x5C for x in block)


def key_table(spark: SparkSession, key: str) -> DataFrame:
    """One row with column key: struct<inner, outer>."""
    return spark.createDataFrame([(hmac_pads(key),)], "key struct<inner:binary,outer:binary>")


def _keyed(key: Column, what: Column, round_: Column, x: Column) -> Column:
    """60 bits of HMAC-SHA-256 over kind, round and the other half."""
    text = F.concat_ws(":", what, round_.cast("string"), x.cast("string")).cast("binary")
    inner = F.unhex(F.sha2(F.concat(key["inner"], text), 256))
    return F.conv(F.substring(F.sha2(F.concat(key["outer"], inner), 256), 1, 15), 16, 10).cast("long")


def feistel(key: Column, what: Column, left: Column, right: Column, a: Column, b: Column) -> Column:
    """struct<l, r>: the permuted pair of Z_a x Z_b."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def step(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        l = F.when(odd, s["l"]).otherwise(F.pmod(s["l"] + F.pmod(_keyed(key, what, i, s["r"]), a), a))
        r = F.when(odd, F.pmod(s["r"] + F.pmod(_keyed(key, what, i, s["l"]), b), b)).otherwise(s["r"])
        return F.struct(l.cast("long").alias("l"), r.cast("long").alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(2 * ROUNDS - 1)), start, step)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _pow10(n: Column) -> Column:
    return F.rpad(F.lit("1"), (n + 1).cast("int"), "0").cast("long")


def permute_digits(key: Column, what: str, digits: Column) -> Column:
    """A string of 2 to 36 decimal digits, permuted among those of its length."""

    def body(d: Column) -> Column:
        u = F.floor(F.length(d) / 2).cast("int")
        v = F.length(d) - u
        kind = F.concat(F.lit(what), F.length(d).cast("string"))
        out = feistel(key, kind, F.substr(d, F.lit(1), u).cast("long"), F.substr(d, u + 1, v).cast("long"), _pow10(u), _pow10(v))
        return _let(out, lambda s: F.concat(_padded(s["l"], u), _padded(s["r"], v)))

    return _let(digits, body)


def _padded(x: Column, n: Column) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def _only(value: Column, keep: str) -> Column:
    return F.regexp_replace(value, f"[^{keep}]", "")


def relaid(layout: Column, chars: Column, keep: str) -> Column:
    """layout with its characters of class [keep] replaced in turn by those of chars."""

    def at(i: Column) -> Column:
        here = F.substr(layout, i, F.lit(1))
        return F.when(here.rlike(f"[{keep}]"), F.substr(chars, F.length(_only(F.substr(layout, F.lit(1), i), keep)), F.lit(1))).otherwise(here)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(layout)), at), "")


def _luhn_sum(digits: Column, last_doubled: bool) -> Column:
    """Sum of the Luhn scheme, from the right; last_doubled: the last digit is one that counts twice."""
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when((i + int(last_doubled)) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), worth), F.lit(0), lambda s, x: s + x)


def _card(key: Column, v: Column) -> Column:
    """The leading digit stays, the rest is permuted, the check digit is computed anew."""

    def body(d: Column) -> Column:
        payload = F.concat(F.substr(d, F.lit(1), F.lit(1)), permute_digits(key, "card", F.substr(d, F.lit(2), F.length(d) - 2)))
        new = _let(payload, lambda p: F.concat(p, F.pmod(-_luhn_sum(p, True), F.lit(10)).cast("string")))
        return F.when(_luhn_sum(d, False) % 10 == 0, relaid(v, new, "0-9"))

    return _let(_only(v, "0-9"), body)


#: A group has a digit at least, so no more than 19 of them make a card.
_MOST_GROUPS = 19


def _groups(run: Column) -> Column:
    """array<struct<before, digits>>: the run's groups of digits, each with the blanks and hyphens before it."""
    digits = F.regexp_extract_all(run, F.lit("[0-9]+"), F.lit(0))
    return F.zip_with(F.split(run, "[0-9]+", -1), digits, lambda b, d: F.when(d.isNotNull(), F.struct(b.alias("before"), d.alias("digits"))))


def _laid(groups: Column) -> Column:
    return F.array_join(F.transform(groups, lambda g: F.concat(g["before"], g["digits"])), "")


def _cards(groups: Column) -> Column:
    """array<struct<first, last>> of the cards among the groups of a run, in their order; groups count from 0.

    Two sweeps from left to right: cards in a layout of cards first, then others clear of those. Each takes the longest
    stretch from a group on, if it begins after the last one taken.
    """
    spot = "array<struct<first:int,last:int>>"

    def stretches(g: Column, i: Column) -> Column:
        """The cards that begin at a group, the longest first. Single blanks or hyphens part their groups."""

        def grow(s: Column, x: Column) -> Column:
            ok = s["open"] & ((s["n"] == 0) | (F.length(x["before"]) == 1)) & (F.length(s["digits"]) + F.length(x["digits"]) <= 19)
            digits = F.concat(s["digits"], x["digits"])
            text = F.when(s["n"] == 0, x["digits"]).otherwise(F.concat(s["text"], x["before"], x["digits"]))
            one = F.struct((i + s["n"]).cast("int").alias("last"), digits.alias("digits"), text.alias("text"))
            out = F.when(ok & (F.length(digits) >= 13), F.concat(F.array(one), s["out"])).otherwise(s["out"])
            return F.struct(ok.alias("open"), (s["n"] + 1).alias("n"), digits.alias("digits"), text.alias("text"), out.alias("out"))

        start = F.struct(F.lit(True).alias("open"), F.lit(0).alias("n"), F.lit("").alias("digits"), F.lit("").alias("text"), F.array().cast("array<struct<last:int,digits:string,text:string>>").alias("out"))
        found = F.aggregate(F.slice(g, i + 1, F.lit(_MOST_GROUPS)), start, grow, lambda s: s["out"])
        valid = F.filter(found, lambda x: _luhn_sum(x["digits"], False) % 10 == 0)
        return F.transform(valid, lambda x: F.struct(i.cast("int").alias("first"), x["last"].alias("last"), (~x["text"].rlike(_LAYOUT)).alias("odd")))

    def sweep(every: Column) -> Column:
        start = F.struct(F.lit(-1).alias("end"), F.array().cast(spot).alias("out"))

        def take(s: Column, own: Column) -> Column:
            new = F.array_append(s["out"], F.struct(own[0]["first"].alias("first"), own[0]["last"].alias("last")))
            return F.when((F.size(own) > 0) & (F.get(own, F.lit(0))["first"] > s["end"]), F.struct(own[0]["last"].alias("end"), new.alias("out"))).otherwise(s)

        return F.aggregate(every, start, take, lambda s: s["out"])

    def both(every: Column) -> Column:
        laid = sweep(F.filter(F.transform(every, lambda own: F.filter(own, lambda x: ~x["odd"])), lambda own: F.size(own) > 0))

        def others(taken: Column) -> Column:
            clear = lambda x: ~F.exists(taken, lambda o: (o["first"] <= x["last"]) & (x["first"] <= o["last"]))
            rest = F.transform(every, lambda own: F.filter(own, lambda x: x["odd"] & clear(x)))
            return F.array_sort(F.concat(taken, sweep(F.filter(rest, lambda own: F.size(own) > 0))))

        return _let(laid, others)

    every = F.filter(F.transform(groups, lambda x, i: stretches(groups, i)), lambda own: F.size(own) > 0)
    return _let(every, both)


def segments(text: Column) -> Column:
    """array<struct<card, value>>: the text in its order, cut at the cards."""
    kind = "array<struct<card:boolean,value:string>>"
    piece = lambda card, value: F.struct(F.lit(card).alias("card"), value.alias("value"))

    def cut(run: Column) -> Column:
        def at_cards(groups: Column) -> Column:
            part = lambda low, n: F.slice(groups, low + 1, n)

            def step(s: Column, c: Column) -> Column:
                before = groups[c["first"]]["before"]
                gap = F.concat(_laid(part(s["at"], c["first"] - s["at"])), before)
                card = F.substr(_laid(part(c["first"], c["last"] - c["first"] + 1)), F.length(before) + 1)
                return F.struct((c["last"] + 1).cast("int").alias("at"), F.concat(s["out"], F.array(piece(False, gap), piece(True, card))).alias("out"))

            start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
            return F.aggregate(_cards(groups), start, step, lambda s: F.array_append(s["out"], piece(False, _laid(part(s["at"], F.size(groups) - s["at"])))))

        return _let(F.filter(_groups(run), lambda g: g.isNotNull()), at_cards)

    found, pieces = F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), F.split(text, ANY, -1)
    each = F.transform(found, lambda v: F.when(v.rlike(f"^(?:{_RUN})$") & (_kind(v) == "card"), cut(v)).otherwise(F.array(piece(False, v))))
    rows = F.flatten(F.zip_with(pieces, each, lambda p, m: F.concat(F.array(piece(False, F.coalesce(p, F.lit("")))), F.coalesce(m, F.array().cast(kind)))))

    def join(rows: Column) -> Column:
        """The pieces between cards become one each."""
        between = lambda low, n: piece(False, F.array_join(F.transform(F.slice(rows, low + 1, n), lambda x: x["value"]), ""))

        def step(s: Column, i: Column) -> Column:
            return F.struct((i + 1).cast("int").alias("at"), F.concat(s["out"], F.array(between(s["at"], i - s["at"]), rows[i])).alias("out"))

        cards = F.filter(F.sequence(F.lit(0), F.size(rows) - 1), lambda i: rows[i]["card"])
        start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
        return F.aggregate(cards, start, step, lambda s: F.array_append(s["out"], between(s["at"], F.size(rows) - s["at"])))

    return F.when(text.rlike(_RUN), _let(rows, join)).otherwise(F.array(piece(False, text)))


def _phone(key: Column, v: Column) -> Column:
    """Area and exchange codes stay within 200 to 999."""

    def body(d: Column) -> Column:
        own = F.substr(d, F.length(d) - 9, F.lit(10))
        area, rest = F.substr(own, F.lit(1), F.lit(3)).cast("long") - 200, F.substr(own, F.lit(4), F.lit(7)).cast("long") - 2_000_000
        new = _let(feistel(key, F.lit("phone"), area, rest, F.lit(800), F.lit(8_000_000)), lambda s: F.concat((s["l"] + 200).cast("string"), (s["r"] + 2_000_000).cast("string")))
        return relaid(v, F.concat(F.substr(d, F.lit(1), F.length(d) - 10), new), "0-9")

    return _let(_only(v, "0-9"), body)


def _abroad(key: Column, v: Column) -> Column:
    """The first two digits (the country code, most often) stay; 8 to 15 digits are valid."""
    return _let(_only(v, "0-9"), lambda d: F.when(F.length(d).between(8, 15), relaid(v, F.concat(F.substr(d, F.lit(1), F.lit(2)), permute_digits(key, "abroad", F.substr(d, F.lit(3), F.length(d) - 2))), "0-9")))


def _ssn(key: Column, v: Column) -> Column:
    """Areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999, mapped among themselves."""

    def body(d: Column) -> Column:
        area, group, serial = F.substr(d, F.lit(1), F.lit(3)).cast("long"), F.substr(d, F.lit(4), F.lit(2)).cast("long"), F.substr(d, F.lit(6), F.lit(4)).cast("long")
        valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        own = area - 1 - F.when(area > 666, 1).otherwise(0)
        out = feistel(key, F.lit("ssn"), own, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999))
        new = _let(out, lambda s: F.concat(F.lpad((s["l"] + 1 + F.when(s["l"] >= 665, 1).otherwise(0)).cast("string"), 3, "0"), F.lpad((F.floor(s["r"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((s["r"] % 9999 + 1).cast("string"), 4, "0")))
        return F.when(valid, relaid(v, new, "0-9"))

    return _let(_only(v, "0-9"), body)


def _ip(key: Column, v: Column) -> Column:
    def body(p: Column) -> Column:
        n = [p[i].cast("long") for i in range(4)]
        valid = (n[0] <= 255) & (n[1] <= 255) & (n[2] <= 255) & (n[3] <= 255)
        out = feistel(key, F.lit("ip"), n[0] * 256 + n[1], n[2] * 256 + n[3], F.lit(65536), F.lit(65536))
        return F.when(valid, _let(out, lambda s: F.concat_ws(".", *(x.cast("string") for x in (F.floor(s["l"] / 256), s["l"] % 256, F.floor(s["r"] / 256), s["r"] % 256)))))

    return _let(F.split(v, r"\."), body)


def _mod97(text: Column) -> Column:
    """Remainder of an IBAN's digits and letters (A: 10) modulo 97, character by character."""

    def step(s: Column, c: Column) -> Column:
        x = F.conv(c, 36, 10).cast("int")
        return F.pmod(s * F.when(x > 9, 100).otherwise(10) + x, F.lit(97))

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), step)


def _iban(key: Column, v: Column) -> Column:
    """The account's digits are permuted, its letters stay, the two check digits are computed anew."""

    def body(t: Column) -> Column:
        country, account = F.substr(t, F.lit(1), F.lit(2)), F.substr(t, F.lit(5))
        valid = _mod97(F.concat(account, F.substr(t, F.lit(1), F.lit(4)))) == 1
        digits = _only(account, "0-9")
        new = relaid(account, permute_digits(key, "iban", digits), "0-9")
        whole = _let(new, lambda n: F.concat(country, F.lpad((98 - _mod97(F.concat(n, country, F.lit("00")))).cast("string"), 2, "0"), n))
        return F.when(valid & F.length(digits).between(2, 36), relaid(v, whole, "A-Z0-9"))

    return _let(F.replace(v, F.lit(" "), F.lit("")), body)


def _permuted_date(key: Column, x: Column) -> Column:
    """struct<y, m, d>: a valid date permuted within its class."""
    leap = (x["m"] == 2) & (x["d"] == 29)
    late = lambda which: F.array(*map(F.lit, LATE_DAYS[which]))
    autumn = (x["m"] >= 10).cast("int")
    days = F.when(x["d"] < 10, 0).when(x["d"] <= 12, 1).otherwise(2)
    month = x["m"] - 1 - autumn * 9
    within = F.when(days == 0, month * 9 + x["d"] - 1).when(days == 1, month * 3 + x["d"] - 10).when(autumn == 1, late(1)[month] + x["d"] - 13).otherwise(late(0)[month] + x["d"] - 13)
    each, left, right = F.lit(0), F.lit(0), F.lit(0)
    for (two, kind), (a, b) in DATE_HALVES.items():
        own = (autumn == two) & (days == kind)
        each, left, right = F.when(own, a * b // YEARS).otherwise(each), F.when(own, a).otherwise(left), F.when(own, b).otherwise(right)
    name = F.when(leap, "date leap").otherwise(F.concat_ws(" ", F.lit("date"), autumn.cast("string"), days.cast("string")))
    # Leap days by their number among those of the 400 years; 1800, 1900 and 2100 have none.
    number = F.floor((x["y"] - FIRST_YEAR) / 4) - 1 - (x["y"] > 1900).cast("int") - (x["y"] > 2100).cast("int")
    place = F.when(leap, number).otherwise((x["y"] - FIRST_YEAR) * each + within).cast("long")
    state = F.struct(place.alias("at"), name.alias("name"), each.cast("long").alias("each"), F.when(leap, 1).otherwise(left).alias("a"), F.when(leap, LEAP_DAYS).otherwise(right).alias("b"), autumn.alias("autumn"), days.alias("days"), leap.alias("leap"))

    def back(p: Column, s: Column) -> Column:
        raw = p + (p >= 24).cast("int") + (p >= 73).cast("int")
        w = (p % s["each"]).cast("int")
        starts = F.when(s["autumn"] == 1, late(1)).otherwise(late(0))
        later = F.size(F.filter(starts, lambda v: v <= w)) - 1
        month = F.when(s["days"] == 0, F.floor(w / 9)).when(s["days"] == 1, F.floor(w / 3)).otherwise(later).cast("int")
        day = F.when(s["days"] == 0, w % 9 + 1).when(s["days"] == 1, w % 3 + 10).otherwise(w - starts[month] + 13)
        plain = F.struct((F.floor(p / s["each"]) + FIRST_YEAR).cast("int").alias("y"), (month + 1 + s["autumn"] * 9).cast("int").alias("m"), day.cast("int").alias("d"))
        return F.when(s["leap"], F.struct((raw * 4 + FIRST_YEAR + 4).cast("int").alias("y"), F.lit(2).alias("m"), F.lit(29).alias("d"))).otherwise(plain)

    def mapped(s: Column) -> Column:
        out = feistel(key, s["name"], F.floor(s["at"] / s["b"]), s["at"] % s["b"], s["a"], s["b"])
        return _let(out, lambda o: _let((o["l"] * s["b"] + o["r"]).cast("long"), lambda p: back(p, s)))

    return _let(state, mapped)


def _date(key: Column, v: Column) -> Column:
    """Year first, or day before month (else month before day) and year; the permuted date in the same layout."""

    def body(p: Column) -> Column:
        iso = v.contains("-")
        year = F.when(iso, p[0]).otherwise(p[2]).cast("int")
        low, high = F.when(iso, p[2]).otherwise(p[0]).cast("int"), p[1].cast("int")
        swapped = ~iso & (high > 12)
        day, month = F.when(swapped, high).otherwise(low), F.when(swapped, low).otherwise(high)
        date = F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")), "yyyy-MM-dd")
        return F.when(date.isNotNull() & year.between(FIRST_YEAR, FIRST_YEAR + YEARS - 1), laid(F.struct(year.alias("y"), month.alias("m"), day.alias("d"), iso.alias("iso"), swapped.alias("swapped")), p))

    def laid(x: Column, p: Column) -> Column:
        wide = lambda n, part: F.lpad(n.cast("string"), F.length(part), F.lit("0"))

        def digits(x: Column) -> Column:
            def put(new: Column) -> Column:
                own = F.when(x["iso"], F.concat(wide(new["y"], p[0]), wide(new["m"], p[1]), wide(new["d"], p[2])))
                own = own.when(x["swapped"], F.concat(wide(new["m"], p[0]), wide(new["d"], p[1]), wide(new["y"], p[2])))
                return relaid(v, own.otherwise(F.concat(wide(new["d"], p[0]), wide(new["m"], p[1]), wide(new["y"], p[2]))), "0-9")

            return _let(_permuted_date(key, x), put)

        return _let(x, digits)

    return _let(F.split(v, "[./-]"), body)


def _email(key: Column, v: Column) -> Column:
    """The name's letters and digits, as numbers in base 36, are permuted; marks and the host stay."""

    def body(name: Column) -> Column:
        def run(x: Column) -> Column:
            u = F.floor(F.length(x) / 2).cast("int")
            w = F.length(x) - u
            part = lambda t: F.coalesce(F.conv(F.when(t == "", "0").otherwise(t), 36, 10).cast("long"), F.lit(0).cast("long"))
            size = lambda n: F.pow(F.lit(36.0), n).cast("long")
            out = feistel(key, F.concat(F.lit("email"), F.length(x).cast("string")), part(F.substr(x, F.lit(1), u)), part(F.substr(x, u + 1, w)), size(u), size(w))
            return _let(out, lambda s: F.lower(F.concat(F.when(u > 0, F.lpad(F.conv(s["l"].cast("string"), 10, 36), u, "0")).otherwise(""), F.lpad(F.conv(s["r"].cast("string"), 10, 36), w, "0"))))

        plain = F.lower(_only(name, "A-Za-z0-9"))
        # 18 characters at a time: halves of base 36 then stay exact in 53 bits.
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.length(plain) - 1) / 18).cast("int")), lambda i: run(F.substr(plain, i * 18 + 1, F.lit(18))))
        return F.concat(relaid(name, F.array_join(parts, ""), "A-Za-z0-9"), F.substr(v, F.length(name) + 1))

    return _let(F.substring_index(v, "@", 1), body)


def _kind(v: Column) -> Column:
    out = F.lit("card")
    for name in reversed(list(KINDS)[:-1]):
        out = F.when(v.rlike(f"^(?:{KINDS[name]})$"), name).otherwise(out)
    return out


def pseudonym(value: Column, key: Column) -> Column:
    """struct<kind, value, new>: new is null where the value fails its kind's validation."""
    make = {"email": _email, "ip": _ip, "iban": _iban, "phone": _phone, "abroad": _abroad, "ssn": _ssn, "date": _date}

    def body(x: Column) -> Column:
        new = F.lit(None).cast("string")
        for kind, f in make.items():
            new = F.when(x["kind"] == kind, f(key, x["value"])).otherwise(new)
        return F.struct(x["kind"].alias("kind"), x["value"].alias("value"), new.alias("new"))

    return _let(F.struct(_kind(value).alias("kind"), value.alias("value")), body)


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, n_values, kinds, text): each valid value in the text replaced by its pseudonym, and counts by kind."""
    values = "array<struct<kind:string,value:string,new:string>>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), key_table(docs.sparkSession, key).scalar().alias("key"))
    rows = rows.select("doc_id", "text", "key", F.when(F.col("text").rlike(ANY), segments(F.col("text"))).alias("cut"))

    def found(x: Column) -> Column:
        plain = F.transform(F.regexp_extract_all(x["value"], F.lit(OTHERS), F.lit(0)), lambda v: pseudonym(v, F.col("key")))
        card = F.array(F.struct(F.lit("card").alias("kind"), x["value"].alias("value"), _card(F.col("key"), x["value"]).alias("new")))
        return F.struct(x["card"].alias("card"), x["value"].alias("value"), F.when(x["card"], card).otherwise(plain).cast(values).alias("found"))

    def put(x: Column) -> Column:
        laid = F.zip_with(F.split(x["value"], OTHERS, -1), F.transform(x["found"], lambda m: F.coalesce(m["new"], m["value"])), lambda p, m: F.concat(F.coalesce(p, F.lit("")), F.coalesce(m, F.lit(""))))
        return F.when(x["card"], x["found"][0]["new"]).otherwise(F.array_join(laid, ""))

    x = rows.select("doc_id", "text", F.transform("cut", found).alias("parts"))
    valid = F.coalesce(F.filter(F.flatten(F.transform("parts", lambda p: p["found"])), lambda m: m["new"].isNotNull()), F.array().cast(values))
    new = F.array_join(F.transform("parts", put), "")
    kinds = F.array_join(F.filter(F.transform(F.array(*map(F.lit, KINDS)), lambda k: F.concat_ws(":", k, F.size(F.filter("valid", lambda m: m["kind"] == k)).cast("string"))), lambda s: ~s.endswith(":0")), ",")
    x = x.select("doc_id", "text", "parts", valid.alias("valid"))
    return x.select("doc_id", F.size("valid").cast("long").alias("n_values"), kinds.alias("kinds"), F.when(F.size("valid") > 0, new).otherwise(F.col("text")).alias("text"))
