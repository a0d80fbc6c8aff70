"""Pseudonyms of each kind against a plain version, permutations over whole sets, and odd tables."""

import datetime
import hmac
import random
import re

from pyspark.sql import functions as F

from parcelyn.llm import pseudonyms as P
from parcelyn.llm import queries as Q

KEY = "a key"


def feistel(what, left, right, a, b):
    f = lambda i, x: int(hmac.digest(KEY.encode(), f"{what}:{i}:{x}".encode(), "sha256").hex()[:15], 16)
    for i in range(2 * P.ROUNDS):
        if i % 2 == 0:
            left = (left + f(i, right)) % a
        else:
            right = (right + f(i, left)) % b
    return left, right


def digits(what, d):
    u = len(d) // 2
    v = len(d) - u
    left, right = feistel(f"{what}{len(d)}", int(d[:u]), int(d[u:]), 10**u, 10**v)
    return f"{left:0{u}}{right:0{v}}"


def relaid(layout, chars, keep):
    it = iter(chars)
    return re.sub(keep, lambda _: next(it), layout)


def luhn_digit(payload):
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(payload)))
    return str(-total % 10)


def card(v):
    d = re.sub(r"\D", "", v)
    payload = d[0] + digits("card", d[1:-1])
    return relaid(v, payload + luhn_digit(payload), r"\d")


def phone(v):
    d = re.sub(r"\D", "", v)
    a, b = feistel("phone", int(d[-10:-7]) - 200, int(d[-7:]) - 2_000_000, 800, 8_000_000)
    return relaid(v, d[:-10] + f"{a + 200}{b + 2_000_000}", r"\d")


def abroad(v):
    d = re.sub(r"\D", "", v)
    return relaid(v, d[:2] + digits("abroad", d[2:]), r"\d")


def ssn(v):
    areas = [x for x in range(1, 900) if x != 666]
    area, group, serial = map(int, v.split("-"))
    a, r = feistel("ssn", areas.index(area), (group - 1) * 9999 + serial - 1, 898, 99 * 9999)
    return f"{areas[a]:03}-{r // 9999 + 1:02}-{r % 9999 + 1:04}"


def ip(v):
    n = list(map(int, v.split(".")))
    a, b = feistel("ip", n[0] * 256 + n[1], n[2] * 256 + n[3], 65536, 65536)
    return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"


def iban(v):
    t = v.replace(" ", "")
    account = relaid(t[4:], digits("iban", re.sub(r"\D", "", t[4:])), r"\d")
    rest = int("".join(str(int(c, 36)) for c in account + t[:2] + "00")) % 97
    return relaid(v, f"{t[:2]}{98 - rest:02}{account}", r"[A-Z0-9]")


def email(v):
    name, host = v.split("@")
    plain, out = re.sub(r"[^A-Za-z0-9]", "", name).lower(), ""
    alphabet = "0123456789abcdefghijklmnopqrstuvwxyz"

    def written(x, n):
        return "".join(alphabet[x // 36**k % 36] for k in range(n - 1, -1, -1))

    for at in range(0, len(plain), 18):
        part = plain[at : at + 18]
        u = len(part) // 2
        w = len(part) - u
        a, b = feistel(f"email{len(part)}", int(part[:u] or "0", 36), int(part[u:], 36), 36**u, 36**w)
        out += written(a, u) + written(b, w)
    return relaid(name, out, r"[A-Za-z0-9]") + "@" + host


def date_classes():
    """All dates in order, by class."""
    out, day = {}, datetime.date(1800, 1, 1)
    while day.year < 2200:
        if (day.month, day.day) == (2, 29):
            name = "date leap"
        else:
            name = f"date {int(day.month >= 10)} {0 if day.day < 10 else 1 if day.day <= 12 else 2}"
        out.setdefault(name, []).append(day)
        day += datetime.timedelta(1)
    return out


CLASSES = date_classes()
PLACE = {day: (name, i) for name, days in CLASSES.items() for i, day in enumerate(days)}


def date(v):
    p = re.split(r"[./-]", v)
    iso = "-" in v
    order = "ymd" if iso else "mdy" if int(p[1]) > 12 else "dmy"
    part = dict(zip(order, map(int, p), strict=True))
    name, i = PLACE[datetime.date(part["y"], part["m"], part["d"])]
    a, b = (1, P.LEAP_DAYS) if name == "date leap" else P.DATE_HALVES[tuple(map(int, name.split()[1:]))]
    left, right = feistel(name, i // b, i % b, a, b)
    new = CLASSES[name][left * b + right]
    own = {"y": new.year, "m": new.month, "d": new.day}
    return relaid(v, "".join(f"{own[k]:0{len(x)}}" for k, x in zip(order, p, strict=True)), r"\d")


def samples():
    rng = random.Random(9)
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    out = []
    for i in range(40):
        payload = rng.choice("3456") + n(14)
        c = payload + luhn_digit(payload)
        out.append((card, rng.choice([c, "-".join(re.findall("....", c)), " ".join(re.findall("....", c))])))
        out.append((phone, f"{rng.choice(['', '+1 ', '1-'])}({rng.randint(200, 999)}) {rng.randint(200, 999)}-{n(4)}"))
        out.append((abroad, f"+{rng.choice(['44', '49', '351'])} {n(3)} {n(3)} {n(3)}"))
        out.append((ssn, f"{rng.choice([1, 65, 665, 667, 899]):03}-{rng.randint(1, 99):02}-{rng.randint(1, 9999):04}"))
        out.append((ip, ".".join(str(rng.randint(0, 255)) for _ in range(4))))
        account = "".join(rng.choice(["WEST", "ABNA", "DEUT"])) + n(14)
        rest = 98 - int("".join(str(int(x, 36)) for x in account + "GB00")) % 97
        out.append((iban, f"GB{rest:02}{account}" if i % 2 else " ".join(re.findall(".{1,4}", f"GB{rest:02}{account}"))))
        out.append((email, f"{rng.choice(['Jo.Doe', 'a', 'x_y-z9', 'averyveryverylongname.with.parts'])}{n(rng.randint(0, 3))}@mail.example.org"))
        day = datetime.date(1800, 1, 1) + datetime.timedelta(rng.randrange(146_097))
        y, m, d = day.year, day.month, day.day
        shapes = [f"{y}-{m:02}-{d:02}", f"{d}.{m}.{y}", f"{d:02}/{m:02}/{y}", f"{d}/{m}/{y}"] + [f"{m}/{d}/{y}"] * (d > 12)
        out.append((date, rng.choice(shapes)))
    return [*out, (date, "29.2.2024"), (date, "02/29/1804"), (date, "1896-02-29"), (date, "1/2/2020"), (date, "31/12/2199")]


def test_each_kind_as_by_the_plain_version(spark):
    rows = samples()
    docs = spark.createDataFrame([(i, f"see {v} now", f.__name__) for i, (f, v) in enumerate(rows)], "doc_id long, text string, kind string")
    for r in P.pseudonymise(docs, KEY).collect():
        f, v = rows[r.doc_id]
        assert (r.kinds, r.text) == (f"{f.__name__}:1", f"see {f(v)} now"), v


def test_permutations_of_whole_sets(spark):
    key = P.key_table(spark, KEY)
    four = spark.range(10_000).join(F.broadcast(key)).select(P.permute_digits(F.col("key"), "x", F.lpad(F.col("id").cast("string"), 4, "0")).alias("p"))
    assert four.distinct().count() == 10_000 and four.where("length(p) <> 4").isEmpty()


def test_all_dates_keep_their_reading(spark):
    """Every date of 400 years in three layouts: a permutation, the same for all layouts, in the same widths."""
    days = spark.range(146_097).select(F.col("id").alias("doc_id"), F.date_add(F.lit("1800-01-01").cast("date"), F.col("id").cast("int")).alias("day"))
    late = F.when(F.dayofmonth("day") > 12, F.date_format("day", "M/d/yyyy")).otherwise(F.date_format("day", "d/M/yyyy"))
    docs = days.select("doc_id", F.concat_ws(" and ", F.date_format("day", "yyyy-MM-dd"), F.date_format("day", "dd.MM.yyyy"), late).alias("text"))
    joined = P.pseudonymise(docs, KEY).select("doc_id", F.col("text").alias("new")).join(docs, "doc_id").collect()
    seen = set()
    for r in joined:
        iso, dotted, slashed = r.new.split(" and ")
        assert list(map(len, (iso, dotted, slashed))) == list(map(len, r.text.split(" and ")))
        y, m, d = map(int, iso.split("-"))
        seen.add(datetime.date(y, m, d))
        a, b, c = map(int, slashed.split("/"))
        assert dotted == f"{d:02}.{m:02}.{y}" and ((a, b, c) == (m, d, y) if b > 12 else (b, a, c) == (m, d, y))
    assert len(seen) == len(joined) == 146_097


def test_odd_rows(spark, odd_dir):
    """Nulls, empty and very long texts, repeated rows: every row stays, texts without values as they are."""
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    got = sorted(map(repr, Q.op2_feistel_pseudonyms(spark, odd_dir).select("doc_id", "text").collect()))
    assert got == sorted(map(repr, docs.select("doc_id", "text").collect()))


def test_the_key_is_in_no_plan(spark):
    docs = spark.createDataFrame([(1, "at 10.1.2.3")], "doc_id long, text string")
    plan = P.pseudonymise(docs, "very-secret-key")._jdf.queryExecution().toString()
    assert "very-secret-key" not in plan and P.hmac_pads("very-secret-key")[0].hex()[:20] not in plan.lower()


def test_long_runs_of_digits(spark):
    """100,000 digits with and without blanks, ten times as many as in the first rows, in about ten times their time."""
    import time

    def texts(n):
        rng = random.Random(n)
        d = "".join(rng.choice("0123456789") for _ in range(n))
        quads = " ".join(d[i : i + 4] for i in range(0, n, 4))
        lines = "\n".join(d[i : i + 20] for i in range(0, n, 20))
        return [f"Pi is {d} so.", " ".join(d), "-".join(d), quads, lines, d + "x", "1  2- " * (n // 6), ("4111 1111 1111 1111 " * (n // 16)).strip()]

    took = {}
    for n in (1_000, 10_000, 100_000):
        began = time.time()
        frame = spark.createDataFrame(list(enumerate(texts(n))), "doc_id long, text string").repartition(4)
        got = {r.doc_id: r for r in P.pseudonymise(frame, KEY).collect()}
        took[n] = time.time() - began
        assert got[0].n_values == 0 and got[5].n_values == 0 and got[6].n_values == 0
        assert got[7].n_values == n // 16 and got[7].text == " ".join([card("4111 1111 1111 1111")] * (n // 16))
        assert all(len(got[i].text) == len(t) for i, t in enumerate(texts(n)))
    assert took[100_000] < 25 * took[10_000] + 20, took


def test_runs_parted_by_more_than_one(spark):
    good = "4111 1111 1111 1111"
    rows = [f"{good}  12/27", f"12  {good}", f"{good}--{good}", good.replace(" ", "  "), "4111 1111  1111 1111"]
    got = {r.doc_id: r.text for r in P.pseudonymise(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), KEY).collect()}
    assert [got[i] for i in range(5)] == [f"{card(good)}  12/27", f"12  {card(good)}", f"{card(good)}--{card(good)}", rows[3], rows[4]]
