"""Random-token spans against a plain version, planted keys by length, and time on texts with many matches."""

import math
import random
import re
import string
import time
from collections import Counter, defaultdict

import pytest

from parcelyn.llm import secret_scan as S

LETTERS = string.ascii_letters + string.digits


def p_value(token):
    """(encoding, magnitude, p) by loops over the characters."""
    body = token.rstrip("=")
    if not (re.search("[0-9]", body) and re.search("[A-Za-z]", body)):
        return None
    for name, pattern, letters in S.ALPHABETS:
        if re.search(pattern, token):
            break
    else:
        return None
    n, k = len(body), len(letters)
    kind = lambda c: "upper" if c.isupper() else "lower" if c.islower() else "digit" if c.isdigit() else "mark"

    def chi(cells, share):
        m = len(share)
        counts = Counter(cells)
        x = sum((counts[c] - n * p) ** 2 / (n * p) for c, p in share.items())
        variance = 2 * (m - 1) + (sum(1 / p for p in share.values()) - m * m - 2 * m + 2) / n
        return max((x - (m - 1)) / math.sqrt(variance), 0.0)

    classes = {c: v / k for c, v in Counter(map(kind, letters)).items()}
    z = [chi(body, {c: 1 / k for c in letters}), chi(map(kind, body), classes)]
    same, q = sum(kind(a) == kind(b) for a, b in zip(body, body[1:])), sum(p * p for p in classes.values())
    z.append((same - (n - 1) * q) / math.sqrt((n - 1) * q * (1 - q)))
    values = [letters.index(c) - (k - 1) / 2 for c in body]
    z.append(sum(a * b for a, b in zip(values, values[1:])) / ((k * k - 1) / 12) / math.sqrt(n - 1))
    s = sum(x * x for x in z)
    two, three = math.exp(-s / 2), math.erfc(math.sqrt(s / 2)) + math.sqrt(2 * s / math.pi) * math.exp(-s / 2)
    return name, math.floor(math.log2(n)), two / 4 + three / 2 + two * (1 + s / 2) / 4


def plain(texts, rate=0.05):
    """Random spans of each text: the threshold of each stratum by trying all, spans against base spans pair by pair."""
    tokens = [[(m.start(), m.end(), m[0], p_value(m[0])) for m in re.finditer(S.TOKEN, t)] for t in texts]
    strata = defaultdict(set)
    for found in tokens:
        for _, _, token, test in found:
            if test:
                strata[test[:2]].add((token, min(math.floor(test[2] * S.BINS), S.BINS - 1)))
    least = {}
    for key, distinct in strata.items():
        bins = [b for _, b in distinct]
        random_ones = 2 * (sum(b >= S.BINS // 2 for b in bins) + 0.5)
        share = lambda k: 1 - random_ones * (1 - k / S.BINS) / max(sum(b >= k for b in bins), 1e-9)
        least[key] = next((k / S.BINS for k in range(1, S.BINS // 2) if share(k) <= rate), 0.5)
    out = []
    for text, found in zip(texts, tokens, strict=True):
        base = [m.span() for m in re.finditer(S.ASSIGN, text) if len(m[2]) >= 6]
        base += [m.span() for p in (S.ACCESS, S.HEX) for m in re.finditer(p, text)]
        out.append([(a, b) for a, b, _, test in found if test and test[2] >= least[test[:2]] and not any(x < b and a < y for x, y in base)])
    return out


def random_spans(row):
    return [tuple(map(int, x.split(":")[1:])) for x in row["all"].split(",") if x.startswith("random")]


def corpus(seed=4):
    rng = random.Random(seed)
    key = lambda n, letters=LETTERS: "".join(rng.choice(letters) for _ in range(n))
    words = ["report", "Final", "v2", "user", "data", "2024", "index", "Page", "model7", "test"]
    texts = []
    for i in range(400):
        name = "_".join(rng.choice(words) for _ in range(rng.randint(4, 8))) + str(i)
        texts.append(rng.choice([
            f"see {name} and {key(rng.choice([20, 24, 32, 40, 64]))} here",
            f"id={key(32, string.hexdigits[:16])} {name}",
            f"password: {key(24)} {name}/{name}",
            f"AKIA{key(16, string.ascii_uppercase)} {key(30, string.ascii_letters + string.digits + '+/')}==",
            name,
        ]))
    return texts


def test_spans_as_by_the_plain_version(spark):
    texts = [*corpus(), "", "é" * 30 + " " + "A1" * 15]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: random_spans(r) for r in S.find_secrets(docs).collect()}
    due = plain(texts)
    assert sum(map(len, due)) > 100
    assert got == dict(enumerate(due))


@pytest.mark.parametrize(("length", "power", "most"), [(20, 0.85, 0.25), (24, 0.85, 0.1), (32, 0.9, 0.05), (40, 0.9, 0.05), (64, 0.9, 0.05)])
def test_power_and_false_discoveries(spark, length, power, most):
    """Keys of one length among as many names of the same length; the shortest names can look like keys."""
    rng = random.Random(length)
    words = "alpha beta gamma delta model index value state count total".split()
    keys, names = [], []
    for i in range(300):
        keys.append("".join(rng.choice(LETTERS) for _ in range(length)))
        names.append((str(i) + "".join(rng.choice(words).title() for _ in range(16)))[:length])
    docs = spark.createDataFrame([(i, f"a {t} b") for i, t in enumerate(keys + names)], "doc_id long, text string")
    got = {r.doc_id: len(random_spans(r)) for r in S.find_secrets(docs).collect()}
    hit, wrong = sum(got[i] for i in range(300)), sum(got[i] for i in range(300, 600))
    print(f"length {length}: power {hit / 300:.3f}, false discoveries {wrong / max(hit + wrong, 1):.3f}")
    assert hit >= power * 300 and wrong <= most * (hit + wrong)


def test_a_key_in_many_documents_is_found_in_all(spark):
    key = next(k for s in range(99) if p_value(k := "".join(random.Random(s).choices(LETTERS, k=32)))[2] > 0.3)
    docs = spark.createDataFrame([(i, f"line {i} {key} end") for i in range(10)], "doc_id long, text string")
    assert all(len(random_spans(r)) == 1 for r in S.find_secrets(docs).collect())
    assert all(r.text == f"line {r.doc_id} [SECRET] end" for r in S.redact(docs).collect())


def test_time_is_linear_in_the_matches(spark):
    rng = random.Random(1)
    took = {}
    for n in (5_000, 5_000, 20_000):
        text = " ".join("".join(rng.choice("0123456789abcdef") for _ in range(24)) for _ in range(n))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.perf_counter()
        found = docs.select(S.scan(docs.text, {("hex", 4): 0.005}).alias("s")).selectExpr("size(s) AS n").first().n
        took[n] = time.perf_counter() - began
        assert found == n
        assert S.redact(docs).first().text == " ".join(["[SECRET]"] * n)
    assert took[20_000] < 6 * took[5_000] + 2


def test_parts_cut_from_blocks(spark):
    """Texts longer than a block, with matches across its border and characters outside the basic plane."""
    rng = random.Random(2)
    texts = []
    for n in (S.STRETCH - 10, S.STRETCH - 1, S.STRETCH, 3 * S.STRETCH + 5):
        texts.append("😀é\n" * (n // 3) + " password=abcdefgh " + "deadbeef" * 3 + "".join(rng.choice("\n xyz") for _ in range(2000)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in S.redact(docs).collect()}
    assert got == {i: t.replace("password=abcdefgh", "[SECRET]").replace("deadbeef" * 3, "[SECRET]") for i, t in enumerate(texts)}
