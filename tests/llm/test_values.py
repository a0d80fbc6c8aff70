"""Secrets after '=' and cards beside other numbers."""

import random
import string

from parcelyn.llm import pseudonyms, secret_scan


def test_secrets_after_equals_signs(spark):
    rng = random.Random(8)
    draw = lambda n: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n))
    layouts = ("AWS_SECRET_ACCESS_KEY={}", "see https://x.example/a?sig={}&v=1", "auth={}", "AWS_SECRET_ACCESS_KEY={}==", "k=={} x")
    rows = []
    for i in range(200):
        value = draw(36) if i else "wJalrXUtnFEMIK7MDENGbPxRfiCYzT3mPq9L"
        rows.append((i, layouts[i % len(layouts)].format(value), value))
    docs = spark.createDataFrame(rows, "doc_id long, text string, value string")
    got = {r.doc_id: r.all for r in secret_scan.find_secrets(docs.select("doc_id", "text")).collect()}
    hit = 0
    for i, text, value in rows:
        at = text.index(value)
        hit += f"random:{at}:{at + len(value) + (2 if text.endswith('==') else 0)}" in got[i].split(",")
    assert hit >= 0.9 * len(rows)
    kept = sum(r.value in r.text for r in secret_scan.redact(docs).collect())
    assert kept == len(rows) - hit


def test_token_pattern():
    import re

    found = lambda t: [m[0] for m in re.finditer(secret_scan.TOKEN, t)]
    assert found("a" * 19) == [] and found("a" * 20) == ["a" * 20]
    assert found("a" * 18 + "==") == ["a" * 18 + "=="] and found("a" * 17 + "==") == []
    assert found("N" * 21 + "=" + "b" * 20 + "= x") == ["N" * 21, "b" * 20 + "="]
    assert found("=" + "b" * 20) == ["b" * 20] and found("N" * 15 + "=====b") == []


def test_cards_beside_numbers(spark):
    card, other = "4111 1111 1111 1111", "5500-0000-0000-0004"
    texts = [
        f"{card} 12/27", f"{card.replace(' ', '-')} 123", f"No. 7 {card}", f"{card} 12 2027 x", f"123 456 789 {card}.", f"{card} {other}",
        f"pay {card} 212-555-0123 now", f"{card} 12/27/2027", f"{card} 079-05-1120", "4111 1111 1111 1112 12/27", "1234 212-555-0123", card, "DE89 3704 0044 0532 0130 00",
    ]
    kinds = ["card:1"] * 5 + ["card:2", "phone:1,card:1", "date:1,card:1", "ssn:1,card:1", "", "phone:1", "card:1", "iban:1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = pseudonyms.pseudonymise(docs, "k").orderBy("doc_id").collect()
    assert [r.kinds for r in got] == kinds
    new = got[11].text
    assert new != card and new[0] == "4"
    for r, text in zip(got, texts, strict=True):
        assert len(r.text) == len(text)
        assert card not in r.text and card.replace(" ", "-") not in r.text and other not in r.text
    for i in (0, 2, 3, 4):
        assert got[i].text == texts[i].replace(card, new)
    assert got[1].text == texts[1].replace(card.replace(" ", "-"), new.replace(" ", "-"))
    assert got[9].text == texts[9]
