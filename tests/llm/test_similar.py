"""Near-duplicates of the pipeline against all pairs by brute force."""

import itertools
import random
from collections import Counter

import pytest

import corpus_pipeline as P
from parcelyn.llm import simhash, similar
from parcelyn.operators import graph


def texts() -> list[str]:
    """Texts of 80 words and copies of them with 1 to 8 words changed; a large group of copies of one text."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    out = []
    for k in range(60):
        base = [rng.choice(words) for _ in range(80)]
        out.append(" ".join(base))
        for _ in range(40 if k == 0 else 2):
            copy = list(base)
            for at in rng.sample(range(80), rng.randint(1, 4 if k else 8)):
                copy[at] = rng.choice(words)
            out.append(" ".join(copy))
    return [*out, "", " \n", "One two", "one  two", "one two three"]


def shingled(text: str) -> set[tuple[str, ...]]:
    words = text.lower().split()
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def brute(found: list[str]) -> tuple[list[int], set[tuple[int, int]]]:
    sets, root, linked = [shingled(t) for t in found], list(range(len(found))), set()
    for a in range(len(found)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                linked.add((b, a))
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return root, linked


@pytest.mark.parametrize("chunk", [similar.CHUNK, 7])
def test_components(spark, chunk):
    found = texts()
    root, linked = brute(found)
    fps = [simhash.fingerprint(t) for t in found]
    # Most pairs above the bar are further apart than op8's fingerprints link.
    assert sum((fps[a] ^ fps[b]).bit_count() > simhash.DISTANCE for a, b in linked) > len(linked) / 2
    docs = spark.createDataFrame(list(enumerate(found)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in similar.similar_documents(docs, chunk).collect()}
    assert got == dict(enumerate(root))


def test_stage_keeps_what_is_below_the_bar(spark):
    found = texts()
    root, _ = brute(found)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(found)], "doc_id long, text string")
    assert sorted(r.doc_id for r in P.near_duplicates(spark, docs, "").collect()) == sorted(set(root))


def test_recall_on_the_data(spark):
    """All pairs of distinct texts of sf0.01 by brute force over their shared shingles: every one is in one component."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {r.doc_id: similar.shingles(r.text) for r in rows.collect()}
    holders = {}
    for d, x in sets.items():
        for h in x.tolist():
            holders.setdefault(h, []).append(d)
    shared = Counter(p for ds in holders.values() if len(ds) < 400 for p in itertools.combinations(sorted(ds), 2))
    pairs = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    got = {r.doc_id: r.component_id for r in similar.similar_documents(rows).collect()}
    caught = sum(got[a] == got[b] for a, b in pairs)
    print(f"{caught} of {len(pairs)} pairs")
    assert len(pairs) > 20 and caught >= 0.99 * len(pairs)
    for d, c in got.items():
        assert c <= d


def test_hot_keys_are_spread(spark):
    """Components and joins of a hub with far more edges than a task takes."""
    edges = spark.range(1, 3000).selectExpr("0L AS a", "id AS b").union(spark.range(5000, 5400).selectExpr("id AS a", "id + 1 AS b"))
    got = {r.node: r.root for r in graph.components(edges, most=100).collect()}
    assert got == {i: 0 for i in range(3000)} | {i: 5000 for i in range(5000, 5401)}
