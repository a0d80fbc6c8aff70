"""Line dedup, lexical search and the Merkle manifest against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelyn.llm import lines, merkle, search
from parcelyn.llm import queries as Q

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(params=["small", "odd_dir", "empty_dir"])
def where(request):
    return SMALL if request.param == "small" else request.getfixturevalue(request.param)


def rows_of(spark, where, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{where}/documents.parquet").select(*columns).collect()]


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text)


def key(line):
    return lowered(line.strip(" \t\n\x0b\x0c\r"))


def plain_drop(rows, least, keep, min_chars=1):
    """(doc_id, n_lines, n_dropped, kept text) of (doc_id, text)."""
    held, first = Counter(), {}
    for doc_id, text in rows:
        own = {}
        for i, line in enumerate((text or "").split("\n")):
            if len(key(line)) >= min_chars:
                own.setdefault(key(line), i)
        held.update(own.keys())
        for k, i in own.items():
            at = (doc_id is None, doc_id or 0, hashlib.sha256((text or "").encode()).digest(), i)
            first[k] = min(first.get(k, at), at)
    out = Counter()
    for doc_id, text in rows:
        kept = []
        for i, line in enumerate((text or "").split("\n")):
            k = key(line)
            often = len(k) >= min_chars and held[k] >= least
            here = (doc_id is None, doc_id or 0, hashlib.sha256((text or "").encode()).digest(), i)
            if not often or (keep == "first" and first[k] == here):
                kept.append(line)
        n = len((text or "").split("\n"))
        out[doc_id, n, n - len(kept), None if text is None else "\n".join(kept)] += 1
    return out


@pytest.mark.parametrize(("least", "keep", "min_chars", "few"), [(10, "none", 1, 1 << 18), (2, "first", 1, 1 << 18), (2, "first", 3, 0), (3, "none", 1, 0)])
def test_lines(spark, where, least, keep, min_chars, few):
    docs = spark.read.parquet(f"{where}/documents.parquet")
    got = lines.drop_repeated_lines(docs, least=least, keep=keep, min_chars=min_chars, few_keys=few)
    assert [c for c in got.columns if c not in ("n_lines", "n_dropped")] == docs.columns
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == plain_drop(rows_of(spark, where, "doc_id", "text"), least, keep, min_chars)


def test_lines_full_filters_and_skew(spark):
    """Filters far too small, many builders, one text in a third of all rows, and names that the operator uses itself."""
    rng = random.Random(3)
    rows = [(i, "\n".join(f" Line {rng.randint(0, 400)} " for _ in range(rng.randint(1, 6)))) for i in range(600)]
    rows += [(1000 + i, "Same\nline 7\nSAME ") for i in range(300)]
    docs = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], "doc_id long, Text string, n_lines string, `row` string, lost string").repartition(7)
    for few in (0, 1 << 18):
        for keep in ("first", "none"):
            got = lines.drop_repeated_lines(docs, least=4, keep=keep, bits=1 << 8, few_keys=few)
            assert got.columns == [*docs.columns, "n_lines_", "n_dropped"]
            assert Counter((r.doc_id, r.n_lines_, r.n_dropped, r.Text) for r in got.collect()) == plain_drop(rows, 4, keep)


def test_two_filters_miss_nothing(spark):
    """Every key of two rows is suspected, whatever the number of builders; at the usual size few others are."""
    rng = np.random.default_rng(1)
    texts = ["\n".join(f"k{x}" for x in rng.integers(0, 60_000, 20)) for _ in range(2000)]
    held = Counter(k for t in texts for k in set(t.split("\n")))
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(9)
    bits = lines.filter_bits(frame)
    assert bits == 1 << 18
    for builders in (1, 4, 9):
        twice = lines.TwoFilters(bits)
        twice.twice = lines.seen_twice(frame, bits, builders=builders)
        keys = list(held)
        hit = twice.suspects(lines._hashes([k.encode() for k in keys]))
        assert all(h for h, k in zip(hit, keys, strict=True) if held[k] > 1)
        alone = [h for h, k in zip(hit, keys, strict=True) if held[k] == 1]
        assert sum(alone) < 0.05 * len(alone)


def plain_search(docs, items, k=50):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    counted = [(d, Counter(pattern.findall(lowered(t or "")))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = Counter()
    for item_id, text in items:
        found = []
        for d, c in counted:
            m = 50 + (50 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(pattern.findall(lowered(text or ""))) if c[t])
            if s > 0:
                found.append((-s, d is None, d or 0))
        for rank, (s, no_id, d) in enumerate(sorted(found)[:k], 1):
            out[item_id, rank, None if no_id else d, -s] += 1
    return out


def test_search(spark, where, monkeypatch):
    docs = rows_of(spark, where, "doc_id", "text")
    items = [tuple(r) for r in spark.read.parquet(f"{where}/benchmark.parquet").select("item_id", "text").collect()]
    due = plain_search(docs, items)
    assert Counter(map(tuple, Q.op12_shared_term_search(spark, where).collect())) == due
    # Small blocks, small batches, and rankings merged in two steps.
    monkeypatch.setattr(search, "ITEMS", 3 if len(items) < 10 else 15)
    monkeypatch.setattr(search, "MERGED", 2)
    monkeypatch.setattr(search, "ENTRIES", 1)
    frame = spark.read.parquet(f"{where}/documents.parquet").repartition(5)
    got = search.search(frame, spark.read.parquet(f"{where}/benchmark.parquet"), k=7)
    assert Counter(map(tuple, got.collect())) == plain_search(docs, items, 7)


def test_search_ties(spark):
    docs = [(i % 40, "same words here" if i % 3 else "other words") for i in range(400)]
    items = [(1, "words here"), (2, "same"), (3, "absent"), (4, "here same words other")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    got = search.search(frame, spark.createDataFrame(items, "item_id long, text string"), k=30)
    assert Counter(map(tuple, got.collect())) == plain_search(docs, items, 30)


def test_sharing_dag():
    rng = random.Random(4)
    topics = [rng.sample(range(300), 12) for _ in range(9)]
    items = [sorted({*rng.choice(topics), *rng.choice(topics), *rng.sample(range(300), 5)}) for _ in range(120)] + [[]]
    dag = search.sharing_dag(items)
    for own, roots in zip(items, dag.roots, strict=True):
        terms = [t for r in roots for t in dag.terms(r)]
        assert sorted(terms) == own
    assert dag.additions() < 0.7 * sum(len(x) - 1 for x in items if x)
    owner, term, value = np.array([0, 0, 1, 2]), np.array([topics[0][0], topics[0][1], topics[0][0], topics[1][0]]), np.array([5, 7, 11, 13])
    got = search.Accumulators(dag, 300).scores(3, owner, term, value)
    for row, own in zip(got, items, strict=True):
        assert row.tolist() == [sum(v for o, t, v in zip(owner, term, value, strict=True) if o == d and t in own) for d in range(3)]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def plain_proofs(nodes):
    """Root and, for each node, its siblings by level as (left, right)."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for way, i in zip(ways, at, strict=True):
            run = runs[i // 16]
            way.append((run[: i % 16], run[i % 16 + 1 :]))
        nodes, at = [h(*r) for r in runs], [i // 16 for i in at]
    return nodes[0], ways


def plain_manifest(rows):
    by_source = defaultdict(list)
    for r in rows:
        changed = plain_leaf(r, None if r[4] is None else lowered(r[4])) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else None
        by_source[r[1]].append((r[0] is not None, r[0] or 0, plain_leaf(r, r[4]), changed))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: (sorted(by_source[s], key=lambda x: x[:3]), *plain_proofs([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])])) for s in order}
    out = Counter()
    if not order:
        return out
    root, tops = plain_proofs([trees[s][1] for s in order])
    for s, top in zip(order, tops, strict=True):
        own, subroot, ways = trees[s]
        for (has_id, doc_id, leaf, changed), way in zip(own, ways, strict=True):
            way, folded = way + top, changed or leaf
            for left, right in way:
                folded = h(*left, folded, *right)
            out[doc_id if has_id else None, leaf, subroot, root, h(*(x for left, right in way for x in (*left, *right))), folded, folded == root] += 1
    return out


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def test_manifest(spark, where):
    got = Q.op13_midstate_merkle(spark, where)
    assert Counter(map(tuple, got.collect())) == plain_manifest(rows_of(spark, where, *FIELDS))


def test_manifest_of_deep_and_many_trees(spark):
    """A source of three rounds, sources of 1, 16, 17, 256 and 257 rows, and 300 of one row; repeated rows and null ids."""
    sizes = {"deep": 4500, "one": 1, "full": 16, "more": 17, None: 256, "é": 257} | {f"s{i}": 1 for i in range(300)}
    rows = [(i, s, None, i, f"Text {s} {i}") for s, n in sizes.items() for i in range(n)]
    rows += [(None, "deep", "x", None, None), (7, "deep", None, 7, "Text deep 7"), (7, "deep", None, 7, "TEXT deep 7")]
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    checked = merkle.verified(*merkle.manifest(merkle.leaves(frame, F.crc32(F.col("doc_id").cast("string")) % 5 == 0)))
    got = checked.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert Counter(map(tuple, got.collect())) == plain_manifest(rows)


def test_parents_resume_before_a_slot():
    children = [hashlib.sha256(bytes([i])).hexdigest().encode() for i in range(16)]
    p = merkle.Parent(children)
    assert p.digest.decode() == hashlib.sha256(b"".join(children)).hexdigest()
    for slot in range(16):
        assert p.fold(slot, b"x" * 64).decode() == hashlib.sha256(b"".join([*children[:slot], b"x" * 64, *children[slot + 1 :]])).hexdigest()
