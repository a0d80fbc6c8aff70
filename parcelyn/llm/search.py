"""Ranked lexical search of many queries at once by shared partial sums.

A document's score for an item is a sum over the item's terms, so items that share terms share partial sums. From the
items a sharing DAG is mined: terms that the same items hold form one node; then the pair of nodes that most items still
hold becomes a node itself, in place of the two, for as long as a pair is shared. Each node is one accumulator of
document scores. Accumulators are filled once for a batch of documents, from terms to pairs to items.

The documents are read and cut into terms once for each block of ITEMS items: a task keeps its documents' counts of the
block's terms in a compact table, and sums up how many documents hold each term. Over that table, with the weights known,
each task fills the accumulators and keeps its best documents of each item; the best of these are chosen in two steps, so
that no task gets the rows of all tasks.

Defined results: null and termless documents have no terms, count for nothing and are never found; an item without terms
finds nothing; rows that repeat an item_id are items of their own; rows that repeat a doc_id are ranked each; a null
doc_id comes after all others of its score; without documents or items the result is empty; other columns aren't read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, written

#: Fixed value: a term is a longest run of ASCII letters and digits and of characters from U+0080 on; A-Z are lower-cased.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
#: Items of a block, entries of accumulators that are filled at once, and partial rankings that are merged in one task.
ITEMS, ENTRIES, MERGED = 1024, 1 << 22, 256


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


@dataclass(frozen=True)
class SharingDag:
    """Node k < len(members) sums the terms members[k]; later ones sum the pair of nodes pairs[k - len(members)].

    roots has the nodes whose sums make up each item; no term is in two of an item's nodes.
    """

    members: list[list[int]]
    pairs: list[tuple[int, int]]
    roots: list[list[int]]

    def terms(self, node: int) -> list[int]:
        if node < len(self.members):
            return self.members[node]
        return [t for part in self.pairs[node - len(self.members)] for t in self.terms(part)]

    def additions(self) -> int:
        """Additions of accumulators for a document, against one for each term of each item without sharing."""
        return sum(len(m) - 1 for m in self.members) + len(self.pairs) + sum(max(0, len(r) - 1) for r in self.roots)


def sharing_dag(items: list[list[int]]) -> SharingDag:
    """Mine shared sets of terms (numbers, once each in an item)."""
    holders = defaultdict(list)
    for i, own in enumerate(items):
        for t in own:
            holders[t].append(i)
    classes = defaultdict(list)
    for t, held in sorted(holders.items()):
        classes[tuple(held)].append(t)
    members = list(classes.values())
    at = {k: set(held) for k, held in enumerate(classes)}
    own = [set() for _ in items]
    for k, held in at.items():
        for i in held:
            own[i].add(k)
    shared = Counter()
    for parts in own:
        live = sorted(k for k in parts if len(at[k]) > 1)
        shared.update((a, b) for n, a in enumerate(live) for b in live[n + 1 :])
    heap = [(-n, a, b) for (a, b), n in shared.items() if n > 1]
    heapq.heapify(heap)
    pairs: list[tuple[int, int]] = []
    while heap:
        n, a, b = heapq.heappop(heap)
        both = at[a] & at[b]
        if len(both) < 2:
            continue
        if len(both) < -n:
            heapq.heappush(heap, (-len(both), a, b))
            continue
        new = len(members) + len(pairs)
        pairs.append((a, b))
        at[new] = both
        at[a] -= both
        at[b] -= both
        beside = Counter()
        for i in both:
            own[i] -= {a, b}
            beside.update(k for k in own[i] if len(at[k]) > 1)
            own[i].add(new)
        for k, held in beside.items():
            if held > 1:
                heapq.heappush(heap, (-held, k, new))
    return SharingDag(members, pairs, [sorted(x) for x in own])


class Accumulators:
    """Fills the DAG's accumulators for a batch of documents."""

    def __init__(self, dag: SharingDag, terms: int):
        self.dag, self.node = dag, np.zeros(terms, np.int64)
        for k, own in enumerate(dag.members):
            self.node[own] = k

    def scores(self, docs: int, owner: np.ndarray, term: np.ndarray, value: np.ndarray) -> np.ndarray:
        """items x docs, of the values of (document, term)."""
        first, d = len(self.dag.members), self.dag
        sums = np.zeros((first + len(d.pairs), docs), np.int64)
        np.add.at(sums.reshape(-1), self.node[term] * docs + owner, value)
        for k, (a, b) in enumerate(d.pairs, first):
            np.add(sums[a], sums[b], out=sums[k])
        return np.stack([sums[own].sum(axis=0) if own else np.zeros(docs, np.int64) for own in d.roots])


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _counted(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts) of documents with terms: numbers of the given terms and their occurrences, packed."""
    shared = docs.sparkSession.sparkContext.broadcast(numbers)

    def scan(batches):
        import pyarrow as pa

        for batch in batches:
            known, keep, n, terms, counts = shared.value, [], [], [], []
            for i, text in enumerate(batch.column(1).cast(pa.large_binary()).to_pylist()):
                words = terms_of(text) if text else ()
                if not words:
                    continue
                found = Counter(filter(known.__contains__, words))
                keep.append(i)
                n.append(len(words))
                terms.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)).tobytes())
                counts.append(np.fromiter(found.values(), np.int32, len(found)).tobytes())
            yield pa.record_batch([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "n", "terms", "counts"])

    return docs.mapInArrow(scan, "doc_id long, n long, terms binary, counts binary")


def _holding(counted: DataFrame, terms: int) -> tuple[int, int, list[int]]:
    """N, L and the number of documents that hold each term."""

    def tally(batches):
        import pyarrow as pa

        held, docs, total = np.zeros(terms, np.int64), 0, 0
        for batch in batches:
            docs, total = docs + batch.num_rows, total + int(np.sum(batch.column(0).to_numpy()))
            at = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int32)
            held += np.bincount(at, minlength=terms)
        some = np.flatnonzero(held)
        yield pa.record_batch([pa.array(np.concatenate([[-2, -1], some]).astype(np.int32)), pa.array(np.concatenate([[docs, total], held[some]]).astype(np.int64))], ["term", "docs"])

    got = {r.term: r.docs for r in counted.select("n", "terms").mapInArrow(tally, "term int, docs long").groupBy("term").agg(F.sum("docs").alias("docs")).collect()}
    return got.get(-2, 0), got.get(-1, 0), [got.get(t, 0) for t in range(terms)]


def _ranked(counted: DataFrame, dag: SharingDag, weights: np.ndarray, N: int, L: int, k: int) -> DataFrame:
    """(item, part, doc_id, score): each task's k best documents of each item; part numbers tasks."""
    shared = counted.sparkSession.sparkContext.broadcast((dag, weights))

    def scan(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        dag, weights = shared.value
        fill, items = Accumulators(dag, len(weights)), len(dag.roots)
        step = max(16, min(1024, ENTRIES // (len(dag.members) + len(dag.pairs))))
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in range(items)]
        for batch in batches:
            for low in range(0, batch.num_rows, step):
                part = batch.slice(low, step)
                doc = part.column(0)
                no_id = doc.is_null().to_numpy(zero_copy_only=False)
                doc_id, n = doc.fill_null(0).to_numpy(), part.column(1).to_numpy()
                terms = part.column(2).to_pylist()
                owner = np.repeat(np.arange(len(n)), [len(t) >> 2 for t in terms])
                term = np.frombuffer(b"".join(terms), np.int32)
                tf = np.frombuffer(b"".join(part.column(3).to_pylist()), np.int32).astype(np.int64)
                m = 50 + (50 * n * N) // L
                value = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[owner]))
                for i, row in enumerate(fill.scores(len(n), owner, term, value)):
                    held, ids, without = best[i]
                    hit = np.flatnonzero(row > (held[-1] - 1 if len(held) == k else 0))
                    if not len(hit):
                        continue
                    held, ids, without = np.concatenate([held, row[hit]]), np.concatenate([ids, doc_id[hit]]), np.concatenate([without, no_id[hit]])
                    # lexsort by score, null ids last, id.
                    order = np.lexsort((ids, without, -held))[:k]
                    best[i] = held[order], ids[order], without[order]
        sizes = [len(b[0]) for b in best]
        task = TaskContext.get().partitionId()
        columns = [
            pa.array(np.repeat(np.arange(items), sizes).astype(np.int32)),
            pa.array(np.full(sum(sizes), task, np.int32)),
            pa.array(np.concatenate([b[1] for b in best]), mask=np.concatenate([b[2] for b in best])),
            pa.array(np.concatenate([b[0] for b in best])),
        ]
        yield pa.record_batch(columns, ["item", "part", "doc_id", "score"])

    return counted.mapInArrow(scan, "item int, part int, doc_id long, score long")


def _top(rows: DataFrame, by: list, k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(items: DataFrame) -> Iterator[list]:
    """Items in blocks of ITEMS, whose rows alone reach the driver."""
    rows = written(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")), "items")
    rows = rows.orderBy(F.col("item_id").asc_nulls_last(), "text")
    at = 0
    while block := rows.offset(at).limit(ITEMS).collect():
        yield block
        at += ITEMS


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item, by descending score, then doc_id."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in _blocks(items):
        numbers: dict[bytes, int] = {}
        sets = [sorted({numbers.setdefault(t, len(numbers)) for t in terms_of((r.text or "").encode("utf-8", "surrogatepass"))}) for r in block]
        if not numbers:
            continue
        counted = written(_counted(rows, numbers), "counted-terms")
        N, L, held = _holding(counted, len(numbers))
        if not L:
            break
        weights = np.array([weight(N, n) for n in held], np.int64)
        best = _ranked(counted, sharing_dag(sets), weights, N, L, k)
        best = _top(best, ["item", F.expr(f"part div {MERGED}")], k).drop("rank")
        ids = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(block)], "item int, item_id long")
        found = _top(best, ["item"], k).join(F.broadcast(ids), "item")
        out = out.union(found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return out
