"""Inverted-file index of vectors, and searches by cosine over it.

Coarse cells come from k-means on a bounded sample; every row is indexed in the cell of its nearest centroid, with its
vector rounded to one byte a component and the length of what rounding took away. A search deals its queries over groups
and sends the index past each of them, cell by cell; there a query is compared with the cells that it probes. A similarity
is then known within bounds, so a group keeps for its queries only what can still be among the k best, and what they have
found so far narrows what they probe. The pairs that are left are joined to the full vectors, and ranked. So the index is
shuffled once for every group, and neither pairs of a query and a cell nor any but near pairs are.

Two ways of probing: all cells that can hold a similarity above a threshold (by the angle to the centroid and the cell's
widest angle), which loses nothing; or the nearest few cells, whose recall is to be measured.

Rows with a null or zero vector have no similarity and are left out. Vectors of different lengths are never compared.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import matching as M
from ..storage import written

#: Most rows that centroids are fitted on, and most cells.
SAMPLE, MOST_CELLS = 16_384, 4096
#: Members and queries of one block, and candidate pairs of one at most.
BLOCK, BLOCK_PAIRS = 2048, 2**20
#: Queries of a group, and pairs that it holds at most before it hands them on.
QUERIES, HELD = 16_384, 2**22
#: Room for rounding of single-precision products.
SLACK = 1e-5
_CODED = (("dim", T.IntegerType()), ("cell", T.IntegerType()), ("angle", T.FloatType()), ("code", T.BinaryType()), ("scale", T.FloatType()), ("error", T.FloatType()), ("digest", T.BinaryType()))


def unit(rows: list) -> list[np.ndarray | None]:
    """Vectors of length one; None for null, empty and zero vectors and those with a null or infinite component."""
    out = []
    for v in rows:
        x = np.array([] if v is None or any(c is None for c in v) else v, np.float64)
        n = math.sqrt(float(x @ x)) if len(x) else 0.0
        out.append(x / n if 0 < n < math.inf else None)
    return out


def centroids(vectors: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; starts from evenly spaced rows of the sample."""
    own = vectors[np.linspace(0, len(vectors) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        nearest = np.argmax(vectors @ own.T, axis=1)
        sums = np.zeros_like(own)
        np.add.at(sums, nearest, vectors)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        own = np.where(length > 0, sums / np.maximum(length, 1e-300), own)
    return own


def fit(rows: DataFrame, vector: str = "embedding", by: str = "id", cells: int | None = None, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """Centroids by the vectors' length, from at most `sample` rows, chosen by a hash of their id."""
    found = rows.where(F.col(vector).isNotNull()).select(F.xxhash64(F.col(by).cast("string")).alias("_h"), F.col(by).cast("string").alias("_id"), vector).orderBy("_h", "_id").limit(sample)
    n = rows.count()
    by_length: dict[int, list[np.ndarray]] = {}
    for x in unit([r[vector] for r in found.collect()]):
        if x is not None:
            by_length.setdefault(len(x), []).append(x)
    out = {}
    for dim, own in sorted(by_length.items()):
        k = cells or max(1, min(MOST_CELLS, int(math.sqrt(n)), len(own) // 4))
        out[dim] = centroids(np.array(own), min(k, len(own))).astype(np.float32)
    return out


def _by_length(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and vectors of an Arrow column that have a direction, in batches of one length."""
    import pyarrow as pa

    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    for dim in np.unique(lengths[lengths > 0]).tolist():
        every = np.flatnonzero(lengths == dim)
        for low in range(0, len(every), BLOCK):
            at = every[low : low + BLOCK]
            given = flat[starts[at][:, None] + np.arange(dim)]
            with np.errstate(over="ignore", invalid="ignore"):
                length = np.sqrt((given * given).sum(axis=1))
            some = (length > 0) & (length < math.inf)
            if some.any():
                yield at[some], given[some]


def _rounded(given: np.ndarray, cells: dict[int, np.ndarray]) -> dict[str, object]:
    """The columns _CODED of vectors of one length."""
    x = given / np.sqrt((given * given).sum(axis=1, keepdims=True))
    known = cells.get(x.shape[1])
    cell, angle = np.zeros(len(x), np.int32), np.full(len(x), math.pi, np.float32)
    if known is not None:
        cell = np.argmax(x.astype(np.float32) @ known.T, axis=1).astype(np.int32)
        c = known[cell].astype(np.float64)
        angle = (np.arccos(np.clip((c * x).sum(axis=1) / np.linalg.norm(c, axis=1), -1, 1)) + SLACK).astype(np.float32)
    scale = (np.abs(x).max(axis=1) / 127).astype(np.float32)
    code = np.rint(x / scale[:, None].astype(np.float64)).astype(np.int8)
    error = (np.linalg.norm(x - code * scale[:, None].astype(np.float64), axis=1) + 1e-7).astype(np.float32)
    digest = [hashlib.sha256(v.tobytes()).digest() for v in given]
    return {"dim": np.full(len(x), x.shape[1], np.int32), "cell": cell, "angle": angle, "code": [v.tobytes() for v in code], "scale": scale, "error": error, "digest": digest}


def indexed(rows: DataFrame, cells: dict[int, np.ndarray], vector: str = "embedding") -> DataFrame:
    """rows without the vector but with its cell, angle to the centroid and rounded form; every row with a direction.

    A vector whose length the centroids don't know is in cell 0 of its length, at any angle.
    """
    kept = [f for f in rows.schema.fields if f.name != vector]
    schema = T.StructType([*kept, *(T.StructField(n, t) for n, t in _CODED)])
    shared = rows.sparkSession.sparkContext.broadcast(cells)

    def scan(batches):
        import pyarrow as pa

        types = {"dim": pa.int32(), "cell": pa.int32(), "angle": pa.float32(), "scale": pa.float32(), "error": pa.float32()}
        for batch in batches:
            for at, given in _by_length(batch.column(len(kept))):
                own = [batch.column(j).take(pa.array(at)) for j in range(len(kept))]
                yield pa.record_batch([*own, *(pa.array(v, types.get(name, pa.binary())) for name, v in _rounded(given, shared.value).items())], schema.names)

    return rows.select(*(f.name for f in kept), vector).mapInArrow(scan, schema)


def _decoded(table) -> tuple[np.ndarray, np.ndarray]:
    """Rounded vectors of one length, and their errors."""
    scale = table.column("scale").to_numpy().astype(np.float32)
    codes = np.frombuffer(b"".join(table.column("code").to_pylist()), np.int8).reshape(len(scale), -1)
    return codes * scale[:, None], table.column("error").to_numpy().astype(np.float64)


def _numbers(column, codes: dict) -> np.ndarray:
    """Values to be compared: strings as numbers by order of coming (null: -1), null numbers as NaN."""
    import pyarrow as pa

    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        d = column.dictionary_encode()
        own = np.array([*(codes.setdefault(v, len(codes)) for v in d.dictionary.to_pylist()), -1])
        return own[d.indices.fill_null(len(own) - 1).to_numpy(zero_copy_only=False)]
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


class _Group:
    """Queries of one length, and the pairs that can still be among their k best; it meets the index part by part."""

    def __init__(self, x, error, rank, side: dict, k: int, above: float | None, probes: int, later: bool, cells: np.ndarray | None, held: dict[int, float]):
        order = np.argsort(rank, kind="stable")
        self.x, self.error, self.rank, self.side = x[order], error[order], rank[order], {n: v[order] for n, v in side.items()}
        self.k, self.later, self.held = k, later, held
        self.cut = np.full(len(x), -2.0 if above is None else above)
        self.found, self.added = [], 0
        self.cells = self.near = None
        if cells is not None:
            self.cells = cells / np.maximum(np.linalg.norm(cells, axis=1, keepdims=True), 1e-30)
            self.unit = self.x / np.maximum(np.linalg.norm(self.x, axis=1), 1e-30)[:, None]
            self.slack = np.arcsin(np.minimum(1, self.error)) + 1e-3
            self.reach = np.arccos(np.clip(self.cut, -1, 1)) + self.slack
            if above is None and probes < len(held):
                own = self.cells[sorted(held)]
                self.near = np.concatenate([np.partition(self.unit[i : i + BLOCK] @ own.T, len(held) - probes, axis=1)[:, len(held) - probes] for i in range(0, len(x), BLOCK)]) - 1e-6

    def probing(self, cell: int) -> np.ndarray:
        """Which queries probe a cell."""
        if self.cells is None:
            return np.arange(len(self.x))
        dots = self.unit @ self.cells[cell]
        reached = np.arccos(np.clip(dots, -1, 1)) <= self.reach + self.held[cell]
        return np.flatnonzero(reached if self.near is None else reached & (dots >= self.near))

    def meet(self, cell: int, y, error, rank, side: dict, digest: np.ndarray, allowed: Callable, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Compare with members of one cell in order of rank; gives pairs of ranks where too many are held."""
        asked, most = self.probing(cell), float(error.max())
        rows = max(1, min(block, BLOCK_PAIRS // len(y)))
        for start in range(0, len(asked), rows):
            at = asked[start : start + rows]
            first = int(np.searchsorted(rank, self.rank[at[0]], "right")) if self.later else 0
            if first == len(y):
                continue
            whole = at[-1] - at[0] + 1 == len(at)
            shown = (self.x[at[0] : at[-1] + 1] if whole else self.x[at]) @ y[first:].T
            least = (self.cut[at] - most - self.error[at] * (1 + most) - 2 * SLACK).astype(np.float32)
            flat = np.flatnonzero(shown >= least[:, None])
            if not len(flat):
                continue
            i, j = np.divmod(flat, shown.shape[1])
            s, q, j = shown.ravel()[flat].astype(np.float64), at[i], j + first
            room = error[j] + self.error[q] * (1 + error[j]) + SLACK
            own = {n: v[q] for n, v in self.side.items()} | {"rank": self.rank[q]}
            ok = (s + room >= self.cut[q]) & (own["rank"] != rank[j])
            ok &= allowed(own, {n: v[j] for n, v in side.items()} | {"rank": rank[j]})
            if self.later:
                ok &= own["rank"] < rank[j]
            i, q, j, low, high = i[ok], q[ok], j[ok], (s - room)[ok], (s + room)[ok]
            if len(q) > 4 * self.k * len(at):
                dense = np.full((len(at), len(y)), -np.inf)
                dense[i, j] = low
                kth = np.partition(dense, len(y) - self.k, axis=1)[:, len(y) - self.k]
                ok = high >= kth[i]
                q, j, low, high = q[ok], j[ok], low[ok], high[ok]
            if len(q):
                self.found.append((q, rank[j], low, high, digest[j, 0], digest[j, 1], np.zeros(len(q), bool)))
                self.added += len(q)
            if self.added > max(65_536, self.k * len(self.x) // 2):
                yield from self.narrow()

    def narrow(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Drop pairs that can't be among the k best, and of equal vectors all but the k first by id."""
        if not self.found:
            return
        q, rank, low, high, d0, d1, sent = (np.concatenate(c) for c in zip(*self.found, strict=True))
        order = np.lexsort((-low, q))
        place = _places(q[order])
        kth = order[place == self.k - 1]
        self.cut[q[kth]] = np.maximum(self.cut[q[kth]], low[kth])
        if self.cells is not None:
            self.reach = np.arccos(np.clip(self.cut, -1, 1)) + self.slack
        keep = np.flatnonzero(high >= self.cut[q])
        many = keep[np.bincount(q[keep], minlength=len(self.x))[q[keep]] > 4 * self.k]
        if len(many):
            by = many[np.lexsort((rank[many], d1[many], d0[many], q[many]))]
            over = by[_places(q[by], d0[by], d1[by]) >= self.k]
            keep = np.setdiff1d(keep, over, assume_unique=True)
        columns = [c[keep] for c in (q, rank, low, high, d0, d1, sent)]
        if len(keep) > HELD:
            new = ~columns[-1]
            yield self.rank[columns[0][new]], columns[1][new]
            order = np.lexsort((-columns[2], columns[0]))
            best = order[_places(columns[0][order]) < self.k]
            columns = [c[best] for c in columns]
            columns[-1][:] = True
        self.found, self.added = [tuple(columns)], 0

    def rest(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield from self.narrow()
        for q, rank, *_, sent in self.found:
            yield self.rank[q[~sent]], rank[~sent]


def _places(*keys: np.ndarray) -> np.ndarray:
    """The place of each row among those with the same keys, which stand together."""
    n = len(keys[0])
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    first = np.flatnonzero(new)
    return np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))


def best(rows: DataFrame, k: int, allowed: Callable, columns: tuple[str, ...] = (), above: float | None = None, probes: int = 8, cells: dict[int, np.ndarray] | None = None, vector: str = "embedding", queries: Column | None = None, later: bool = False) -> DataFrame:
    """(a_id, b_id, similarity): each query's k most similar partners among rows (id, vector, columns), ties by b_id.

    allowed(a, b) takes dicts of numpy arrays of the columns and of `rank` (the order of ids), shaped to be compared with
    each other, and tells which pairs count; strings come as numbers (null: -1), null numbers as NaN. above: only similarities greater than it, all of them found; without it the
    `probes` nearest cells are searched. queries: which rows ask; all, if not given. later: partners have greater ids.
    """
    spark = rows.sparkSession
    given = written(rows.select("id", *columns, vector), "vectors")
    ranks = given.select("id").where("id IS NOT NULL").distinct().orderBy("id").withColumn("_rank", F.monotonically_increasing_id())
    own = written(given.join(ranks, "id"), "vectors-ranked")
    cells = fit(own, vector) if cells is None else cells
    coded = written(indexed(own, cells, vector), "vector-index")
    asks = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    held: dict[int, dict[int, float]] = {}
    asked: dict[int, int] = {}
    for r in coded.groupBy("dim", "cell").agg(F.max("angle").alias("width"), F.count_if(asks).alias("asking")).collect():
        held.setdefault(r.dim, {})[r.cell] = r.width
        asked[r.dim] = asked.get(r.dim, 0) + r.asking

    # Groups of queries: some for each core, and so many that each stays bounded.
    share, groups, total = 3 * spark.sparkContext.defaultParallelism, [], 0
    for dim, n in sorted(asked.items()):
        parts = max(-(-n // QUERIES), min(share, -(-n // 256)))
        groups.append((dim, total, parts))
        total += parts
    dealt = F.broadcast(spark.createDataFrame(groups, "dim int, first int, parts int").where("parts > 0"))
    hashed = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(5)), F.col("parts")).cast("int")
    sides = coded.where(asks).join(dealt, "dim").withColumn("group", F.col("first") + hashed).withColumn("side", F.lit(0))
    sides = sides.unionByName(coded.join(dealt, "dim").withColumn("group", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1))).withColumn("side", F.lit(1)))
    sides = sides.select("group", "side", "dim", "cell", "_rank", "code", "scale", "error", "digest", *columns)
    tasks = max(1, min(total, max(share, *(g[2] for g in groups)))) if groups else 1
    sides = sides.repartitionById(tasks, "group").sortWithinPartitions("group", "side", "cell", "_rank")
    names, shared, block = sides.columns, spark.sparkContext.broadcast((cells, held)), BLOCK

    def compare(batches):
        import pyarrow as pa

        cells, held = shared.value
        codes: dict[str, dict] = {c: {} for c in columns}
        value = lambda part, name: part.column(names.index(name)).to_numpy(zero_copy_only=False)
        side_of = lambda part: {c: _numbers(part.column(names.index(c)), codes[c]) for c in columns}
        shown = lambda pairs: (pa.record_batch([pa.array(a), pa.array(b)], ["a_rank", "b_rank"]) for a, b in pairs if len(a))
        group, asking, now = None, [], None
        for batch in batches:
            g, side, cell = (value(batch, n) for n in ("group", "side", "cell"))
            new = np.flatnonzero((np.diff(g) != 0) | (np.diff(side) != 0) | (np.diff(cell) != 0)) + 1
            for start, end in zip([0, *new.tolist()], [*new.tolist(), len(g)], strict=True):
                for low in range(start, end, block):
                    part = batch.slice(low, min(block, end - low))
                    if side[low] == 0:
                        if group is not None:
                            yield from shown(group.rest())
                            group = None
                        asking.append((*_decoded(part), value(part, "_rank"), side_of(part)))
                        continue
                    if asking:
                        x, error, rank = (np.concatenate([a[i] for a in asking]) for i in range(3))
                        dim, now = x.shape[1], g[low]
                        group = _Group(x, error, rank, {c: np.concatenate([a[3][c] for a in asking]) for c in columns}, k, above, probes, later, cells.get(dim), held[dim])
                        asking = []
                    if group is None or g[low] != now:
                        continue
                    y, error = _decoded(part)
                    digest = np.array([np.frombuffer(d, np.int64, 2) for d in part.column(names.index("digest")).to_pylist()])
                    yield from shown(group.meet(int(cell[low]), y, error, value(part, "_rank"), side_of(part), digest, allowed, block))
        if group is not None:
            yield from shown(group.rest())

    near = sides.mapInArrow(compare, "a_rank long, b_rank long")
    full = lambda s: own.select(F.col("_rank").alias(f"{s}_rank"), F.col("id").alias(f"{s}_id"), F.col(vector).alias(f"{s}v"), M.norm(F.col(vector)).alias(f"{s}n"))
    pairs = near.join(full("a"), "a_rank").join(full("b"), "b_rank")
    pairs = pairs.select("a_id", "b_id", M.cosine(F.col("av"), F.col("bv"), F.col("an"), F.col("bn")).alias("similarity"))
    pairs = pairs.where(F.col("similarity") > above) if above is not None else pairs.where("similarity IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("a_id").orderBy(F.col("similarity").desc(), "b_id"))
    return pairs.withColumn("place", place).where(F.col("place") <= k).drop("place")


def probes_needed(rows: DataFrame, cells: dict[int, np.ndarray], k: int, recall: float = 0.97, sample: int = 200, vector: str = "embedding") -> int:
    """How many cells a query has to probe so that this share of the true k nearest lies in them.

    Measured on at most `sample` queries, chosen by a hash of their id, against an exact search over all rows.
    """
    own = rows.select("id", vector)
    asked = own.where(F.col(vector).isNotNull()).select("id", vector).orderBy(F.xxhash64(F.col("id").cast("string"), F.lit(9)), F.col("id").cast("string")).limit(sample).collect()
    vectors = {r["id"]: x for r, x in zip(asked, unit([r[vector] for r in asked]), strict=True) if x is not None and len(x) in cells}
    if not vectors:
        return 1
    near = best(own, k, lambda a, b: a["rank"] != b["rank"], above=-1.0, cells=cells, vector=vector, queries=F.col("id").isin(list(vectors)))
    at = indexed(own, cells, vector).select(F.col("id").alias("b_id"), "cell")
    places = []
    for r in near.join(at, "b_id").select("a_id", "cell").collect():
        x = vectors[r.a_id]
        dots = cells[len(x)] @ x
        places.append(int((dots > dots[r.cell]).sum()) + 1)
    return int(np.quantile(places, recall, method="higher")) if places else 1
