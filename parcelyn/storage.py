"""Intermediate tables in the folder that driver and executors share, and upserts by rewriting."""

from __future__ import annotations

import json
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

class _Written(threading.local):
    """Paths that a thread has written. Runs in several threads of one driver never see each other's."""

    def __init__(self):
        self.paths: list[str] = []


_own = _Written()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where all is one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="parcelyn-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    _own.paths.append(path)
    return path


def written(df: DataFrame, what: str, compression: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def n_written() -> int:
    """How many tables of written() this thread has now; the last is the latest."""
    return len(_own.paths)


def release(spark: SparkSession, first: int = 0, keep_last: bool = False) -> None:
    """Delete the tables that written() made in this thread from number `first` on, perhaps but for the latest.

    Frames over deleted tables can't be read any more.
    """
    paths = _own.paths
    kept = paths[first:][-1:] if keep_last else []
    for path in paths[first : len(paths) - len(kept)]:
        remove(spark, path)
    paths[first:] = kept


def _files(spark: SparkSession, path: str):
    """(file system, Path class) of Hadoop for a path."""
    kind = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return kind(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), kind


def _moved(spark: SparkSession, source: str, target: str) -> None:
    files, kind = _files(spark, target)
    if not files.rename(kind(source), kind(target)):
        raise OSError(f"{source} could not be moved to {target}")


def mended(spark: SparkSession, path: str) -> None:
    """Put back the table at `path` where a replacement was cut off between its two moves."""
    files, kind = _files(spark, path)
    if files.exists(kind(path)):
        return
    beside = files.globStatus(kind(f"{path}.old-*"))
    if beside is not None and len(beside):
        latest = max(beside, key=lambda f: f.getModificationTime())
        _moved(spark, latest.getPath().toString(), path)


def replace_table(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Replace the Parquet table at `path` by rows, which may be made from it: write beside it, then two moves.

    If the second move fails the old table is put back; mended() does that after a driver was lost between them. Tables
    that must change together, or without any moment between, are the business of Tables.
    """
    files, kind = _files(spark, path)
    new, old = (f"{path}.{k}-{uuid.uuid4().hex}" for k in ("new", "old"))
    rows.write.parquet(new)
    had = files.exists(kind(path))
    if had:
        _moved(spark, path, old)
    try:
        _moved(spark, new, path)
    except Exception:
        if had:
            _moved(spark, old, path)
        raise
    if had:
        files.delete(kind(old), True)


class Tables:
    """Keyed tables under one folder, rewritten where a change touches them and switched together.

    A table is dealt over buckets by a hash of its keys, each a folder of Parquet files. The file `current` names the
    folders that are in force for all tables; changes write new folders beside them and then move one new `current` into
    place. A failure before that move leaves every table as it was, and a reader that has begun keeps its old folders.
    One writer at a time changes the tables of a folder.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _state(self) -> dict:
        files, kind = _files(self.spark, self.folder)
        found = sorted(f.getPath().getName() for f in files.globStatus(kind(f"{self.folder}/current-*")) or [])
        if not found:
            return {"version": 0, "tables": {}}
        return json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.folder}/{found[-1]}").collect()))

    def _switch(self, state: dict, tables: dict) -> None:
        """The next state's file appears by one move; its number decides, so it is in force from then on."""
        files, kind = _files(self.spark, self.folder)
        new = {"version": state["version"] + 1, "tables": state["tables"] | tables}
        draft = f"{self.folder}/draft-{uuid.uuid4().hex}"
        out = files.create(kind(draft))
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        target = f"{self.folder}/current-{new['version']:012d}"
        if files.exists(kind(target)):
            raise OSError(f"version {new['version']} exists: another writer was faster")
        _moved(self.spark, draft, target)

    def create(self, name: str, rows: DataFrame, keys: list[str], buckets: int = 64) -> None:
        table = {"keys": keys, "buckets": buckets, "schema": rows.schema.json(), "paths": {}}
        self._switch(self._state(), {name: table | {"paths": self._laid(name, rows, table)}})

    def create_log(self, name: str, rows: DataFrame) -> None:
        """An empty table of these rows' columns without keys, to which change() appends pieces that staged() has written."""
        self._switch(self._state(), {name: {"keys": [], "buckets": 0, "schema": rows.schema.json(), "paths": {}}})

    def staged(self, name: str, rows: DataFrame) -> str:
        """Write rows as a piece of a log, as they are dealt; its folder, which counts once change() has appended it."""
        path = f"{self.folder}/{name}/{uuid.uuid4().hex}/_bucket=piece"
        rows.write.option("compression", "zstd").parquet(path)
        return path

    def is_empty(self, name: str) -> bool:
        """Whether no folder of the table is in force."""
        return not self._state()["tables"][name]["paths"]

    def _bucket(self, table: dict):
        return F.pmod(F.xxhash64(*(F.col(k).cast("string") for k in table["keys"])), F.lit(table["buckets"])).cast("int")

    def _laid(self, name: str, rows: DataFrame, table: dict) -> dict[str, str]:
        """Write rows by bucket; the new folder of each bucket that has rows."""
        path = f"{self.folder}/{name}/{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self._bucket(table)).repartition("_bucket").write.partitionBy("_bucket").parquet(path)
        files, kind = _files(self.spark, path)
        return {f.getPath().getName().split("=")[1]: f"{path}/{f.getPath().getName()}" for f in files.listStatus(kind(path)) if f.isDirectory() and f.getPath().getName().startswith("_bucket=")}

    def _read(self, table: dict, buckets: list[str] | None = None) -> DataFrame:
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(json.loads(table["schema"]))
        paths = [p for b, p in sorted(table["paths"].items()) if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, name: str) -> DataFrame:
        return self._read(self._state()["tables"][name])

    def names(self) -> list[str]:
        return sorted(self._state()["tables"])

    def change(self, upserts: dict[str, DataFrame] | None = None, deletes: dict[str, DataFrame] | None = None, protected: tuple[str, ...] = (), appended: dict[str, str] | None = None) -> dict[str, int]:
        """Merge rows into tables by upsert() and take rows with given keys out, all at once; buckets rewritten by table.

        Only buckets with a changed key are read and written. Of new rows with one key make one before (latest() does).
        appended: pieces of logs by table, which are in force from the same switch on.
        """
        state, new, touched = self._state(), {}, {}
        for name in sorted({*(upserts or {}), *(deletes or {})}):
            table = state["tables"][name]
            more, less = (upserts or {}).get(name), (deletes or {}).get(name)
            changed = [df.select(self._bucket(table).alias("_bucket")).distinct() for df in (more, less) if df is not None]
            hit = sorted(str(r["_bucket"]) for r in _union(changed).distinct().collect())
            rows = self._read(table, hit)
            if less is not None:
                rows = rows.join(less.select(*table["keys"]).distinct(), table["keys"], "left_anti")
            if more is not None:
                rows = upsert(rows, more, table["keys"], protected)
            paths = {b: p for b, p in table["paths"].items() if b not in hit} | self._laid(name, rows, table)
            new[name], touched[name] = table | {"paths": paths}, len(hit)
        for name, path in (appended or {}).items():
            table = state["tables"][name]
            new[name] = table | {"paths": table["paths"] | {f"{len(table['paths']):012d}": path}}
        self._switch(state, new)
        return touched

    def clean(self) -> int:
        """Delete folders and states that the state in force doesn't name; run it when no reader needs them."""
        state = self._state()
        files, kind = _files(self.spark, self.folder)
        kept = {p.rstrip("/") for t in state["tables"].values() for p in t["paths"].values()}
        gone = 0
        for f in files.globStatus(kind(f"{self.folder}/*/*/_bucket=*")) or []:
            name = f.getPath().toString()
            if not any(name.endswith(p.removeprefix(self.folder)) for p in kept):
                gone += files.delete(f.getPath(), True)
        for f in files.globStatus(kind(f"{self.folder}/current-*")) or []:
            if int(f.getPath().getName().split("-")[1]) < state["version"]:
                files.delete(f.getPath(), False)
        return gone


def deltas(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """(name, before, after, delta): rows of each table before and after a change, for a look before it is made."""
    one = lambda tables, column: [df.agg(F.count("*").alias(column)).select(F.lit(name).alias("name"), column) for name, df in tables.items()]
    old, new = (_union(one(t, c)) for t, c in ((before, "before"), (after, "after")))
    x = old.join(new, "name", "full_outer").select("name", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
    return x.withColumn("delta", F.col("after") - F.col("before"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def changed(spark: SparkSession, paths: dict[str, str], after: dict[str, DataFrame], dry_run: bool = True) -> DataFrame:
    """deltas() of tables at `paths` against their new states, which are written only if this is no dry run.

    All new states are written first, so that none is made from a table that has changed already; then they take their
    places. Tables.change switches several tables in one move.
    """
    report = written(deltas({k: spark.read.parquet(paths[k]) for k in after}, after), "deltas")
    if not dry_run:
        for name, rows in {name: written(rows, "changed") for name, rows in after.items()}.items():
            replace_table(spark, rows, paths[name])
    return report


def upsert(old: DataFrame, new: DataFrame, keys: list[str], protected: tuple[str, ...] = ()) -> DataFrame:
    """old with new merged in by keys: a non-null new value wins unless its column is protected; new keys are added.

    One full outer join on the keys. Columns are those of old; of new rows with one key any one is taken, so make them
    unique first (latest() does).
    """
    incoming = {c.lower() for c in new.columns}
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    seen_old = old.withColumn("_old", F.lit(True)).alias("o")
    seen_new = new.withColumn("_new", F.lit(True)).alias("n")
    joined = seen_old.join(seen_new, on, "full_outer")

    def merged(c: str):
        if c.lower() not in incoming:
            return F.col(f"o.{c}").alias(c)
        if c in protected:
            return F.when(F.col("o._old"), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
        return F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)

    return joined.select(*map(merged, old.columns))


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key, the one with the largest `order`: an aggregate, without a sort."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, F.xxhash64(*rest).alias("_tie"))).alias("_best"))
    return best.select(*keys, *(F.col(f"_best.{c}").alias(c) for c in rest)).select(*rows.columns)
