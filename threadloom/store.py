"""The archive on disk: Parquet by buckets, generations that share what didn't change, and a pointer to the latest."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom import schema
from threadloom.archive import Archive
from threadloom.operators import upsert
from threadloom.runtime import Scratch, exists

_BUCKETS = "table_name string, bucket int, generation long, buckets int"


class Bodies:
    """Contents under their SHA-256, in a table under ``path`` whose parts are the hashes' first two digits."""

    #: Larger contents aren't kept.
    LIMIT = 32 << 20

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def all(self) -> DataFrame:
        """hash, content, size and part."""
        shape = "hash string, content binary, size long, part string"
        return self.spark.read.schema(shape).parquet(self.path) if exists(self.spark, self.path) else self.spark.createDataFrame([], shape)

    def put(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``body_hash``, once their ``content`` is stored; null for null or too large ones. What is there isn't written again."""
        fits = F.col("content").isNotNull() & (F.octet_length("content") <= self.LIMIT)
        hashed = rows.withColumn("body_hash", F.when(fits, F.sha2("content", 256)))
        # what is stored falls first, and what is left is dealt by hash once
        new = hashed.filter("body_hash is not null").select(F.col("body_hash").alias("hash"), "content").join(self.all().select("hash"), "hash", "left_anti").dropDuplicates(["hash"])
        new.withColumn("size", F.octet_length("content").cast("long")).withColumn("part", F.substring("hash", 1, 2)).repartition("part").write.mode("append").partitionBy("part").parquet(self.path)
        return hashed.drop("content")

    def damaged(self) -> DataFrame:
        """Hashes whose content is no longer theirs."""
        return self.all().filter((F.sha2("content", 256) != F.col("hash")) | (F.octet_length("content") != F.col("size"))).select("hash")


class Store:
    """Snapshots under ``path``; a generation is visible when its ``_done`` table is, so a failed write changes nothing.

    Each table's rows are dealt to buckets by their ids, and a generation names the folders that each bucket is in, of
    this generation or an earlier one. What changes is a few buckets, and only these are read and written; rows that are
    kept of a changed one's past are laid beside the bucket of their own id, which is merged with them when it is next
    written, or when it lies in more than ``DEEP`` folders.
    """

    #: Folders that a bucket may lie in before it is written as one.
    DEEP = 8

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self._buckets = spark, path.rstrip("/"), buckets
        self.bodies = Bodies(spark, f"{self.path}/bodies")

    def generation(self) -> int:
        """The latest complete generation; 0 for an empty store."""
        try:
            return self.spark.read.parquet(f"{self.path}/_done").agg(F.max("generation")).first()[0] or 0
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            return 0

    def _held(self, g: int) -> tuple[int, dict[str, dict[int, list[int]]]]:
        """The number of buckets, and for each table the generations that each of its buckets is in."""
        rows = self.spark.read.schema(_BUCKETS).parquet(f"{self.path}/{g}/_buckets").orderBy("generation").collect() if g else []
        held: dict[str, dict[int, list[int]]] = {t: {} for t in schema.TABLES}
        for r in rows:
            if r["bucket"] >= 0:
                held[r["table_name"]].setdefault(r["bucket"], []).append(r["generation"])
        return (rows[0]["buckets"] if rows else self._buckets), held

    def _read(self, table: str, held: dict[int, list[int]]) -> DataFrame:
        """The rows of some buckets."""
        shape, paths = schema.TABLES[table], [f"{self.path}/{g}/{table}/bucket={b}" for b, generations in sorted(held.items()) for g in generations]
        return self.spark.read.schema(shape).parquet(*paths) if paths else self.spark.createDataFrame([], shape)

    def _write(self, g: int, table: str, rows: DataFrame, buckets: int) -> set[int]:
        """Writes rows to their buckets' folders of a generation; which these are."""
        at = f"{self.path}/{g}/{table}"
        rows.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(at)
        found = self.spark.read.schema("id string, bucket int").option("basePath", at).parquet(at)
        return {r["bucket"] for r in found.select("bucket").distinct().collect()}  # at most ``buckets``

    def _finish(self, g: int, buckets: int, held: dict[str, dict[int, list[int]]], moved: DataFrame | None) -> int:
        rows = [(t, b, x, buckets) for t, own in held.items() for b, generations in own.items() for x in generations]
        self.spark.createDataFrame(rows or [("", -1, 0, buckets)], _BUCKETS).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{g}/_buckets")
        (moved if moved is not None else self.spark.createDataFrame([], schema.CHANGES)).write.mode("overwrite").parquet(f"{self.path}/{g}/_changes")
        self.spark.range(1).select(F.lit(g).cast("long").alias("generation")).write.mode("append").parquet(f"{self.path}/_done")
        return g

    def archive(self, generation: int | None = None) -> Archive:
        """The archive at a generation, the latest by default."""
        g = self.generation() if generation is None else generation
        if not g:
            return Archive(self.spark)
        _, held = self._held(g)
        return Archive(self.spark, **{t: self._read(t, held[t]) for t in schema.TABLES})

    def changes(self) -> DataFrame:
        """The change index: each entity's latest generation."""
        g = self.generation()
        if not g:
            return self.spark.createDataFrame([], schema.CHANGES)
        return upsert.index(self.spark.read.schema(schema.CHANGES).parquet(*[f"{self.path}/{k}/_changes" for k in range(1, g + 1)]))

    def ingest(self, incoming: dict[str, DataFrame], now: datetime) -> int:
        """Merges what readers found and gives the new generation. Merging the same again changes nothing but the generation.

        ``bodies`` are stored before the rows that name them.
        """
        if "bodies" in incoming:
            self.bodies.put(incoming["bodies"])
        last = self.generation()
        (buckets, held), g, moved = self._held(last), last + 1, None
        for name, shape in schema.TABLES.items():
            new = incoming.get(name)
            if new is None:
                continue
            new = upsert.latest(new.select(*[F.col(f.name).cast(f.dataType) if f.name in new.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in shape]))
            own = held[name]
            found = {r["b"] for r in new.select(F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int").alias("b")).distinct().collect()}  # at most ``buckets``
            touched = found | {b for b, generations in own.items() if len(generations) > self.DEEP}
            old = self._read(name, {b: own[b] for b in touched if b in own})
            merged = upsert.conversations(old, new) if name == "conversations" else upsert.messages(old, new, now) if name == "messages" else upsert.replace_preserving(old, new, name)
            written = self._write(g, name, merged, buckets)
            # a past row that is there already came from a bucket that wasn't read: it isn't laid beside itself
            beside = {b: own[b] for b in written - touched if b in own}
            if beside:
                again = self._read(name, {b: [g] for b in beside}).select("id").join(self._read(name, beside).select("id"), "id", "left_semi")
                twice = [r["b"] for r in again.select(F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int").alias("b")).distinct().collect()]
                for b in twice:
                    left = self._read(name, {b: [g]}).join(self._read(name, {b: own[b]}).select("id"), "id", "left_anti")
                    kept = Scratch(self.spark, "store").keep(left, "left")
                    kept.write.mode("overwrite").parquet(f"{self.path}/{g}/{name}/bucket={b}")
            after = self._read(name, {b: [g] for b in written})
            diff = upsert.changed(name, old, after, g)
            moved = diff if moved is None else moved.unionByName(diff)
            held[name] = own | {b: ([] if b in touched else own.get(b, [])) + [g] for b in written}
        return self._finish(g, buckets, held, moved)

    def backup(self, target: str) -> int:
        """Writes the latest generation to ``target``, which must not exist; a store of one generation with all bodies, and its number."""
        g = self.generation()
        if not g:
            raise ValueError("nothing to back up: the store is empty")
        if exists(self.spark, target):
            raise ValueError(f"backup target already exists: {target}")
        buckets, archive, other = self._held(g)[0], self.archive(g), Store(self.spark, target)
        other.bodies.put(self.bodies.all().select("content"))
        # as with a generation, the mark comes last
        other._finish(1, buckets, {t: {b: [1] for b in other._write(1, t, getattr(archive, t), buckets)} for t in schema.TABLES}, None)
        return g

    def restore(self, source: str) -> int:
        """Takes a backup's tables as the next generation, with what that changes; earlier generations stay as a rescue.

        A table that is missing, or whose columns are others, is an error before anything is written.
        """
        other = Store(self.spark, source)
        if self.path == other.path:
            raise ValueError("backup and store must be different folders")
        from_ = other.generation()
        _, theirs = other._held(from_)
        for name, shape in schema.TABLES.items():
            for b, generations in theirs[name].items():
                for x in generations:
                    found = self.spark.read.parquet(f"{other.path}/{x}/{name}/bucket={b}").schema
                    if [(f.name, f.dataType) for f in found] != [(f.name, f.dataType) for f in shape]:
                        raise ValueError(f"not a table of this archive: {name}")
        self.bodies.put(other.bodies.all().select("content"))
        last = self.generation()
        (buckets, _), before, after, g = self._held(last), self.archive(), other.archive(), last + 1
        moved, held = None, {}
        for name in schema.TABLES:
            held[name] = {b: [g] for b in self._write(g, name, getattr(after, name), buckets)}
            diff = upsert.changed(name, getattr(before, name), self._read(name, held[name]), g)
            moved = diff if moved is None else moved.unionByName(diff)
        return self._finish(g, buckets, held, moved)
