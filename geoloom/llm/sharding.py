"""Size-tiered compaction of immutable Parquet shards under a versioned manifest.

A store is a folder.  ``data/`` holds shards, which never change; a table below
``manifest/`` lists the shards of a version, and ``manifest/v########.json`` names
that table.  Arrivals are appended as small shards.  Compaction merges runs of
shards of a similar size into files near a target size.  A version exists from
the moment its JSON file gets its name, by a rename that refuses a taken name.
Until then readers see the version before, and a job that dies leaves only files
that no manifest names.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import drop_written, written

LISTING = "shard string, version long, n_rows long, n_bytes long, tier int"


class CommitConflict(RuntimeError):
    """Another writer has merged the same shards."""


@dataclass(frozen=True)
class Policy:
    """``target``: bytes of a merged file.  Shards of a tier are alike within a factor
    of ``growth``; tier 0, from ``target / growth`` on, is left alone.  A tier of
    ``fan_in`` shards or more is merged.  ``arrival_rows``: rows of a small shard.
    ``wave``: paths that one merging job is given."""

    target: int = 128 << 20
    growth: float = 4.0
    fan_in: int = 4
    arrival_rows: int = 1_000
    wave: int = 10_000

    def tier(self, n_bytes: Column) -> Column:
        ratio = F.lit(float(self.target)) / F.greatest(n_bytes, F.lit(1)).cast("double")
        return F.greatest(F.lit(0), F.floor(F.log(self.growth, ratio))).cast("int")


class Store:
    """One sharded table below ``folder``, which Spark can read and write."""

    def __init__(self, spark: SparkSession, folder: str, policy: Policy | None = None):
        self.spark, self.folder, self.policy = spark, folder.rstrip("/"), policy or Policy()
        self._fs = spark._jvm.org.apache.hadoop.fs
        self.files = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def version(self) -> int:
        """The latest committed version; 0 for a new store."""
        if not self.files.exists(self._path("manifest")):
            return 0
        names = [x.getPath().getName() for x in self.files.listStatus(self._path("manifest"))]
        return max((int(x[1:9]) for x in names if x.startswith("v") and x.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "listing": None, "schema": None}
        (line,) = self.spark.read.text(f"{self.folder}/manifest/v{version:08d}.json").collect()
        return json.loads(line[0])

    def shards(self, version: int | None = None) -> DataFrame:
        """shard (path below the folder), version that wrote it, n_rows, n_bytes, tier."""
        name = self.manifest(version)["listing"]
        return self.spark.read.schema(LISTING).parquet(f"{self.folder}/{name}") if name else self.spark.createDataFrame([], LISTING)

    def read(self, version: int | None = None, shard_as: str | None = None) -> DataFrame:
        """The rows of a version; with ``shard_as``, each one's shard under that name."""
        entry = self.manifest(version)
        if entry["schema"] is None:
            raise ValueError("a store without a version has no schema")
        schema, found = StructType.fromJson(entry["schema"]), None
        for paths in self._waves(self.shards(entry["version"])):
            some = self._scan(schema, paths, shard_as)
            found = some if found is None else found.unionByName(some)
        if found is None:
            found = self.spark.createDataFrame([], schema)
            found = found.drop(shard_as).withColumn(shard_as, F.lit(None).cast("string")) if shard_as else found
        return found

    def _scan(self, schema: StructType, paths: list[str], shard_as: str | None) -> DataFrame:
        rows = self.spark.read.schema(schema).parquet(*(f"{self.folder}/{x}" for x in paths))
        if not shard_as:
            return rows
        return rows.select(*(F.col(f"`{x}`") for x in rows.columns if x != shard_as), _shard_name().alias(shard_as))

    def _waves(self, shards: DataFrame) -> Iterator[list[str]]:
        """Paths in runs of at most ``wave``; the driver holds one run at a time."""
        held = []
        for row in shards.select("shard").toLocalIterator():
            held.append(row.shard)
            if len(held) == self.policy.wave:
                yield held
                held = []
        if held:
            yield held

    def append(self, rows: DataFrame) -> int:
        """Writes an arrival as small shards, without a shuffle, and commits it."""
        base = self.manifest()
        if base["schema"] is not None and StructType.fromJson(base["schema"]).fieldNames() != rows.columns:
            raise ValueError("the columns differ from the store's")
        folder = f"data/v{base['version'] + 1:08d}-{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").option("maxRecordsPerFile", self.policy.arrival_rows).parquet(f"{self.folder}/{folder}")
        return self._commit(None, [folder], json.loads(rows.schema.json()))

    def compact(self, fan_in: int | None = None) -> int:
        """Merges each tier that has enough shards; returns the version that then holds.

        Shards of a tier are alike in size, so merging them evenly by number gives
        files near the target without a shuffle: tasks read several shards and
        write one file.
        """
        base, shards = self.manifest(), self.shards()
        least = self.policy.fan_in if fan_in is None else fan_in
        tiers = shards.where("tier > 0").groupBy("tier").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("n_bytes")).where(F.col("n") >= max(2, least)).collect()
        if not tiers:
            return base["version"]
        schema, folders = StructType.fromJson(base["schema"]), []
        for row in sorted(tiers):
            one = shards.where(F.col("tier") == row.tier).orderBy("version", "shard")
            for paths in self._waves(one):
                share = row.n_bytes * len(paths) / row.n
                files = max(1, round(share / self.policy.target))
                folders.append(f"data/v{base['version'] + 1:08d}-{uuid.uuid4().hex}")
                self._scan(schema, paths, None).coalesce(files).write.option("compression", "zstd").parquet(f"{self.folder}/{folders[-1]}")
        return self._commit(shards.where(F.col("tier").isin([x.tier for x in tiers])), folders, base["schema"])

    def _listed(self, folders: list[str], schema: dict) -> DataFrame:
        """The shards of new folders, with the rows and bytes of each."""
        new = self.spark.read.schema(StructType.fromJson(schema)).parquet(*(f"{self.folder}/{x}" for x in folders))
        sums = new.select(_shard_name().alias("shard"), F.col("_metadata.file_size").alias("n_bytes")).groupBy("shard", "n_bytes").agg(F.count("*").alias("n_rows"))
        return sums.select("shard", "n_rows", "n_bytes", self.policy.tier(F.col("n_bytes")).alias("tier"))

    def _commit(self, merged: DataFrame | None, folders: list[str], schema: dict) -> int:
        """Makes the next version of the latest one, less what was merged, with the shards of ``folders``.

        Where another writer commits first, this one goes on from that version.  Only
        if that lacks a shard which was merged here, the merge is void: an error.
        """
        new = written(self._listed(folders, schema), "new-shards")
        while True:
            base, kept = self.version(), self.shards()
            if merged is not None:
                if not merged.join(kept.select("shard"), "shard", "left_anti").isEmpty():
                    raise CommitConflict(f"version {base} lacks shards that were merged")
                kept = kept.join(merged.select("shard"), "shard", "left_anti")
            listing = f"manifest/listing-{uuid.uuid4().hex}"
            listed = new.withColumn("version", F.lit(base + 1).cast("long")).select("shard", "version", "n_rows", "n_bytes", "tier")
            listed.unionByName(kept.select(listed.columns)).write.parquet(f"{self.folder}/{listing}")
            if self._named(base + 1, {"version": base + 1, "listing": listing, "schema": schema}):
                drop_written(new)
                return base + 1
            self.files.delete(self._path(listing), True)

    def _named(self, version: int, entry: dict) -> bool:
        """Whether the version's file got its name; False if another writer's has it."""
        begun, final = self._path(f"manifest/.{uuid.uuid4().hex}.begun"), self._path(f"manifest/v{version:08d}.json")
        out = self.files.create(begun, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        context = self._fs.FileContext.getFileContext(self.files.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark._sc._gateway.new_array(getattr(self._fs, "Options$Rename"), 0)
        try:
            context.rename(self.files.makeQualified(begun), self.files.makeQualified(final), options)
        except Exception:
            self.files.delete(begun, False)
            if self.files.exists(final):
                return False
            raise
        return True

    def _old(self, name: str, before: float) -> bool:
        return self.files.getFileStatus(self._path(name)).getModificationTime() / 1000 <= before

    def vacuum(self, keep_s: float = 7 * 86_400) -> int:
        """Deletes what no version needs, after ``keep_s`` seconds; returns the number of shards.

        Versions before the latest that were committed longer ago go, with their
        listings and the shards that no later version has; then folders and listings
        that no version names and that are as old, which jobs that died have left.
        Readers of a version, and jobs that still write, have that time to end.
        """
        latest, before, gone = self.version(), time.time() - keep_s, 0
        there = [v for v in range(1, latest + 1) if self.files.exists(self._path(f"manifest/v{v:08d}.json"))]
        # A version is in use until the next one is committed.
        old = [v for v, after in zip(there, there[1:], strict=False) if self._old(f"manifest/v{after:08d}.json", before)]
        kept = [v for v in there if v not in old]
        if not kept:
            return 0
        needed = written(reduce(DataFrame.unionByName, [self.shards(v).select("shard") for v in kept]).distinct(), "needed-shards")
        for version in old:
            for paths in self._waves(self.shards(version).select("shard").join(needed, "shard", "left_anti")):
                gone += sum(bool(self.files.delete(self._path(x), False)) for x in paths)
            listing = self.manifest(version)["listing"]
            self.files.delete(self._path(f"manifest/v{version:08d}.json"), False)
            self.files.delete(self._path(listing), True)
        folders = {r[0] for r in needed.select(F.element_at(F.split("shard", "/"), -2)).distinct().collect()}
        listings = {self.manifest(v)["listing"].rpartition("/")[2] for v in kept}
        for parent, named in (("data", folders), ("manifest", listings)):
            if self.files.exists(self._path(parent)):
                for x in self.files.listStatus(self._path(parent)):
                    name = f"{parent}/{x.getPath().getName()}"
                    if x.isDirectory() and x.getPath().getName() not in named and self._old(name, before):
                        self.files.delete(self._path(name), True)
        drop_written(needed)
        return gone


def _shard_name() -> Column:
    """The last three parts of a file's path, which are below the store's folder."""
    return F.concat_ws("/", F.slice(F.split(F.col("_metadata.file_path"), "/"), -3, 3))


def sharded(docs: DataFrame, folder: str, policy: Policy | None = None, shard_as: str = "shard") -> DataFrame:
    """Appends ``docs`` to the store, compacts it, and returns its rows with their shards.

    All rows stay, whatever is null or repeated in them; an empty text or a very
    long one is a row like any other, and a long row may make its shard larger
    than the target.  Ties of size can't change what is kept.  An empty table
    commits a version without shards.  A column named ``shard_as`` gives way to
    the shard's name in the result; the store keeps it.
    """
    store = Store(docs.sparkSession, folder, policy)
    store.append(docs)
    store.compact()
    store.vacuum()  # what is older than a week
    return store.read(shard_as=shard_as)
