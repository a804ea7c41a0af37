"""Shards with size-tiered compaction and atomically committed manifests, in DataFrames only.

An append writes small immutable Parquet shards, never touching others. Compaction takes tiers of
similarly sized shards that have ``fan_in`` members or more and merges each into files of the target
size, reading and writing once without a shuffle. A state is a manifest, a small Parquet table of shards
in a folder of its own. A version is a file that is created only if it doesn't exist and names its
manifest, which is whole by then: of two writers of one version the second fails, and readers see the
version before or after, never between. Creating a file if absent is atomic on HDFS and local disks; it doesn't
need folders to be renamed at once, which object stores can't. Files that no kept version needs go with ``vacuum``.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import delete_path, new_path

#: Files whose rows one task counts.
FOOTERS = 256
MANIFEST = "shard string, bytes long, n_rows long, tier int, run string"


class ShardStore:
    """Shards and manifests under ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = 128 << 20, fan_in: int = 4, base_bytes: int = 1 << 20, keep_versions: int = 2):
        self.spark, self.path, self.target_bytes, self.fan_in, self.base_bytes = spark, path.rstrip("/"), target_bytes, fan_in, base_bytes
        self.keep_versions = max(1, keep_versions)

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def versions(self) -> list[int]:
        """All versions there are, ascending."""
        fs, at = self._fs(f"{self.path}/versions")
        if not fs.exists(at):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(at) if x.getLen() > 0]
        return sorted(int(x[1:]) for x in names if x[:1] == "v" and x[1:].isdigit())

    def version(self) -> int:
        """The newest version; 0 before the first commit."""
        return max(self.versions(), default=0)

    def _head(self, version: int) -> dict:
        """What a version's file says: its manifest's folder and the rows' schema."""
        if not version:
            return {"manifest": None, "schema": None}
        fs, at = self._fs(f"{self.path}/versions/v{version:08d}")
        stream = fs.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> DataFrame:
        """The shards of a version, the newest by default; without versions, none."""
        name = self._head(self.version() if version is None else version)["manifest"]
        if name is None:
            return self.spark.range(0).selectExpr(*[f"cast(null as {kind}) as {column}" for column, kind in (x.split() for x in MANIFEST.split(", "))])
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/{name}")

    def schema(self, version: int | None = None) -> StructType:
        """The rows' schema in a version: columns of all appends, in the order of their coming."""
        said = self._head(self.version() if version is None else version)["schema"]
        return StructType.fromJson(json.loads(said)) if said else StructType([])

    def _commit(self, manifest: DataFrame, version: int, schema: StructType) -> int:
        name = uuid.uuid4().hex
        manifest.select("shard", "bytes", "n_rows", "tier", "run").coalesce(1).write.parquet(f"{self.path}/manifests/{name}")
        fs, at = self._fs(f"{self.path}/versions/v{version:08d}")
        fs.mkdirs(at.getParent())
        try:
            stream = fs.create(at, False)  # fails where the file exists
        except Exception as error:
            raise RuntimeError(f"version {version} was committed by another writer") from error
        stream.write(bytearray(json.dumps({"manifest": name, "schema": schema.json()}).encode()))
        stream.close()
        return version

    def _tier(self, size):
        """0 up to base_bytes, then one more for each factor of fan_in; shards of a tier are of similar size."""
        return F.greatest(F.lit(0), F.ceil(F.log(size / F.lit(self.base_bytes)) / F.lit(math.log(self.fan_in)))).cast("int")

    def _described(self, run: str) -> DataFrame:
        """The shards that a job has written under data/run: size by the files' own metadata, rows counted."""
        path = f"{self.path}/data/{run}"
        fs, at = self._fs(path)
        tasks = math.ceil(sum(x.getPath().getName().endswith(".parquet") for x in fs.listStatus(at)) / FOOTERS)
        # One task holds all rows of its files, so up to FOOTERS files are counted without a shuffle.
        found = self.spark.read.schema("n long").parquet(path).coalesce(max(1, tasks))
        found = found.groupBy(F.col("_metadata.file_path").alias("shard"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("n_rows"))
        return found.select("shard", "bytes", "n_rows", self._tier(F.col("bytes")).alias("tier"), F.lit(run).alias("run"))

    def append(self, rows: DataFrame) -> int:
        """Adds rows as new shards, one a task, in one version. Columns that the store has not had come in; of a
        column of one name, case apart, the kind must be the one before."""
        version = self.version()
        schema = self.schema(version)
        had = {x.name.lower(): x for x in schema.fields}
        for x in rows.schema.fields:
            old = had.get(x.name.lower())
            if old is None:
                schema = schema.add(x.name, x.dataType, True)
            elif old.dataType != x.dataType:
                raise ValueError(f"column {x.name} was {old.dataType.simpleString()}, not {x.dataType.simpleString()}")
        run = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{run}")
        return self._commit(self.manifest(version).unionByName(self._described(run)), version + 1, schema)

    def _groups(self, manifest: DataFrame) -> list:
        """Tiers to merge, the smallest first: (tier, shard names, bytes): metadata of the merges, not rows."""
        small = manifest.where(F.col("bytes") < self.target_bytes / 2).coalesce(1)
        rows = small.groupBy("tier").agg(F.collect_list("shard").alias("shards"), F.sum("bytes").alias("bytes")).where(F.size("shards") >= self.fan_in)
        return sorted((r["tier"], sorted(r["shards"]), r["bytes"]) for r in rows.collect())

    def compact(self) -> int:
        """Merges until no tier below half the target size has fan_in shards; a version a round.

        A round takes each tier that is full and writes ceil(bytes / target) files from it. Shards of a
        tier differ by at most fan_in in size, so dealing them evenly gives files of about one size."""
        while True:
            version = self.version()
            manifest, schema = self.manifest(version), self.schema(version)
            groups = self._groups(manifest)
            if not groups:
                return version
            kept, added = manifest, []
            for tier, shards, size in groups:
                run = uuid.uuid4().hex
                files = min(len(shards) // 2, max(1, math.ceil(size / self.target_bytes)))
                self.spark.read.schema(schema).parquet(*shards).coalesce(files).write.parquet(f"{self.path}/data/{run}")
                kept = kept.where(~((F.col("tier") == tier) & (F.col("bytes") < self.target_bytes / 2)))
                added.append(self._described(run))
            for more in added:
                kept = kept.unionByName(more)
            self._commit(kept, version + 1, schema)

    def vacuum(self) -> None:
        """Deletes all versions but the newest keep_versions, and data and manifests that none of those names.
        A writer's data that no version names yet would go too: vacuum when none is writing."""
        kept = self.versions()[-self.keep_versions :]
        runs = None
        for version in kept:
            some = self.manifest(version).select("run")
            runs = some if runs is None else runs.unionByName(some)
        needed = {r["run"] for r in runs.coalesce(1).distinct().collect()} if kept else set()
        for folder, keep in (("versions", {f"v{v:08d}" for v in kept}), ("manifests", {self._head(v)["manifest"] for v in kept}), ("data", needed)):
            fs, at = self._fs(f"{self.path}/{folder}")
            if fs.exists(at):
                for x in fs.listStatus(at):
                    if x.getPath().getName() not in keep:
                        delete_path(self.spark, x.getPath().toString())

    def read(self, version: int | None = None, shard_col: str = "_shard", tier_col: str = "_tier") -> DataFrame:
        """All rows of a version with their shard's name and tier as shard_col and tier_col; where the rows
        have columns of those names, case apart, underscores go before them until they are free. A
        version without shards or rows gives an empty table of the rows' schema. Columns that came
        with a later append are null in rows before."""
        version = self.version() if version is None else version
        schema, manifest = self.schema(version), self.manifest(version)
        taken = {x.lower() for x in schema.names}
        named = []
        for name in (shard_col, tier_col):
            while name.lower() in taken:
                name = f"_{name}"
            taken.add(name.lower())
            named.append(name)
        shards = sorted((r["tier"], r["shard"]) for r in manifest.select("tier", "shard").collect())
        out = None
        for tier in sorted({t for t, _ in shards}):  # tiers are few: their number is the logarithm of a shard's size
            rows = self.spark.read.schema(schema).parquet(*[x for t, x in shards if t == tier])
            path = rows.metadataColumn("_metadata")["file_path"]
            rows = rows.select("*", F.element_at(F.split(path, "/"), -1).alias(named[0]), F.lit(tier).alias(named[1]))
            out = rows if out is None else out.unionAll(rows)
        if out is None:
            kinds = [(x.name, x.dataType.simpleString()) for x in schema.fields] + [(named[0], "string"), (named[1], "int")]
            return self.spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in kinds])
        return out


def sharded(rows: DataFrame, arrivals: int = 6, path: str | None = None, key: str = "doc_id", **options) -> ShardStore:
    """A store that took rows in as many appends as ``arrivals``, by a hash of the key, compacting after
    each as a service would; rows with a null key arrive too. Columns of any names and nulls in them
    pass through as they are; repeated rows stay repeated. Empty arrivals add no rows, and a store of an empty table
    is an empty table of the same columns."""
    spark = rows.sparkSession
    store = ShardStore(spark, path or new_path(spark, "shards"), **options)
    for arrival in range(arrivals):
        store.append(rows.where(F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(arrivals)) == arrival))
        store.compact()
        store.vacuum()
    return store
