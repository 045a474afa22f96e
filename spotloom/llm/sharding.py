"""A sharded store with size-tiered compaction and atomically committed, versioned manifests.

Arrivals are appended as small immutable shards (folders of Parquet files). A shard's tier is the number of times
`fan_in` small shards fit into it; when `fan_in` shards of a tier have gathered, they are merged into files of about
`target_bytes`. Every change writes shards first and then one manifest, a file _manifests/v<number>.json that is
renamed into place; renaming fails if another writer has made that version, who then is followed: an arrival is committed
after it, and a merge too, unless one of its shards is gone. Readers see the last version that is whole. What the last
`keep_versions` manifests do not name stays for readers that began before, until `vacuum` finds it old enough.

All rows go through Spark's own Parquet reader and writer: no Python, and no shuffle, as a merge only coalesces what
it reads. Work a lost executor leaves is repeated by Spark; shards without a manifest are never seen. Commits rely on a
rename that does not replace a file, as HDFS and local disks have it; object stores whose rename copies don't give that,
and need a single writer.

Defined cases: rows are stored as they come, so null, empty, very long and repeated ones come back the same number of
times; an empty arrival adds a shard without rows; a store without a manifest reads as an error unless a schema is
given, and then as empty. All arrivals need the columns of the first, in any order; other columns are stored alike.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer committed this version first."""


@dataclass(frozen=True)
class Shard:
    name: str
    bytes: int
    files: int


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, *, target_bytes: int = 128 << 20, fan_in: int = 4, keep_versions: int = 3) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.fan_in, self.keep_versions = target_bytes, fan_in, keep_versions
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def versions(self) -> list[int]:
        where = self._path("_manifests")
        if not self._fs.exists(where):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(where)]
        return sorted(int(n[1:-5]) for n in names if n[0] == "v" and n.endswith(".json") and n[1:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, the last one by default; version 0 is the empty store."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return {"version": 0, "schema": None, "shards": []}
        stream = self._fs.open(self._path(f"_manifests/v{version:09d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def shards(self, version: int | None = None) -> list[Shard]:
        return [Shard(**s) for s in self.manifest(version)["shards"]]

    def commit(self, base: dict, shards: list[Shard], schema: StructType) -> int:
        """Puts the manifest that follows base in place, or raises Conflict."""
        version = base["version"] + 1
        said = json.dumps({"version": version, "schema": schema.jsonValue(), "shards": [asdict(s) for s in shards]})
        draft, final = self._path(f"_manifests/.draft-{uuid.uuid4().hex}"), self._path(f"_manifests/v{version:09d}.json")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(said.encode()))
        finally:
            out.close()
        fs = self._jvm.org.apache.hadoop.fs
        context = fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:  # unlike FileSystem.rename, this never replaces a file
            context.rename(draft, final, self.spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0))
        except Py4JJavaError as e:
            self._fs.delete(draft, False)
            if "AlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(f"version {version} of {self.root} is taken") from e
            raise
        return version

    def _shard(self, name: str) -> Shard:
        files = [f.getLen() for f in self._fs.listStatus(self._path(name)) if f.getPath().getName().startswith("part-")]
        return Shard(name, sum(files), len(files))

    def _write(self, df: DataFrame) -> Shard:
        name = f"shard-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.root}/{name}")
        return self._shard(name)

    def _follow(self, change: Callable[[dict, list[Shard]], list[Shard] | None], schema: StructType | None = None) -> int | None:
        """Commits what change makes of the last version's shards, again after each writer who was faster; None if it makes nothing."""
        while True:
            base = self.manifest()
            shards = change(base, [Shard(**s) for s in base["shards"]])
            if shards is None:
                return None
            try:
                return self.commit(base, shards, StructType.fromJson(base["schema"]) if base["schema"] else schema)
            except Conflict:
                continue

    def _as_first(self, df: DataFrame) -> DataFrame:
        schema = self.manifest()["schema"]
        return df.select(*[f"`{f['name']}`" for f in schema["fields"]]) if schema else df

    def append(self, df: DataFrame) -> int:
        """Commits df as one more shard."""
        df = self._as_first(df)
        shard = self._write(df)
        return self._follow(lambda _, shards: [*shards, shard], df.schema)

    def append_each(self, df: DataFrame, arrival: Column) -> list[int]:
        """Commits the rows of each value of arrival (a number) as a shard of its own, in order, from one pass over df."""
        df, draft, by = self._as_first(df), f"draft-{uuid.uuid4().hex}", f"arrival{uuid.uuid4().hex}"
        df.withColumn(by, arrival).write.partitionBy(by).option("compression", "zstd").parquet(f"{self.root}/{draft}")
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(draft)) if f.getPath().getName().startswith(f"{by}=")]
        done = [] if names else [self.append(df.limit(0))]
        for name in sorted(names, key=lambda n: (len(n), n)):
            shard = f"shard-{uuid.uuid4().hex}"
            self._fs.rename(self._path(f"{draft}/{name}"), self._path(shard))
            made = self._shard(shard)
            done.append(self._follow(lambda _, shards, made=made: [*shards, made], df.schema))
        self._fs.delete(self._path(draft), True)
        return done

    def tier(self, shard: Shard, least: int) -> int:
        """How often fan_in shards of the least size go into this one."""
        n, size = 0, max(1, least)
        while size * self.fan_in <= shard.bytes:
            n, size = n + 1, size * self.fan_in
        return n

    def runs(self, shards: list[Shard], small_bytes: int) -> list[list[Shard]]:
        """What is to be merged now: of each tier below the target, fan_in shards or more, oldest first."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.bytes < self.target_bytes * max(1, s.files) or s.files > 1 and s.bytes / s.files < self.target_bytes / 2:
                tiers.setdefault(self.tier(s, small_bytes), []).append(s)
        return [run for _, run in sorted(tiers.items()) if len(run) >= self.fan_in]

    def compact(self, small_bytes: int = 1 << 20, *, everything: bool = False) -> int:
        """Merges until no tier holds fan_in shards; with everything=True, all shards below the target into one run.

        The merges of a round are independent and run side by side; each is one commit. Returns the number of merges.
        """
        done = 0
        while True:
            base = self.manifest()
            shards = [Shard(**s) for s in base["shards"]]
            work = self.runs(shards, small_bytes)
            if not work and everything:
                rest = [s for s in shards if s.files and s.bytes / s.files < self.target_bytes / 2]
                work, everything = [rest] if len(rest) > 1 or rest and rest[0].files > 1 else [], False
            if not work:
                return done
            with ThreadPoolExecutor(min(8, len(work))) as pool:
                done += sum(pool.map(lambda run: self._merge(run, StructType.fromJson(base["schema"])), work))

    def _merge(self, run: list[Shard], schema: StructType) -> bool:
        """Puts one shard in place of a run; not if another writer has removed one of them in the meantime."""
        merged = self._write(self._load(run, schema).coalesce(max(1, round(sum(s.bytes for s in run) / self.target_bytes))))
        names = {s.name for s in run}

        def change(_: dict, shards: list[Shard]) -> list[Shard] | None:
            return [*(s for s in shards if s.name not in names), merged] if names <= {s.name for s in shards} else None

        if self._follow(change) is None:
            self._fs.delete(self._path(merged.name), True)
            return False
        return True

    def vacuum(self, older_than_s: float = 3600.0) -> None:
        """Removes all manifests but the last keep_versions, then shards and drafts that none of those left names.

        Nothing younger than older_than_s goes, as it may be read, or be about to be committed.
        """
        before = (time.time() - older_than_s) * 1000
        for v in self.versions()[: -self.keep_versions]:
            where = self._path(f"_manifests/v{v:09d}.json")
            if self._fs.getFileStatus(where).getModificationTime() <= before:
                self._fs.delete(where, False)
        named = {s.name for v in self.versions() for s in self.shards(v)}
        for f in self._fs.listStatus(self._path("")):
            name = f.getPath().getName()
            if name.startswith(("shard-", "draft-")) and name not in named and f.getModificationTime() <= before:
                self._fs.delete(f.getPath(), True)

    def _load(self, shards: list[Shard], schema: StructType) -> DataFrame:
        if not shards:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{s.name}" for s in shards])

    def read(self, version: int | None = None, schema: StructType | None = None) -> DataFrame:
        m = self.manifest(version)
        if not m["schema"]:
            if schema is None:
                raise PySparkException(f"{self.root} has no version yet")
            return self.spark.createDataFrame([], schema)
        return self._load([Shard(**s) for s in m["shards"]], StructType.fromJson(m["schema"]))
