"""Keyed state as versioned Parquet tables with a ledger of committed runs.

A write goes to a new directory of its own; it counts only once a row naming it is
in the ledger, so a lost job leaves nothing half-applied.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER_DDL = ("table string, version bigint, folder string, kind string, tier int, replaces string, key string, "
              "order_by string, run_id string, committed_at string, digests string, engine string")


def newest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Newest row per key.  A maximum by order, combined map-side: no window per key."""
    packed = F.struct(*[F.col(c) for c in rows.columns])
    found = rows.groupBy(*key).agg(F.max_by(packed, F.struct(*[F.col(c) for c in order])).alias("_r"))
    return found.select("_r.*")


def upsert(stored: DataFrame, fresh: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Stored and fresh rows as one table with the newest row per key."""
    return newest(stored.unionByName(fresh), key, order)


def append_new(stored: DataFrame, fresh: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows of ``fresh`` whose content id is not stored yet, one per id."""
    packed = F.struct(*[F.col(c) for c in fresh.columns])
    one = fresh.groupBy(key).agg(
        F.min_by(packed, F.struct(*[F.col(c) for c in order])).alias("_r")).select("_r.*")
    return one.join(stored.select(key), key, "left_anti")


class Store:
    """Tables as sorted runs that are merged when they are read.

    A write adds one run with its own rows only, sorted by a hash of the key, so its
    files are key ranges and their number follows its size.  When ``fan`` runs of a
    tier are live they are merged into one of the next tier: a row is rewritten
    once per tier, so writing k rows costs O(k) and a share of merges that grows
    with the logarithm of the runs.  The ledger says which runs a merge replaces; a
    snapshot is the live runs up to a version.
    """

    def __init__(self, spark: SparkSession, root: str, fan: int = 8):
        self.spark, self.root, self.fan = spark, root.rstrip("/"), fan

    def ledger(self) -> DataFrame:
        return self.spark.read.schema(LEDGER_DDL).json(f"{self.root}/_runs/*")

    def _folder(self, path: str):
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _runs(self, table: str) -> list:
        folder, files = self._folder(f"{self.root}/_runs")
        if not files.exists(folder):
            return []
        return self.ledger().where(F.col("table") == table).orderBy("version").collect()

    def latest(self, table: str) -> int | None:
        return max((r["version"] for r in self._runs(table)), default=None)

    def live(self, table: str, version: int | None = None) -> list:
        """Ledger rows of the runs that together hold the table, as of a version."""
        runs = [r for r in self._runs(table) if version is None or r["version"] <= version]
        gone = {int(v) for r in runs for v in r["replaces"].split(",") if v}
        return [r for r in runs if r["version"] not in gone]

    def paths(self, table: str, version: int | None = None) -> list[str]:
        return [self._path(run) for run in self.live(table, version)]

    def _path(self, run) -> str:
        return f"{self.root}/{run['table']}/{run['folder']}"

    def read(self, table: str, version: int | None = None) -> DataFrame | None:
        """The newest row of each key; of rows that are equally new, the one written last."""
        runs = self.live(table, version)
        return self._merged(runs) if runs else None

    def _merged(self, runs: list) -> DataFrame:
        if len(runs) == 1 or all(r["kind"] == "append" for r in runs):
            return self.spark.read.parquet(*map(self._path, runs)).drop("_hash")
        parts = [self.spark.read.parquet(self._path(r)).drop("_hash").withColumn("_version", F.lit(r["version"])) for r in runs]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        writes = [r for r in runs if r["kind"] != "append"]
        key, order = writes[-1]["key"].split(","), writes[-1]["order_by"].split(",")
        return newest(rows, key, [*order, "_version"]).drop("_version")

    def _commit(self, rows: DataFrame, table: str, key: list[str], order: list[str], kind: str, tier: int,
                replaces: list[int], run_id: str, committed_at: str, digests: str) -> int:
        """Writes the rows, then the ledger row that makes them count.

        That row's name is the version and may not exist yet: of two writers with
        the same version the second fails and leaves nothing visible.
        """
        version = (self.latest(table) or 0) + 1
        name = f"v{version:08d}-{uuid.uuid4().hex[:8]}"
        hashed = rows.withColumn("_hash", F.xxhash64(*key))
        hashed.repartitionByRange("_hash").sortWithinPartitions("_hash").write.parquet(f"{self.root}/{table}/{name}")
        facts = {"table": table, "version": version, "folder": name, "kind": kind, "tier": tier,
                 "replaces": ",".join(map(str, replaces)), "key": ",".join(key), "order_by": ",".join(order),
                 "run_id": run_id, "committed_at": committed_at, "digests": digests, "engine": self.spark.version}
        entry = self.spark.range(1).select(*[F.lit(v).alias(k) for k, v in facts.items()])
        entry.coalesce(1).write.mode("errorifexists").json(f"{self.root}/_runs/{table}-v{version:08d}")
        return version

    def upsert(self, fresh: DataFrame, table: str, key: list[str], order: list[str],
               run_id: str, committed_at: str, digests: str = "") -> int:
        """Newest row per key; nothing stored is read or rewritten, but for merges that fall due."""
        version = self._commit(newest(fresh, key, order), table, key, order, "upsert", 0, [], run_id, committed_at, digests)
        self._tiered(table, key, order, run_id, committed_at)
        return version

    def append(self, fresh: DataFrame, table: str, key: str, order: list[str], run_id: str,
               committed_at: str, digests: str = "") -> int:
        """Insert or ignore: rows with new keys are added; of what is stored only keys are read."""
        runs = self.live(table)
        stored = self.spark.read.parquet(*map(self._path, runs)).select(key) if runs else fresh.limit(0).select(key)
        rows = append_new(stored, fresh, key, order)
        version = self._commit(rows, table, [key], order, "append", 0, [], run_id, committed_at, digests)
        self._tiered(table, [key], order, run_id, committed_at)
        return version

    def _tiered(self, table: str, key: list[str], order: list[str], run_id: str, committed_at: str) -> None:
        """Merges full tiers, lowest first, so that a merged run is newer than all that it leaves out below it."""
        tier = 0
        while len(runs := [r for r in self.live(table) if r["tier"] == tier]) >= self.fan:
            self._merge(runs, table, key, order, tier + 1, f"merge-{run_id}", committed_at)
            tier += 1

    def _merge(self, runs: list, table: str, key: list[str], order: list[str], tier: int, run_id: str, committed_at: str) -> int:
        kind = "append" if all(r["kind"] == "append" for r in runs) else "upsert"
        return self._commit(self._merged(runs), table, key, order, kind, tier, [r["version"] for r in runs], run_id,
                            committed_at, "")

    def compact(self, table: str, key: list[str], run_id: str, committed_at: str) -> int | None:
        """Merges all live runs into one."""
        runs = self.live(table)
        if not runs:
            return None
        order = next((r["order_by"] for r in reversed(runs) if r["kind"] != "append"), runs[-1]["order_by"]).split(",")
        return self._merge(runs, table, key, order, max(r["tier"] for r in runs) + 1, run_id, committed_at)

    def vacuum(self, table: str, version: int | None = None) -> int:
        """Deletes the files of runs that no snapshot from ``version`` (by default the latest) on needs."""
        runs = self._runs(table)
        version = version or max((r["version"] for r in runs), default=0)
        needed = {r["version"] for r in self.live(table, version)}
        gone = [r for r in runs if r["version"] <= version and r["version"] not in needed]
        for run in gone:
            folder, files = self._folder(self._path(run))
            files.delete(folder, True)
        return len(gone)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """sha256 of each input file."""
    return spark.read.format("binaryFile").load(path).select(
        "path", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("digest"))
