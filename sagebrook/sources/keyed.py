"""Keyed state kept as base and delta files under a versioned manifest.

A batch of writes is stored as a delta of its own size, dealt into buckets by session.  A version is
one small file that names, for every bucket, the folders to read; it is put in place by a rename that
never replaces another, so a reader sees the whole of one version or of the one before, and a writer
that is stopped leaves nothing behind that a version names.  Buckets with many deltas are merged
into a new base, each by itself.  Folders that no kept version names are deleted by ``vacuum``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.memory import merged, upsert

BUCKETS = 16
#: Folders that one bucket is read from at most, before it is merged.
MOST_FOLDERS = 8
SCHEMA = (
    "session_id string, key string, value string, agent string, step_number int, expires_at timestamp_ntz, "
    "created_at timestamp_ntz, seq long, first_seq long"
)


class Conflict(RuntimeError):
    """Another writer has made the version that was to be made."""


class KeyedTable:
    """The state of keyed writes at ``path``; one writer at a time, any number of readers."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, most_folders: int = MOST_FOLDERS) -> None:
        self.spark, self.path, self.buckets, self.most_folders = spark, path.rstrip("/"), buckets, most_folders
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def _files(self):
        return self._at("versions").getFileSystem(self._conf)

    def versions(self) -> list[int]:
        files, folder = self._files(), self._at("versions")
        if not files.exists(folder):
            return []
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _manifest(self, version: int) -> dict:
        stream = self._files().open(self._at(f"versions/{version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def manifest(self) -> dict:
        """The newest version: its number, the last batch in it, and the folders of each bucket."""
        found = self.versions()
        return self._manifest(found[-1]) if found else {"version": 0, "batch": None, "buckets": self.buckets, "folders": {}}

    def _commit(self, before: dict, folders: dict[str, list[str]], batch: int | None) -> None:
        after = before | {"version": before["version"] + 1, "folders": folders, "batch": before["batch"] if batch is None else batch}
        fresh, at = self._at(f"versions/{uuid.uuid4().hex}.new"), self._at(f"versions/{after['version']:012d}.json")
        stream = self._files().create(fresh)
        stream.write(json.dumps(after).encode())
        stream.close()
        context = self._hadoop.FileContext.getFileContext(at.toUri(), self._conf)
        plain = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0)
        try:
            context.rename(context.makeQualified(fresh), context.makeQualified(at), plain)
        except Exception as e:
            self._files().delete(fresh, False)
            raise Conflict(f"version {after['version']} is there already") from e

    def _rows(self, folders: dict[str, list[str]]) -> DataFrame | None:
        paths = [f"{self.path}/{name}/bucket={b}" for b, names in folders.items() for name in names]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else None

    def read(self, version: int | None = None) -> DataFrame:
        """The state as of a version, the newest by default: one row a key, with seq and first_seq."""
        rows = self._rows((self.manifest() if version is None else self._manifest(version))["folders"])
        return merged(rows) if rows is not None else self.spark.createDataFrame([], SCHEMA)

    def _store(self, rows: DataFrame, kind: str, buckets: int) -> tuple[str, list[str]]:
        """Write rows by bucket; the folder and the buckets that it has."""
        name = f"{kind}-{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64("session_id"), F.lit(buckets)).cast("int")
        dealt = rows.select(*[c.split()[0] for c in SCHEMA.split(", ")], bucket.alias("bucket"))
        dealt.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(8))).write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/{name}")
        found = [s.getPath().getName() for s in self._files().listStatus(self._at(name))]
        return name, [n.removeprefix("bucket=") for n in found if n.startswith("bucket=")]

    def write(self, writes: DataFrame, batch: int | None = None) -> int:
        """Add a batch of writes as a delta; the number of the version that has it.

        With ``batch``, a number that grows, a batch that is in already changes nothing.  A late
        write with an older seq changes nothing but, if it is the first, the time of creation.
        """
        before = self.manifest()
        if batch is not None and before["batch"] is not None and batch <= before["batch"]:
            return before["version"]
        name, buckets = self._store(upsert(writes, keep_seq=True), "delta", before["buckets"])
        folders = {b: [*names] for b, names in before["folders"].items()}
        for b in buckets:
            folders.setdefault(b, []).append(name)
        self._commit(before, folders, batch)
        if any(len(names) > self.most_folders for names in folders.values()):
            self.compact()
        return self.manifest()["version"]

    def compact(self, as_of: Column | None = None, everything: bool = False) -> None:
        """Merge the buckets that are read from many folders, or all, into one base each; with
        ``as_of`` rows that expired before it go, in all buckets."""
        self._rewrite(lambda rows: rows if as_of is None else rows.filter(~F.coalesce(F.col("expires_at") < as_of, F.lit(False))), None if everything or as_of is not None else self.most_folders)

    def delete(self, session_id: str, key: str | None = None) -> int:
        """Delete a key or a session; only its bucket is written anew.  How many keys went."""
        one = self.spark.range(1).select(F.pmod(F.xxhash64(F.lit(session_id)), F.lit(self.manifest()["buckets"])).alias("b"))
        hit = F.col("session_id") == session_id
        hit = F.coalesce(hit if key is None else hit & (F.col("key") == key), F.lit(False))
        bucket = str(one.first()["b"])
        gone = merged(rows).filter(hit).count() if (rows := self._rows({bucket: self.manifest()["folders"].get(bucket, [])})) is not None else 0
        if gone:
            self._rewrite(lambda rows: rows.filter(~hit), None, [bucket])
        return gone

    def _rewrite(self, keep, most: int | None, only: list[str] | None = None) -> None:
        before = self.manifest()
        chosen = {b: n for b, n in before["folders"].items() if (only is None or b in only) and (most is None or len(n) > most)}
        if not chosen:
            return
        name, buckets = self._store(keep(merged(self._rows(chosen))), "base", before["buckets"])
        folders = {b: n for b, n in before["folders"].items() if b not in chosen} | {b: [name] for b in buckets}
        self._commit(before, folders, None)

    def vacuum(self, keep: int = 2) -> int:
        """Delete all versions but the last ``keep``, and every folder that none of these names.
        No writer may be at work.  How many folders went."""
        found, files = self.versions(), self._files()
        kept = {name for v in found[-keep:] for names in self._manifest(v)["folders"].values() for name in names}
        for v in found[:-keep]:
            files.delete(self._at(f"versions/{v:012d}.json"), False)
        gone = [s.getPath() for s in files.listStatus(self._hadoop.Path(self.path)) if s.getPath().getName().startswith(("base-", "delta-"))]
        gone = [p for p in gone if p.getName() not in kept]
        for p in gone:
            files.delete(p, True)
        return len(gone)
