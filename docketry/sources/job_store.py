"""Versioned job table on a shared file system, laid out by key.

Rows lie in hash buckets of the job id. A version is a small JSON file: for each
bucket its base folder and the change folders after it, and the last batch of each
stream that writes here. A new version copies the entries of the buckets it does
not touch and names new folders for the others, so a change costs what it changes;
a bucket with many change folders is rewritten alone. Inside a bucket rows are
sorted by job id and carry a bloom filter, so a lookup opens the buckets of the ids
asked for and skips most row groups of those.

A version file is written completely under a temporary name and then given its
name only if that is free (a hard link on a local disk, a rename that does not
overwrite elsewhere), so a reader never sees half of one, and of two writers that
saw the same version one fails and must read again. A writer that dies leaves
folders and temporary files that no version names; ``remove_unused`` deletes them.
Object stores need a file system whose rename fails on an existing target.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry import schemas as S

_FORMAT = "%012d"


class VersionConflict(RuntimeError):
    """Another writer published the version first."""


class JobStore:
    """Current job state: ``read()``, ``lookup(ids)``, and ``apply(changes)`` as one new version.

    ``buckets`` counts for a new store; an old one keeps the number it was made with.
    """

    def __init__(self, spark: SparkSession, root: str, *, compact_after: int = 20, buckets: int = 64) -> None:
        self._spark = spark
        self._root = root.rstrip("/")
        self._compact_after = compact_after
        self._buckets = buckets

    # ---- versions --------------------------------------------------------

    def _path(self, name: str):
        return self._spark._jvm.org.apache.hadoop.fs.Path(f"{self._root}/{name}")

    def _fs(self):
        conf = self._spark._jsc.hadoopConfiguration()
        return self._path("_versions").getFileSystem(conf)

    def _numbers(self) -> list[int]:
        fs, folder = self._fs(), self._path("_versions")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self) -> int:
        """Latest published version, 0 for a new store."""
        return max(self._numbers(), default=0)

    def _text(self, version: int) -> str:
        source = self._fs().open(self._path(f"_versions/{_FORMAT % version}.json"))
        try:
            return self._spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()

    def _manifest(self, version: int) -> dict:
        """What a version holds.

        A file that does not parse can only have been left by a writer of another
        kind that died; as the newest one it counts as the version before it, with
        others after it the store is damaged.
        """
        if version == 0:
            return {"buckets": self._buckets, "base": {}, "deltas": {}, "batches": {}}
        try:
            return json.loads(self._text(version))
        except json.JSONDecodeError:
            earlier = [n for n in self._numbers() if n < version]
            if version != self.version():
                raise
            return self._manifest(max(earlier, default=0))

    def _publish(self, version: int, manifest: dict) -> None:
        fs = self._fs()
        fs.mkdirs(self._path("_versions"))
        final = self._path(f"_versions/{_FORMAT % version}.json")
        temporary = self._path(f"_versions/.{uuid.uuid4().hex}.tmp")
        out = fs.create(temporary, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        try:
            self._name(fs, temporary, final)
        except Exception as error:
            if not fs.exists(final):  # no permission, no space, no connection
                raise
            raise VersionConflict(f"version {version} already exists") from error
        finally:
            if fs.exists(temporary):
                fs.delete(temporary, False)

    def _name(self, fs, temporary, final) -> None:
        """Give a complete file its name, in one step that fails if the name is taken."""
        jvm = self._spark._jvm
        if fs.getUri().getScheme() == "file":
            at = [jvm.java.nio.file.Paths.get(p.toUri().getPath(), self._spark.sparkContext._gateway.new_array(jvm.String, 0)) for p in (final, temporary)]
            jvm.java.nio.file.Files.createLink(*at)
            return
        options = self._spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf()).rename(temporary, final, options)

    # ---- reading ---------------------------------------------------------

    def _rows(self, folders: list[str]) -> DataFrame:
        """Rows of ``run=../bucket=..`` folders, with both as columns."""
        schema = f"{S.JOB.simpleString()[7:-1]},run:string,bucket:int"
        reader = self._spark.read.schema(schema.replace(":", " ")).option("basePath", f"{self._root}/data")
        return reader.parquet(*[f"{self._root}/data/{f}" for f in folders])

    def _at(self, manifest: dict, buckets: set[int] | None = None) -> DataFrame:
        """Base rows without newer changes, plus the newest change of each job."""
        chosen = [b for b in set(manifest["base"]) | set(manifest["deltas"]) if buckets is None or int(b) in buckets]
        base = sorted(f"run={manifest['base'][b]}/bucket={b}" for b in chosen if b in manifest["base"])
        deltas = sorted(f"run={run}/bucket={b}" for b in chosen for run in manifest["deltas"].get(b, ()))
        kept = self._rows(base).select(*S.JOB_COLUMNS) if base else self._spark.createDataFrame([], S.JOB)
        if not deltas:
            return kept
        row = F.struct(*S.JOB_COLUMNS)
        latest = self._rows(deltas).groupBy("job_id").agg(F.max_by(row, "run").alias("r")).select("r.*")
        return kept.join(latest.select("job_id"), "job_id", "left_anti").unionByName(latest) if base else latest

    def read(self, version: int | None = None) -> DataFrame:
        return self._at(self._manifest(self.version() if version is None else version))

    def lookup(self, ids: DataFrame, version: int | None = None) -> DataFrame:
        """The rows of the job ids in ``ids`` (column ``job_id``); only their buckets are opened.

        The driver receives bucket numbers, at most one for each bucket.
        """
        manifest = self._manifest(self.version() if version is None else version)
        asked = ids.select("job_id").where("job_id is not null").distinct()
        found = {r[0] for r in asked.select(self._bucket(manifest["buckets"])).distinct().collect()}
        return self._at(manifest, found).join(asked, "job_id", "left_semi")

    def last_batch(self, stream: str = "intake", version: int | None = None) -> int:
        """Number of the last published batch of a stream, -1 before the first."""
        manifest = self._manifest(self.version() if version is None else version)
        return manifest["batches"].get(stream, -1)

    # ---- writing ---------------------------------------------------------

    @staticmethod
    def _bucket(buckets: int):
        return F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("int").alias("bucket")

    def _write(self, rows: DataFrame, run: str, buckets: int) -> list[int]:
        """Write rows below ``run``, a folder and one sorted file or more for each bucket; the buckets written."""
        bucket = self._bucket(buckets)
        (
            rows.select(*S.JOB_COLUMNS, bucket).repartition("bucket").sortWithinPartitions("bucket", "job_id")
            .write.partitionBy("bucket").option("parquet.bloom.filter.enabled#job_id", "true")
            .parquet(f"{self._root}/data/run={run}")
        )
        return [int(s.getPath().getName()[7:]) for s in self._fs().listStatus(self._path(f"data/run={run}")) if s.isDirectory()]

    def apply(
        self, changes: DataFrame, *, batch: int | None = None, expected: int | None = None, stream: str = "intake"
    ) -> int:
        """Publish changed rows as the next version and return its number.

        A stream passes its name and batch number; a batch that is already part
        of the store is skipped, so a repeated micro-batch has no second effect.
        It also passes the version its changes were computed on: when that is
        not the newest any more, ``VersionConflict`` asks to read again.
        """
        seen = self.version()
        manifest = self._manifest(seen)
        if batch is not None and batch <= manifest["batches"].get(stream, -1):
            return seen
        if expected is not None and expected != seen:
            raise VersionConflict(f"store is at version {seen}, not {expected}")
        count = manifest["buckets"]
        # later runs sort behind earlier ones
        run = f"{_FORMAT % (seen + 1)}-0-{uuid.uuid4().hex}"
        touched = self._write(changes, run, count)
        base, deltas = dict(manifest["base"]), {b: list(r) for b, r in manifest["deltas"].items()}
        for b in map(str, touched):
            if b in base:
                deltas.setdefault(b, []).append(run)
            else:
                base[b] = run
        following = {
            "buckets": count, "base": base, "deltas": deltas,
            "batches": manifest["batches"] | ({} if batch is None else {stream: batch}),
        }
        full = {int(b) for b, runs in deltas.items() if len(runs) > self._compact_after}
        if full:
            rewritten = f"{_FORMAT % (seen + 1)}-1-{uuid.uuid4().hex}"
            self._write(self._at(following, full), rewritten, count)
            for b in map(str, full):
                base[b] = rewritten
                deltas.pop(b)
        self._publish(seen + 1, following)
        return seen + 1

    def remove_unused(self, *, keep_versions: int = 10, older_than_seconds: int = 86_400) -> int:
        """Delete versions before the last ``keep_versions``, then old folders and temporary files no version names.

        What is younger than ``older_than_seconds`` may belong to a writer at
        work and stays. Returns the number of folders deleted.
        """
        fs, numbers = self._fs(), self._numbers()
        for n in numbers[:-keep_versions] if keep_versions else []:
            fs.delete(self._path(f"_versions/{_FORMAT % n}.json"), False)
        used = set()
        for n in numbers[-keep_versions:]:
            manifest = self._manifest(n)
            used |= set(manifest["base"].values()) | {run for runs in manifest["deltas"].values() for run in runs}
        limit = (time.time() - older_than_seconds) * 1000
        removed = 0
        for status in fs.listStatus(self._path("data")) if fs.exists(self._path("data")) else []:
            if status.getPath().getName()[4:] not in used and status.getModificationTime() <= limit:
                fs.delete(status.getPath(), True)
                removed += 1
        for status in fs.listStatus(self._path("_versions")) if numbers else []:
            if status.getPath().getName().endswith(".tmp") and status.getModificationTime() <= limit:
                fs.delete(status.getPath(), False)
        return removed
