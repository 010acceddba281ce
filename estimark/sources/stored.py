"""A keyed table in Parquet that is upserted, swept and cut in place.

Rows lie in hash buckets of the key. A change reads and writes the buckets it touches only, into
a folder of its own, and then publishes a manifest that names each bucket's folder: a small file
whose name is the next version, put there by one rename. Readers take the newest manifest, so a
change that dies before its rename has changed nothing, and a reader goes on with the files it
began with. The manifest records the last batch of each stream that was applied; a batch that
comes again changes nothing. One writer at a time; a second one of the same version gets an error.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from estimark.operators import lifecycle

BUCKET = "__bucket"


@dataclass
class Manifest:
    """One version of the table: schema as JSON, the folder of each bucket that has rows, and the
    last batch of each stream."""

    version: int
    key: str
    by: str
    buckets: int
    schema: str
    folders: dict[str, str] = field(default_factory=dict)
    applied: dict[str, int] = field(default_factory=dict)


class Folder:
    """A folder of the file system that its path names, by Hadoop's interface."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark.sparkContext._jvm, path.rstrip("/")
        self.fs = self.at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at(name))) if self.fs.exists(self.at(name)) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """Writes a file under another name and renames it; an error if there is one of the name."""
        draft = self.at(f"draft-{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self.fs.exists(self.at(name)) or not self.fs.rename(draft, self.at(name)):
            self.fs.delete(draft, False)
            raise FileExistsError(f"{self.path}/{name} was written by somebody else")

    def remove(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


class StoredTable:
    """The table below ``path``. ``buckets`` and ``by`` count for a new table; choose so many that a
    bucket is what a change may well rewrite. by: the column whose values share a bucket, if that
    isn't the key; a key may not change it."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64, by: str | None = None):
        self.spark, self.folder, self.path = spark, Folder(spark, path), path.rstrip("/")
        now = self.manifest() or Manifest(0, key, by or key, buckets, "")
        self.key, self.by, self.buckets = now.key, now.by, now.buckets

    def manifest(self) -> Manifest | None:
        names = [n for n in self.folder.names("manifests") if n.endswith(".json")]
        return Manifest(**json.loads(self.folder.read(f"manifests/{names[-1]}"))) if names else None

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.by).cast("string")), F.lit(self.buckets)).cast("int")

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows of the newest version, of all buckets or some."""
        now = self.manifest()
        if now is None:
            raise FileNotFoundError(f"there is no table below {self.path}")
        return self.rows(now, buckets)

    def rows(self, now: Manifest, buckets: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(now.schema))
        paths = [f"{self.path}/{folder}" for b, folder in now.folders.items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def replace(self, now: Manifest, touched: list[int], rows: DataFrame, batch: tuple[str, int] | None) -> int:
        """The next version: ``rows`` in the touched buckets, all others as they are."""
        name = f"data/{now.version + 1:012d}-{uuid.uuid4().hex}"
        if touched:
            dealt = rows.withColumn(BUCKET, self.bucket()).hint("rebalance", BUCKET)
            dealt.write.partitionBy(BUCKET).parquet(f"{self.path}/{name}")
        made = {n.split("=")[1]: f"{name}/{n}" for n in self.folder.names(name) if n.startswith(f"{BUCKET}=")} if touched else {}
        folders = {b: f for b, f in now.folders.items() if int(b) not in touched} | made
        applied = now.applied | ({batch[0]: batch[1]} if batch else {})
        self.publish(Manifest(now.version + 1, self.key, self.by, self.buckets, rows.schema.json() if touched else now.schema, folders, applied))
        return now.version + 1

    def publish(self, manifest: Manifest) -> None:
        self.folder.put(f"manifests/{manifest.version:012d}.json", json.dumps(asdict(manifest)))

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of some rows: numbers below ``buckets``, however many rows there are."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def upsert(self, rows: DataFrame, batch: tuple[str, int] | None = None, latest: list | None = None) -> int:
        """Puts rows in: the columns they have replace those of stored rows of their key, other
        columns stay, new keys are added. Of rows with one key the first by ``latest`` counts (else
        the greatest by its columns). batch: (stream, number); a number that isn't above the last
        one applied is skipped. Returns the version."""
        now = self.manifest() or Manifest(0, self.key, self.by, self.buckets, StructType(list(rows.schema)).json())
        if batch and batch[1] <= now.applied.get(batch[0], -1):
            return now.version
        kinds = {f.name: f.dataType for f in StructType.fromJson(json.loads(now.schema))}
        rows = rows.where(F.col(self.key).isNotNull()).select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in rows.columns])
        order = latest or [F.desc(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])))]
        rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy(self.key).orderBy(*order))).where("__n = 1").drop("__n")
        touched = self.touched(rows)
        return self.replace(now, touched, lifecycle.upsert(self.rows(now, touched), rows, self.key), batch)

    def change(self, rows: Column, made: Callable[[DataFrame], DataFrame]) -> int:
        """The next version with ``made`` of the buckets that hold rows of the condition."""
        now = self.manifest()
        if now is None:
            return 0
        touched = self.touched(self.rows(now).where(rows))
        return self.replace(now, touched, made(self.rows(now, touched)), None) if touched else now.version

    def sweep(self, steps: list[tuple[Column, dict[str, Column]]]) -> int:
        """Conditional updates in their order; buckets that none of them changes aren't written."""
        now = self.manifest()
        if now is None:
            return 0
        before = self.rows(now)
        changed = [c for c in before.columns if any(c in changes for _, changes in steps)]
        was = before.withColumns({f"__was_{c}": F.col(f"`{c}`") for c in changed})
        differs = F.lit(False)
        for c in changed:
            differs = differs | ~F.col(f"`{c}`").eqNullSafe(F.col(f"`__was_{c}`"))
        touched = self.touched(lifecycle.sweep(was, steps).where(differs))
        return self.replace(now, touched, lifecycle.sweep(self.rows(now, touched), steps), None) if touched else now.version

    def delete(self, rows: Column) -> int:
        gone = F.coalesce(rows, F.lit(False))
        return self.change(gone, lambda df: df.where(~gone))

    def vacuum(self, keep: int = 2) -> list[str]:
        """Removes folders and manifests that the newest ``keep`` versions don't use, and what
        changes that died have left. Only while nobody writes."""
        names = [n for n in self.folder.names("manifests") if n.endswith(".json")]
        used = {f.split("/")[1] for n in names[-keep:] for f in json.loads(self.folder.read(f"manifests/{n}"))["folders"].values()}
        gone = [f"data/{n}" for n in self.folder.names("data") if n not in used] + [f"manifests/{n}" for n in names[:-keep]] + [n for n in self.folder.names("") if n.startswith("draft-")]
        for name in gone:
            self.folder.remove(name)
        return gone
