"""The chunk table: Parquet, partitioned by a hash bucket of the file path.

All rows of a file live in one bucket, so changing files rewrites their
buckets only. What the table is stands in numbered files below ``_versions``,
each made once and never changed; the highest whole one counts. It names the
folders that hold rows, the number of buckets, the metadata of the vectors, and
a replacement that is being put in place.

* An insert writes a folder of its own and then names it.
* A rebuild writes a new folder and then names it alone; the folders of the
  version before stay until the next rebuild, for readers that still use them.
* An upsert writes new contents of the touched buckets to a staging folder that
  names the rows it was made from. Once a version names the staging folder,
  readers take those buckets from there, and the copy into the table can be
  repeated until it is whole. Staged work of other rows is dropped.

So a crash between any two steps leaves the old or the new table. One writer at
a time: a second one finds its version number taken and fails.
"""

from __future__ import annotations

import functools
import json
import re
import time
import uuid
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lumenseek.functions.vector import checked_dimension, has_vector
from lumenseek.schema import CHUNK_SCHEMA

BUCKET = "bucket"
#: Buckets of a table that starts empty, and rows of a bucket that a rebuild aims at.
DEFAULT_BUCKETS, ROWS_PER_BUCKET = 64, 250_000
#: Files of earlier versions that stay.
KEPT_VERSIONS = 8
#: Replaced files up to which their paths are sent to every task; the rows that stay then need no shuffle.
SENT_PATHS = 100_000


@dataclass(frozen=True)
class IndexMetadata:
    dimension: int
    model: str
    provider: str
    created_at: int
    last_updated: int


@dataclass(frozen=True)
class Version:
    """What the table is: ``folders`` with rows, and a name of its ``rows`` that changes when they do."""

    folders: list[str] = field(default_factory=list)
    buckets: int | None = None
    metadata: dict | None = None
    #: Folder below ``_staged`` whose buckets take the place of those in the table.
    staged: str | None = None
    rows: str | None = None


@dataclass(frozen=True)
class IndexStats:
    chunk_count: int
    file_count: int
    storage_size: int


class DimensionMismatch(ValueError):
    pass


def index_stats(chunks: DataFrame) -> DataFrame:
    """One row: chunks and distinct files. Reads the path column only."""
    return chunks.agg(F.count(F.lit(1)).alias("chunk_count"), F.count_distinct("file_path").alias("file_count"))


def valid_rows(chunks: DataFrame) -> DataFrame:
    return chunks.where(has_vector(F.col("vector")))


class BucketedTable:
    """Rows by ``file_path`` that are replaced file by file."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, buckets: int | None = None):
        """``buckets`` is for new tables; an existing one keeps its own, and another number is refused."""
        self.spark, self.path, self.schema, self.wanted = spark, path.rstrip("/"), schema, buckets
        stored = self._live().buckets
        if buckets and stored and stored != buckets:
            raise ValueError(f"the table below {self.path} has {stored} buckets, not {buckets}")

    # -- versions -----------------------------------------------------------------------
    def _numbers(self) -> list[int]:
        return sorted(int(name[1:-5]) for name in self._names(f"{self.path}/_versions") if re.fullmatch(r"v\d+\.json", name))

    def _live(self) -> Version:
        """The highest version that was written whole."""
        for number in reversed(self._numbers()):
            try:
                return Version(**self._read_json(f"{self.path}/_versions/v{number:012d}.json"))
            except (ValueError, TypeError):
                continue  # its writer died in the middle
        return Version()

    def _point_to(self, version: Version) -> None:
        """Make a version the live one: its file must not exist yet."""
        numbers = self._numbers()
        target = f"{self.path}/_versions/v{(numbers[-1] if numbers else 0) + 1:012d}.json"
        self._write_json(target, asdict(version))
        for number in numbers[:-KEPT_VERSIONS]:
            self._delete(f"{self.path}/_versions/v{number:012d}.json")

    @property
    def buckets(self) -> int:
        return self._live().buckets or self.wanted or DEFAULT_BUCKETS

    # -- file system --------------------------------------------------------------------
    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _exists(self, path: str) -> bool:
        fs, target = self._fs(path)
        return fs.exists(target)

    def _delete(self, path: str) -> None:
        if not path.startswith(self.path + "/"):
            raise ValueError(f"refusing to delete {path} outside {self.path}")
        fs, target = self._fs(path)
        fs.delete(target, True)

    def _names(self, path: str) -> list[str]:
        """Names of what lies in a folder, from one listing."""
        fs, target = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []

    # -- reading ---------------------------------------------------------------------------
    def bucket_of(self, file_path: Column, buckets: int | None = None) -> Column:
        return F.pmod(F.xxhash64(file_path), F.lit(buckets or self.buckets)).cast("int")

    def exists(self) -> bool:
        return bool(self._folders(self._live()))

    def _folders(self, version: Version) -> list[str]:
        """Folders with rows; one without any rows is never made."""
        return [f for f in (f"{self.path}/{name}" for name in version.folders) if self._exists(f)]

    def _rows_in(self, *folders: str) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        there = [f for f in folders if self._exists(f)]
        if not there:
            return self.spark.createDataFrame([], schema)
        # One partitioned root per read; Spark does not take several at once.
        return functools.reduce(DataFrame.union, [self.spark.read.schema(schema).parquet(f) for f in there])

    def _read(self) -> DataFrame:
        version = self._live()
        rows = self._rows_in(*(f"{self.path}/{name}" for name in version.folders))
        if version.staged is None:
            return rows
        staged = f"{self.path}/_staged/{version.staged}"
        return rows.join(self._touched(staged), BUCKET, "left_anti").select(rows.columns).unionByName(self._rows_in(f"{staged}/rows"))

    def _touched(self, staged: str) -> DataFrame:
        return self.spark.read.schema(f"{BUCKET} int").parquet(f"{staged}/touched")

    def rows_for(self, paths: DataFrame) -> DataFrame:
        """Rows of the files in ``paths``; only their buckets are read."""
        wanted = paths.select("file_path").distinct().withColumn(BUCKET, self.bucket_of(F.col("file_path")))
        return self._read().join(wanted, [BUCKET, "file_path"], "left_semi").drop(BUCKET)

    def read(self) -> DataFrame:
        return self._read().drop(BUCKET)

    def file_rows(self, file_path: str) -> DataFrame:
        """Chunks of one file; only its bucket is read."""
        here = self.bucket_of(F.lit(file_path))
        return self._read().where((F.col(BUCKET) == here) & (F.col("file_path") == file_path)).drop(BUCKET)

    def is_ready(self) -> bool:
        return self.exists() and not self.read().isEmpty()

    def count(self) -> int:
        return self.read().count()

    def storage_size(self) -> int:
        """Bytes below the store folder, as the file system sums them."""
        fs, target = self._fs(self.path)
        return fs.getContentSummary(target).getLength() if fs.exists(target) else 0

    # -- writing ----------------------------------------------------------------------------
    def _shaped(self, rows: DataFrame, dimension: int | None) -> DataFrame:
        return rows.select(*[F.col(f.name).cast(f.dataType.simpleString()).alias(f.name) for f in self.schema.fields])

    def _laid_out(self, rows: DataFrame, buckets: int | None = None, dimension: int | None = None) -> DataFrame:
        """Table columns, spread for the write.

        Rebalancing lets AQE split a bucket that one file dominates and merge
        small ones, where repartitioning by bucket would write it in one task.
        """
        return self._shaped(rows, dimension).withColumn(BUCKET, self.bucket_of(F.col("file_path"), buckets)).hint("rebalance", BUCKET)

    def insert(self, chunks: DataFrame) -> None:
        """Append rows; the first insert creates the table."""
        self.recover()
        folder = f"chunks-{uuid.uuid4().hex}"
        self._laid_out(chunks).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        live = self._live()
        self._point_to(replace(live, folders=[*live.folders, folder], buckets=self.buckets, rows=uuid.uuid4().hex))

    def delete_files(self, paths: DataFrame) -> None:
        """Delete every chunk of the files in ``paths(file_path)``."""
        self.upsert(paths, None)

    def upsert(self, paths: DataFrame, chunks: DataFrame | None) -> None:
        """Replace all chunks of the files in ``paths`` by ``chunks``.

        A path without new chunks is thereby deleted. Paths, chunks and the
        numbers of the touched buckets stay distributed.
        """
        self.recover()
        live = self._live()
        paths = paths.groupBy("file_path").agg(F.count(F.lit(1)).alias("_n")).select("file_path")
        staged = f"{self.path}/_staged/{uuid.uuid4().hex}"
        paths.groupBy(self.bucket_of(F.col("file_path")).alias(BUCKET)).agg(F.count(F.lit(1)).alias("paths")).write.parquet(f"{staged}/touched")
        replaced = self.spark.read.schema("paths bigint").parquet(f"{staged}/touched").agg(F.sum("paths")).first()[0]
        if replaced is None:
            self._delete(staged)
            return
        self._replaced(staged, paths, replaced, chunks).write.partitionBy(BUCKET).parquet(f"{staged}/rows")
        self._write_json(f"{staged}/ready.json", {"rows": live.rows})
        self._apply(staged)

    def _replaced(self, staged: str, paths: DataFrame, count: int, chunks: DataFrame | None) -> DataFrame:
        """New contents of the touched buckets: the rows of other files than the ``count`` paths, and the chunks.

        Rows that stay lie by bucket as they are read, so only new ones are
        spread. With too many paths to send, the rows that stay are joined by
        path and spread again.
        """
        columns = [*self.schema.fieldNames(), BUCKET]
        few = count <= SENT_PATHS
        kept = self._read().join(self._touched(staged), BUCKET, "left_semi").join(
            F.broadcast(paths) if few else paths, "file_path", "left_anti").select(columns)
        new = [] if chunks is None else [self._laid_out(chunks).select(columns)]
        rows = functools.reduce(DataFrame.unionByName, [*new, kept])
        return rows if few else rows.hint("rebalance", BUCKET)

    def recover(self) -> None:
        """Finish a replacement that was staged for the rows that are live, and drop what else lies in staging."""
        for name in self._names(f"{self.path}/_staged"):
            staged, live = f"{self.path}/_staged/{name}", self._live()
            ready = None
            if self._exists(f"{staged}/ready.json"):
                try:
                    ready = self._read_json(f"{staged}/ready.json")
                except ValueError:
                    pass  # cut short, as if it were not there
            if live.staged == name or (live.staged is None and ready is not None and ready["rows"] == live.rows):
                self._apply(staged)
            elif live.staged != name:
                self._delete(staged)

    def _apply(self, staged: str) -> None:
        """Name the staged buckets in a version, copy them into the first folder, and name the table without them."""
        name, live = staged.rsplit("/", 1)[1], self._live()
        if live.staged != name:
            folders = live.folders or [f"chunks-{uuid.uuid4().hex}"]
            live = replace(live, folders=folders, buckets=self.buckets, staged=name)
            self._point_to(live)
        table, *more = (f"{self.path}/{folder}" for folder in live.folders)
        filled = {n for n in self._names(f"{staged}/rows") if n.startswith(f"{BUCKET}=")}
        if filled:
            (self._rows_in(f"{staged}/rows").write.option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET)
             .mode("overwrite").parquet(table))
        touched = {f"{BUCKET}={r[0]}" for r in self._touched(staged).collect()}
        for folder, gone in [(table, touched - filled), *((f, touched) for f in more)]:
            for bucket in gone & set(self._names(folder)):
                self._delete(f"{folder}/{bucket}")
        self._point_to(replace(live, staged=None, rows=uuid.uuid4().hex))
        self._delete(staged)

    def replace_all(self, chunks: DataFrame, metadata: IndexMetadata | None = None) -> None:
        """Make ``chunks`` the whole content, in as many buckets as their number asks for.

        ``metadata`` becomes that of the new rows in the same step. Readers of
        the version before keep its folders until the next rebuild.
        """
        live = self._live()
        buckets = self.wanted or max(1, -(-self._shaped(chunks, metadata and metadata.dimension).count() // ROWS_PER_BUCKET))
        folder = f"chunks-{uuid.uuid4().hex}"
        laid_out = self._laid_out(chunks, buckets, metadata.dimension if metadata else None)
        laid_out.write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        self._point_to(Version([folder], buckets, asdict(metadata) if metadata else live.metadata, rows=uuid.uuid4().hex))
        for name in self._names(self.path):
            if name.startswith("chunks-") and name != folder and name not in live.folders:
                self._delete(f"{self.path}/{name}")
        # Whatever is staged was made from rows that are gone, unless readers of the version before need it.
        for name in self._names(f"{self.path}/_staged"):
            if name != live.staged:
                self._delete(f"{self.path}/_staged/{name}")

    def clear(self) -> None:
        if self._numbers():
            self._point_to(Version())
        for name in sorted(self._names(self.path), key=lambda n: n == "_versions"):
            self._delete(f"{self.path}/{name}")

    @contextmanager
    def staged(self, df: DataFrame, name: str):
        """``df`` as a table written below the store, gone when the block ends."""
        folder = f"{self.path}/_work/{name}"
        df.write.mode("overwrite").parquet(folder)
        try:
            yield self.spark.read.schema(df.schema).parquet(folder)
        finally:
            self._delete(folder)

    # -- metadata ------------------------------------------------------------------------------
    def _read_json(self, path: str) -> dict:
        fs, target = self._fs(path)
        source = fs.open(target)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()

    def _write_json(self, path: str, value: dict) -> None:
        """A new file; one that exists is not replaced."""
        fs, target = self._fs(path)
        out = fs.create(target, False)
        try:
            out.write(bytearray(json.dumps(value).encode()))
        finally:
            out.close()


class ChunkStore(BucketedTable):
    """The table of chunks and vectors, with the metadata of the vectors and the errors of the last build."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        super().__init__(spark, path, CHUNK_SCHEMA, buckets)

    def _shaped(self, rows: DataFrame, dimension: int | None) -> DataFrame:
        """Rows that have a vector, of the index's dimension if it is known."""
        meta = self.metadata()
        dimension = dimension or (meta.dimension if meta else None)
        vector = checked_dimension(F.col("vector"), dimension) if dimension else F.col("vector")
        return super()._shaped(valid_rows(rows).withColumn("vector", vector), dimension)

    def rows_of(self, hits: list) -> DataFrame:
        """Full rows of a few known hits with ``id`` and ``file_path``.

        The ids are literals, so whole buckets and row groups are skipped
        instead of reading the texts of the table to keep a handful.
        """
        if not hits:
            return self.read().limit(0)
        paths = sorted({h["file_path"] for h in hits})
        where = self.spark.createDataFrame([(p,) for p in paths], "file_path string").select(
            self.bucket_of(F.col("file_path")).alias(BUCKET)).distinct()
        buckets = [r[0] for r in where.collect()]
        ids = [h["id"] for h in hits]
        return self._read().where(
            F.col(BUCKET).isin(buckets) & F.col("file_path").isin(paths) & F.col("id").isin(ids)).drop(BUCKET)

    def stats(self) -> IndexStats:
        row = index_stats(self.read()).first()
        return IndexStats(row.chunk_count, row.file_count, self.storage_size())

    def write_errors(self, errors: DataFrame) -> str:
        """Replace the table of what the last build could not index; returns its folder."""
        errors.write.mode("overwrite").parquet(f"{self.path}/errors")
        return f"{self.path}/errors"

    def errors(self) -> DataFrame:
        """``file_path``, ``stage`` and ``error`` of the last build."""
        schema = "file_path string, stage string, error string"
        if not self._exists(f"{self.path}/errors"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/errors")

    def metadata(self) -> IndexMetadata | None:
        """What the index was built with; None if unknown or unreadable."""
        try:
            return IndexMetadata(**(self._live().metadata or {}))
        except TypeError:
            return None

    def next_metadata(self, dimension: int, model: str, provider: str) -> IndexMetadata:
        """Metadata for new rows; a known index keeps its time of creation."""
        now, old = int(time.time() * 1000), self.metadata()
        return (replace(old, dimension=dimension, model=model, provider=provider, last_updated=now) if old
                else IndexMetadata(dimension, model, provider, now, now))

    def set_metadata(self, dimension: int, model: str, provider: str) -> IndexMetadata:
        meta = self.next_metadata(dimension, model, provider)
        self._point_to(replace(self._live(), metadata=asdict(meta)))
        return meta

    def check_dimension(self, dimension: int) -> None:
        meta = self.metadata()
        if meta and meta.dimension != dimension:
            raise DimensionMismatch(
                f"index holds {meta.dimension}-dimensional vectors of {meta.model}, "
                f"the current model makes {dimension}; clear the index and build it again")
