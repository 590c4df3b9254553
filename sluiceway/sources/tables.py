"""Tables partitioned by one string column, held under a path or in the catalog.

Both read one partition and replace one partition. A replacement may be computed
from the partition it replaces: the new files are put in place only after every task
has finished. A partition must have one writer at a time.

A catalog keeps where each partition lies. There ``switch_partitions`` writes the new rows to
folders of their own and then tells the catalog, in one step for each: readers see all old or all
new rows of a partition, and a run that ends before changes nothing. The old files stay for those
who still read them, until ``remove_unused``. Under a path the swap is not a transaction.

``swap_files`` replaces single files. New ones are added in one commit, then the old ones
are deleted, so a reader may see both in between.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluiceway.functions.columns import quoted
from sluiceway.operators.staging import only_partition

# The characters a partition folder name carries as %XX.
_ESCAPED = set("\"#%'*/:=?\\{[]^\x7f") | {chr(code) for code in range(1, 32)}

# The column that says which file a row is from, and the folder of partitions that were switched.
FILE = "__file"
_VERSIONS = "_versions"
_OVERWRITE_MODE = "spark.sql.sources.partitionOverwriteMode"


def _in_folder_name(text: str) -> str:
    return "".join(f"%{ord(c):02X}" if c in _ESCAPED else c for c in text)


class Buckets(NamedTuple):
    """How a table's files are divided: by a hash of ``columns``, which Spark's own shuffle shares."""

    number: int
    columns: list[str]
    sorted_by: list[str]


@dataclass(frozen=True)
class PathTable:
    """Parquet files under ``path`` in one folder per partition, with a declared schema."""

    path: str
    schema: T.StructType
    partition_column: str = "ds"

    def columns(self, spark: SparkSession) -> T.StructType:
        return self.schema

    def buckets(self, spark: SparkSession) -> None:
        """Buckets are kept by a catalog."""

    def read(self, spark: SparkSession) -> DataFrame:
        # The schema keeps the partition column a string; inference would make it a date.
        files = spark.read.schema(self.schema).parquet(self.path)
        return files.select(*map(quoted, self.schema.names))

    def read_partition(self, spark: SparkSession, value: str) -> DataFrame | None:
        """One partition, or None if it does not exist. Lists only that partition's files.

        Raises if they hold a column that the schema does not name, which a rewrite of the
        partition would delete.
        """
        data = T.StructType([f for f in self.schema if f.name != self.partition_column])
        try:
            path = f"{self.path.rstrip('/')}/{self._folder(value)}"
            found = spark.read.option("mergeSchema", "true").parquet(path)
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return None
            if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
                raise
            return spark.createDataFrame([], self.schema)  # a folder without files
        self._require_declared(found.columns, path)
        files = spark.read.schema(data).parquet(path)
        return files.withColumn(self.partition_column, F.lit(value))

    def read_with_files(self, spark: SparkSession) -> DataFrame:
        """All rows, with the file that each is from; none if there is no table yet."""
        try:
            files = spark.read.schema(self.schema).parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], self.schema).withColumn(FILE, F.lit(""))
        return files.select(*map(quoted, self.schema.names), F.col("_metadata.file_path").alias(FILE))

    def replace_partition(self, df: DataFrame) -> None:
        (
            df.select(*map(quoted, self.schema.names))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(self.partition_column)
            .parquet(self.path)
        )

    def read_partitions(self, spark: SparkSession, values: Sequence[str]) -> DataFrame | None:
        """Some partitions, or None if none of them exists. Lists only their files; see ``read_partition``."""
        there = {name for name, _ in _folders(spark, self.path)}
        folders = [f"{self.path.rstrip('/')}/{self._folder(value)}" for value in values]
        folders = [folder for folder in folders if _spelled(spark, folder) in there]
        if not folders:
            return None
        options = {"basePath": self.path, "mergeSchema": "true"}
        # The types of what is found do not matter, and inference would make the partition column a date.
        try:
            found = spark.read.options(**options).parquet(*folders)
        except AnalysisException as error:
            if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
                raise
            return None  # folders without files
        self._require_declared(found.columns, ", ".join(folders))
        files = spark.read.schema(self.schema).option("basePath", self.path).parquet(*folders)
        return files.select(*map(quoted, self.schema.names))

    def _folder(self, value: str) -> str:
        return f"{_in_folder_name(self.partition_column)}={_in_folder_name(value)}"

    def _require_declared(self, columns: Sequence[str], where: str) -> None:
        known = {name.lower() for name in self.schema.names}
        unknown = [name for name in columns if name.lower() not in known]
        if unknown:
            raise ValueError(f"{where} has columns the table does not declare: {unknown}")

    def switch_partitions(self, df: DataFrame, values: Sequence[str]) -> None:
        """Replace the partitions that the rows of ``df`` belong to."""
        self.replace_partition(df)

    def swap_files(self, gone: Sequence[str], df: DataFrame) -> None:
        """Add the rows of ``df``, which may be read from the files that are then deleted."""
        rows = df.select(*map(quoted, self.schema.names))
        rows.write.mode("append").partitionBy(self.partition_column).parquet(self.path)
        _delete(df.sparkSession, gone)
        df.sparkSession.catalog.refreshByPath(self.path)


@dataclass(frozen=True)
class CatalogTable:
    """An existing partitioned table of the session's catalog."""

    name: str
    partition_column: str = "ds"

    def columns(self, spark: SparkSession) -> T.StructType:
        return spark.table(self.name).schema

    def buckets(self, spark: SparkSession) -> Buckets | None:
        return _Described(spark, self.name).buckets

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.name)

    def read_partition(self, spark: SparkSession, value: str) -> DataFrame | None:
        return only_partition(spark.table(self.name), value, self.partition_column)

    def read_with_files(self, spark: SparkSession) -> DataFrame:
        """All rows, with the file that each is from."""
        return spark.table(self.name).select("*", F.col("_metadata.file_path").alias(FILE))

    def replace_partition(self, df: DataFrame) -> None:
        spark = df.sparkSession
        # insertInto binds by position and does not heed the writer option.
        ordered = df.select(*map(quoted, spark.table(self.name).columns))
        with _dynamic_overwrite(spark):
            ordered.write.mode("overwrite").insertInto(self.name)

    def read_partitions(self, spark: SparkSession, values: Sequence[str]) -> DataFrame | None:
        """Some partitions, which a filter selects before any file is listed."""
        return spark.table(self.name).filter(quoted(self.partition_column).isin(*values))

    def switch_partitions(self, df: DataFrame, values: Sequence[str]) -> None:
        """Replace the partitions that the rows of ``df`` belong to, each in one step of the catalog.

        A partition without rows to write stays as it is. A table whose partitions the catalog
        does not keep gets them replaced in place.
        """
        spark = df.sparkSession
        about = _Described(spark, self.name)
        if not about.keeps_partitions:
            self.replace_partition(df)
            return
        folder = f"{about.location}/{_VERSIONS}/{uuid.uuid4().hex}"
        rows = df.select(*map(quoted, spark.table(self.name).columns))
        writer = rows.write.format(about.provider).partitionBy(self.partition_column)
        if about.buckets:
            self._save_in_buckets(spark, writer, about, folder)
        else:
            writer.save(folder)
        written = {place for place, _ in _folders(spark, folder)}
        partition = f"PARTITION ({_name(self.partition_column)} = :value)"
        for value in values:
            place = f"{folder}/{_in_folder_name(self.partition_column)}={_in_folder_name(value)}"
            if _spelled(spark, place) in written:
                named = {"table": self.name, "value": value, "place": place}
                spark.sql(f"ALTER TABLE IDENTIFIER(:table) ADD IF NOT EXISTS {partition} LOCATION :place", args=named)
                spark.sql(f"ALTER TABLE IDENTIFIER(:table) {partition} SET LOCATION :place", args=named)
        if not written:
            _delete(spark, [_spelled(spark, folder)])
        spark.catalog.refreshTable(self.name)

    def _save_in_buckets(
        self, spark: SparkSession, writer: DataFrameWriter, about: _Described, folder: str
    ) -> None:
        """Files with their buckets' numbers, which Spark writes for a table of the catalog alone.

        That table is there for as long as the write; dropping it leaves its files. One that a killed run
        has left beside this one ends in ``_writing_`` and letters, and can be dropped.
        """
        other = f"{about.sibling}_writing_{uuid.uuid4().hex}`"
        first, *more = about.buckets.columns
        writer = writer.bucketBy(about.buckets.number, first, *more)
        if about.buckets.sorted_by:
            writer = writer.sortBy(*about.buckets.sorted_by)
        try:
            writer.option("path", folder).saveAsTable(other)
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {other}")

    def remove_unused(self, spark: SparkSession, older_than: float = 7 * 24 * 3600) -> list[str]:
        """Delete what ``switch_partition`` has left, if nothing was added for so many seconds.

        These are folders of replaced versions and of runs that ended before the switch, and the first
        places of partitions that lie elsewhere now. Gives the folders deleted.
        """
        about = _Described(spark, self.name)
        used = about.partition_locations()
        folders = [*_folders(spark, f"{about.location}/{_VERSIONS}"), *_folders(spark, about.location)]
        first = f"{self.partition_column}=".lower()
        limit = (time.time() - older_than) * 1000
        gone = [
            path
            for path, changed in folders
            if changed <= limit
            and not any(place == path or place.startswith(f"{path}/") for place in used)
            and (f"/{_VERSIONS}/" in path or path.rsplit("/", 1)[1].lower().startswith(first))
        ]
        _delete(spark, gone)
        return gone

    def swap_files(self, gone: Sequence[str], df: DataFrame) -> None:
        """Add the rows of ``df``, which may be read from the files that are then deleted."""
        spark = df.sparkSession
        ordered = df.select(*map(quoted, spark.table(self.name).columns))
        ordered.write.mode("append").insertInto(self.name)
        _delete(spark, gone)
        spark.catalog.refreshTable(self.name)


class _Described:
    """What the catalog says about a table."""

    def __init__(self, spark: SparkSession, name: str):
        self._spark = spark
        self._session = spark._jsparkSession.sessionState()
        self._catalog = self._session.catalog()
        self._none = spark._jvm.scala.Option.empty()
        self._table = self._session.sqlParser().parseTableIdentifier(name)
        about = self._catalog.getTableMetadata(self._table)
        self.keeps_partitions = about.tracksPartitionsInCatalog() and about.provider().get().lower() != "hive"
        self.provider = about.provider().get()
        self.sibling = about.identifier().quotedString()[:-1]
        self.buckets = None
        if about.bucketSpec().isDefined():
            spec = about.bucketSpec().get()
            by, order = spec.bucketColumnNames(), spec.sortColumnNames()
            self.buckets = Buckets(
                spec.numBuckets(), [by.apply(i) for i in range(by.size())], [order.apply(i) for i in range(order.size())]
            )
        self.location = spark._jvm.org.apache.hadoop.fs.Path(about.location()).toString()

    def partition_locations(self) -> set[str]:
        found = self._catalog.listPartitions(self._table, self._none)
        return {_spelled(self._spark, found.apply(i).location()) for i in range(found.size())}


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def _delete(spark: SparkSession, places: Iterable[str]) -> None:
    """Delete files and folders named as URIs."""
    for place in places:
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI.create(place))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _spelled(spark: SparkSession, uri) -> str:
    """A path or URI as a URI in one spelling; ``file:/`` and ``file:///`` are the same."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    return f"{full.getScheme()}://{full.getAuthority() or ''}{full.getRawPath()}".rstrip("/")


def _folders(spark: SparkSession, place: str) -> list[tuple[str, int]]:
    """The folders under a path, as URIs, and when each was changed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    return [
        (_spelled(spark, f.getPath().toUri()), f.getModificationTime())
        for f in system.listStatus(path)
        if f.isDirectory()
    ]


Table = PathTable | CatalogTable


@contextmanager
def _dynamic_overwrite(spark: SparkSession):
    before = spark.conf.get(_OVERWRITE_MODE)
    spark.conf.set(_OVERWRITE_MODE, "dynamic")
    try:
        yield
    finally:
        spark.conf.set(_OVERWRITE_MODE, before)
