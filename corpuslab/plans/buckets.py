"""Tables that stay dealt out by a key while rounds of a loop add to them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from corpuslab.plans.storage import new_path

# Rounds after which the files of a bucket become one again.
COMPACT = 16
# Whether Spark reads buckets as such only where it sees a use for it.
AUTO = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
# Whether a join by several keys refuses tables that lie by one of them.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


@contextmanager
def together(spark: SparkSession) -> Iterator[None]:
    """Tables in buckets are read as such inside, and joins by several keys take those that lie by one of them as they are.

    Write what is built inside before the end.
    """
    given = {name: spark.conf.get(name) for name in (AUTO, ALL_KEYS)}
    try:
        for name in given:
            spark.conf.set(name, "false")
        yield
    finally:
        for name, value in given.items():
            spark.conf.set(name, value)


class Buckets:
    """Rows on disk in ``n`` buckets, or one per shuffle partition, by ``key``.

    A join or aggregation by ``key`` reads the buckets where they are: only the other side is
    shuffled, however large the table has grown. Rows are added, never changed. Files lie in the shared
    folder; the session's catalog holds their description until :meth:`close`.
    """

    def __init__(self, rows: DataFrame, key: str, label: str, n: int | None = None):
        self.spark, self.key, self.label = rows.sparkSession, key, label
        self.n = n or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.adds = 0
        self._create(rows)

    @classmethod
    def over(cls, rows: DataFrame, path: str, key: str, label: str, n: int) -> Buckets:
        """The buckets in ``path`` described again, after :meth:`close`; ``rows`` is their plain scan."""
        found = cls.__new__(cls)
        found.spark, found.key, found.label, found.n, found.adds, found.path = rows.sparkSession, key, label, n, 0, path
        found._name()
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        at = path.replace("\\", "\\\\").replace("'", "\\'")
        found.spark.sql(f"CREATE TABLE {found.name} ({columns}) USING parquet CLUSTERED BY (`{key}`) INTO {n} BUCKETS LOCATION '{at}'")
        return found

    def _name(self) -> None:
        self.name = f"{self.label.replace('-', '_')}_{uuid.uuid4().hex}"

    def _create(self, rows: DataFrame) -> None:
        self._name()
        self.path = new_path(self.spark, self.label)
        self._writer(rows).option("path", self.path).saveAsTable(self.name)

    def _writer(self, rows: DataFrame):
        return rows.write.format("parquet").bucketBy(self.n, self.key)

    def add(self, rows: DataFrame) -> None:
        """Add ``rows``, which must not be read from this table itself."""
        self._writer(rows).mode("append").option("path", self.path).saveAsTable(self.name)
        self.adds += 1
        if self.adds % COMPACT == 0:
            old = self.name
            # read by bucket, so that each is written as one file
            given = self.spark.conf.get(AUTO)
            self.spark.conf.set(AUTO, "false")
            try:
                self._create(self.read())
            finally:
                self.spark.conf.set(AUTO, given)
            self.spark.sql(f"DROP TABLE {old}")

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def close(self) -> DataFrame:
        """Forget the table's description; its rows as a plain scan."""
        schema = self.read().schema
        self.spark.sql(f"DROP TABLE {self.name}")
        return self.spark.read.schema(schema).parquet(self.path)
