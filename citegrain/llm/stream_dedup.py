"""Operator 11: exact de-duplication as a stateful stream.

Files of documents arrive as a stream. Per digest of the text the stream keeps, on disk (RocksDB) and without expiry,
the stable identifier of the document that stays, its content locator (file and row), and how many rows carry the
digest. Rows are combined per digest before they reach the state, so a text that a third of all rows share costs the
state one row per task. A later run goes on from the committed state and reads only files that are new.

A hit, a row whose digest the state knows from another row, counts as equal only after its full bytes were compared
with the content at the locator. Digests under which bytes differ are grouped by the bytes themselves.

Defined results: null and empty texts are equal; of rows with equal text and equal id the one with the larger locator
stays; null ids are below all others, and ``keep_id`` is null only if all ids of a group are; an empty table
gives no rows; whole texts are read; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from citegrain.llm.common import stored
from citegrain.session import shared_dir

# Bytes of files that one micro-batch takes; each batch commits its changes of the state once.
BATCH_BYTES = 64 << 30
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # a state of many small partitions would otherwise reserve megabytes of disk for each
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256(text: Column) -> Column:
    """The 32 bytes of a text's SHA-256."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


class Deduplicator:
    """Equal texts of a Parquet table that grows by files; ``folder`` holds the durable state between runs."""

    def __init__(
        self, spark: SparkSession, path: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text",
        digest: Callable[[Column], Column] = sha256, batch_bytes: int = BATCH_BYTES,
    ):
        self.spark, self.path, self.id_col, self.text_col, self.digest, self.batch_bytes = spark, path, id_col, text_col, digest, batch_bytes
        if folder is None:
            folder = f"{shared_dir(spark).rstrip('/')}/citegrain-llm/dedup-state-{uuid.uuid4().hex}"
            self._files(folder).deleteOnExit(self._path(folder))
        self.folder = folder
        self.schema = spark.read.parquet(path).schema

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _files(self, name: str):
        return self._path(name).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _rows(self, source: DataFrame) -> DataFrame:
        """Digest, text and stable locator of each row."""
        text = F.coalesce(F.col(self.text_col).cast("string"), F.lit(""))
        place = source.metadataColumn("_metadata")
        at = F.struct(F.col(self.id_col).alias("id"), place["file_path"].alias("file"), place["row_index"].alias("row"))
        return source.select(text.alias("text"), at.alias("at")).select(self.digest(F.col("text")).alias("digest"), "at", "text")

    @contextlib.contextmanager
    def _state_settings(self):
        before = {k: self.spark.conf.get(k, None) for k in STATE_SETTINGS}
        for k, v in STATE_SETTINGS.items():
            self.spark.conf.set(k, v)
        try:
            yield
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def advance(self) -> Deduplicator:
        """Take all files that are there and new into the state; a run that was cut off is finished by the next one."""
        # as a pattern the path may be one file as well as a folder, which the stream's source alone does not take
        source = self.spark.readStream.schema(self.schema).option("maxBytesPerTrigger", str(self.batch_bytes))
        rows = self._rows(source.parquet(f"{self.path[:-1]}[{self.path[-1]}]"))
        state = rows.groupBy("digest").agg(F.max("at").alias("keep"), F.count("*").alias("n"))
        with self._state_settings():
            stream = state.writeStream.outputMode("update").format("noop").trigger(availableNow=True)
            stream.option("checkpointLocation", self.folder).start().awaitTermination()
        return self

    def state(self) -> DataFrame:
        """The committed state: digest, keep (id, file, row) and n."""
        if not self._files(self.folder).exists(self._path(f"{self.folder}/commits/0")):
            id_type = self.schema[self.id_col].dataType.simpleString()
            return self.spark.createDataFrame([], f"digest binary, keep struct<id:{id_type},file:string,row:bigint>, n bigint")
        with self._state_settings():
            found = self.spark.read.format("statestore").load(self.folder)
        return found.select("key.digest", F.col("value.max").alias("keep"), F.col("value.count").alias("n"))

    def collisions(self, state: DataFrame) -> DataFrame:
        """Digests of hits whose bytes differ from the content at the state's locator, once per such hit."""
        shared = state.where("n > 1").select("digest", "keep")
        rows = self._rows(self.spark.read.schema(self.schema).parquet(self.path)).join(shared, "digest")
        hits = stored(rows.select("digest", "text", (F.col("at") == F.col("keep")).alias("first")), "dedup-hits")
        first = hits.where("first").select("digest", F.col("text").alias("content"))
        return stored(hits.where("NOT first").join(first, "digest").where("text != content").select("digest"), "dedup-collisions")

    def report(self) -> DataFrame:
        """Each row of the files taken so far: id, keep_id, group_size, kept and digest."""
        state = self.state()
        rows = self._rows(self.spark.read.schema(self.schema).parquet(self.path))
        differing = self.collisions(state)
        found = rows.drop("text").join(state, "digest")
        if not differing.isEmpty():
            digests = differing.distinct()
            again = rows.join(digests, "digest")
            groups = again.groupBy("digest", "text").agg(F.max("at").alias("keep"), F.count("*").alias("n"))
            again = again.join(groups, ["digest", "text"]).select("digest", "at", "keep", "n")
            found = found.join(digests, "digest", "left_anti").unionByName(again)
        return found.select(
            F.col("at.id").alias(self.id_col), F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"),
            (F.col("at") == F.col("keep")).alias("kept"), "digest",
        )


def deduplicate(spark: SparkSession, path: str, **options) -> DataFrame:
    """The report on a whole table by a state of its own."""
    return Deduplicator(spark, path, **options).advance().report()
