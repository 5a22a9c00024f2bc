"""Exact duplicates by stateful streaming: a keyed state on disk that never expires.

Documents stream in by Structured Streaming in batches of bounded size. The state (RocksDB, files in the shared folder,
no watermark, so no key is ever dropped) holds per digest of the normalised text the number of documents, the largest
doc_id so far and a content locator, the file that document was read from. Stopping and starting again goes on from the
same state; a lost executor's share is rebuilt from its change log. When all input is in, the state is read as a table.

A digest that was hit more than once is not trusted: each document of such a group is compared, byte by byte, with the
text of the document that the state names. Documents that differ (a collision of digests) are grouped anew by their text
itself, so the result is exact for any digest function, even a poor one.

Only DataFrame functions. Grouping pre-aggregates before its shuffle, so a group with a third of all rows sends one row
per task. The comparison moves texts of hit groups only, in a join that Spark can split at a hot digest.

Texts are equal when they are after lower-casing A-Z; null counts as empty. The row with the largest doc_id stays; of
several rows with that doc_id and an equal text one stays (the others' rank is above 1); null doc_ids rank below all.
Empty tables give empty results; other columns, whatever their names, are carried by ``without_copies`` untouched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fellscan.llm.common import ascii_lower, beside, landed, shared_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Settings of the stream alone: the state on disk, without space reserved ahead for each of its many small files.
STREAM_SETTINGS = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}
BYTES_PER_BATCH = 1 << 36
#: Rows of digest and id that may be broadcast (about 30 MB); more are joined by a shuffle.
HIT_ROWS = 250_000


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _normal(docs: DataFrame) -> Column:
    return ascii_lower(F.coalesce(F.col("text"), F.lit("")))


def arrivals(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, digest and locator of a stream or table of documents."""
    return docs.select("doc_id", digest(_normal(docs)).alias("digest"), F.input_file_name().alias("locator"))


def keyed_state(stream: DataFrame, checkpoint: str) -> DataFrame:
    """Run the stream to its end and return the state: digest, n, doc_id and locator of the document that stays.

    The same checkpoint folder may be used again with more input; the state then goes on from where it was.
    """
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in STREAM_SETTINGS}
    state = stream.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "locator")).alias("last"))
    for k, v in STREAM_SETTINGS.items():
        spark.conf.set(k, v)
    try:
        query = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    table = spark.read.format("statestore").load(checkpoint)
    n, last = (F.col(f"value.{f.name}") for f in table.schema["value"].dataType.fields)
    return table.select("key.digest", n.alias("n"), last["doc_id"].alias("keep_id"), last["locator"].alias("locator"))


def document_stream(spark: SparkSession, path: str, bytes_per_batch: int = BYTES_PER_BATCH) -> DataFrame:
    """Documents of a Parquet folder or file as a stream."""
    pattern = f"{path[:-1]}[{path[-1]}]"  # a stream may not be given one file by name; as a pattern it may, and a folder too
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxBytesPerTrigger", bytes_per_batch).parquet(pattern)


def arrival_stream(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Any table as a stream of arrivals: its ids, digests and locators are written to the shared folder and read from there."""
    table = arrivals(docs, digest)
    path = shared_folder(docs.sparkSession, "dedup-arrivals")
    table.write.parquet(path)
    return docs.sparkSession.readStream.schema(table.schema).parquet(path)


def _rows(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    return docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"), "doc_id", _normal(docs).alias("normal")).withColumn("digest", digest(F.col("normal")))


def colliding(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Digests that different texts share, found by comparing each text of a hit group with the one the state names."""
    hits = landed(state.where("n > 1").select("digest", "keep_id"), "dedup-hits")
    members = beside(rows.select("doc_id", "normal", "digest"), hits, hits.count(), ["digest"], limit=HIT_ROWS)
    named = members.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.min("normal").alias("named"))
    return landed(members.join(named, "digest").where("normal <> named").select("digest").distinct(), "dedup-colliding")


def groups_of(docs: DataFrame, state: DataFrame, digest: Callable[[Column], Column] = sha256) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` (row, doc_id, digest, key), and per (doc_id, key) that occurs: digest, m rows, keep_id, group_size.

    The key is the digest; where digests collide it is the text itself.
    """
    rows = _rows(docs, digest)
    groups = state.select(F.col("digest").alias("key"), "keep_id", F.col("n").alias("group_size"))
    bad = colliding(rows, state)
    if bad.isEmpty():
        rows = rows.withColumn("key", F.col("digest"))
    else:
        rows = rows.join(bad.withColumn("bad", F.lit(True)), "digest", "left").withColumn("key", F.when(F.col("bad"), F.concat(F.lit("text:"), "normal")).otherwise(F.col("digest"))).drop("bad")
        anew = rows.where("key LIKE 'text:%'").groupBy("key").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        groups = groups.join(bad.withColumnRenamed("digest", "key"), "key", "left_anti").unionByName(anew)
    pairs = rows.groupBy("doc_id", "digest", "key").agg(F.count(F.lit(1)).alias("m"))
    return rows, pairs.join(groups, "key")


def verdicts(docs: DataFrame, state: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, digest."""
    _, pairs = groups_of(docs, state, digest)
    each = pairs.withColumn("rank", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))
    return each.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("rank") == 1)).alias("kept"), "digest")


def without_copies(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The documents that stay, with their columns."""
    state = landed(keyed_state(arrival_stream(docs, digest), shared_folder(docs.sparkSession, "dedup-state")), "dedup-groups")
    rows, pairs = groups_of(docs, state, digest)
    pairs = landed(pairs.withColumn("stays", F.col("doc_id").eqNullSafe(F.col("keep_id"))).where("NOT stays OR m > 1").select(F.col("doc_id").alias("p_id"), F.col("key").alias("p_key"), "stays"), "dedup-exceptions")
    on = (rows["key"] == pairs["p_key"]) & rows["doc_id"].eqNullSafe(pairs["p_id"])
    small = pairs.count() <= HIT_ROWS
    once = rows.join(F.broadcast(pairs) if small else pairs, on, "left_anti").select("row")
    order = Window.partitionBy("key", "doc_id").orderBy("row")
    several = pairs.where("stays")  # of all rows only those of repeated ids are wanted, so no row is shuffled to find them
    again = rows.join(F.broadcast(several) if small or several.count() <= HIT_ROWS else several, on).withColumn("rank", F.row_number().over(order)).where("rank = 1").select("row")
    return once.unionByName(again).select("row.*").toDF(*docs.columns)
