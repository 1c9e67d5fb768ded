"""Exact deduplication by a stateful stream.

The keyed state (digest -> best copy's size, stable id and content locator, and the count) is a streaming
aggregate without a watermark: it never expires, and it lives in RocksDB on the executors' disks, with its
changelog in the shared folder, so a lost executor costs a reload. A hit on a digest is no proof: the whole
normalised bytes of every further copy are compared with those of the copy that stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, remove, small, workspace

WHITE = " \t\n\x0b\x0c\r"
#: Micro-batches that the rows are streamed in unless told otherwise, and bytes of texts that may be broadcast.
BATCHES, BROADCAST_BYTES = 3, 8_000_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(text="text"):
    """The text without the six ASCII white space characters; null counts as empty."""
    out = F.coalesce(F.col(text).cast("string"), F.lit(""))
    for ch in WHITE:
        out = F.replace(out, F.lit(ch), F.lit(""))
    return out


def sha256(norm):
    return F.unhex(F.sha2(norm, 256))


def digested(docs: DataFrame, digest=sha256) -> DataFrame:
    """(doc_id, digest binary, points): what the stream needs of each row."""
    points = F.char_length(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.select("doc_id", digest(normalised().cast("binary")).alias("digest"), points.alias("points"))


def dedup_state(stream: DataFrame) -> DataFrame:
    """The stateful operator itself, on a stream of (doc_id, digest, points, locator): the groups that changed."""
    best = F.max(F.struct("points", F.bitwise_not("doc_id").alias("not_id"), F.bitwise_not("locator").alias("not_locator")))
    return stream.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("n"))


def run_stream(spool: DataFrame, path: str, files_per_trigger: int) -> DataFrame:
    """Stream the spool in micro-batches through the state; one row per digest as the state ends."""
    spark = spool.sparkSession
    own = spark.newSession()
    for k, v in {
        "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions"),
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
        # A store leaves its executor when its task is done, so that disk and memory hold a few stores, not all.
        "spark.sql.streaming.stateStore.unloadOnCommit": "true",
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "96",
    }.items():
        own.conf.set(k, v)
    stream = own.readStream.schema(spool.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path}/spool")

    def sink(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/changes/batch={batch}")

    query = (
        dedup_state(stream)
        .writeStream.outputMode("update")
        .option("checkpointLocation", f"{path}/state")
        .trigger(availableNow=True)
        .foreachBatch(sink)
        .start()
    )
    query.awaitTermination()
    changes = "digest binary, best struct<points int, not_id long, not_locator long>, n long, batch int"
    # The count only grows, so the largest one is the last.
    return spark.read.schema(changes).parquet(f"{path}/changes").groupBy("digest").agg(F.max(F.struct("n", "best")).alias("s")).select("digest", "s.*")


def exact_groups(docs: DataFrame, files_per_trigger: int | None = None, digest=sha256) -> DataFrame:
    """Each row of docs with its group: doc_id, digest, points, keep_id, group_size, kept, verified.

    Of equal texts the row with the most code points stays, then the smallest doc_id, then the earliest row; of
    exactly repeated rows one stays. Null texts count as empty, null ids lose to others; extra columns, whatever their
    names, are ignored; no rows give no rows. verified: the row's bytes were compared with those of the row that stays
    in its digest's group, or it is alone. Where bytes differ under one digest, the rows of that digest are grouped by their whole
    texts instead, and are marked as not verified by it.
    """
    spark = docs.sparkSession
    path = workspace(spark, "exact-dedup")
    digested(docs, digest).withColumn("locator", F.monotonically_increasing_id()).write.parquet(f"{path}/spool")
    spool = spark.read.parquet(f"{path}/spool")
    if spool.isEmpty():
        groups = cut(spark.createDataFrame([], "digest binary, n long, best struct<points int, not_id long, not_locator long>"))
    else:
        groups = cut(run_stream(spool, path, files_per_trigger or -(-len(spool.inputFiles()) // BATCHES)))
    out = cut(
        spool.join(groups, "digest").select(
            "doc_id", "digest", "points",
            F.bitwise_not("best.not_id").alias("keep_id"),
            F.col("n").alias("group_size"),
            (F.col("locator") == F.bitwise_not("best.not_locator")).alias("kept"),
        )
    )
    remove(spark, path)
    verified = out.withColumn("verified", F.lit(True))
    mixed = cut(mismatches(docs, out.where("group_size > 1"), digest))
    if mixed.isEmpty():
        return verified
    whole = Window.partitionBy("digest", "norm")
    order = whole.orderBy(F.desc("points"), F.col("doc_id").asc_nulls_last())
    texts = digested_texts(docs, digest).join(mixed, "digest", "left_semi")
    apart = texts.select(
        "doc_id", "digest", "points", F.first("doc_id").over(order).alias("keep_id"), F.count(F.lit(1)).over(whole).alias("group_size"),
        (F.row_number().over(order) == 1).alias("kept"), F.lit(False).alias("verified"),
    )
    return verified.join(mixed, "digest", "left_anti").select(*apart.columns).unionByName(apart)


def digested_texts(docs: DataFrame, digest) -> DataFrame:
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).alias("points"), normalised().alias("norm"))
    return rows.withColumn("digest", digest(F.col("norm").cast("binary")))


def mismatches(docs: DataFrame, hits: DataFrame, digest=sha256) -> DataFrame:
    """The digests under which a row's full normalised bytes differ from those of the row that stays.

    Only rows of digests that were hit take part: those keys are broadcast if a count shows that they are few,
    and joined by a shuffle otherwise. The texts that stay are a table of one row for each group, broadcast if their bytes
    are few; else the join by digest has one row on its right for each group, so a group of any size can be split between tasks.
    """
    keep = cut(hits.where("kept").select("digest", "keep_id"))
    texts = digested_texts(docs, digest).join(small(keep), "digest")
    own = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    right = cut(texts.where(own).groupBy("digest").agg(F.min("norm").alias("keep_norm")))
    size = right.agg(F.sum(F.octet_length("keep_norm"))).first()[0] or 0
    right = F.broadcast(right) if size <= BROADCAST_BYTES else right
    # Of rows that repeat the keeper's id, one is the right side itself.
    return texts.join(right, "digest").where("norm <> keep_norm").select("digest").distinct()


def drop_exact_duplicates(docs: DataFrame, files_per_trigger: int | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns; edge cases as in exact_groups."""
    groups = cut(exact_groups(docs, files_per_trigger).select("doc_id", "digest", "kept"))
    key = F.unhex(F.sha2(normalised().cast("binary"), 256))
    gone = cut(groups.groupBy("doc_id", "digest").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")))
    drop = gone.where("not kept").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"))
    again = gone.where("kept and n > 1").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"))
    on = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__digest"))
    rest = docs.withColumn("__key", key).join(small(drop), on, "left_anti")
    if n_again := again.count():
        once = rest.join(small(again, n_again), on, "left_semi").dropDuplicates(["doc_id", "__key"])
        rest = rest.join(small(again, n_again), on, "left_anti").unionByName(once)
    return rest.drop("__key")


def op2_exact_dedup(docs: DataFrame) -> DataFrame:
    """The groups with the digest in hexadecimal; edge cases as in exact_groups."""
    return exact_groups(docs).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"), "verified"
    )
