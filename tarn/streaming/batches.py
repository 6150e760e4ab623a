"""Resumable batches over files, growing prefixes, and keep-last upserts by micro-batches."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.sources.storage import shared_folder


def available_now(source: DataFrame, each, checkpoint: str) -> None:
    """Runs ``each(batch, number)`` over what is new since the checkpoint, then ends; a second run skips what was done."""
    source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


#: Parts that the state of an upsert is kept in; a batch rewrites those that its keys fall into.
BUCKETS = 32


class State:
    """The last row of each key, in a shared folder: versions of buckets, and for each batch a manifest of the versions in force.

    A batch reads the manifest of the batch before it, writes the buckets that it touches under its own number, then its
    manifest. So a batch that is stopped at any point can run again, and a later process finds the state by its folder.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], order: list[str], buckets: int = BUCKETS):
        self.spark, self.root, self.keys, self.order, self.buckets = spark, root, keys, order, buckets

    def _there(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def manifest(self, before: int | None = None) -> dict[int, int]:
        """The version of every bucket after the last batch, or the last one before a number."""
        if not self._there(f"{self.root}/manifest"):
            return {}
        rows = self.spark.read.schema("bucket int, version long, batch long").parquet(f"{self.root}/manifest")
        rows = rows if before is None else rows.where(F.col("batch") < before)
        last = rows.agg(F.max("batch")).first()[0]
        return {r["bucket"]: r["version"] for r in rows.where(F.col("batch") == last).collect()} if last is not None else {}

    def _buckets(self, versions: dict[int, int], schema) -> DataFrame | None:
        paths = [f"{self.root}/v{v}/_bucket={b}" for b, v in sorted(versions.items())]
        return self.spark.read.schema(schema).parquet(*paths) if paths else None

    def merge(self, batch: DataFrame, number: int) -> None:
        """Merges one batch; the same number again replaces what it has written."""
        old = self.manifest(number)
        placed = batch.withColumn("_bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))
        touched = [r["_bucket"] for r in placed.select("_bucket").distinct().collect()]  # as many as there are buckets at most
        if not touched:
            return
        before = self._buckets({b: old[b] for b in touched if b in old}, batch.schema)
        both = batch if before is None else batch.unionByName(before)
        last = both.groupBy(*self.keys).agg(F.max_by(F.struct(*batch.columns), F.struct(*self.order)).alias("r")).select("r.*")
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        last.withColumn("_bucket", bucket).write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.root}/v{number}")
        now = [(b, number) for b in touched] + [(b, v) for b, v in old.items() if b not in touched]
        self.spark.createDataFrame(now, "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/batch={number}")
        self._forget(old, dict(now))

    def _forget(self, old: dict[int, int], now: dict[int, int]) -> None:
        """Deletes the versions that neither this batch's manifest nor the one before it names; the latter is what this batch would start from again."""
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        kept = {(b, v) for m in (old, now) for b, v in m.items()}
        for b, v in old.items():
            if now[b] != v:
                for older in fs.globStatus(path(f"{self.root}/v*/_bucket={b}")) or []:
                    number = int(older.getPath().getParent().getName()[1:])
                    if (b, number) not in kept and number < v:
                        fs.delete(older.getPath(), True)

    def read(self, schema, before: int | None = None) -> DataFrame:
        """The state after the last batch that is whole, or the last one before a number."""
        got = self._buckets(self.manifest(before), schema)
        return self.spark.createDataFrame([], schema) if got is None else got


def upsert(spark: SparkSession, folder: str, file: str, schema, keys: list[str], order: list[str], per_batch: int = 1, root: str | None = None) -> DataFrame:
    """The last row of each key over all files that ``file`` matches, micro-batch by micro-batch.

    State and checkpoint are kept below ``root``: called again with it, in this process or another, only new files are read
    and the state goes on. Without it a new folder is taken.
    """
    root = root or f"{shared_folder(spark)}/state-{uuid.uuid4().hex}"
    state = State(spark, root, keys, order)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).option("pathGlobFilter", file).parquet(folder)
    available_now(source, state.merge, f"{root}/checkpoint")
    return state.read(schema)


def _tried(items: DataFrame, accepted: list[Column]) -> DataFrame:
    """Items after an attempt on their rung: done, to be tried on the next rung, or quarantined behind the last."""
    ok = F.coalesce(*[F.when(F.col("rung") == r, F.coalesce(c, F.lit(False))) for r, c in enumerate(accepted)])
    last = F.col("rung") == len(accepted) - 1
    status = F.when(ok, "done").when(last, "quarantined").otherwise("retry")
    return items.withColumn("status", status).withColumn("rung", F.when(status == "retry", F.col("rung") + 1).otherwise(F.col("rung")))


def recover(spark: SparkSession, folder: str, file: str, schema, keys: list[str], accepted: list[Column], per_batch: int = 1, root: str | None = None) -> DataFrame:
    """The items of all files that ``file`` matches with ``status`` (done or quarantined) and ``rung``, the one that they ended on.

    ``accepted[r]`` says whether an item's attempt on rung r is good. Every micro-batch tries its new items on the first rung
    and, on theirs, the items that earlier ones left to be tried again; the state is kept as ``State`` does, so a batch that
    was stopped starts from the state before it and ends with the same statuses. What is still to be tried when the files
    are through goes up the rest of the ladder, without a state. A key that comes again starts anew.
    """
    root = root or f"{shared_folder(spark)}/ladder-{uuid.uuid4().hex}"
    state = State(spark, root, keys, ["_batch"])
    names = spark.createDataFrame([], schema).columns

    def attempt(batch: DataFrame, number: int) -> None:
        new = batch.dropDuplicates(keys).select(*names, F.lit(0).alias("rung"))
        kept = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in batch.schema)}, rung int, status string, _batch long"
        open_ = state.read(kept, number).where("status = 'retry'").select(*names, "rung").join(new.select(*keys), keys, "left_anti").select(*names, "rung")
        state.merge(_tried(new.unionByName(open_), accepted).withColumn("_batch", F.lit(number).cast("long")), number)

    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).option("pathGlobFilter", file).parquet(folder)
    available_now(source, attempt, f"{root}/checkpoint")
    kept = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in spark.createDataFrame([], schema).schema)}, rung int, status string, _batch long"
    out = state.read(kept).drop("_batch")
    for _ in accepted:
        settled = _tried(out.where("status = 'retry'").drop("status"), accepted).select(out.columns)
        out = out.where("status != 'retry'").unionByName(settled)
    return out


def resumable(spark: SparkSession, folder: str, file: str, schema, transform, out: str, checkpoint: str) -> DataFrame:
    """Appends ``transform`` of the files not yet done to ``out``."""
    source = spark.readStream.schema(schema).option("pathGlobFilter", file).parquet(folder)
    transform(source).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def windowed_counts(events: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """An extension beyond the survey's inventory: tumbling windows with a watermark, for streams and tables alike."""
    timed = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(F.window("_t", width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def sessions(events: DataFrame, user: str, time: str, gap: int) -> DataFrame:
    """An extension: sessions by gaps of more than ``gap`` seconds, as ``<user>, session, n``; times count to the nearest whole
    second, halves to the even one."""
    w = Window.partitionBy(user).orderBy(time)
    seconds = F.rint(F.unix_micros(F.col(time).cast("timestamp")) / 1e6)
    new = F.coalesce((seconds - F.lag(seconds).over(w) > gap).cast("int"), F.lit(0))
    return events.withColumn("_new", new).withColumn("session", F.sum("_new").over(w)).groupBy(user, "session").agg(F.count("*").alias("n"))
