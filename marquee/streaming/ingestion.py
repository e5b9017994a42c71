"""Exactly-once ingestion of observation streams, and the rate limiter as a stateful operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.operators.merge import ingest


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.read.schema(schema).parquet(path) if fs.exists(hadoop.Path(path)) else spark.createDataFrame([], schema)


LOG = "identity string, seq long, content string, keys array<string>, batch long"


def batch_writer(log_path: str, out_path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function. The observation log is the replay memory: it never forgets a key, as watermarked
    dropDuplicates would, and late observations count whenever they come, in order of arrival.

    Only identities of the batch are read back (semi join). Log and actions are written per batch into a folder of its
    own, overwritten on a retry, so a batch that ran twice counts once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        slim = batch.select("identity", "seq", "content", "keys")
        before = read_table(spark, log_path, LOG).where(F.col("batch") < batch_id).select("identity", "seq", "content", "keys")
        mine = before.join(slim.select("identity").distinct(), "identity", "left_semi").unionByName(slim)
        actions = ingest(mine).join(slim.select("identity", "seq"), ["identity", "seq"], "left_semi")
        actions.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
        slim.write.mode("overwrite").parquet(f"{log_path}/batch={batch_id}")

    return write


def start_ingestion(observations: DataFrame, log_path: str, out_path: str, checkpoint: str):
    return observations.writeStream.foreachBatch(batch_writer(log_path, out_path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str, key: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts per tumbling window and key with a bound on lateness; for streams and batches alike."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), key, "n")


def limited(requests: DataFrame, most: int, window_s: int) -> DataFrame:
    """(client, seq, accepted) of a stream of (client, seq, at): state per client is its accepted requests of the last
    window, at most ``most`` timestamps, dropped when a window passes without any."""
    import pandas as pd

    def step(key, batches, state):
        log = list(state.get[0]) if state.exists else []
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["us", "seq"])
        out = []
        for seq, us in rows[["seq", "us"]].itertuples(index=False):
            log = [t for t in log if us - t < window_s * 1_000_000]
            ok = len(log) < most
            if ok:
                log.append(int(us))
            out.append((key[0], int(seq), ok))
        state.update((log,))
        state.setTimeoutDuration(window_s * 1000)
        yield pd.DataFrame(out, columns=["client", "seq", "accepted"])

    slim = requests.select("client", "seq", F.unix_micros("at").alias("us"))
    return slim.groupBy("client").applyInPandasWithState(step, "client string, seq long, accepted boolean", "log array<long>", "append", "ProcessingTimeTimeout")
