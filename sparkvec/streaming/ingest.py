"""Streams: micro-batched ingest with acknowledgements, deduplication, last writer wins, windows, replay.

State is bounded by watermarks. Batches are written through ``foreachBatch``; the store makes a batch and its number visible by one rename, and
skips a number that it has, so neither a crash between two writes nor a restart from the checkpoint writes anything twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from sparkvec.operators.text_search import TextIndex, documents
from sparkvec.sources.store import Store


def files(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    """A folder of parquet files as a stream; the files per batch bound the rate."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def into(stream: DataFrame, store: Store, path: str, checkpoint: str, ack: Callable[[dict], None] | None = None, min_rows: int = 0, name: str = "stream") -> StreamingQuery:
    """Append every micro-batch to a dataset, each once for a stream's ``name``; ``ack`` gets ``{status, batch_id, rows}``.

    Batches of fewer than ``min_rows`` rows are written to one file.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.count()
        done = store.insert(path, batch.coalesce(1) if rows < min_rows else batch, name, batch_id)
        if ack:
            ack({"status": done["status"], "batch_id": batch_id, "rows": rows})

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(stream: DataFrame, keys: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def marked(rows: DataFrame, ts: str, late: str) -> DataFrame:
    """A stream with its watermark (whose column must have a time zone); a table as it is."""
    return rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if rows.isStreaming else rows


def window_counts(stream: DataFrame, ts: str, by: str, value: str, size: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """``(start, <by>, n, total)`` of tumbling or sliding windows; works on streams and tables alike."""
    rows = marked(stream, ts, late)
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return rows.groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(stream: DataFrame, ts: str, by: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """``(<by>, start, end, n)`` of sessions that a gap ends."""
    rows = marked(stream, ts, late)
    g = rows.groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return g.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def latest(stream: DataFrame, key: str, ts: str, value: str, late: str = "1 hour", keep_seconds: int = 3600) -> DataFrame:
    """Last writer wins over a stream: ``(key, ts, value)`` whenever a key gets a newer row; a key's state ends ``keep_seconds`` behind the watermark."""
    kinds = dict(stream.dtypes)
    out = f"{key} {kinds[key]}, {ts} timestamp, {value} {kinds[value]}"

    def update(k: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = state.get[0] if state.exists else -1
        best, val = known, None
        for df in rows:
            t = df[ts].astype("int64") if str(df[ts].dtype).endswith("us]") else df[ts].astype("datetime64[us]").astype("int64")
            i = t.to_numpy().argmax()
            if t.iloc[i] > best:
                best, val = int(t.iloc[i]), df[value].iloc[i]
        if best > known:
            state.update((best,))
            yield pd.DataFrame({key: [k[0]], ts: pd.to_datetime([best], unit="us"), value: [val]})
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, best // 1000 + keep_seconds * 1000))

    return stream.withWatermark(ts, late).groupBy(key).applyInPandasWithState(update, out, "seen bigint", "update", GroupStateTimeout.EventTimeTimeout)


def term_counts(stream: DataFrame, text: str) -> DataFrame:
    """Running counts of terms over a stream of texts, for incremental keyword statistics."""
    from sparkvec.functions.text import tokenize

    return stream.select(F.explode(tokenize(F.col(text))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def indexed(stream: DataFrame, index: TextIndex, id_col: str, text_cols: list[str], checkpoint: str) -> StreamingQuery:
    """Add every micro-batch's texts to a keyword index: postings, lengths and document counts."""
    return stream.writeStream.foreachBatch(lambda batch, _: index.add(documents(batch, id_col, *text_cols))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay(store: Store, source: str, target: str, after: int = 0) -> int:
    """Apply the batches of one dataset with a sequence number above ``after`` to another, once; the last number applied."""
    after = max(after, store.applied(target, source) or 0)
    rows = store.changes(source, after)
    last = rows.agg(F.max("_seq")).first()[0]
    if last is not None:
        store.insert(target, rows.where(F.col("_seq") <= last).drop("_seq"), source, last)
    return last or after
