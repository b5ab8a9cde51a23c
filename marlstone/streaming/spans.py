"""Observability spans: ingest from OTLP JSON files, latest-wins storage, retention, windows."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.shared import Files

#: One OTLP/JSON export request a line.
REQUEST = "resourceSpans array<struct<resource:struct<attributes:array<struct<key:string,value:struct<stringValue:string,intValue:string,boolValue:boolean,doubleValue:double>>>>,scopeSpans:array<struct<spans:array<struct<traceId:string,spanId:string,parentSpanId:string,name:string,startTimeUnixNano:string,endTimeUnixNano:string,status:struct<code:int>,attributes:array<struct<key:string,value:struct<stringValue:string,intValue:string,boolValue:boolean,doubleValue:double>>>>>>>>>"
SPANS = "trace_id string, span_id string, parent_span_id string, service_name string, span_name string, duration_ms bigint, status string, started_at timestamp, attributes string"


def _text(v):
    return F.coalesce(v["stringValue"], v["intValue"], v["boolValue"].cast("string"), v["doubleValue"].cast("string"))


def convert(requests: DataFrame) -> DataFrame:
    """SPANS rows from export requests (streaming or not)."""
    r = requests.select(F.explode("resourceSpans").alias("r"))
    service = F.get(F.filter("r.resource.attributes", lambda a: a["key"] == "service.name"), 0)
    s = r.select(_text(service["value"]).alias("service"), F.explode(F.flatten(F.col("r.scopeSpans.spans"))).alias("s"))
    start, end = (F.col(f"s.{c}TimeUnixNano").cast("bigint") for c in ("start", "end"))
    # Of a key that comes twice, the last value counts.
    named = F.filter("s.attributes", lambda a: a["key"].isNotNull())
    once = F.filter(named, lambda a, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda b: b["key"] == a["key"]))
    attributes = F.map_from_entries(F.transform(once, lambda a: F.struct(a["key"], _text(a["value"]))))
    return s.select(
        F.col("s.traceId").alias("trace_id"), F.col("s.spanId").alias("span_id"), F.nullif(F.col("s.parentSpanId"), F.lit("")).alias("parent_span_id"), F.col("service").alias("service_name"), F.col("s.name").alias("span_name"),
        F.floor((end - start) / 1_000_000).cast("bigint").alias("duration_ms"), F.when(F.col("s.status.code") == 2, "ERROR").when(F.col("s.status.code") == 1, "OK").otherwise("UNSET").alias("status"),
        F.timestamp_micros(F.floor(start / 1000).cast("bigint")).alias("started_at"), F.coalesce(F.to_json(attributes), F.lit("{}")).alias("attributes"),
    )


def latest(spans: DataFrame) -> DataFrame:
    """One row for each (trace_id, span_id): the one that arrived last, then of the last batch, then the last start."""
    w = Window.partitionBy("trace_id", "span_id").orderBy(F.desc("arrived"), F.desc("batch"), F.desc("started_at"), F.desc("duration_ms"))
    return spans.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


class SpanTable:
    """Spans as Parquet by stream, batch and day.

    A batch that is written again replaces itself, so ingest is exactly-once; a
    stream is known by its checkpoint, so streams never touch each other's batches.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.files = Files(spark, self.path)

    def ingest(self, source: str, checkpoint: str, once: bool = True) -> StreamingQuery:
        """A stream of OTLP JSON files under ``source`` into the table."""
        requests = self.spark.readStream.schema(REQUEST).json(source)
        own = uuid.uuid5(uuid.NAMESPACE_URL, checkpoint.rstrip("/")).hex

        def write(batch: DataFrame, epoch: int) -> None:
            self.write(batch, epoch, own)

        writer = convert(requests).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()

    def write(self, spans: DataFrame, epoch: int, stream: str = "direct") -> None:
        """One batch of a stream; written again, it replaces itself."""
        rows = spans.withColumn("arrived", F.current_timestamp()).withColumn("day", F.to_date("started_at"))
        rows.write.mode("overwrite").partitionBy("day").parquet(f"{self.path}/stream={stream}/batch={epoch}")

    def read(self) -> DataFrame:
        """The latest version of each span that retention leaves."""
        schema = SPANS + ", arrived timestamp, stream string, batch bigint, day date"
        if not any(n.startswith("stream=") for n in self.files.names("")):
            return self.spark.createDataFrame([], SPANS)
        rows = self.spark.read.schema(schema).parquet(self.path)
        swept = self.files.latest("_retention")
        if swept >= 0:
            cutoff, at = json.loads(self.files.read(f"_retention-{swept}"))
            first = F.lit(cutoff).cast("timestamp")
            rows = rows.filter((F.col("started_at") >= first) | (F.col("arrived") > F.lit(at).cast("timestamp")) | F.col("started_at").isNull())
        return latest(rows).drop("arrived", "stream", "batch", "day")

    def sweep(self, cutoff: str) -> int:
        """Delete the spans here that started before a time.

        Writing the time down hides them all at once; days that have passed whole are
        then deleted unread, the rest of the cutoff's day with a later sweep.
        """
        before = self.read().count()
        row = self.spark.sql(f"SELECT CAST(CAST('{cutoff}' AS TIMESTAMP) AS STRING) t, CAST(CAST('{cutoff}' AS TIMESTAMP) AS DATE) d, CAST(current_timestamp() AS STRING) n").first()
        while not self.files.create(f"_retention-{self.files.latest('_retention') + 1}", json.dumps([row["t"], row["n"]])):
            pass  # another sweep was first: this one comes after it
        left = self.read().count()
        for stream in self.files.names(""):
            for batch in self.files.names(stream) if stream.startswith("stream=") else []:
                for day in self.files.names(f"{stream}/{batch}"):
                    if day.startswith("day=") and day.removeprefix("day=") < str(row["d"]):
                        self.files.delete(f"{stream}/{batch}/{day}")
        return before - left


def windowed(events: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts by event-time window and keys; works on streams, late rows beyond ``late`` being dropped."""
    timed = events.withColumn("_t", F.col(time).cast("timestamp"))
    return timed.withWatermark("_t", late).groupBy(F.window("_t", width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")
