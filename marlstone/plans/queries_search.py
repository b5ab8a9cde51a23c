"""Vector search, full-text search and span streams."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fulltext, vector
from ..sources.shared import folder
from ..streaming import spans
from .catalogue import dialect, query

_QUERY = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
for _key, _op, _f in (("l2", "<->", "list_distance"), ("cosine", "<=>", "list_cosine_distance"), ("ip", "<#>", "list_negative_inner_product")):
    dialect(
        f"knn_{_key}",
        f"SELECT e.vec_id, round(e.embedding {_op} q.embedding, 4) AS d FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY e.embedding {_op} q.embedding, e.vec_id LIMIT 10",
        f"SELECT e.vec_id, round({_f}(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 4) AS d FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY {_f}(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), e.vec_id LIMIT 10",
    )


@query("SELECT q.vec_id AS query_key, e.vec_id AS key, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), e.vec_id) AS INTEGER) AS rank FROM embeddings e, embeddings q WHERE q.vec_id < 5 QUALIFY rank <= 3")
def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return vector.search_many(e, e.filter("vec_id < 5"), 3, "vec_id", "embedding", "vec_id", "embedding").select("query_key", "key", "rank")


@query()
def knn_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    q = e.orderBy("vec_id").first()["embedding"]
    return vector.HyperplaneIndex(e, "vec_id", "embedding", len(q)).search(q, 10).select("vec_id", F.round("distance", 4).alias("distance"))


_BM25 = """
WITH tok AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '' AND t NOT IN (%s)) AS ts FROM documents WHERE text IS NOT NULL),
len AS (SELECT doc_id, len(ts) AS dl FROM tok), tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len),
post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM tok) WHERE term IN ('license', 'version', 'released') GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term)
SELECT post.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
FROM post JOIN df USING (term) JOIN len ON len.doc_id = post.doc_id CROSS JOIN tot GROUP BY post.doc_id ORDER BY score DESC, post.doc_id LIMIT 10""" % ", ".join(f"'{w}'" for w in sorted(fulltext.STOP_WORDS))


@query(_BM25)
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = fulltext.TextIndex(docs, "doc_id", "text").scores("license version released").select("doc_id", F.round("score", 6).alias("score"))
    return found.orderBy(F.desc("score"), "doc_id").limit(10)


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts by a stream over the events, run to its end."""
    own = "w" + uuid.uuid4().hex
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    running = spans.windowed(source, "ts", "1 day", "40 days", "event_type").writeStream.outputMode("complete").format("memory").queryName(own).option("checkpointLocation", f"{folder(spark)}/{own}").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.table(own).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT * FROM (VALUES ('t1', 's1', 'auth', 'login', CAST(7 AS BIGINT), 'ERROR'), ('t1', 's2', 'auth', 'query', CAST(3 AS BIGINT), 'OK')) AS v(trace_id, span_id, service_name, span_name, duration_ms, status)")
def stream_ingest_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two OTLP files, the second of which sends a span again; then a retention sweep."""
    root = f"{folder(spark)}/spans-{uuid.uuid4().hex}"

    def request(*own: tuple) -> str:
        made = [{"traceId": t, "spanId": s, "parentSpanId": "", "name": n, "startTimeUnixNano": str(a), "endTimeUnixNano": str(a + ms * 1_000_000), "status": {"code": c}, "attributes": []} for t, s, n, a, ms, c in own]
        return json.dumps({"resourceSpans": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "auth"}}]}, "scopeSpans": [{"spans": made}]}]})

    now, old = 1_750_000_000 * 10**9, 1_600_000_000 * 10**9
    table = spans.SpanTable(spark, f"{root}/table")
    for i, text in enumerate([request(("t1", "s1", "login", now, 5, 1), ("t0", "s0", "old", old, 1, 1)), request(("t1", "s1", "login", now, 7, 2), ("t1", "s2", "query", now, 3, 1))]):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{root}/in{i}")
        table.ingest(f"{root}/in{i}", f"{root}/checkpoint{i}").awaitTermination() if i == 0 else table.write(spans.convert(spark.read.schema(spans.REQUEST).json(f"{root}/in{i}")), 1)
    table.sweep("2023-01-01 00:00:00")
    return table.read().select("trace_id", "span_id", "service_name", "span_name", "duration_ms", "status")
