"""Structured Streaming: score documents as they arrive.

The reference has no streaming part; document scoring (cleaning, tokens,
shifters, lexicon lookup, counts / proportional scores, feature weights) is
row-local, so the batch operator runs unchanged on every micro-batch through
``foreachBatch``.  Each batch is written to its own ``batch=<id>`` folder with
mode ``overwrite``: a batch replayed after a failure replaces its own output,
which makes the sink idempotent (exactly-once together with the checkpointed
source offsets).  tf-idf is not offered here: it needs corpus-wide document
frequencies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.sentiment import document_sentiment
from ..sources.corpus import corpus_from_table

DOCUMENTS_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])


def score_stream(spark: SparkSession, source_dir: str, to_corpus, lexicons: DataFrame, out_dir: str,
                 checkpoint_dir: str, valence: DataFrame | None = None, stopwords: list[str] | None = None,
                 how: str = "counts", schema: T.StructType = DOCUMENTS_SCHEMA,
                 max_files_per_trigger: int = 100) -> StreamingQuery:
    """Start a query that scores every new parquet file of ``source_dir``.

    ``to_corpus`` maps a micro-batch of raw rows to the corpus shape
    ``(id, date, text, features)``; output rows are
    ``(id, date, word_count, lexicon, feature, score)``.
    """
    if how not in ("counts", "proportional"):
        raise ValueError("streaming scores are 'counts' or 'proportional' (tf-idf needs the whole corpus)")
    raw = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
           .parquet(source_dir))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        corpus = corpus_from_table(to_corpus(batch))
        scores = document_sentiment(corpus, lexicons, valence, stopwords, how)
        scores.write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/batch={batch_id}")

    return (raw.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_dir)
            .trigger(availableNow=True).start())
