"""Models on Structured Streaming.

The models' transform() is row-local (the broadcast and pattern strategies of the segmenter, the tagger
with a broadcast dictionary), so it runs on a stream as on a table.
"""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def read_text_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files as they come in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def write_transformed(stream: DataFrame, model: Transformer, to: str, checkpoint: str) -> StreamingQuery:
    """Each row with the model's output, appended to Parquet files exactly once, until no input is left."""
    return model.transform(stream).writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def word_counts(stream: DataFrame, model: Transformer, time_col: str, words_col: str = "words", window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """(window, word, n): segmented words counted by event time; state older than `late` is dropped."""
    words = model.transform(stream.withWatermark(time_col, late)).select(F.window(time_col, window), F.explode(words_col).alias("word"))
    return words.groupBy("window", "word").agg(F.count(F.lit(1)).alias("n"))
