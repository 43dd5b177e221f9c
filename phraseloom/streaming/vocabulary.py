"""A running vocabulary over a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from phraseloom.functions.text import tokenize


def streaming_vocabulary(stream: DataFrame) -> DataFrame:
    """(token, df, cf) of a stream (doc_id, text), each document arriving once.

    A document's tokens are counted inside its row, so the state has one row for each token and needs no set of ids.
    """
    own = stream.select(tokenize("text").alias("tokens"))
    per_doc = F.transform(F.array_distinct("tokens"), lambda t: F.struct(t.alias("token"), F.size(F.filter("tokens", lambda x: x == t)).alias("n")))
    return own.select(F.explode(per_doc).alias("x")).groupBy("x.token").agg(F.count("*").alias("df"), F.sum("x.n").alias("cf"))


def start(stream: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Keep the vocabulary in the memory table ``name``, with the input that is there so far."""
    return streaming_vocabulary(stream).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
