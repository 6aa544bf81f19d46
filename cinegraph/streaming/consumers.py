"""Consumers of message queues: outcomes of deliveries, dead letters and poison messages, for streams and tables alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinegraph.operators.ranking import classify_error

#: Deliveries before a message is given up.
MAX_ATTEMPTS = 3


def consume(messages: DataFrame) -> DataFrame:
    """event_id, topic, outcome of messages (event_id, topic, well_formed, error, attempt): done, retry or dead.

    A message that is not well formed, or fails for a lasting reason or too often, is dead; the rules need no state,
    since a queue counts the attempts of a message itself.
    """
    again = classify_error(F.col("error"), F.lit("RuntimeError"))["retryable"] & (F.col("attempt") < MAX_ATTEMPTS)
    outcome = F.when(~F.col("well_formed"), "dead").when(F.col("error").isNull(), "done").when(again, "retry").otherwise("dead")
    return messages.select("event_id", "topic", outcome.alias("outcome"))


def poison(messages: DataFrame, malformed: Column, to_ledger: Column, to_dead_letters: Column) -> DataFrame:
    """Malformed messages with what the two sinks took; a message that neither took is not acknowledged."""
    return messages.where(malformed).select("event_id", to_ledger.alias("ledger"), to_dead_letters.alias("dead_letter"), (to_ledger | to_dead_letters).alias("acknowledged"))
