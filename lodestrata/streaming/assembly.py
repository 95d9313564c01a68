"""Structured Streaming: turn assembly with state for each source, and micro-batches that are committed once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ingestion import TURNS_SQL
from ..plans.store import shared_dir
from ..queries import query, table
from ..ship import ship

#: Characters of an open turn that state may hold: the message that goes beyond closes it, as a policy disposition, and what
#: follows is a turn of its own.
MOST_CHARS = 4_000_000
SEAL = "seal"

OUTPUT = "conv_id long, run long, first_turn long, last_turn long, n long, kind string, digest string"
STATE = "run long, first_turn long, last_turn long, n long, asked boolean, answered boolean, text string"


def _assemble(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    run, first, last, n, asked, answered, text = state.get if state.exists else (0, 0, 0, 0, False, False, "")
    out = []

    def close() -> None:
        kind = "policy_disposition" if len(text) > MOST_CHARS else "exact_turn" if asked and answered else "transcript_span"
        out.append((key[0], run, first, last, n, kind, hashlib.sha256(text.encode()).hexdigest()))

    rows = pd.concat(batches).sort_values("turn")
    for turn, role, words in zip(rows["turn"].tolist(), rows["role"].tolist(), rows["text"].tolist(), strict=True):
        if role == SEAL:
            if n:
                close()
            n = 0
            continue
        if n and role == "user":
            close()
            n = 0
        if not n:
            run, first, asked, answered, text = run + 1, turn, False, False, words or ""
        else:
            text = f"{text}\n{words or ''}"
        last, n = turn, n + 1
        asked, answered = asked or role == "user", answered or role == "assistant"
        if len(text) > MOST_CHARS:
            close()
            n, text = 0, ""
    state.update((run, first, last, n, asked, answered, text))
    yield pd.DataFrame(out, columns=["conv_id", "run", "first_turn", "last_turn", "n", "kind", "digest"])


def assemble(stream: DataFrame) -> DataFrame:
    """Finished turns of a stream of messages (conv_id, turn, role, text), in order for each conversation.

    A turn ends where the next user message or a seal (role `seal`) comes; what a seal finds unfinished becomes a span.
    State is one open turn for each conversation, of MOST_CHARS characters and one message at most. Messages of a micro-batch are
    put in order; one that comes in a later batch than its successor is appended where it comes.
    """
    return stream.groupBy("conv_id").applyInPandasWithState(_assemble, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def folder(spark: SparkSession) -> str:
    return shared_dir(spark, "stream-")


def drain(stream: DataFrame, path: str) -> DataFrame:
    """Run a stream over all there is, into files, and read these: a restart goes on at the checkpoint and repeats nothing."""
    stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def commit_once(stream: DataFrame, path: str) -> DataFrame:
    """Run a stream over all there is, writing each micro-batch under its number: a batch that is run again replaces itself."""

    def commit(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    stream.writeStream.foreachBatch(commit).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out/batch=*")


@query("stream_turns", TURNS_SQL)
def stream_turns(spark: SparkSession, d: str) -> DataFrame:
    """Turn assembly as a stream with state, and a seal at each conversation's end."""
    ship(spark)
    path = folder(spark)
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    seals = c.groupBy("conv_id").agg((F.max("turn") + 1).alias("turn")).select("conv_id", "turn", F.lit(SEAL).alias("role"), F.lit("").alias("text"))
    c.unionByName(seals).repartition("conv_id").write.parquet(f"{path}/in")
    stream = spark.readStream.schema(c.schema).parquet(f"{path}/in")
    return drain(assemble(stream), path)


@query("stream_commit", "SELECT event_type, count(*) AS n, min(event_id) AS lo, max(event_id) AS hi FROM events GROUP BY event_type")
def stream_commit(spark: SparkSession, d: str) -> DataFrame:
    """Events captured in micro-batches that are committed once each, then counted."""
    path = folder(spark)
    e = table(spark, d, "events").select("event_id", "event_type")
    e.write.parquet(f"{path}/in")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 4).parquet(f"{path}/in")
    return commit_once(stream, path).groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))
