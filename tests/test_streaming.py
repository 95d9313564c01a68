"""State across micro-batches, and restarts that repeat nothing."""

from pyspark.sql import functions as F

from lodestrata.operators.ingestion import turns
from lodestrata.ship import ship
from lodestrata.streaming import assembly

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
ROWS = [
    (1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "assistant", "c"), (1, 4, "user", "d"), (2, 0, "user", "x"), (2, 1, "user", None), (2, 2, "assistant", ""),
]


def test_turns_span_micro_batches(spark, tmp_path):
    ship(spark)
    seals = [(1, 5, assembly.SEAL, ""), (2, 3, assembly.SEAL, "")]
    for k, row in enumerate(ROWS + seals):
        spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/f={k:02d}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"file://{tmp_path}/in/*")
    got = assembly.drain(assembly.assemble(stream), f"file://{tmp_path}/s")
    key = lambda r: (r["conv_id"], r["run"])
    rows = sorted(got.collect(), key=key)
    want = sorted(turns(spark.createDataFrame([(*r[:3], r[3] or "") for r in ROWS], SCHEMA)).collect(), key=key)
    assert [tuple(r[c] for c in ("conv_id", "run", "first_turn", "last_turn", "n", "kind", "digest")) for r in rows] == [tuple(r[c] for c in ("conv_id", "run", "first_turn", "last_turn", "n", "kind", "digest")) for r in want]
    assert {r["kind"] for r in rows} == {"exact_turn", "transcript_span"}


def test_restart_commits_each_record_once(spark, tmp_path):
    schema = "k bigint, v string"
    make = lambda lo, hi: spark.range(lo, hi).select(F.col("id").alias("k"), F.lit("v").alias("v")).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    make(0, 10)
    assert assembly.commit_once(stream(), f"file://{tmp_path}/c").count() == 10
    assert assembly.commit_once(stream(), f"file://{tmp_path}/c").count() == 10
    make(10, 15)
    again = assembly.commit_once(stream(), f"file://{tmp_path}/c")
    assert sorted(r["k"] for r in again.collect()) == list(range(15))


def test_a_long_turn_is_a_disposition(spark, tmp_path, monkeypatch):
    key = (7,)

    class State:
        exists, get = False, None

        def update(self, value):
            self.get = value

    import pandas as pd

    monkeypatch.setattr(assembly, "MOST_CHARS", 5)
    rows = pd.DataFrame([(7, 0, "user", "long text"), (7, 1, assembly.SEAL, "")], columns=["conv_id", "turn", "role", "text"])
    (out,) = assembly._assemble(key, iter([rows]), State())
    assert out["kind"].tolist() == ["policy_disposition"]
