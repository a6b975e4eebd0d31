"""The ledger as a stream: decisions as by a plain walk, over several micro-batches, with few groups for many ledgers."""

from foldline.operators.kernels import Policy, decide_one
from foldline.streaming.ledger_stream import decisions

POLICY = Policy(1, 1.0, "minimize")
SCHEMA = "ledger long, seq long, day string, valid boolean, cv double, force boolean"


def _events(lo, hi):
    big = 2**60
    return [
        (None if i % 50 == 49 else big + i % 50, i, f"2024-01-{1 + i // 130:02d}", i % 13 != 0, None if i % 6 == 0 else float((i * 7919) % 97), i % 17 == 0)
        for i in range(lo, hi)
    ]


def test_buckets_of_ledgers_keep_their_states(spark, tmp_path):
    rows = _events(0, 600)
    want, states = {}, {}
    for who, seq, day, valid, cv, force in rows:
        want[(who, seq)], states[who] = decide_one(states.get(who, (None, None, 0)), day, valid, cv, force, POLICY)
    for part in ((0, 250), (250, 600)):
        spark.createDataFrame(_events(*part), SCHEMA).write.mode("append").parquet(f"{tmp_path}/in")
        stream = decisions(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), POLICY)
        run = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        run.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert len(got) == 600 and {(r["ledger"], r["seq"]): r["decision"] for r in got} == want


def test_groups_do_not_grow_with_the_ledgers(spark, tmp_path):
    rows = [(i, i, "2024-01-01", True, 1.0, False) for i in range(5000)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/in")
    stream = decisions(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), POLICY)
    run = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5000
    assert spark.read.format("statestore").load(f"{tmp_path}/cp").count() <= 4097
