"""The submission ledger as a stream: decisions with per-ledger state and daily counts."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foldline.operators.kernels import Policy, decide_one
from foldline.session import scratch_root

OUTPUT = "ledger long, seq long, decision string"
STATE = "ledgers array<long>, best array<double>, days array<string>, used array<long>"
#: Groups that ledgers are dealt into; every call of the group function costs milliseconds, so one for each ledger is too many.
BUCKETS = 4096


def decisions(events: DataFrame, policy: Policy, buckets: int = BUCKETS) -> DataFrame:
    """Streaming decisions over ``(ledger, seq, day, valid, cv, force)``.

    The state of a ledger is its best accepted score, the current day and what was used of its budget. A group holds the states of
    the ledgers of one hash bucket and the rows they have in a micro-batch; ``buckets`` must stay the same over the life of a checkpoint.
    Events must arrive in ledger order between micro-batches; inside one they are sorted by ``seq``.
    """

    def step(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = state.get if state.exists else ([], [], [], [])
        known = {who: now for who, *now in zip(*old)}
        rows = pd.concat(list(batches), ignore_index=True).sort_values("seq")
        # null ledgers are alone in their bucket
        ledgers = [None] * len(rows) if key[0] < 0 else rows["ledger"].tolist()
        said = []
        for who, day, valid, cv, force in zip(ledgers, rows["day"], rows["valid"], rows["cv"].tolist(), rows["force"]):
            cv = None if cv is None or cv != cv else float(cv)
            decision, known[who] = decide_one(known.get(who, (None, None, 0)), day, bool(valid), cv, bool(force), policy)
            said.append(decision)
        state.update((list(known), *(list(part) for part in zip(*known.values()))))
        yield pd.DataFrame({"ledger": rows["ledger"], "seq": rows["seq"], "decision": said})

    bucket = F.when(F.col("ledger").isNull(), F.lit(-1)).otherwise(F.pmod(F.hash("ledger"), F.lit(buckets)))
    return events.withColumn("bucket", bucket).groupBy("bucket").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def daily_counts(events: DataFrame, ts: str, id: str, late: str = "1 day") -> DataFrame:
    """Distinct submissions per day; late repeats inside the watermark count once."""
    marked = events.withWatermark(ts, late).dropDuplicatesWithinWatermark([id])
    return marked.groupBy(F.window(ts, "1 day")).agg(F.count("*").alias("used"))


def replay(spark: SparkSession, events: DataFrame, policy: Policy) -> DataFrame:
    """Run :func:`decisions` once over a stored ledger and return the written result."""
    root = f"{scratch_root(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}"
    events.write.parquet(f"{root}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{root}/in")
    run = (
        decisions(stream, policy)
        .writeStream.format("parquet")
        .option("path", f"{root}/out")
        .option("checkpointLocation", f"{root}/state")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.schema(OUTPUT).parquet(f"{root}/out")
