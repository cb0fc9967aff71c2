"""The status machine over a table against a loop, and over a stream against the table, with shuffled and late input and a restart."""

import random
from datetime import datetime, timedelta

from strataform.streaming import status_machine as sm

SCHEMA = "item long, ts timestamp, event_id long, status string"
BEGIN = datetime(2024, 1, 1)
WAITING = ("queued", "extracting")


def events(seed, n=400):
    r = random.Random(seed)
    names = ["queued", "extracting", "ready", "failed", "approved", "unknown", None]
    return [(r.randint(0, 15), BEGIN + timedelta(seconds=r.randint(0, 20_000)), k, r.choice(names)) for k in range(n)]


def by_hand(rows, seconds):
    out, state = [], {}
    for item, ts, event, said in sorted(rows, key=lambda x: (x[1], x[2])):
        status, since = state.get(item, ("", BEGIN))
        if status in WAITING and (ts - since).total_seconds() >= seconds:
            status, since = sm.TIMED_OUT, since + timedelta(seconds=seconds)
        good = said in sm.IMPORT.get(status, ())
        out.append((item, event, ts, said, status, good))
        state[item] = (said, ts) if good else (status, since)
    return sorted(out)


def test_transitions_equal_a_loop(spark):
    rows = events(1)
    got = sm.transitions(spark.createDataFrame(rows, SCHEMA).repartition(5), "item", sm.IMPORT, 900, WAITING)
    want = by_hand(rows, 900)
    assert sorted(map(repr, map(tuple, got.select("item", "event_id", "ts", "status", "before", "accepted").collect()))) == sorted(map(repr, want))
    assert any(w[5] for w in want) and any(w[4] == sm.TIMED_OUT for w in want)


def test_a_stream_equals_the_table(spark, tmp_path):
    rows = events(2)
    late = sorted(rows, key=lambda x: x[1] + timedelta(seconds=random.Random(x[2]).randint(0, 3000)))  # at most 50 minutes late
    last = (99, BEGIN + timedelta(days=3), 9999, "queued")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = f"{tmp_path}/out"

    def run(some, k):
        spark.createDataFrame(some, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        done = sm.transitions_of_stream(stream, "item", sm.IMPORT, 900, WAITING, "1 hour").writeStream.format("parquet").option("path", out)
        done.option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()

    try:
        for k, part in enumerate((late[:150], late[150:300], late[300:], [last], [(98, last[1] + timedelta(days=1), 9998, "queued")])):
            run(part, k)  # each run goes on from the checkpoint of the one before
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.read.parquet(out).where("item < 98")
    judged = got.where("event_id is not null").select("item", "event_id", "ts", "status", "before", "accepted")
    want = sm.transitions(spark.createDataFrame(rows, SCHEMA), "item", sm.IMPORT, 900, WAITING).select(*judged.columns)
    assert sorted(map(repr, map(tuple, judged.collect()))) == sorted(map(repr, map(tuple, want.collect())))
    timed = {r["item"] for r in got.where("event_id is null").collect()}
    assert {w["item"] for w in want.where(f"before = '{sm.TIMED_OUT}'").collect()} <= timed
