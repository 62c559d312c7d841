"""The stateful request stream against its batch twin and a plain fold, over out-of-order files and a restart."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from lodestone.streaming import events as S
from lodestone.streaming import requests as R

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "request_id string, seq int, ts timestamp, type string, payload string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    out = []
    for i in range(40):
        start = rng.randint(0, 7200)
        for seq in range(rng.randint(1, 9)):
            out.append((f"r{i}", seq, T0 + timedelta(seconds=start + rng.randint(0, 1500)), rng.choice(["token", "token", "status", "done"]), rng.choice(["a", "b ", None])))
    out += [(None, 1, T0, "token", "x"), ("r0", None, T0, "token", "x"), ("r1", 1, None, "done", "x"), out[5], out[5]]
    # A last request carries the watermark past all others.
    return out + [("last", 0, T0 + timedelta(hours=9), "status", None)]


def plain(rows, timeout):
    by = {}
    for key, seq, ts, kind, payload in rows:
        if None not in (key, seq, ts):
            by.setdefault(key, []).append((round((ts - T0) / timedelta(microseconds=1)), seq, kind, payload))
    out = []
    for key, r in by.items():
        status, a, b, tokens = R.fold(r, timeout)
        out.append((key, status, a, b, len(tokens), "".join(tokens)))
    return sorted(out)


def told(frame):
    at = lambda c: F.unix_micros(c) - int(T0.timestamp() * 1_000_000)
    return sorted(tuple(r) for r in frame.select("request_id", "status", at("started"), at("ended"), "n_tokens", "answer").collect())


def test_fold_and_batch_twin(spark, rows):
    want = plain(rows, 600_000_000)
    assert {r[1] for r in want} == {"complete", "abandoned"}
    assert told(R.outcomes_of_all(spark.createDataFrame(rows, SCHEMA), "10 minutes")) == want


def test_stream_with_a_restart(spark, rows, tmp_path):
    """Four files in order of arrival, rows up to half an hour out of order; the query ends after two files and goes on from its checkpoint."""
    rng = random.Random(2)
    timed = [r for r in rows if r[2]]
    coming = sorted(timed, key=lambda r: r[2] + timedelta(seconds=rng.randint(0, 1500)))
    parts = [coming[len(coming) * i // 4 : len(coming) * (i + 1) // 4] for i in range(4)]
    source = spark.createDataFrame([], SCHEMA).schema

    def add(i):
        spark.createDataFrame(parts[i], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def drain():
        frame = R.outcomes(S.read(spark, str(tmp_path / "in"), source), "10 minutes", late="30 minutes")
        with R.rocksdb(spark):
            q = frame.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
            q.awaitTermination()
        return spark.read.schema(frame.schema).parquet(str(tmp_path / "out"))

    for i in range(2):
        add(i)
    first = told(drain())
    for i in range(2, 4):
        add(i)
    last = told(drain())
    want = [r for r in plain(rows, 600_000_000) if r[0] != "last"]
    assert set(first) < set(want) and last == want


def test_rocksdb_setting_is_put_back(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    with R.rocksdb(spark):
        assert "RocksDB" in spark.conf.get(name)
    assert spark.conf.get(name, None) == before


def test_many_requests_are_folded_at_once(rows):
    """As one by one, with ties of time, repeats and rows out of order."""
    import pandas as pd

    whole = [(k, round((ts - T0) / timedelta(microseconds=1)), seq, kind, payload) for k, seq, ts, kind, payload in rows if None not in (k, seq, ts)]
    for cut in (len(whole), 1, 0):
        got = R.folded(pd.DataFrame(whole[:cut], columns=["request_id", "at", "seq", "type", "payload"]), 600_000_000)
        want = plain([(k, seq, T0 + timedelta(microseconds=at), kind, payload) for k, at, seq, kind, payload in whole[:cut]], 600_000_000)
        assert sorted(got.itertuples(index=False, name=None)) == want


def test_requests_share_a_few_keys_of_the_state(spark, tmp_path):
    """Forty requests in three keys, file by file: each has one outcome, and what comes after it is left out until the request is forgotten, which opens it anew."""
    files = [[(f"r{i}", 0, T0 + timedelta(seconds=i), "token", "a") for i in range(40)]]
    files += [[("far", 0, T0 + timedelta(hours=1), "status", None)]]
    # r0 is over and remembered, r1 is too.
    files += [[("r0", 1, T0 + timedelta(hours=1), "done", None), ("far", 1, T0 + timedelta(hours=2), "done", None)]]
    files += [[("far", 2, T0 + timedelta(hours=9), "status", None)], [("r1", 2, T0 + timedelta(hours=9, seconds=1), "done", None)], [("last", 0, T0 + timedelta(hours=20), "status", None)]]
    for part in files:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        frame = R.outcomes(S.read(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema), "10 minutes", late="1 minute", remember="3 hours", groups=3)
        with R.rocksdb(spark):
            q = frame.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
            q.awaitTermination()
    found = [(r[0], r[1], r[4]) for r in told(spark.read.schema(frame.schema).parquet(str(tmp_path / "out")))]
    again = [("far", "abandoned", 0), ("r1", "complete", 0)]
    assert sorted(found) == sorted([(f"r{i}", "abandoned", 1) for i in range(40)] + again)
