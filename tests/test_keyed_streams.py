import random
import time

import pytest
from pyspark.sql import functions as F

from millrace.streaming import keyed as K


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def drain(plan, out, mark, mode="append"):
    plan.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


SCHEMA = "k string, i long, v double, s string"


def made(n, seed):
    rng = random.Random(seed)
    return [(rng.choice(["a", "b", "a", None]), i, rng.choice([None, 1.5, i / 7]), rng.choice(["x", None, "é"])) for i in range(n)]


def plain_batches(groups, size):
    """``groups``: rows of each micro-batch."""
    held, done, out = {}, {}, []
    for rows in groups:
        for r in sorted(rows, key=lambda r: r[1]):
            held.setdefault(r[0], []).append(r)
        for k, rest in held.items():
            while len(rest) >= size:
                out += [(k, done.get(k, 0), p, *r[1:]) for p, r in enumerate(rest[:size])]
                done[k] = done.get(k, 0) + 1
                del rest[:size]
    return sorted(out, key=repr)


def test_batches_by_key_go_on_after_a_restart(spark, tmp_path):
    path, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    rows = made(120, 1)
    groups = [rows[:7], rows[7:50], rows[50:51], rows[51:]]
    for g in groups:
        put(spark, path, g, SCHEMA)
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
        drain(K.rebatch_by_key(source, "k", "i", 5), out, mark)  # a new query each time, from the checkpoint
    got = spark.read.parquet(out)
    assert got.columns == ["k", "batch", "place", "i", "v", "s"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_batches(groups, 5)


def test_idle_keys_give_their_rest(spark, tmp_path):
    path, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    put(spark, path, [("a", i, 1.0, "x") for i in range(7)], SCHEMA)
    source = spark.readStream.schema(SCHEMA).parquet(path)
    plan = K.rebatch_by_key(source, "k", "i", 5, idle_ms=1000)
    q = plan.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(90):
            time.sleep(1)
            if q.exception() or len(spark.read.schema(plan.schema).parquet(out).collect() if (tmp_path / "out").exists() else []) == 7:
                break
    finally:
        q.stop()
    assert sorted((r["batch"], r["place"], r["i"]) for r in spark.read.parquet(out).collect()) == [(i // 5, i % 5, i) for i in range(7)]


def plain_sessions(groups, gap, delay):
    latest, spans, out = {}, {}, []
    for rows in groups:
        mark = {k: t - delay for k, t in latest.items()}
        late = {}
        for k, t, v in rows:
            if t is None:
                continue
            if k in mark and t < mark[k]:
                n, x = late.get(k, (0, 0.0))
                late[k] = n + 1, x + (v or 0)
            else:
                spans.setdefault(k, []).append((t, v or 0))
                latest[k] = max(latest.get(k, t), t)
        out += [(k, "late", None, None, n, round(x, 6)) for k, (n, x) in late.items()]
        for k in {k for k, t, _ in rows if t is not None}:
            points, runs = sorted(spans.get(k, [])), []
            for p in points:
                if runs and p[0] - runs[-1][-1][0] <= gap:
                    runs[-1].append(p)
                else:
                    runs.append([p])
            spans[k] = []
            for r in runs:
                if r[-1][0] + gap < latest[k] - delay:
                    out.append((k, "session", r[0][0], r[-1][0], len(r), round(sum(x for _, x in r), 6)))
                else:
                    spans[k] += r
    return sorted(out, key=repr)


def test_sessions_and_late_rows(spark, tmp_path):
    path, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    rng, groups = random.Random(5), []
    for g in range(4):
        groups.append([(rng.choice(["a", "b", None]), rng.choice([None] + [g * 300 + rng.randrange(-400, 400) for _ in range(9)]), rng.choice([None, 0.5, 2.0])) for _ in range(60)])
    for g in groups:
        put(spark, path, g, "k string, t long, v double")
        source = spark.readStream.schema("k string, t long, v double").option("maxFilesPerTrigger", 1).parquet(path)
        drain(K.sessions(source, "k", F.timestamp_micros("t"), "v", 10, 200), out, mark)
    rows = spark.read.parquet(out).collect()
    got = sorted(((*tuple(r)[:5], round(r["total"], 6)) for r in rows), key=repr)
    assert got == plain_sessions(groups, 10, 200) and {r["kind"] for r in rows} == {"late", "session"}


def test_windows_on_a_table_and_a_stream(spark, tmp_path):
    path, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    rows = [("a" if i % 3 else "b", i * 37) for i in range(100)] + [("a", None)]
    put(spark, path, rows, "k string, s long")
    at = lambda df: df.select("k", F.timestamp_seconds("s").alias("t"))
    how = dict(time="t", size="10 minutes", keys=["k"], aggregates=[F.count("*").alias("n")], slide="5 minutes")
    table = K.windows(at(spark.read.parquet(path)), **how)
    drain(K.windows(at(spark.readStream.schema("k string, s long").parquet(path)), **how), out, mark)
    want = {tuple(r) for r in table.where(f"stop <= timestamp_seconds({99 * 37})").collect()}
    assert {tuple(r) for r in spark.read.parquet(out).collect()} == want and len(want) > 10
    assert sum(r["n"] for r in K.windows(at(spark.read.parquet(path)), "t", "1 hour", [], [F.count("*").alias("n")]).collect()) == 100


def test_wrong_calls(spark):
    with pytest.raises(ValueError):
        K.rebatch_by_key(spark.range(3), "id", "id", 2)
    with pytest.raises(ValueError):
        K.sessions(spark.range(3), "id", "id", "id", 2, 1)
    rate = spark.readStream.format("rate").load()
    with pytest.raises(ValueError):
        K.rebatch_by_key(rate, "value", "timestamp", 0)
    with pytest.raises(ValueError):
        K.sessions(rate, "value", "timestamp", "value", -1, 0)
