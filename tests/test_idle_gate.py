import datetime as dt
import random

from packloom.streaming.idle_gate import idle_gate, idle_gate_stream, idle_runs

START = dt.datetime(2024, 1, 1)


def brute(rows):
    out = []
    for k in {r[0] for r in rows}:
        run = []
        for _, t, i, v in [*sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])), (k, None, None, None)]:
            if v is not None and v <= 10:
                run.append(t)
            elif run:
                out.append((k, run[0], run[-1], len(run)))
                run = []
    return sorted(out)


def test_runs_across_buckets(spark):
    rng = random.Random(9)
    rows = []
    for k in ("a", "b", "c"):
        for i in range(400):
            calm = k == "c" or rng.random() < (0.97 if k == "a" else 0.5)
            rows.append((k, START + dt.timedelta(seconds=rng.randrange(0, 200_000)), i, 5.0 if calm else rng.choice([50.0, None])))
    df = spark.createDataFrame([(*r, "x") for r in rows], "k string, ts timestamp, i int, v double, samples string")
    for bucket in (3600, 30_000, 10_000_000):
        got = sorted(tuple(r) for r in idle_runs(df, "k", "ts", "i", "v", 10.0, bucket).collect())
        assert got == brute(rows)
    opened = idle_gate(df, "k", "ts", "i", "v", 10.0, 7200).collect()
    assert {(r["k"], r["run_start"]) for r in opened} == {(k, s) for k, s, e, _ in brute(rows) if (e - s).total_seconds() >= 7200}
    assert idle_runs(df.limit(0), "k", "ts", "i", "v", 10.0).count() == 0


def test_stream_opens_once_a_run(spark, tmp_path):
    at = lambda m: START + dt.timedelta(minutes=m)
    rows = [("u", at(m), 1.0) for m in (0, 4, 8, 12)] + [("u", at(13), 99.0)] + [("u", at(m), 1.0) for m in (14, 20, 25)] + [("w", at(0), 1.0)]
    spark.createDataFrame(rows, "k string, ts timestamp, v double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp, v double").parquet(str(tmp_path / "in"))
    q = idle_gate_stream(stream, "k", "ts", "v", 10.0, 600).writeStream.format("memory").queryName("gate").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["k"], r["run_start"], r["opened_at"]) for r in spark.table("gate").collect()) == [("u", at(0), at(12)), ("u", at(14), at(25))]
