from datetime import datetime, timedelta

from pathtide.streaming.peaks import first_deliveries, windowed_counts, write_stream

T = datetime(2024, 1, 1)


def test_repeats_and_windows(spark, tmp_path):
    rows = [(i % 40, "a" if i % 3 else "b", T + timedelta(minutes=i % 40)) for i in range(80)] + [(900, "a", T + timedelta(days=9))]
    df = spark.createDataFrame(rows, "peak_id long, chromosome string, called_at timestamp")
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    write_stream(first_deliveries(stream, "peak_id", "called_at", "1 hour"), str(tmp_path / "out"), str(tmp_path / "c1"))
    assert sorted(r.peak_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [*range(40), 900]
    write_stream(windowed_counts(stream, ["chromosome"], "called_at", "10 minutes", "1 hour"), str(tmp_path / "w"), str(tmp_path / "c2"))
    got = {(r.chromosome, r.window_start): r.n for r in spark.read.parquet(str(tmp_path / "w")).collect()}
    want = {}
    for _, c, t in rows[:-1]:
        key = c, T + timedelta(minutes=(t - T).seconds // 600 * 10)
        want[key] = want.get(key, 0) + 1
    assert got == want
