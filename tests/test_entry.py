import __spark_entry__


def test_entry_is_the_flagship(monkeypatch):
    monkeypatch.setattr(__spark_entry__, "queries", lambda: {k: lambda spark, d, k=k: k for k in ("significant_runs", "called_peaks")})
    assert __spark_entry__.entry(None) == "called_peaks"
