import numpy as np
import pytest

from cairn.operators import metrics as M


@pytest.mark.parametrize("bins", [2, 7, 1024])
@pytest.mark.parametrize("kind", ["long", "double"])
def test_selection_is_exact(spark, kind, bins):
    rng = np.random.default_rng(bins)
    for values in ([5], [3, 3, 3], [1, 2], rng.integers(-10, 10, 200).tolist(), (rng.lognormal(3, 4, 150) * 1e6).tolist()):
        own = [int(v) if kind == "long" else float(v) for v in values]
        ranks = sorted({0, len(own) // 2, (len(own) - 1) // 2, len(own) - 1, len(own) * 19 // 20})
        df = spark.createDataFrame([(v,) for v in own], f"x {kind}").repartition(2)
        assert M.selected(df, ranks, bins) == [sorted(own)[r] for r in ranks]


def test_latency_of_odd_and_even_counts(spark):
    of = lambda *v: M.latency(spark.createDataFrame([(x,) for x in v], "latency_ms long")).first()
    assert tuple(of(4, None, 1, 3)) == (3.0, 4, 4) and tuple(of(4, 1)) == (2.5, 4, 4) and tuple(of(None)) == (None, None, None)
    assert tuple(of(*range(41))) == (20.0, 38, 40)


def test_no_window_over_all_values(spark, capsys):
    M.latency(spark.range(1000).selectExpr("id AS latency_ms")).explain()
    assert "Window" not in capsys.readouterr().out
