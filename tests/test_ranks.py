import numpy as np
import pandas as pd
import pytest

from tidemark.operators import ranks


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value, another value covers a tenth, the rest is long-tailed."""
    rng = np.random.default_rng(1)
    n = 4000
    v = np.where(rng.random(n) < .33, 0.0, np.where(rng.random(n) < .15, 7.0, rng.lognormal(0, 3, n).round(2)))
    pdf = pd.DataFrame({"g": rng.choice(["x", "x", "x", "y"], n), "ticker": [f"T{i}" for i in range(n)], "v": v})
    pdf.loc[rng.random(n) < .05, "v"] = np.nan
    return pdf, spark.createDataFrame(pdf.astype({"v": "object"}).where(pdf.notna(), None), "g string, ticker string, v double")


@pytest.mark.parametrize("one_in,slices", [(4, 16), (50, 64), (10**9, 64)])
def test_ranks_do_not_depend_on_the_cut_points(skewed, one_in, slices):
    pdf, df = skewed
    got = ranks.ranked(df, ["g"], "v", ["ticker"], one_in, slices).toPandas().set_index("ticker")
    want = pdf.dropna().set_index("ticker")
    assert len(got) == len(want)
    g = want.groupby("g").v
    assert (got.avg_rank - g.rank()).abs().max() == 0
    assert (got.below - (g.rank(method="min") - 1)).abs().max() == 0
    assert (got.n - g.transform("count")).abs().max() == 0


def test_exact_quantiles(skewed):
    pdf, df = skewed
    got = ranks.group_quantiles(ranks.ranked(df, ["g"], "v", ["ticker"], 8, 32), ["g"], "v",
                                {"q1": .1, "q5": .5, "q9": .9}).toPandas().set_index("g")
    for g, vals in pdf.dropna().groupby("g").v:
        assert np.allclose(got.loc[g, ["q1", "q5", "q9"]].astype(float), np.quantile(vals, [.1, .5, .9]))


def test_hash_positions_number_every_row_once(skewed):
    _, df = skewed
    got = ranks.hash_positions(df, ["g"]).toPandas()
    for _, part in got.groupby("g"):
        assert sorted(part.position) == list(range(len(part))) and (part.n == len(part)).all()


def test_history_ranks_agree(skewed):
    pdf, df = skewed
    a = ranks.ranked_in_history(df, ["g"], "v").toPandas().set_index("ticker").avg_rank
    assert (a - pdf.dropna().set_index("ticker").groupby("g").v.rank()).abs().max() == 0
