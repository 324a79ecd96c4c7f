"""The registered classifier is fitted on every labelled sequence, however many there are."""

import pytest

from hubrisk.operators import ml as ML
from hubrisk.plans import registry as R
from hubrisk.sources.proxy import HUB, HubData
from tests.conftest import flight


@pytest.mark.parametrize("staged", [None, 0])
def test_all_labelled_rows_are_fitted(spark, make_flights, monkeypatch, staged):
    """320 arrivals and 350 departures of a training day, as many of a test day: 112,000 labelled pairs."""
    rows = []
    for day in ("1997-03-04", "2001-09-04"):
        rows += [flight(f"i{day}{k}", day, f"NATION_{1 + k % 3}", HUB, 800.0 + k % 60, 20.0, 0.0, 5.0) for k in range(320)]
        rows += [flight(f"o{day}{k}", day, HUB, f"NATION_{4 + k % 3}", 1500.0 + k % 60, 0.0, 20.0) for k in range(350)]
    sf = "/root/testdata/sf0.001"
    features, weather = R.pair_feats(spark, sf), R.daily_weather(spark, sf)
    flights = make_flights(rows)
    monkeypatch.setattr(R, "data", lambda spark, sf: HubData(flights, None, None, None))
    monkeypatch.setattr(R, "pair_feats", lambda spark, sf: features)
    monkeypatch.setattr(R, "daily_weather", lambda spark, sf: weather)
    monkeypatch.setattr(R, "stage", lambda spark, sf, name, build: build())
    if staged is not None:
        monkeypatch.setattr(R, "STAGED_ROWS", staged)
    fitted = []
    monkeypatch.setattr(ML, "train_trees", lambda df, p, fit_rows=None, **more: fitted.append((df.count(), fit_rows)))
    monkeypatch.setattr(R, "_MODELS", {})
    R.model(spark, sf)
    assert fitted == [(320 * 350, None)]
    assert R.unseen_rows(spark, sf).count() == 320 * 350
