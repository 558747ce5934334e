"""The registered fits are those of production: no short ones, no member left out."""

import inspect

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from loadspan.operators import models
from loadspan.plans import batch
from loadspan.queries import learning

EVERY = {"boosted", "forest", "linear"}


class Fitted(Exception):
    pass


@pytest.mark.parametrize("name, wanted", [
    ("fit_ensemble", EVERY), ("ensemble_mean", EVERY), ("model_conformal", EVERY), ("direct_forecast", EVERY), ("model_store", EVERY),
    ("deployment", EVERY), ("recursive_ensemble", EVERY), ("feature_importance", EVERY - {"linear"}), ("top_importances", EVERY - {"linear"}),
])
def test_registered_fits_have_the_operators_sizes(spark, monkeypatch, name, wanted):
    given = inspect.signature(models.fit_ensemble)
    seen = {}

    def fit(*args, **named):
        seen.update(given.bind(*args, **named).arguments)
        raise Fitted

    rows = spark.range(1).withColumn("part", F.lit("train"))
    monkeypatch.setattr(models, "fit_ensemble", fit)
    monkeypatch.setattr(learning, "split_rows", lambda spark, d: rows)
    monkeypatch.setattr(learning.src, "series", lambda spark, d: rows)
    monkeypatch.setattr(learning, "imputed", lambda spark, d, share: (rows, rows))
    monkeypatch.setattr(batch, "training_rows", lambda series: rows)
    monkeypatch.setattr(batch, "staged", lambda df, purpose: df)
    with pytest.raises(Fitted):
        contract.queries()[name](spark, "")
    assert not seen.get("settings") and set(seen["algorithms"]) == wanted
