"""The registered model queries train the operator's own number of rounds."""

from creditloom.operators import model
from creditloom.plans import registry


def test_registered_queries_train_all_rounds(spark, sf, monkeypatch):
    asked = []
    monkeypatch.setattr(model, "load_or_train", lambda spark, path, loans, rounds: asked.append(rounds))
    registry._model(spark, sf)
    assert asked == [model.ROUNDS] == [200]
