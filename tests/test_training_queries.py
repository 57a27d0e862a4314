"""The training queries run the reference's sizes and score rows that nobody trained on."""

import pytest

from flowlens.operators import baselines, federated
from flowlens.operators.baselines import fit_tree_baseline
from flowlens.plans import queries

SF_DIR = "/root/testdata/sf0.001"


class Caught(Exception):
    pass


def caught(spark, monkeypatch, module, function, name):
    """The arguments with which query ``name`` calls ``function``."""
    def stop(*args, **kwargs):
        raise Caught(args, kwargs)

    monkeypatch.setattr(module, function, stop)
    with pytest.raises(Caught) as error:
        queries.QUERIES[name](spark, SF_DIR)
    return error.value.args


@pytest.mark.parametrize("name, function", [
    ("fedavg_rounds", "fit_federated"), ("fedprox_rounds", "fit_federated"), ("local_only", "fit_local_only")])
def test_federated_rows_are_held_out(spark, monkeypatch, name, function):
    (clients, held, settings, *_), kwargs = caught(spark, monkeypatch, federated, function, name)
    assert settings.dims == (64, 256, 128, 64, 10) and kwargs["rounds"] == 3
    assert held.count() > 0 and clients.count() > held.count()
    assert clients.join(held, clients.row_key == held.vec_id).count() == 0


def test_baselines_take_the_reference_sizes(spark, monkeypatch):
    args, kwargs = caught(spark, monkeypatch, baselines, "fit_mlp_baseline", "mlp_baseline")
    assert args[2] == (64, 256, 128, 64, 10) and kwargs["max_epochs"] == 10
    _, kwargs = caught(spark, monkeypatch, baselines, "fit_tree_baseline", "tree_baseline")
    assert kwargs == {"max_trees": 500, "max_depth": 8}
    assert fit_tree_baseline.__defaults__[-2:] == (0.1, 20)
