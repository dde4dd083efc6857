"""Catalogue queries do the whole job."""

import inspect

import pytest

import __spark_entry__ as entry
from oracle import compare
from taplight.operators import evaluation as E, flows as FL, lifecycle as L, models as M
from taplight.plans.views import Views

SF = "/root/testdata/sf0.001"


def rows(df, *cols):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(*cols).collect())


def test_streams_close_every_record(spark):
    v = Views(spark, SF)
    cols = ("flow_id", "packet_count", "bytes_transferred", "start_time", "end_time")
    assert rows(entry.queries()["stream_flows"](spark, SF), *cols) == rows(FL.export_flows(v.packets), *cols)
    cols = ("alert_id", "ts", "confidence", "n_detections", "severity")
    assert rows(entry.queries()["stream_alerts"](spark, SF), *cols) == rows(L.merge_alerts(v.alerts), *cols)


def test_resampling_covers_all_levels_and_trials(spark):
    got = entry.queries()["packet_loss_resample"](spark, SF)
    n = Views(spark, SF).slow.count()
    assert {(r["loss"], r["trial"]): r["count"] for r in got.groupBy("loss", "trial").count().collect()} == {
        (p, t): n for p in E.LOSS_LEVELS for t in range(5)}
    ok, note = compare(got, entry.oracle_sql()["packet_loss_resample"], SF)
    assert ok, note


@pytest.mark.parametrize("name", ["train_dga", "dga_detect", "cross_validated_auc", "loss_study"])
def test_models_and_studies_use_the_full_numbers(monkeypatch, spark, name):
    seen = {}

    def note(module, function, result):
        real = inspect.signature(getattr(module, function))

        def call(*args, **kwargs):
            bound = real.bind(*args, **kwargs)
            bound.apply_defaults()
            seen.update(bound.arguments)
            raise result
        monkeypatch.setattr(module, function, call)

    class Stop(Exception):
        pass

    note(M, "train_dga", Stop())
    note(E, "cross_validated_auc", Stop())
    if name == "loss_study":
        note(E, "packet_loss_resample", Stop())
    with pytest.raises(Stop):
        entry.queries()[name](spark, SF)
    assert seen.get("rounds", 200) == 200 and seen.get("folds", 5) == 5
    if name == "loss_study":
        assert tuple(seen["levels"]) == E.LOSS_LEVELS and seen["trials"] == 5
