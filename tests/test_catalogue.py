"""Every query with SQL gives the SQL's rows; the others run."""

import pytest

import __spark_entry__ as entry
from oracle import compare

SF = "/root/testdata/sf0.001"
SLOW = {"train_dga", "cross_validated_auc", "loss_study", "train_tls", "stream_flows",
        "feature_importance_top", "tls_malware_detect", "isolation_forest", "ddos_calibration",
        "ddos_isolation_forest", "exfil_forest", "dga_detect", "stream_alerts", "stream_detect"}


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in SLOW])
def test_query(spark, name):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        df.write.format("noop").mode("overwrite").save()
    else:
        ok, note = compare(df, sql, SF)
        assert ok, note


@pytest.mark.parametrize("name", sorted(SLOW))
def test_slow_query_has_rows_and_columns(spark, name):
    assert entry.queries()[name](spark, SF).columns


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
