"""Claims and confirmations of notifications."""

import datetime as dt

import pytest

from updraft.sinks.ledger import SendLog

AT = dt.datetime(2026, 3, 2, 20, 0)


def pairs(df):
    return sorted((r["metric"], str(r["data_date"])) for r in df.collect())


def test_a_run_that_dies_neither_loses_nor_repeats(spark, tmp_path):
    log = SendLog(spark, str(tmp_path / "log"))
    asked = spark.createDataFrame([("volume", dt.date(2026, 3, 2)), ("volume", dt.date(2026, 3, 2)), ("turnover", dt.date(2026, 3, 2)), ("odd", None)], "metric string, data_date date")
    everything = [("odd", "None"), ("turnover", "2026-03-02"), ("volume", "2026-03-02")]
    assert pairs(log.sent()) == pairs(log.in_doubt()) == []
    assert pairs(log.claim(asked.where("metric = 'volume'"), "a1", AT)) == [("volume", "2026-03-02")]
    # the run dies here; the next one does not send what is in doubt
    assert pairs(log.claim(asked, "a2", AT)) == [("odd", "None"), ("turnover", "2026-03-02")]
    assert pairs(log.in_doubt()) == everything
    # the same attempt goes on with the same claims, whatever it is asked
    assert pairs(log.claim(asked.limit(0), "a2", AT)) == [("odd", "None"), ("turnover", "2026-03-02")]
    log.confirm("a2", AT)
    log.confirm("a2", AT)
    assert pairs(log.in_doubt()) == [("volume", "2026-03-02")]
    log.release("a1", AT)
    # what was released is free again, what has no date is always pending
    assert pairs(log.claim(asked, "a3", AT)) == [("odd", "None"), ("volume", "2026-03-02")]
    log.confirm("a3", AT)
    assert pairs(log.sent().where("metric <> 'odd'")) == [("turnover", "2026-03-02"), ("volume", "2026-03-02")]
    assert pairs(log.claim(asked, "a4", AT, force=True)) == everything
    # an ended attempt has nothing left to send
    assert pairs(log.claim(asked, "a3", AT)) == []


def test_wrong_order_and_keys(spark, tmp_path):
    log = SendLog(spark, str(tmp_path / "log"))
    asked = spark.createDataFrame([("volume", dt.date(2026, 3, 2))], "metric string, data_date date")
    with pytest.raises(ValueError):
        log.confirm("never", AT)
    for key in ("", "a/b", "../x", "1"):
        with pytest.raises(ValueError):
            log.claim(asked, key, AT)
    log.claim(asked, "a1", AT)
    log.release("a1", AT)
    with pytest.raises(ValueError):
        log.confirm("a1", AT)
    # a claim of nothing is a claim too
    assert log.claim(asked.limit(0), "a2", AT).count() == 0
    log.confirm("a2", AT)
