import json
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from covera.session import build_session
    s = build_session(master="local[8]", shuffle_partitions=8,
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="covera-test-ckpt-"),
                             "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="covera-test-warehouse-"),
                             "spark.eventLog.enabled": "true", "spark.eventLog.compress": "false",
                             "spark.eventLog.dir": "file://" + EVENTS})
    yield s
    s.stop()


EVENTS = tempfile.mkdtemp(prefix="covera-test-events-")


@pytest.fixture
def event_log(spark):
    """A function that reads the session's job events so far."""
    def read():
        out = []
        for folder, _, files in os.walk(EVENTS):
            for f in files:
                if not f.startswith(("appstatus", ".")):
                    with open(os.path.join(folder, f)) as lines:
                        out += [json.loads(line) for line in lines if line.endswith("\n") and "SparkListenerJob" in line[:60]]
        return out
    return read


def policy_rows(spark, rows, with_premium=True):
    """Hand-built raw policy rows (the columns of a raw batch plus a row id)."""
    cols = ["OBJECT_ID", "SEX", "INSR_BEGIN", "INSR_END", "INSR_TYPE", "INSURED_VALUE", "PREMIUM", "PROD_YEAR",
            "SEATS_NUM", "CCM_TON", "TYPE_VEHICLE", "MAKE", "USAGE", "_row_id"]
    schema = ("OBJECT_ID long, SEX int, INSR_BEGIN string, INSR_END string, INSR_TYPE int, INSURED_VALUE double, "
              "PREMIUM double, PROD_YEAR double, SEATS_NUM double, CCM_TON double, TYPE_VEHICLE string, MAKE string, "
              "USAGE string, _row_id long")
    df = spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rows], schema)
    return df if with_premium else df.drop("PREMIUM")


def row(**kw):
    base = dict(OBJECT_ID=1, SEX=0, INSR_BEGIN="01-JAN-11", INSR_END="01-JAN-12", INSR_TYPE=1202,
                INSURED_VALUE=1000.0, PREMIUM=100.0, PROD_YEAR=2005.0, SEATS_NUM=4.0, CCM_TON=1500.0,
                TYPE_VEHICLE="Automobile", MAKE="toyota", USAGE="Private", _row_id=0)
    base.update(kw)
    return base
