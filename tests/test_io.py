import os
import tempfile

import pytest

from covera.sources import policy_io


def test_csv_by_name_append_and_route(spark):
    d = tempfile.mkdtemp(prefix="covera-io-")
    path = os.path.join(d, "batch.csv")
    with open(path, "w") as f:   # columns in an unusual order, one junk cell
        f.write("USAGE,MAKE,TYPE_VEHICLE,CCM_TON,SEATS_NUM,PROD_YEAR,PREMIUM,INSURED_VALUE,INSR_TYPE,"
                "INSR_END,INSR_BEGIN,SEX,OBJECT_ID\n")
        f.write("Private,toyota,Truck,2000,3,2001,150.5,0,1202,01-JAN-13,01-JAN-12,1,5000107805\n")
        f.write("Own Goods,vw,Bus,x,3,2001,99,10,1201,01-JAN-13,01-JAN-12,0,7\n")
    df = policy_io.read_policies_csv(spark, path)
    assert policy_io.route(df) == "store"
    rows = df.orderBy("_row_id").collect()
    assert rows[0].OBJECT_ID == 5000107805 and rows[0].PREMIUM == 150.5 and rows[1].CCM_TON is None
    store = os.path.join(d, "store")
    policy_io.append_labelled(df, store)
    policy_io.append_labelled(df, store)
    policy_io.append_labelled(df, store, batch="x")
    policy_io.append_labelled(df, store, batch="x")  # a replay
    assert policy_io.read_store(spark, store).count() == 6
    assert policy_io.route(df.drop("PREMIUM")) == "predict"
    out = policy_io.write_predictions(df.drop("PREMIUM"), path)
    assert out.endswith("batch_predicted.csv") and spark.read.option("header", True).csv(out).count() == 2


NAMES = ["OBJECT_ID", "SEX", "INSR_BEGIN", "INSR_END", "INSR_TYPE", "INSURED_VALUE", "PREMIUM", "PROD_YEAR", "SEATS_NUM",
         "CCM_TON", "TYPE_VEHICLE", "MAKE", "USAGE"]


def write_csv(path, names, rows):
    with open(path, "w") as f:
        f.write(",".join(names) + "\n")
        for r in rows:
            f.write(",".join(str(r.get(n, "")) for n in names) + "\n")


def policy(i, **kw):
    return dict(OBJECT_ID=i, SEX=1, INSR_BEGIN="01-JAN-12", INSR_END="01-JAN-13", INSR_TYPE=1202, INSURED_VALUE=0,
                PREMIUM=10.5 * i, PROD_YEAR=2001, SEATS_NUM=4, CCM_TON=1500, TYPE_VEHICLE="Truck", MAKE="vw",
                USAGE="Private") | kw


def test_files_of_different_column_order(spark, tmp_path):
    write_csv(tmp_path / "a.csv", NAMES, [policy(1), policy(2)])
    write_csv(tmp_path / "b.csv", ["EFFECTIVE_YR", *reversed(NAMES), "CLAIM_PAID"],
              [policy(3, EFFECTIVE_YR=11, CLAIM_PAID=7), policy(4, CCM_TON="junk", MAKE="")])
    rows = {r["OBJECT_ID"]: r for r in policy_io.read_policies_csv(spark, str(tmp_path)).collect()}
    assert set(rows) == {1, 2, 3, 4}
    assert [rows[i]["PREMIUM"] for i in (1, 2, 3, 4)] == [10.5, 21.0, 31.5, 42.0]
    assert rows[3]["EFFECTIVE_YR"] == "11" and rows[1]["EFFECTIVE_YR"] is None and rows[3]["CLAIM_PAID"] == "7"
    assert rows[4]["CCM_TON"] is None and rows[4]["MAKE"] is None and rows[3]["TYPE_VEHICLE"] == "Truck"
    assert len({r["_row_id"] for r in rows.values()}) == 4
    failures = policy_io.cast_failures(policy_io.read_csv_text(spark, str(tmp_path)))
    assert {r["col"]: r["value"] for r in failures.collect() if r["value"]} == {"CCM_TON": 1}


def test_a_file_without_header_fails(spark, tmp_path):
    write_csv(tmp_path / "a.csv", NAMES, [policy(1)])
    (tmp_path / "b.csv").write_text("1,2,3\n")
    with pytest.raises(Exception, match="without header"):
        policy_io.read_policies_csv(spark, str(tmp_path)).collect()


def test_cells_that_look_like_a_header_are_data(spark, tmp_path):
    """A make OBJECT_ID, a row equal to the header's names, a header that sorts before and after the rows."""
    write_csv(tmp_path / "a b.csv", NAMES, [policy(1, MAKE="OBJECT_ID"), policy(2, USAGE="OBJECT_ID", MAKE="zzz")])
    write_csv(tmp_path / "c.csv", [*NAMES, "aaa"], [policy(3, aaa="OBJECT_ID"), policy(4, MAKE="a, quoted".join('""'))])
    rows = {r["OBJECT_ID"]: r for r in policy_io.read_policies_csv(spark, str(tmp_path)).collect()}
    assert set(rows) == {1, 2, 3, 4}
    assert rows[1]["MAKE"] == rows[2]["USAGE"] == rows[3]["aaa"] == "OBJECT_ID" and rows[4]["MAKE"] == "a, quoted"
    write_csv(tmp_path / "c.csv", NAMES, [dict(zip(NAMES, NAMES)), policy(5)])
    rows = policy_io.read_policies_csv(spark, str(tmp_path / "c.csv")).orderBy("_row_id").collect()
    assert [(r["OBJECT_ID"], r["MAKE"]) for r in rows] == [(None, "MAKE"), (5, "vw")]


def test_row_ids_follow_files_and_lines(spark, tmp_path):
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for f, n in (("a.csv", 30), ("b.csv", 400), ("c.csv", 1), ("d.csv", 90)):
            names = NAMES if f < "c" else list(reversed(NAMES))
            write_csv(tmp_path / f, names, [policy(i, MAKE=f) for i in range(n)])
        (tmp_path / "e.csv").write_text("")
        df = policy_io.read_policies_csv(spark, str(tmp_path))
        rows = df.orderBy("_row_id").select("_row_id", "MAKE", "OBJECT_ID").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r["_row_id"] for r in rows] == list(range(521))
    assert [(r["MAKE"], r["OBJECT_ID"]) for r in rows] == [(f, i) for f, n in (("a.csv", 30), ("b.csv", 400), ("c.csv", 1), ("d.csv", 90))
                                                           for i in range(n)]


def test_one_scan_per_header_and_wide_files(spark, tmp_path):
    wide = [*NAMES, *(f"x{i}" for i in range(200))]
    for i in range(6):
        write_csv(tmp_path / f"{i}.csv", wide if i % 2 else NAMES, [policy(i)])
    heads = [tuple(r) for r in policy_io.file_heads(policy_io.text_lines(spark, str(tmp_path))).collect()]
    scan = policy_io.scan_csv(spark, heads)
    assert scan._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 2
    assert scan.count() == 6 and "x199" in scan.columns


def test_a_line_longer_than_its_header_fails(spark, tmp_path):
    write_csv(tmp_path / "a.csv", NAMES, [policy(1), policy(2)])
    with open(tmp_path / "a.csv", "a") as f:
        f.write("3" + ",1" * len(NAMES) + "\n")
    with pytest.raises(Exception, match="more cells"):
        policy_io.read_policies_csv(spark, str(tmp_path)).collect()
