"""Raw files to named tables, and the checks of a report."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockweave import session
from stockweave.plans import outputs, report
from stockweave.sources import panel as panels
from stockweave.sources import synthetic

def least(spark, **changes):
    """The smallest report that passes: a row of its stated schema for each dataset, all null but for what is checked."""
    filled = {"meta": {"escenarios": "array(struct(7, 0.95D, 'sqrt'))", "pronostico_fechas": "array('2016-05-23')"}, "skus": {"id": "'A_1'", "ss": "array(3L)", "rop": "array(9L)", "pronostico": "array(1.5D)"}}
    sets = {}
    for name in report.DATASETS:
        own = filled.get(name, {}) | (changes.get(name) or {})
        stated = T.StructType.fromDDL(report.SCHEMAS[name])
        columns = [f"CAST({own.pop(f.name, 'NULL')} AS {f.dataType.simpleString()}) AS `{f.name}`" for f in stated]
        sets[name] = spark.range(1).selectExpr(*columns, *[f"{v} AS `{k}`" for k, v in own.items()])
    return {k: v for k, v in sets.items() if changes.get(k, 1) is not None}


def test_report_checks(spark):
    report.validate(least(spark))
    for column in ("y", "sell_price", "price", "revenue", "demand"):
        with pytest.raises(ValueError, match=r"real_vs_pronostico: original \(1\)"):
            report.validate(least(spark, real_vs_pronostico={column: "3"}))
    with pytest.raises(ValueError, match="frontera: present"):
        report.validate(least(spark, frontera=None))
    with pytest.raises(ValueError, match=r"skus: scenarios \(1\)"):
        report.validate(least(spark, skus={"ss": "array(3L, 4L)"}))
    with pytest.raises(ValueError, match="skus: horizon"):
        report.validate(least(spark, skus={"pronostico": "array(1.5D, 2.5D)"}))
    with pytest.raises(ValueError, match="skus: scenarios"):
        report.validate(least(spark, skus={"rop": "NULL"}))
    sets = least(spark)
    sets["wrmsse"] = sets["wrmsse"].drop("value")
    sets["costos"] = sets["costos"].withColumn("order_cost", F.lit("dear"))
    assert sorted(tuple(r) for r in report.faults(sets).collect()) == [("costos", "columns", 1), ("wrmsse", "columns", 1)]
    assert report.faults({}).count() == len(report.DATASETS)


def test_report_document_and_round_trip(spark, tmp_path):
    sets = least(spark, costos={"order_cost": "2.5D"}, skus={"id": "'é\"</script>'"}, real_vs_pronostico={"GlobalBoosted": "4.5D"})
    got = json.loads(report.document(sets))
    assert got["costos"]["order_cost"] == [2.5] and got["skus"]["id"] == ["é\"</script>"] and got["meta"]["escenarios"] == [{"col1": 7, "col2": 0.95, "col3": "sqrt"}] or got["meta"]["escenarios"][0]["metodo"] == "sqrt"
    with pytest.raises(ValueError, match="too many"):
        report.document({"costos": spark.range(11)}, most=10)
    report.write(sets, f"{tmp_path}/r")
    back = report.read(spark, f"{tmp_path}/r")
    report.validate(back)
    for name, df in sets.items():
        assert back[name].select(*df.columns).collect() == df.collect(), name
    part = next((tmp_path / "r" / "costos").glob("part-*"))
    part.write_text("{not json\n")
    for crc in (tmp_path / "r" / "costos").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(Exception, match="(?i)malformed"):
        report.read(spark, f"{tmp_path}/r")["costos"].collect()
    assert set(report.read(spark, f"{tmp_path}/none")) == set() and len(report.combos()) == 18


def test_commit_of_a_work_tree(tmp_path):
    assert report.commit_of(tmp_path, {}) is None and report.commit_of(tmp_path, {"GITHUB_SHA": "abc"}) == "abc"
    git = tmp_path / ".git"
    (git / "refs/heads").mkdir(parents=True)
    (git / "HEAD").write_text("ref: refs/heads/main\n")
    (git / "packed-refs").write_text("# pack\n1234 refs/heads/main\n")
    assert report.commit_of(tmp_path, {}) == "1234"
    (git / "refs/heads/main").write_text("5678\n")
    assert report.commit_of(tmp_path, {}) == "5678"
    (git / "HEAD").write_text("9abc\n")
    assert report.commit_of(tmp_path, {}) == "9abc"


def test_settings():
    assert outputs.Settings.from_environment({}) == outputs.Settings()
    assert outputs.Settings.from_environment({"STOCKWEAVE_STORE": "TX_2", "STOCKWEAVE_SKIP_SARIMA": "1"}) == outputs.Settings("TX_2", "FOODS", True)


def test_raw_files_to_tables(spark, tmp_path):
    synthetic.generate(spark, f"{tmp_path}/raw", 6, 420)
    tables = outputs.run(spark, f"{tmp_path}/raw", f"{tmp_path}/out", 420, outputs.Settings(skip_sarima=True), min_history=300, rounds=2, leaves=8, rate=0.3)
    assert {"sales_long", "future_exog", "cv_global", "forecast_future", "metrics_segment", "sim_frontier", "policy_table"} <= set(tables)
    n = tables["sales_long"].select("unique_id").distinct().count()
    assert n == 5 and tables["policy_table"].count() == n and tables["forecast_future"].count() == 28 * n
    assert {r["policy"] for r in tables["sim_by_sku"].select("policy").distinct().collect()} == {"Clásica (media móvil)", "SeasonalNaive", "GlobalBoosted"}
    assert tables["forecast_future"].where("`80_lo` > `80_hi` or `95_lo` > `80_lo` or yhat is null").count() == 0
    assert tables["cv_ets"].where("yhat is null or yhat < 0").count() == 0


def test_broken_lines_are_kept_and_reported(spark, tmp_path):
    synthetic.generate(spark, f"{tmp_path}/raw", 4, 30)
    folder = tmp_path / "raw" / "sales_train_evaluation.csv"
    part = next(f for f in folder.iterdir() if f.name.startswith("part-") and len(f.read_text().splitlines()) > 1)
    head, *lines = part.read_text().splitlines()
    wrong = lines[0].rsplit(",", 1)[0] + ",many"
    part.write_text("\n".join([head, *lines, wrong, "only,three,values"]) + "\n")
    for crc in folder.glob(".*.crc"):
        crc.unlink()
    sales, calendar, prices, rejected = panels.read_raw_checked(spark, f"{tmp_path}/raw", 30)
    assert sales.count() == 4 and calendar.count() == 58 and prices.count() > 0
    got = rejected.collect()
    assert sorted(r["line"] for r in got) == sorted([wrong, "only,three,values"]) and all(r["file"].startswith("sales_train") for r in got)
    assert panels.read_raw(spark, f"{tmp_path}/raw", 30)[0].count() == 4


def test_store_notices_release_and_changed_sources(spark, tmp_path):
    source, made = f"{tmp_path}/source", []
    spark.range(3).write.parquet(f"{source}/t.parquet")

    def make():
        made.append(1)
        return {"a": spark.read.parquet(f"{source}/t.parquet"), "b": spark.range(1)}

    assert outputs.stored(spark, source, "a", make).count() == 3 and outputs.stored(spark, source, "b", make).count() == 1 and len(made) == 1
    spark.range(5).write.mode("append").parquet(f"{source}/t.parquet")
    assert outputs.stored(spark, source, "a", make).count() == 8 and len(made) == 2
    session.release(spark)
    assert outputs.stored(spark, source, "b", make).count() == 1 and outputs.stored(spark, source, "a", make).count() == 8 and len(made) == 3


def test_discard_deletes_own_tables_only(spark, tmp_path):
    own = session.materialize(spark.range(4), "own")
    folder = next(iter(own.inputFiles())).rsplit("/", 1)[0]
    spark.range(2).write.parquet(f"{tmp_path}/kept")
    session.discard(own)
    session.discard(spark.read.parquet(f"{tmp_path}/kept"))
    assert not session.exists(spark, folder) and session.exists(spark, f"{tmp_path}/kept")
