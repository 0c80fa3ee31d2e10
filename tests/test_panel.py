import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import features, panel, splits
from gridloom.plans.inputs import supplier_panel, supplier_series
from gridloom.sources import tables
from tests.conftest import SF


def test_series_from_facts_equals_the_dense_grid(spark):
    dense = {r.id: r.ys for r in panel.series(supplier_panel(spark, SF)).collect()}
    direct = {r.id: r.ys for r in supplier_series(spark, SF).collect()}
    assert dense == direct and all(len(y) == 2500 for y in dense.values())
    edge = spark.createDataFrame([(1, 1, 5.0), (1, 4, 7.0), (2, 5, 1.0), (3, 9, 1.0)], "id int, day_idx int, sales double")
    assert {r.id: r.ys for r in panel.series_from_facts(edge, 1, 5).collect()} == {1: [5, 0, 0, 7, 0], 2: [0, 0, 0, 0, 1]}


def test_dense_checks_and_labels(spark):
    grid = panel.dense_grid(spark.createDataFrame([(1, 2, 3.0)], "id int, day_idx int, sales double"), 1, 3)
    assert panel.require_dense(grid, 3).count() == 3
    with pytest.raises(panel.SchemaError):
        panel.require_dense(grid.where("day_idx <> 2"), 3)
    with pytest.raises(Exception, match="not a day label"):
        spark.createDataFrame([("x_3",)], "d string").select(panel.day_number(F.col("d"))).collect()
    with pytest.raises(panel.SchemaError):
        panel.require_columns(grid, ["price"], "grid")


def test_ingest(spark, tmp_path):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    tables.generate_raw(raw, 120, 3)
    assert not tables.ingest(spark, raw, out, 120)["skipped"]
    assert tables.ingest(spark, raw, out, 120)["skipped"]
    assert not tables.ingest(spark, raw, out, 120, force=True)["skipped"]
    entities, dynamic = tables.load_processed(spark, out)
    assert entities.count() == 24 and dynamic.count() == 24 * 120
    panel.require_dense(dynamic, 120)
    assert dynamic.where("sell_price is null").count() > 0
    with pytest.raises(panel.SchemaError):
        tables.read_raw(spark, raw, 119)
    with pytest.raises(panel.SchemaError):
        tables.read_raw(spark, str(tmp_path), 120)
    prices = spark.createDataFrame([("s", "i", 1, 2.0)] * 2, "store_id string, item_id string, wm_yr_wk long, sell_price double")
    with pytest.raises(panel.SchemaError):
        panel.join_calendar_and_prices(dynamic, dynamic, prices)


def test_features_ignore_the_future(spark, tmp_path):
    tables.generate_raw(str(tmp_path), 120, 1)
    entities, dynamic = tables.build_panel(*tables.read_raw(spark, str(tmp_path), 120))
    joined = dynamic.join(entities.select("id", "item_id"), "id")
    wrong = joined.withColumn("sales", F.when(F.col("day_idx") > 92, 999).otherwise(F.col("sales"))).withColumn("sell_price", F.when(F.col("day_idx") > 92, 77.0).otherwise(F.col("sell_price")))
    rows = [features.training_rows(features.feature_frame(x, 92), 92).select("id", "day_idx", *features.FEATURE_COLUMNS).toPandas().sort_values(["id", "day_idx"]).reset_index(drop=True) for x in (joined, wrong)]
    assert rows[0].equals(rows[1]) and len(rows[0]) == 24 * (92 - 28)


def test_splits_and_guards(spark):
    made = splits.check_splits(splits.rolling_splits(spark, 1941))
    assert sorted(r.origin for r in made.collect()) == [1829, 1857, 1885, 1913]
    assert splits.split_of(made, "val").last == 1913
    with pytest.raises(KeyError):
        splits.split_of(made, "other")
    with pytest.raises(splits.LeakageError):
        splits.check_splits(spark.createDataFrame([("val", 100, 101, 128), ("test", 110, 111, 138)], made.schema), 0)
    with pytest.raises(splits.LeakageError):
        splits.check_splits(splits.rolling_splits(spark, 1941, earlier=1))
    with pytest.raises(splits.LeakageError):
        splits.require_horizon(72, 28, 100)
    splits.require_horizon(71, 28, 100)
    with pytest.raises(ValueError):
        splits.require_horizon(1, 0, 100)
    found = spark.createDataFrame([(71, 100), (72, 100)], "t_r int, origin int")
    with pytest.raises(Exception, match="reaches into"):
        splits.require_legal(found, 28).collect()
    spec = {"split": {"train_end": 5, "val_end": 9, "test_start": 9}, "windows": {"train": [[1, 5]], "eval": [[6, 9]]}, "features": {"columns": ["a", "y"], "target": "y"}, "retrieval": {"t_r": 1, "horizon": 2, "origin": 9}}
    assert [c["ok"] for c in splits.audit_spec(spec)] == [False, True, False, True]


def test_sources(spark, tmp_path):
    log = spark.createDataFrame([(1, 7, "2024-01-01", 2.0, True), (1, 7, "2024-01-03", -1.0, None), (2, 7, "2024-01-02", 5.0, False), (1, 7, "2024-01-04", 1.0, None)], "store_nbr int, item_nbr int, date string, unit_sales double, onpromotion boolean")
    items = spark.createDataFrame([(7, "F")], "item_nbr int, family string")
    stores = spark.createDataFrame([(1, "Quito")], "store_nbr int, city string")
    entities, dynamic = tables.ingest_sales_log(log, items, stores, "2024-01-01", "2024-01-04", 2)
    assert [r.sales for r in dynamic.orderBy("day_idx").collect()] == [2, 0, 0, 1]
    assert entities.first().city == "Quito" and entities.first().family == "F"
    path = str(tmp_path / "z.csv")
    with open(path, "w") as f:
        f.write("date,a,b\n" + "".join(f"2016-01-{k + 1:02d},{k},{5}\n" for k in range(9)))
    z = {(r["var"], r.t): r.z for r in tables.load_multivariate(spark, path, 5).collect()}
    assert z["a", 3] == 0 and abs(z["a", 5] - 2 / np.sqrt(2)) < 1e-12 and z["b", 9] == 0
    out = str(tmp_path / "runs")
    assert tables.run_resumable(spark, out, [1, 2], lambda o: spark.range(o)) == [1, 2]
    assert tables.run_resumable(spark, out, [1, 2, 3], lambda o: spark.range(o)) == [3]
    # A run that ended between a unit's data and its entry in the manifest: the unit is written again, in place.
    spark.range(99).write.parquet(f"{out}/origin=4")
    assert tables.read_resumable(spark, out).groupBy("origin").count().orderBy("origin").collect() == [(1, 1), (2, 2), (3, 3)]
    assert tables.run_resumable(spark, out, [4], lambda o: spark.range(o)) == [4] and tables.read_resumable(spark, out).where("origin = 4").count() == 4
    with pytest.raises(ValueError):
        tables.read_resumable(spark, str(tmp_path / "none"))
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"name": "a", "processed_dir": "p", "subset": 10, "seeds": [1, 2]}))
    assert tables.require_declared(tables.RunConfig.load(str(config))).seeds == (1, 2)
    config.write_text(json.dumps({"name": "a", "processed_dir": "p", "wrong": 1}))
    with pytest.raises(ValueError):
        tables.RunConfig.load(str(config))
    tables.write_report({"mae": 1.0}, str(tmp_path / "r.json"))
    tables.lock_once(str(tmp_path / "lock"))
    with pytest.raises(PermissionError):
        tables.lock_once(str(tmp_path / "lock"))
    assert tables.select_subset(spark.range(50), 5, 0).count() == 5
    assert tables.read_any(spark, f"{SF}/region.parquet").count() == 5 and "spark" in tables.environment(spark)


def test_stream_equals_batch(spark, tmp_path):
    from gridloom.streaming.rolling import update_panel, windowed_sums

    events = spark.read.parquet(f"{SF}/events.parquet").select(F.col("user_id").alias("id"), "ts", "value")
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    events.orderBy("ts").coalesce(1).write.parquet(src)
    update_panel(spark.readStream.schema(events.schema).parquet(src), out, str(tmp_path / "ck")).awaitTermination()
    batch = {(r.id, r.start): r.n for r in windowed_sums(events).collect()}
    streamed = {(r.id, r.start): r.n for r in spark.read.parquet(out).collect()}
    assert streamed and all(batch[k] == n for k, n in streamed.items())
