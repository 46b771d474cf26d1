"""Weighted choice, landing reader, sinks, layout, refresh and streaming."""

import datetime as dt
import os
import uuid

from pyspark.sql import functions as F

from claimscope import constants as K
from claimscope.functions.choice import weighted_choice
from claimscope.plans import catalog
from claimscope.plans import layers as L
from claimscope.plans.layout import layout_cluster
from claimscope.plans.refresh import refresh, refresh_report
from claimscope.session import scratch_path
from claimscope.sources import landing as LD
from claimscope.sources import sinks as SK
from claimscope.sources.tables import read_table
from claimscope.streaming import scoring as ST

SF = "/root/testdata/sf0.001"


def scratch(spark, name):
    return scratch_path(spark, f"test-{name}-{uuid.uuid4().hex[:8]}")


def test_weighted_choice_thresholds(spark):
    df = spark.createDataFrame([(0.0,), (0.0799,), (0.08,), (0.9999,)], "u double")
    got = [r.v for r in df.select(weighted_choice(K.FRAUD_LABELS, K.FRAUD_LABEL_WEIGHTS, F.col("u")).alias("v")).collect()]
    assert got == ["WIRE_FRAUD", "WIRE_FRAUD", "ID_MISMATCH", "NONE"]


def test_landing_csv_keeps_corrupt_rows(spark):
    path = scratch(spark, "landing")
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "claimants.csv"), "w") as f:
        f.write("claimant_id,first_name,last_name,state,ssn_last4,id_verified,account_age_days\n")
        f.write("CLM-ID-1,Ann,Lee,TX,1234,true,100\n")
        f.write("CLM-ID-2,Ben,Kim,FL,5678,notabool,200\n")
    rows = LD.read_landing(spark, path, LD.CLAIMANTS_SCHEMA, fmt="csv").collect()
    assert len(rows) == 2
    assert rows[0]._corrupt_record is None and rows[1]._corrupt_record is not None


def test_landing_csv_binds_columns_by_header(spark):
    path = scratch(spark, "landing-order")
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "claimants.csv"), "w") as f:
        f.write("last_name,claimant_id,first_name,state,ssn_last4,id_verified,account_age_days\n")
        f.write("Smith,CLM-ID-1,Ann,TX,1234,true,100\n")
    row = LD.read_landing(spark, path, LD.CLAIMANTS_SCHEMA, fmt="csv", keep_corrupt=False).collect()[0]
    assert (row.claimant_id, row.last_name) == ("CLM-ID-1", "Smith")


def test_read_table_sees_a_folder_grow(spark):
    base = scratch(spark, "growing")
    spark.range(10).write.parquet(f"{base}/t.parquet")
    assert read_table(spark, base, "t").count() == 10
    spark.range(10).write.mode("append").parquet(f"{base}/t.parquet")
    assert read_table(spark, base, "t").count() == 20


def test_retried_micro_batch_replaces_its_rows(spark):
    base = scratch(spark, "retry")
    bronze = L.bronze_claims(spark, SF).limit(50)
    batch = spark.createDataFrame(bronze.collect(), bronze.schema)
    process = ST.velocity_batches(f"{base}/state", f"{base}/gold", as_of=K.FIXTURE_AS_OF, scored_at=K.FIXTURE_SCORED_AT)
    process(batch, 0)
    process(batch, 0)
    assert spark.read.parquet(f"{base}/gold").count() == 50


def test_overwrite_counts_and_append_evolution(spark):
    path = scratch(spark, "sink")
    n = SK.sink_overwrite(spark.range(10), path)
    assert n == 10 and SK.rows_after_write(spark, path).collect()[0].row_count == 10
    SK.sink_append_evolving(spark.range(3).withColumn("extra", F.lit("x")), path)
    merged = SK.read_evolving(spark, path)
    assert merged.count() == 13 and merged.filter(F.col("extra").isNull()).count() == 10


def test_layout_cluster_keeps_rows(spark):
    gold = L.gold(spark, SF)
    clustered = layout_cluster(gold, partitions=4)
    assert clustered.count() == gold.count()
    assert clustered.rdd.getNumPartitions() <= 4
    assert sorted(clustered.collect()) == sorted(gold.collect())


def test_refresh_writes_layers(spark):
    from claimscope.sources import fixtures as FX

    res = refresh(spark, FX.bronze_claims(spark, SF), FX.claimants(spark, SF), FX.properties(spark, SF),
                  base=scratch(spark, "refresh"), as_of=K.FIXTURE_AS_OF, scored_at=K.FIXTURE_SCORED_AT)
    assert res.rows["gold_claims_fraud_scored"] == res.rows["bronze_claims_raw"]
    rep = refresh_report(spark, res).collect()
    assert {r.section for r in rep} == {"row_counts", "schema", "score_distribution", "nulls", "velocity"}


def test_alert_throttle_stream_first_breach_per_hour(spark):
    base = scratch(spark, "alerts")
    batches = [
        [(dt.datetime(2024, 1, 1, 0, 5), 1.0), (dt.datetime(2024, 1, 1, 0, 10), 3.0),
         (dt.datetime(2024, 1, 1, 0, 50), 5.0), (dt.datetime(2024, 1, 1, 1, 30), 2.0)],
        [(dt.datetime(2024, 1, 1, 5, 0), 0.0)],   # advances the watermark past both hours
        [(dt.datetime(2024, 1, 1, 6, 0), 0.0)],   # next batch evicts the closed windows
    ]
    for rows in batches:  # one file per micro-batch, in time order
        spark.createDataFrame(rows, "ts timestamp, value double").coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema("ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    q = (ST.alert_throttle_stream(stream, threshold=0).writeStream.outputMode("append").format("memory")
         .queryName("alerts_" + uuid.uuid4().hex[:6]).trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.sql(f"SELECT * FROM {q.name}").orderBy("window_start").collect()
    # windows 00:00 and 01:00 are closed by the watermark of the 05:00 event
    assert [(r.alert_ts.hour, r.alert_ts.minute, r.alert_value) for r in got] == [(0, 5, 1.0), (1, 30, 2.0)]


def test_velocity_stream_matches_batch(spark):
    import __spark_entry__ as E

    stream = E.queries()["stream_velocity"](spark, SF)
    batch = L.silver(spark, SF).select("claim_id", "claim_velocity_24mo")
    assert sorted(stream.collect()) == sorted(batch.collect())


def test_velocity_stream_lands_each_year_through_several_tasks(spark, monkeypatch):
    sf, base = scratch(spark, "velocity-tables"), scratch(spark, "velocity-stream")
    orders = [
        (k, k % 5, "OFP"[k % 3], 1000.0 + k, dt.date(2020 + k % 2, 1 + k % 3, 1 + k % 2), f"{1 + k % 5}-X")
        for k in range(240)
    ]
    names = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate date, o_orderpriority string"
    spark.createDataFrame(orders, names).repartition(4).write.parquet(f"{sf}/orders.parquet")
    lines = [(k, k % 7) for k in range(240)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint").write.parquet(f"{sf}/lineitem.parquet")
    people = [(k, f"c{k}", k, 900.0 + 50 * k) for k in range(5)]
    spark.createDataFrame(people, "c_custkey bigint, c_name string, c_nationkey bigint, c_acctbal double").write.parquet(
        f"{sf}/customer.parquet")
    parts = [(k, 10.0 + k, f"t{k}", k) for k in range(7)]
    spark.createDataFrame(parts, "p_partkey bigint, p_retailprice double, p_type string, p_size bigint").write.parquet(
        f"{sf}/part.parquet")

    monkeypatch.setattr(catalog, "_scratch", lambda *_: base)
    got = sorted(catalog.CATALOG["stream_velocity"].fn(spark, sf).collect())
    assert got == sorted(L.silver(spark, sf).select("claim_id", "claim_velocity_24mo").collect())

    # a claimant's day stands in several files of a year, which are one micro-batch all the same
    landed = spark.read.parquet(f"{base}/landing").withColumn("file", F.col("_metadata.file_path"))
    per_year = landed.groupBy(F.year("filed_date").alias("y")).agg(F.count_distinct("file").alias("n")).collect()
    assert {r.y for r in per_year} == {2020, 2021} and all(r.n > 1 for r in per_year)
    per_day = landed.groupBy("claimant_id", "filed_date").agg(F.count_distinct("file").alias("n"))
    assert per_day.filter("n > 1").count() > 0
    assert spark.read.parquet(f"{base}/gold").select("batch").distinct().count() == 2
