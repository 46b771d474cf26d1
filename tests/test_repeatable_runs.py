"""Runs that fail and are repeated, rejects of a landing read, catalog tables, point look-ups."""

import datetime as dt
import os
import uuid

import pytest
from pyspark.sql import functions as F

import claimscope.__main__ as cli
from claimscope.operators.measures import row_security_session, secured_view
from claimscope.operators.quality import dq_report
from claimscope.operators.queue import claim_lookup
from claimscope.plans import layers as L
from claimscope.plans import refresh as RF
from claimscope.plans.investigate import investigate
from claimscope.plans.layout import layout_cluster
from claimscope.session import scratch_path
from claimscope.sources import fixtures as FX
from claimscope.sources import landing as LD
from claimscope.sources import sinks as SK

SF = "/root/testdata/sf0.001"
LOGS = ("investigation_quarantine", "investigation_invalid_claims", "investigation_repeated_replies", "gold_investigation_audit_log")


def scratch(spark, name):
    return scratch_path(spark, f"t-{name}-{uuid.uuid4().hex[:8]}")


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def written(spark):
    """A refreshed folder and a replies table."""
    out = scratch(spark, "runs")
    RF.refresh(spark, FX.bronze_claims(spark, SF), FX.claimants(spark, SF), FX.properties(spark, SF), base=out, as_of=dt.date(2001, 8, 1))
    FX.agent_replies(spark, SF).write.parquet(f"{out}/replies")
    return out


def counts(spark, out):
    found = {name: SK.read_evolving(spark, f"{out}/{name}").count() for name in LOGS}
    return found | {"reports": spark.read.json(f"{out}/investigation_reports").count()}


def test_a_run_that_fails_before_the_audit_is_repeated(spark, written, monkeypatch):
    copies = []
    for name in ("whole", "broken"):
        base = scratch(spark, name)
        spark.read.parquet(f"{written}/gold_claims_fraud_scored").write.parquet(f"{base}/gold_claims_fraud_scored")
        copies.append(base)
    whole, broken = copies
    monkeypatch.setattr(cli, "_session", lambda: spark)
    run = lambda out, run_id: cli.main(["investigate", "--out", out, "--replies", f"{written}/replies", "--run-id", run_id])
    assert run(whole, "r1") == 0
    once = counts(spark, whole)
    assert once["gold_investigation_audit_log"] > 0
    assert once["investigation_quarantine"] > 0

    append = SK.sink_append_evolving

    def failing(df, path, **kw):
        if path.endswith("audit_log"):
            raise OSError("lost")
        append(df, path, **kw)

    monkeypatch.setattr(SK, "sink_append_evolving", failing)
    with pytest.raises(OSError):
        run(broken, "r1")
    monkeypatch.setattr(SK, "sink_append_evolving", append)
    assert not os.path.exists(f"{broken}/gold_investigation_audit_log")
    run(broken, "r1")
    assert counts(spark, broken) == once
    run(broken, "r1")  # a repetition of a whole run changes nothing, either
    assert counts(spark, broken) == once
    run(broken, "r2")  # another run: what is audited isn't queued, what is logged isn't logged again
    assert counts(spark, broken) == once


def test_a_repetition_without_rows_replaces_earlier_ones(spark):
    path = scratch(spark, "empty-repeat")
    SK.sink_append_evolving(spark.range(5), path, run_id="a")
    SK.sink_append_evolving(spark.range(3), path, run_id="b")
    SK.sink_append_evolving(spark.range(0), path, run_id="a")
    assert SK.read_evolving(spark, path).groupBy("run").count().collect() == [("b", 3)]
    assert SK.read_evolving(spark, path, but_run="b").count() == 0
    for bad in ("", "2001-01-01", "7", "a/b", "a b"):
        with pytest.raises(ValueError):
            SK.run_folder(path, bad)


LINES = {
    "a": ["claimant_id,first_name,last_name,state,ssn_last4,id_verified,account_age_days", "c1,Ann,\"Li, Wu\",TX,1234,true,10", "c2,Ben,Ox", "", "c3,Cy,Px,TX,1,notabool,xx"],
    "b": ["state,claimant_id,account_age_days,id_verified,ssn_last4,last_name,first_name", "FL,c4,20,false,99,Ode,Dee", "FL,c5,20,false,99,Ode,Dee,more"],
    "c": ["no,header,here", "c6,Eve,Zed,CA,5,true,3"],
    "d": [],
}


def test_landing_split_loses_no_line(spark):
    path = scratch(spark, "landing-split")
    os.makedirs(path)
    for name, lines in LINES.items():
        with open(f"{path}/{name}.csv", "w") as f:
            f.write("\n".join(lines))
    landed = LD.split_landing(spark, path, LD.CLAIMANTS_SCHEMA, fmt="csv")
    assert landed.good.schema == LD.CLAIMANTS_SCHEMA
    assert sorted(tuple(r) for r in landed.good.collect()) == [("c1", "Ann", "Li, Wu", "TX", "1234", True, 10), ("c4", "Dee", "Ode", "FL", "99", False, 20)]
    got = sorted((os.path.basename(r.source_file), r.reason, r.record) for r in landed.rejects.collect())
    assert got == [
        ("a.csv", "malformed", "c2,Ben,Ox"), ("a.csv", "malformed", "c3,Cy,Px,TX,1,notabool,xx"),
        ("b.csv", "malformed", "FL,c5,20,false,99,Ode,Dee,more"),
        ("c.csv", "no header", "c6,Eve,Zed,CA,5,true,3"), ("c.csv", "no header", "no,header,here"),
    ]


def test_json_split_and_rejects_of_a_refresh(spark):
    path, out = scratch(spark, "landing-json"), scratch(spark, "refreshed")
    claims = FX.bronze_claims(spark, SF)
    claims.write.json(path)
    spark.createDataFrame([("{broken",), ('{"claim_id": "x", "id_verified": "perhaps"}',)], "value string").coalesce(1).write.mode("append").text(path)
    landed = LD.split_landing(spark, path, LD.BRONZE_CLAIMS_SCHEMA, fmt="json")
    parquet = LD.split_landing(spark, f"{SF}/customer.parquet", spark.read.parquet(f"{SF}/customer.parquet").schema)
    assert parquet.rejects.count() == 0
    res = RF.refresh(spark, landed, FX.claimants(spark, SF), FX.properties(spark, SF), base=out)
    n = claims.count()
    assert res.rows["bronze_claims_raw"] == n == res.rows["gold_claims_fraud_scored"]
    assert res.rows["bronze_claims_raw_rejects"] == 2
    assert {r.reason for r in spark.read.parquet(f"{out}/bronze_claims_raw_rejects").collect()} == {"malformed"}


def test_catalog_tables_join_without_an_exchange(spark, monkeypatch):
    db, out = f"claims_{uuid.uuid4().hex[:8]}", scratch(spark, "named")
    monkeypatch.setattr(cli, "_session", lambda: spark)
    assert cli.main(["refresh", "--sf-dir", SF, "--out", out, "--database", db, "--as-of", "2001-08-01"]) == 0
    SK.sink_overwrite(FX.agent_replies(spark, SF), f"{out}/replies", f"{db}.replies", bucket_by=(RF.BUCKETS, "claim_id"))
    for _ in range(2):  # a run and its repetition
        assert cli.main(["investigate", "--out", out, "--database", db, "--replies", f"{db}.replies", "--run-id", "r1"]) == 0
    audit, gold = spark.table(f"{db}.gold_investigation_audit_log"), spark.table(f"{db}.gold_claims_fraud_scored")
    plain = investigate(gold, spark.table(f"{db}.replies")).audit
    assert audit.count() == plain.count() > 0
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = gold.join(spark.table(f"{db}.replies"), "claim_id").join(audit.select("claim_id"), "claim_id", "left_anti")
        plan = executed(joined.select("claim_id", "agent"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("SortMergeJoin") >= 2
    assert "Exchange" not in plan
    assert cli.main(["queue", "--out", out, "--database", db]) == 0
    with pytest.raises(ValueError):
        SK.sink_overwrite(spark.range(1), f"{out}/x", bucket_by=(2, "id"))


def test_look_ups_skip_row_groups_by_bloom_filter(spark):
    """The table is sorted by tier and date, so the ids of a row group span a wide range: that it lacks one
    of them only its bloom filter tells."""
    gold = layout_cluster(L.gold(spark, "/root/testdata/sf0.01"), partitions=4)
    there = gold.orderBy("claim_id").select("claim_id").limit(7_500).tail(1)[0].claim_id  # from the middle
    rows = {}
    for name, lookup in (("plain", ()), ("bloom", ("claim_id",))):
        path = scratch(spark, name)
        writer = gold.write.option("parquet.block.size", str(64 * 1024)).option("parquet.enable.dictionary", "false")
        SK.with_lookup(writer, lookup, 15_000).parquet(path)
        for claim_id, n in ((there, 1), (f"{there}5", 0)):
            found = claim_lookup(spark.read.parquet(path), claim_id)
            assert len(found.collect()) == n
            assert f"PushedFilters: [IsNotNull(claim_id), EqualTo(claim_id,{claim_id})]" in found._jdf.queryExecution().executedPlan().toString()
            rows[name, n] = scanned(found)
    assert rows["plain", 0] > 0
    assert rows["bloom", 0] == 0
    assert rows["bloom", 1] <= rows["plain", 1]


def scanned(df):
    """Rows that the scan of an executed plan gave out: those of the row groups it read."""
    plan = df._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().apply(0)
    if "finalPhysicalPlan" in dir(plan):
        plan = plan.finalPhysicalPlan()
    return plan.metrics().apply("numOutputRows").value()


def test_silver_evaluates_bronze_once(spark):
    plan = executed(L.silver(spark, SF))
    assert plan.split("Initial Plan")[0].count("FileScan parquet") == 5  # orders twice, lineitem, customer, part
    with_history = {tuple(r) for r in L.silver(spark, SF).collect()}
    from claimscope.operators.silver import silver_enrich

    assert with_history == {tuple(r) for r in silver_enrich(FX.bronze_claims(spark, SF), as_of=dt.date(2001, 8, 1)).collect()}


def test_replies_of_the_queue_are_selected_by_a_size_checked_broadcast(spark, written):
    """The queue is a written table, so its ids are broadcast to the replies' scan where they are few, and
    the replies themselves never are."""
    inv = investigate(spark.read.parquet(f"{written}/gold_claims_fraud_scored"), spark.read.parquet(f"{written}/replies"))
    plan = executed(inv.repeated_replies)
    assert "ExistingRDD" not in plan
    assert "BroadcastHashJoin [claim_id" in plan
    assert "LeftSemi, BuildRight" in plan
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" in executed(inv.repeated_replies.select("*"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ExistingRDD" not in executed(inv.audit)


def test_coercions_of_reply_values(spark):
    from claimscope.operators.replies import reply_parse

    texts = {
        "a": '{"status": "FLAGGED", "ssn_discrepancies": "3.0", "watchlist_match": "true"}',
        "b": '{"status": "FLAGGED", "ssn_discrepancies": "1_0.00", "watchlist_match": "ON"}',
        "c": '{"status": "FLAGGED", "ssn_discrepancies": "3.5"}',
        "d": '{"status": "FLAGGED", "watchlist_match": " true "}',
        "e": '{"status": "FLAGGED", "ssn_discrepancies": " 4 "}',
    }
    rows = spark.createDataFrame([(c, "identity", t) for c, t in texts.items()], "claim_id string, agent string, raw_response string")
    got = {r.claim_id: r.result for r in reply_parse(rows, "identity").collect()}
    shown = {c: (r["status"], r["ssn_discrepancies"], r["watchlist_match"]) for c, r in got.items()}
    assert shown["a"] == ("FLAGGED", 3, True)
    assert shown["b"] == ("FLAGGED", 10, True)
    assert shown["c"][0] == shown["d"][0] == "ERROR"
    assert shown["e"][:2] == ("FLAGGED", 4)


def test_rows_logged_alike_are_not_logged_again(spark):
    rows = spark.createDataFrame([("a", None, ["x"]), ("b", "t", ["y"]), ("c", "t", None)], "claim_id string, raw string, why array<string>")
    log = rows.limit(2).withColumn("run", F.lit("r0")).drop("why").withColumn("why", F.array(F.lit("x")))
    assert {r.claim_id for r in SK.not_logged(rows, log).collect()} == {"b", "c"}
    assert SK.not_logged(rows, None) is rows


def test_the_report_of_a_refresh_reads_no_layer(spark):
    bronze, claimants, properties = (f(spark, SF) for f in (FX.bronze_claims, FX.claimants, FX.properties))
    for claims in (bronze, bronze.limit(0)):
        res = RF.refresh(spark, claims, claimants, properties, base=scratch(spark, "measured"), as_of=dt.date(2001, 8, 1), scored_at=dt.datetime(2001, 8, 1))
        report = RF.refresh_report(spark, res)
        assert "FileScan" not in executed(report)
        read = dq_report({name: res.read(spark, name) for name in RF.LAYERS})
        assert "FileScan" in executed(read)
        assert report.schema == read.schema
        assert sorted(report.collect(), key=str) == sorted(read.collect(), key=str)


def test_secured_view_follows_the_session_user(spark):
    db = f"secured_{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE DATABASE {db}")
    gold = spark.createDataFrame([("c1", "Ann"), ("c2", "Ben"), ("c3", None), ("c4", "Ann")], "claim_id string, assigned_investigator string")
    me = spark.range(1).select(F.session_user()).first()[0]
    users = spark.createDataFrame([(me, "Ann"), (me, "Ann"), ("another", "Ben"), (None, "Ben"), (me, None)], "user_name string, investigator string")
    SK.sink_overwrite(gold, scratch(spark, "gold"), f"{db}.gold")
    for assigned, expected in ((users, ["c1", "c4"]), (users.filter("user_name = 'another'"), [])):
        SK.sink_overwrite(assigned, scratch(spark, "users"), f"{db}.users")
        secured_view(spark, f"{db}.mine", f"{db}.gold", f"{db}.users")
        view = spark.table(f"{db}.mine")
        assert view.columns == gold.columns
        assert sorted(r.claim_id for r in view.collect()) == expected
        assert sorted(r.claim_id for r in row_security_session(gold, assigned).collect()) == expected
    plan = executed(spark.table(f"{db}.mine").filter("claim_id = 'c1'"))
    assert "EqualTo(claim_id,c1)" in plan
