"""Bronze operators: denormalisation and the property value change."""

from claimscope.operators.bronze import claims_denormalise, property_value_change


def test_denormalise_keeps_claims_and_ignores_duplicate_dimensions(spark):
    claims = spark.createDataFrame(
        [("CLM-2024-1", "C1", "P1", 10.0), ("CLM-2024-2", "C2", None, 20.0), ("CLM-2024-3", "C9", "P9", 30.0)],
        "claim_id string, claimant_id string, property_id string, claim_amount double")
    claimants = spark.createDataFrame(
        [("C1", "TX", False, 100), ("C1", "TX", False, 100), ("C2", "FL", True, 900)],
        "claimant_id string, state string, id_verified boolean, account_age_days bigint")
    properties = spark.createDataFrame([("P1", 31.4, True)], "property_id string, value_pct_change double, has_lien boolean")
    out = {r.claim_id: r for r in claims_denormalise(claims, claimants, properties).collect()}
    assert len(out) == 3
    assert (out["CLM-2024-1"].state, out["CLM-2024-1"].value_pct_change, out["CLM-2024-1"].has_lien) == ("TX", 31.4, True)
    assert out["CLM-2024-2"].value_pct_change is None and out["CLM-2024-2"].state == "FL"
    assert out["CLM-2024-3"].state is None


def test_property_value_change(spark):
    df = spark.createDataFrame([(100000.0, 131400.0), (0.0, 5.0), (200000.0, 190000.0)],
                               "value_at_closing double, current_value double")
    got = [r.value_pct_change_calc for r in property_value_change(df).collect()]
    assert got == [31.4, None, -5.0]
