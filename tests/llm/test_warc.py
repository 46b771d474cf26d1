"""WARC archive: exact round trip, revisits, damage, plain files."""

import hashlib

from claimscope.llm.warc import export_text, read_archive, write_archive

LONG = "<html>é " + "x" * 200
ROWS = [(5, "http://a/", LONG), (2, "http://b/", LONG), (9, None, LONG), (1, "u", None), (3, "u", ""), (4, "u", "short"), (6, "u", "short"), (7, "u\r\nX: y", "line\r\n\r\nline"),
        (2, "http://b/", LONG), (None, "n", "n" * 150), (8, "n", "n" * 150), (10, "big", "z" * 300_000)]


def _read(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'x' AS digest", "1 AS size", "'p' AS payload")
    return read_archive(spark, write_archive(df, str(tmp_path / "archive")))


def test_round_trip_and_revisits(spark, tmp_path):
    got = _read(spark, tmp_path, ROWS).collect()
    assert sorted((r["page_id"] is None, r["page_id"] or 0, bytes(r["payload"])) for r in got) == sorted((i is None, i or 0, (h or "").encode()) for i, _, h in ROWS)
    for r in got:
        payload = bytes(r["payload"])
        assert r["verified"]
        assert r["payload_bytes"] == len(payload)
        assert r["payload_digest"] == hashlib.sha256(payload).hexdigest()
        assert bytes(r["record"]) == r["header"].encode() + payload + b"\r\n\r\n"
        assert f"Content-Length: {len(payload)}\r\n\r\n" in r["header"]
        if payload == LONG.encode() and r["page_id"] != 2:
            assert (r["record_type"], r["refers_to"]) == ("revisit", 2)
        elif r["page_id"] == 8:
            assert (r["record_type"], r["refers_to"]) == ("revisit", None)  # what it refers to has no id
        else:
            assert (r["record_type"], r["refers_to"]) == ("response", None)
    stored = spark.read.parquet(str(tmp_path / "archive/payloads"))
    assert stored.count() == len({h or "" for _, _, h in ROWS})


def test_damage_is_reported(spark, tmp_path):
    _read(spark, tmp_path, ROWS)
    path = str(tmp_path / "archive")
    payloads = spark.read.parquet(f"{path}/payloads")
    payloads.selectExpr("digest", "CASE WHEN length(payload) > 1000 THEN cast('other' AS binary) ELSE payload END AS payload").write.parquet(f"{path}/new")
    headers = spark.read.parquet(f"{path}/headers")
    headers.write.parquet(str(tmp_path / "bad/headers"))
    spark.read.parquet(f"{path}/new").filter("length(payload) <> 150").write.parquet(str(tmp_path / "bad/payloads"))
    bad = {r["page_id"] for r in read_archive(spark, str(tmp_path / "bad")).collect() if not r["verified"]}
    assert bad == {10, None, 8}


def test_plain_files_and_no_rows(spark, tmp_path):
    records = _read(spark, tmp_path, ROWS[:4])
    export_text(records, str(tmp_path / "plain"))
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "plain").glob("part-*")))
    assert sorted(data.split(b"WARC/1.1\r\n")[1:]) == sorted(bytes(r["record"]).removeprefix(b"WARC/1.1\r\n") for r in records.collect())
    assert _read(spark, tmp_path / "none", []).collect() == []
