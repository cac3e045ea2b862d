from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from waybill.operators.timestamps import normalise, normalise_timestamps, to_utc, zone_tables, zone_version

CASES = [
    ("2023-04-27", "UTC", "DMY", "2023-04-27"),
    ("02/07/2025", "America/Chicago", "MDY", "2025-02-07"),
    ("02/07/2025", "Europe/Berlin", "DMY", "2025-07-02"),
    ("10.28.2024", "Europe/Berlin", "DMY", "2024-10-28"),
    ("31/02/2024", "Europe/Berlin", "DMY", None),
    ("26 Feb 2024 23:08 EST", "America/New_York", "MDY", "2024-02-27T04:08:00Z"),
    ("15 Oct 2024 22:52 CST", "Asia/Shanghai", "YMD", "2024-10-15T14:52:00Z"),
    ("13:38 16-FEB-2024", "Asia/Dubai", "DMY", "2024-02-16T09:38:00Z"),
    ("45971", "UTC", "DMY", "2025-11-10"),
    ("1739523912804", "UTC", "DMY", "2025-02-14T09:05:12Z"),
    ("20240902063829", "America/Chicago", "MDY", "2024-09-02T11:38:29Z"),
    ("2023-184", "UTC", "DMY", "2023-07-03"),
    ("2 de novembro de 2024", "UTC", "DMY", "2024-11-02"),
    ("2025年7月18日", "Asia/Tokyo", "YMD", "2025-07-18"),
    ("Jan'25", "UTC", "DMY", "2025-01"),
    ("07/2022", "UTC", "DMY", "2022-07"),
    ("December 25, 2022 at 12:14 AM", "America/Chicago", "MDY", "2022-12-25T06:14:00Z"),
    ("2023-07-25 17:28 GMT+5:30", "UTC", "DMY", "2023-07-25T11:58:00Z"),
    ("2023-03-12 02:30:00", "America/Chicago", "MDY", "2023-03-12T08:30:00Z"),  # skipped: offset before
    ("2023-11-05 01:30:00", "America/Chicago", "MDY", "2023-11-05T06:30:00Z"),  # twice: the earlier
    ("Date: 8/4/2024 06:56 PM", "America/Chicago", "DMY", "2024-04-08T23:56:00Z"),
    ("12 mai 2024 à 10:30", "Europe/Paris", "DMY", "2024-05-12T08:30:00Z"),
    ("8/4/2024 6:56 p.m.", "America/Chicago", "MDY", "2024-08-04T23:56:00Z"),
    (" " * 300 + "2024/05/06" + " " * 300, "UTC", "DMY", "2024-05-06"),
    ("1 " * 50_000, "UTC", "DMY", None),
    ("." * 100_000 + "2024", "UTC", "DMY", None),
    ("to follow", "UTC", "DMY", None),
    ("--/--/----", "UTC", "DMY", None),
    ("", "UTC", "DMY", None),
    (None, None, None, None),
]


@pytest.mark.parametrize(("text", "zone", "order", "norm"), CASES)
def test_forms(text, zone, order, norm):
    assert normalise([text], [zone], [order]) == [norm]


@settings(max_examples=200, deadline=None)
@given(st.datetimes(datetime(1990, 1, 1), datetime(2099, 1, 1)), st.sampled_from(["Europe/Berlin", "America/Sao_Paulo", "Australia/Sydney", "Asia/Kolkata", "America/New_York"]))
def test_zone_tables_agree_with_zoneinfo(local, zone):
    import numpy as np

    local = local.replace(microsecond=0)
    seconds = int((local - datetime(1970, 1, 1)) / timedelta(seconds=1))
    expected = int(local.replace(tzinfo=ZoneInfo(zone), fold=0).astimezone(timezone.utc).timestamp())
    assert to_utc(np.array([seconds]), zone)[0] == expected


def test_operator_nulls_ties_extra_columns_long_texts(spark):
    rows = [("2024/05/06", "Europe/Berlin", "DMY", "old"), ("2024/05/06", "Europe/Berlin", "DMY", "old"), (None, None, None, None), ("1" * 100_000, "UTC", "DMY", ""), ("2024-05-06 10:00", None, None, ""), ("05.06.2024", None, None, "")]
    out = normalise_timestamps(spark.createDataFrame(rows, "t string, z string, o string, norm string"), "t", "z", "o")
    assert [r["norm"] for r in out.collect()] == ["2024-05-06", "2024-05-06", None, None, None, "2024-06-05"]
    assert out.columns == ["t", "z", "o", "norm"]
    assert normalise_timestamps(spark.createDataFrame([], "t string, z string, o string"), "t", "z", "o").count() == 0


def test_tables_are_versioned(spark):
    table = zone_tables(spark, ["Europe/Berlin", "UTC", "Nowhere/At_All"]).collect()
    assert zone_version() and {r["version"] for r in table} == {zone_version()}
    assert {r["zone"] for r in table} == {"Europe/Berlin", "UTC"}
    rows = spark.createDataFrame([("2024-05-06",)], "t string").selectExpr("t", "'UTC' AS z", "'DMY' AS o")
    assert normalise_timestamps(rows, "t", "z", "o", version="tables").first()["tables"] == zone_version()
