from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tapeline.functions import timestamps as ts
from tapeline.functions.timestamps import offset_at, parser_of, to_local_day, to_utc_second, wall_to_instant, zone_table
from tapeline.operators.timestamps import normalise_timestamps, resolved

WRITE = {
    "%Y%m%d%H%M%S": "UTC", "%Y%m%dT%H%M%SZ": "UTC", "%Y-%m-%dT%H:%M:%SZ": "UTC", "%Y-%m-%d %H:%M:%S": "UTC", "%Y/%m/%d %H:%M:%S": "UTC", "%a, %d %b %Y %H:%M:%S GMT": "UTC",
    "%Y-%m-%d %H:%M:%S Europe/London": "Europe/London", "%Y-%m-%d %H:%M:%S[Asia/Tokyo]": "Asia/Tokyo", "%b %d, %Y %I:%M:%S %p ET": "America/New_York",
    "%Y-%m-%dT%H:%M:%S.123456Z": "UTC", "%Y%m%d %H%M%S": "UTC", "%Y-%m-%d T %H:%M:%S Z": "UTC", "%Y-%m-%d  %H:%M:%S": "UTC",
}


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2_000_000_000), st.sampled_from(sorted(WRITE)))
def test_every_form_comes_back(second, form):
    zone = ZoneInfo(WRITE[form])
    local = datetime.fromtimestamp(second, zone)
    text = local.strftime(form)
    first = local.replace(fold=0)
    assert to_utc_second([text]) == [first.astimezone(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")]
    assert to_local_day([text]) == [first.astimezone(ZoneInfo("America/New_York")).strftime("%Y-%m-%d")]


@settings(max_examples=100, deadline=None)
@given(st.integers(-2_000_000_000, 4_000_000_000), st.sampled_from(["America/New_York", "Europe/Berlin", "Australia/Lord_Howe", "America/St_Johns"]))
def test_zone_tables_agree_with_the_library(second, name):
    import numpy as np

    at = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=second)
    assert offset_at(zone_table(name), np.array([second]))[0] == at.astimezone(ZoneInfo(name)).utcoffset().total_seconds()


@pytest.mark.parametrize(
    ("text", "utc", "day"),
    [
        ("2024-03-10 02:30:00 America/New_York", None, None),
        ("2024-11-03 01:30:00 America/New_York", "2024-11-03 05:30:00", "2024-11-03"),
        ("2025-10-26 02:30:00[Europe/Berlin]", "2025-10-26 00:30:00", "2025-10-25"),
        ("1665820200", "2022-10-15 07:50:00", "2022-10-15"),
        ("1738860549253", "2025-02-06 16:49:09", "2025-02-06"),
        ("2024-07-14", None, "2024-07-14"),
        ("20240714", None, "2024-07-14"),
        ("7/4/2022", None, "2022-07-04"),
        ("07.04.2022", None, "2022-04-07"),
        ("14 Jun 2023", None, "2023-06-14"),
        ("Sun Nov 05 2023", None, "2023-11-05"),
        ("December 22, 2022", None, "2022-12-22"),
        ("2025-09-09 01:30:00 +0530", "2025-09-08 20:00:00", "2025-09-08"),
        ("2025-05-18 03:36:07 EDT", "2025-05-18 07:36:07", "2025-05-18"),
        ("Jan 27, 2022 12:05 AM ET", "2022-01-27 05:05:00", "2022-01-27"),
        ("20230229120000", None, None),
        ("2023-02-30", None, None),
        ("2023-01-01 24:00:00", None, None),
        ("2023-01-01 10:00:00 Mars/Base", None, None),
        ("yesterday 4pm", None, None),
        ("1970", None, None),
        ("", None, None),
        ("x" * 5000, None, None),
        ("２０２３-01-01", None, None),
    ],
)
def test_single_values(text, utc, day):
    assert (to_utc_second([text]), to_local_day([text])) == ([utc], [day])


def test_walls_and_masks():
    import numpy as np

    table = zone_table("America/New_York")
    assert wall_to_instant(table, np.array([1710037800]))[1].tolist() == [False]
    assert zone_table("No/Where") is None
    assert parser_of("9999-99-99") is parser_of("9999-99-99")


def test_operator(spark):
    rows = [(1, "20240101000000"), (2, " 20240101000000"), (3, None), (4, "  "), (5, "2024-01-01T00:00:00Z"), (6, "2024-01-01"), (2, " 20240101000000"), (7, "20240101000000\n"), (8, "99999999999999")]
    df = spark.createDataFrame(rows, "id long, seendate string").selectExpr("*", "'x' as normal_form", "1 as row_id", "'t' as raw_value")
    out = normalise_timestamps(df, "id", {"seendate": "utc_second"}, "t")
    assert out.columns == ["table_name", "row_id", "field_name", "raw_value", "normal_form"]
    got = sorted((r.row_id, r.normal_form) for r in out.collect() if r.normal_form)
    assert got == [(2, "2024-01-01 00:00:00")] * 2 + [(5, "2024-01-01 00:00:00"), (7, "2024-01-01 00:00:00")]
    assert normalise_timestamps(df.limit(0), "id", {"seendate": "utc_second"}, "t").count() == 0
    whole = dict(df.select("id", resolved(df, "seendate", "utc_second")).collect())
    assert whole[1] == whole[2] == "2024-01-01 00:00:00" and whole[3] is whole[6] is whole[8] is None
    days = spark.createDataFrame([(1, "2024-01-02"), (2, "2024-02-30"), (3, "1/2/2024")], "id long, d string")
    assert dict(days.select("id", resolved(days, "d", "local_day")).collect()) == {1: "2024-01-02", 2: None, 3: "2024-01-02"}


def test_nothing_is_lost_by_length_or_year():
    long = ["2024-07-01T12:00:00." + "1" * 70 + "Z", "2024-07-01" + " " * 500 + "12:00", "Wednesday, September 30, 2026 12:34:56.123456789 p.m. [America/Argentina/ComodRivadavia]", "x" * 100_000, "9" * 5000, "2024-07-01 12:00 " + "a/" * 300]
    assert ts.to_utc_second(long) == ["2024-07-01 12:00:00", "2024-07-01 12:00:00", "2026-09-30 15:34:56", None, None, None]
    assert ts.to_utc_second(["2150-07-01 12:00 ET", "2150-01-01 12:00 ET", "9150-07-01 12:00 ET", "1880-07-01 12:00 ET"]) == ["2150-07-01 16:00:00", "2150-01-01 17:00:00", "9150-07-01 16:00:00", "1880-07-01 16:56:02"]


def test_zone_tables_against_the_zone_data():
    import zoneinfo
    from datetime import datetime, timedelta, timezone

    rng, epoch = np.random.default_rng(0), datetime(1970, 1, 1, tzinfo=timezone.utc)
    for name in ("America/New_York", "Asia/Gaza", "Africa/Casablanca", "Australia/Lord_Howe"):
        zone, instants = zoneinfo.ZoneInfo(name), rng.integers(-5364662400, 100_000_000_000, 5000)
        want = [int((epoch + timedelta(seconds=int(i))).astimezone(zone).utcoffset().total_seconds()) for i in instants]
        assert ts.offset_at(ts.zone_table(name), instants).tolist() == want
