import pytest

from wardline.functions import timetokens as tt

AS_OF = 1_706_659_200_000
DAY, HOUR = tt.DAY_MS, tt.HOUR_MS


@pytest.mark.parametrize(
    "token, back",
    [
        ("@now", 0),
        ("@hour_ago", HOUR),
        ("@day_ago", DAY),
        ("@week_ago", 7 * DAY),
        ("@month_ago", 14 * DAY),
        ("@1_month_ago", 14 * DAY),
        ("@31_days_ago", 31 * DAY),
        ("@12_weeks_ago", 84 * DAY),
        ("@24_hours_ago", DAY),
        ("@30_mins_ago", 30 * 60_000),
    ],
)
def test_relative_tokens(token, back):
    assert tt.resolve_token(token, AS_OF) == AS_OF - back - 4 * HOUR
    assert tt.resolve_token(token, AS_OF, load_offset_ms=0) == AS_OF - back


@pytest.mark.parametrize("token", ["@32_days_ago", "@13_weeks_ago", "@25_hours_ago", "@0_days_ago", "@later", "@31_mins_ago"])
def test_unknown_tokens(token):
    with pytest.raises(ValueError):
        tt.resolve_token(token, AS_OF)


def test_phrases():
    assert tt.phrase_offset_ms("") == 0
    assert tt.phrase_offset_ms("day ago + 1") == 2 * DAY
    assert tt.phrase_offset_ms("week ago + 1") == 8 * DAY
    assert tt.phrase_offset_ms("3 weeks ago + 1") == 22 * DAY
    with pytest.raises(ValueError):
        tt.phrase_offset_ms("hour ago + 1")


def test_golden_values():
    assert tt.resolve_token("@day_ago", AS_OF) == 1706558400000
    assert tt.resolve_token("@month_ago", AS_OF) == 1705435200000
    assert tt.render("ts >= '@date: 4/1/17 8:30'", AS_OF) == "ts >= '1483518600000'"
    text = tt.render("WHERE '@ddc_nat.full_day: 22/1/17'", AS_OF, retention_days=None)
    assert text == "WHERE ddc_nat.ts >= '1485043200000' AND ddc_nat.ts < '1485129600000'"


def test_dates_fill_in_from_now():
    assert tt.parse_day("5", AS_OF).strftime("%F") == "2024-01-05"
    assert tt.parse_day("5-2", AS_OF).strftime("%F") == "2024-02-05"
    assert tt.parse_day("5.2.2019", AS_OF).strftime("%F") == "2019-02-05"
    for bad in ("31/2/20", "1/2/3/4", "x"):
        with pytest.raises(ValueError):
            tt.parse_day(bad, AS_OF)
    with pytest.raises(ValueError):
        tt.render("@date: 1/1/20 25:00", AS_OF)


def test_full_day_limits():
    assert tt.full_day_window("yesterday", AS_OF) == (AS_OF - DAY, AS_OF)
    assert tt.full_day_window("1/1/24", AS_OF)[0] == AS_OF - 30 * DAY
    for too_far in ("31/12/23", "1/2/24"):
        with pytest.raises(ValueError):
            tt.full_day_window(too_far, AS_OF)


def test_named_tokens():
    text = "ts >= @start_date AND ts < @end_date"
    assert tt.render(text, AS_OF, start_date="day ago + 1", end_date="now", load_offset_ms=0) == (
        f"ts >= {AS_OF - 2 * DAY} AND ts < {AS_OF}"
    )
    with pytest.raises(ValueError):
        tt.render(text, AS_OF, start_date="now")


def test_span_window():
    assert tt.span_window("10/10/2016,00:00,1,d", AS_OF) == (1476057600000, 1476144000000)
    assert tt.span_window("31/01/2016,23:00,3,h", AS_OF) == (1454281200000, 1454281200000 + 3 * HOUR)
    # 2024-01-31 is a Wednesday: that day's name means the one a week before.
    assert tt.span_window("wednesday,00:00,1,d", AS_OF)[0] == AS_OF - 7 * DAY
    assert tt.span_window("last tuesday,01:00,1,d", AS_OF)[0] == AS_OF - DAY + HOUR
    assert tt.span_window("yesterday,09:00,5,h", AS_OF) == (AS_OF - 15 * HOUR, AS_OF - 10 * HOUR)
    assert tt.span_window("2_weeks_ago,00:00,1,d", AS_OF)[0] == AS_OF - 14 * DAY
    for bad in ("10/10/2016,00:00,1", "10/10/2016,00:00,1,m", "10/10/2016,24:00,1,d"):
        with pytest.raises(ValueError):
            tt.span_window(bad, AS_OF)


def test_default_window():
    assert tt.relative_window(as_of_ms=AS_OF) == (1706558400000, AS_OF - 4 * HOUR)


def test_in_window_and_hours(spark):
    rows = spark.createDataFrame([(0,), (5,), (10,), (3_600_001,), (-1,)], "ts bigint")
    assert [r.ts for r in rows.filter(tt.in_window("ts", (0, 10))).collect()] == [0, 5]
    assert [r.ts for r in rows.filter(tt.in_window("ts", (0, 10), closed=True)).collect()] == [0, 5, 10]
    assert [r.h for r in rows.select(tt.hour_of("ts").alias("h")).collect()] == [0, 0, 0, 3_600_000, -3_600_000]


def test_days_prune_partitions(spark, tmp_path):
    rows = spark.range(10).selectExpr("id", "date_add(date'2024-01-01', int(id)) AS day", "1704067200000 + id * 86400000 AS ts")
    rows.write.partitionBy("day").parquet(str(tmp_path / "t"))
    window = (1704067200000 + 2 * DAY, 1704067200000 + 4 * DAY)
    kept = spark.read.parquet(str(tmp_path / "t")).filter(tt.in_days("day", window) & tt.in_window("ts", window))
    assert sorted(r.id for r in kept.collect()) == [2, 3]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "PushedFilters: [IsNotNull(ts)" in plan
