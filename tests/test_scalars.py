import math

import pytest
from pyspark.sql import functions as F

from roamlog import fixed
from roamlog.functions import scalars as S


def value(spark, expr):
    return spark.range(1).select(expr.alias("v")).first().v


@pytest.mark.parametrize("km, want", [(0.0004, "0m"), (0.9994, "999m"), (7.05, "7.0km"), (9.25, "9.3km"), (9.96, "10.0km"), (10.5, "11km")])
def test_distance_label(spark, km, want):
    assert value(spark, S.distance_label(F.lit(km))) == want


@pytest.mark.parametrize("sec, bucket, label", [
    (1799, "none", ""), (1800, "sm", "30m later"), (7199, "sm", "120m later"), (7200, "sm", "2h later"), (28800, "md", "8h later"),
    (129600, "lg", "2d later"), (400000, "lg", "5d later")])
def test_gap(spark, sec, bucket, label):
    assert value(spark, F.concat_ws("/", S.gap_bucket(F.lit(sec)), S.gap_label(F.lit(sec)))) == f"{bucket}/{label}"


def test_haversine(spark):
    assert math.isclose(value(spark, S.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))), math.pi * 6371.0)


@pytest.mark.parametrize("policy, country, lat, lng, want", [
    ("country", "Belarus", 0.0, 100.0, "Europe/Minsk"), ("country", "Nowhere", 0.0, 37.5, "Etc/GMT-2"),
    ("country", "Nowhere", 0.0, -52.5, "Etc/GMT+4"), ("country", "Nowhere", 0.0, 5.0, "Etc/GMT"), ("country", "Nowhere", None, None, "UTC"),
    ("bands", "Russia", 0.0, 59.9, "Europe/Moscow"), ("bands", "Russia", 0.0, 150.0, "Asia/Magadan"), ("bands", "Russia", None, None, "Europe/Moscow"),
    ("bands", "Brazil", 0.0, -45.0, "America/Sao_Paulo"), ("bands", "Brazil", 0.0, None, "America/Sao_Paulo"),
    ("bands", "United States", 0.0, -100.0, "America/Denver"), ("bands", "Australia", 0.0, 140.0, "Australia/Adelaide"),
    ("bands", "Nowhere", 0.0, 0.0, "Etc/GMT+0"), ("bands", "Nowhere", None, None, "UTC")])
def test_zone(spark, policy, country, lat, lng, want):
    lit = lambda x: F.lit(x).cast("double")
    assert value(spark, S.tz_for(F.lit(country), lit(lat), lit(lng), policy)) == want


def test_every_zone_is_known_to_the_jvm(spark):
    zones = sorted({*fixed.COUNTRY_TZ.values(), *fixed.FEED_TZ.values()})
    bands = [("Russia", x) for x in range(-170, 180, 5)] + [(c, x) for c in ("Brazil", "United States", "Australia", "") for x in range(-180, 181, 5)]
    df = spark.createDataFrame([(z,) for z in zones], "z string").unionAll(
        spark.createDataFrame(bands, "c string, x int").select(S.tz_for(F.col("c"), F.lit(0.0), F.col("x").cast("double"), "bands"))).unionAll(
        spark.createDataFrame(bands, "c string, x int").select(S.tz_for(F.col("c"), F.lit(0.0), F.col("x"))))
    assert df.select(S.localise(F.lit(0), F.col("z")).alias("t")).filter("t IS NULL").count() == 0


def test_local_formats(spark):
    at = S.localise(F.lit(1_700_000_000), F.lit("Asia/Tokyo"))
    got = spark.range(1).select(S.fmt_date(at), S.fmt_time(at), S.fmt_day(at), S.fmt_datetime(at)).first()
    assert tuple(got) == ("2023-11-15", "07:13", "15 Nov 2023", "15 Nov 2023, 07:13")


@pytest.mark.parametrize("url, want", [
    ("https://x.org/v/name/4b0588f1f964a520b7cf22e3/", "4b0588f1f964a520b7cf22e3"), (" 12345 ", "12345"), ("https://x.org/v/77//", "77")])
def test_venue_id(spark, url, want):
    assert value(spark, S.venue_id_from_url(F.lit(url))) == want


def test_slug_and_urls(spark):
    assert value(spark, S.venue_slug(F.lit("Café  (Bar) & Co's!"))) == "caf%C3%A9-(bar)-%26-co's!"
    assert value(spark, S.url_of("https://x.org/item/", F.lit("7"))) == "https://x.org/item/7"
    assert value(spark, S.url_of("https://x.org/item/", F.lit(""))) is None


def test_weather_label(spark):
    def got(code, hour):
        r = value(spark, S.weather_label(F.lit(code), F.lit(hour)))
        return r.icon, r.description

    assert got(0, 3) == ("🌙", "Clear") and got(0, 7) == ("🌅", "Clear") and got(1, 19) == ("🌤️", "Mainly clear")
    assert got(0, 12) == ("☀️", "Clear") and got(95, 3) == ("⛈️", "Thunderstorm") and got(7, 3) == ("", "")


@pytest.mark.parametrize("name, want", [("Rome ✈️", "Rome"), ("Rome 🚂 ✈️", "Rome 🚂"), ("Rome", "Rome"), ("Camp ⛺", "Camp")])
def test_strip_icon(spark, name, want):
    assert value(spark, S.strip_icon(F.lit(name))) == want


@pytest.mark.parametrize("pop, want", [(1.0, "1.0M"), (13.96, "14.0M"), (7.25, "7.3M"), (0.3, "300K"), (0.1234, "123K")])
def test_population(spark, pop, want):
    assert value(spark, S.population_label(F.lit(pop))) == want


def test_preview_strip_split(spark):
    assert value(spark, S.preview(F.lit("x" * 91))) == "x" * 90 + "…"
    assert value(spark, S.preview(F.lit("x" * 90))) == "x" * 90
    assert value(spark, S.py_strip(F.lit("　  a b\x1f\x85"))) == "a b"
    assert value(spark, S.split_list(F.lit(" A ,B,, A"))) == ["A", "B", "A"]


def test_tile(spark):
    t = value(spark, S.tile_xy(F.lit(53.9), F.lit(27.56)))
    n = 1 << 14
    y = (1 - math.log(math.tan(math.radians(53.9)) + 1 / math.cos(math.radians(53.9))) / math.pi) / 2 * n
    assert (t.x, t.y) == (int((27.56 + 180) / 360 * n), int(y)) and 0 <= t.px <= 256
