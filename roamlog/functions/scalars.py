"""Scalar expressions over check-in columns. All are plain Column compositions."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from roamlog import fixed

EARTH_RADIUS_KM = 6371.0


# The characters counted as white space.
WHITE_SPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def py_strip(c: Column) -> Column:
    """Strip every kind of Unicode white space from both ends."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def text(c: Column) -> Column:
    """Stripped text with NULL read as blank."""
    return F.coalesce(py_strip(c), F.lit(""))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def to_long(c: Column) -> Column:
    return py_strip(c.cast("string")).try_cast("bigint")


def to_coord(c: Column) -> Column:
    """Number or NULL; NaN and the infinities count as missing."""
    d = py_strip(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), d)


def parse_ts(c: Column) -> Column:
    return F.timestamp_seconds(to_long(c))


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    dlat = F.radians(lat2 - lat1) / 2
    dlng = F.radians(lng2 - lng1) / 2
    h = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlng) * F.sin(dlng)
    # Not least(h, 1), which would read a missing coordinate as the far side of the globe.
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))


def _whole(c: Column) -> Column:
    """Nearest whole number, halves up, as text."""
    return F.floor(c + 0.5).cast("bigint").cast("string")


def fixed_1(x: Column) -> Column:
    """One decimal place, rounding the exact binary value (halves up), as browsers print it.

    Ten times ``x`` is 8x + 2x; the rounding error of that sum decides apparent halves.
    """
    a, b = x * F.lit(8.0), x * F.lit(2.0)
    s = a + b
    error = (a - (s - (s - a))) + (b - (s - a))
    low = F.floor(s)
    rest = s - low
    n = (low + F.when((rest > 0.5) | ((rest == 0.5) & (error >= 0)), 1).otherwise(0)).cast("bigint")
    return F.concat(F.floor(n / 10).cast("bigint").cast("string"), F.lit("."), F.pmod(n, F.lit(10)).cast("string"))


def distance_label(km: Column) -> Column:
    return (
        F.when(km.isNull(), F.lit(None).cast("string"))
        .when(km < 1, F.concat(_whole(km * 1000), F.lit("m")))
        .when(km < 10, F.concat(fixed_1(km), F.lit("km")))
        .otherwise(F.concat(_whole(km), F.lit("km")))
    )


def gap_bucket(seconds: Column) -> Column:
    return (
        F.when(seconds.isNull() | (seconds < 1800), F.lit("none"))
        .when(seconds < 8 * 3600, F.lit("sm"))
        .when(seconds < 36 * 3600, F.lit("md"))
        .otherwise(F.lit("lg"))
    )


def gap_label(seconds: Column) -> Column:
    return (
        F.when(seconds.isNull() | (seconds < 1800), F.lit(""))
        .when(seconds < 2 * 3600, F.concat(_whole(seconds / 60), F.lit("m later")))
        .when(seconds < 36 * 3600, F.concat(_whole(seconds / 3600), F.lit("h later")))
        .otherwise(F.concat(_whole(seconds / 86400), F.lit("d later")))
    )


def lookup(mapping: dict[str, str], key: Column, default: Column | None = None) -> Column:
    """Constant map lookup for one of the fixed tables."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, default)


def iso2(country: Column) -> Column:
    return lookup(fixed.COUNTRY_ISO2, country, F.lit(""))


def continent(country: Column) -> Column:
    return lookup(fixed.COUNTRY_CONTINENT, country, F.lit(""))


def flag(country: Column) -> Column:
    return lookup(fixed.COUNTRY_FLAG, F.coalesce(country, F.lit("")), F.lit(fixed.DEFAULT_FLAG))


def _hour_zone(offset: Column) -> Column:
    """Etc/GMT zone of an hour offset east of Greenwich (the sign is reversed by convention)."""
    return F.when(offset > 0, F.concat(F.lit("Etc/GMT-"), offset.cast("string"))).otherwise(
        F.concat(F.lit("Etc/GMT+"), F.abs(offset).cast("string"))
    )


def tz_for(country: Column, lat: Column, lng: Column, policy: str = "country") -> Column:
    """Time-zone name of a check-in.

    ``country``: country table, then the hour band of the longitude (trips, recent list).
    ``bands``: country table, then longitude bands for four wide countries, then the hour
    band of the longitude (feed).
    """
    hours = F.bround(lng / 15, 0).cast("int")
    if policy == "country":
        off = F.greatest(F.lit(-12), F.least(F.lit(14), hours))
        by_lng = F.when(lng.isNull() | lat.isNull(), F.lit("UTC")).when(off == 0, F.lit("Etc/GMT")).otherwise(_hour_zone(off))
        return F.coalesce(lookup(fixed.COUNTRY_TZ, country), by_lng)
    if policy != "bands":
        raise ValueError(f"unknown policy {policy!r}")

    # Longitude bands of four countries, as (western bound is below, zone).
    east_limits = {
        "Russia": ([(60, "Europe/Moscow"), (73, "Asia/Yekaterinburg"), (84, "Asia/Omsk"), (98, "Asia/Krasnoyarsk"),
                    (115, "Asia/Irkutsk"), (130, "Asia/Yakutsk"), (142, "Asia/Vladivostok")], "Asia/Magadan", "Europe/Moscow"),
        "Australia": ([(129, "Australia/Perth"), (138, "Australia/Darwin"), (142, "Australia/Adelaide")],
                      "Australia/Sydney", "Australia/Sydney"),
    }
    west_limits = {
        "Brazil": ([(-40, "America/Fortaleza"), (-48, "America/Sao_Paulo")], "America/Manaus", "America/Sao_Paulo"),
        "United States": ([(-75, "America/New_York"), (-90, "America/Chicago"), (-110, "America/Denver")],
                          "America/Los_Angeles", "America/New_York"),
    }
    zone = lookup(fixed.FEED_TZ, country)
    for table, inside in ((east_limits, lambda x, b: x < b), (west_limits, lambda x, b: x > b)):
        for name, (bands, rest, unknown) in table.items():
            band = F.when(lng.isNull(), F.lit(unknown))
            for bound, tz in bands:
                band = band.when(inside(lng, bound), F.lit(tz))
            zone = F.coalesce(zone, F.when(country == name, band.otherwise(F.lit(rest))))
    by_lng = (
        F.when(lng.isNull(), F.lit("UTC"))
        .when((hours > 14) | (hours < -12), F.lit("UTC"))
        .otherwise(_hour_zone(hours))
    )
    return F.coalesce(zone, by_lng)


def localise(ts_seconds: Column, tz: Column) -> Column:
    """Wall-clock time of an instant in a zone."""
    return F.from_utc_timestamp(F.timestamp_seconds(ts_seconds), tz)


def fmt_date(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd")


def fmt_time(t: Column) -> Column:
    return F.date_format(t, "HH:mm")


def fmt_day(t: Column) -> Column:
    return F.date_format(t, "dd MMM yyyy")


def fmt_datetime(t: Column) -> Column:
    return F.date_format(t, "dd MMM yyyy, HH:mm")


def duration_days(first_day: Column, last_day: Column) -> Column:
    return F.datediff(last_day, first_day) + 1


def split_list(c: Column) -> Column:
    """Comma-joined cell -> array of stripped, non-blank items (repeats kept)."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), py_strip)
    return F.filter(parts, lambda x: x != "")


def venue_id_from_url(c: Column) -> Column:
    s = F.regexp_replace(py_strip(c), "/+$", "")
    hexa = F.regexp_extract(s, "([0-9a-f]{24})", 1)
    return F.when(hexa != "", hexa).otherwise(F.element_at(F.split(s, "/"), -1))


def _encode(c: Column) -> Column:
    """Percent-encoding of one path part, with the marks a browser leaves alone."""
    out = F.url_encode(c)
    for code, mark in (("\\+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.regexp_replace(out, code, mark)
    return out


def venue_slug(name: Column) -> Column:
    return _encode(F.regexp_replace(F.lower(name), r"[\s\h]+", "-"))


def url_of(base: str, *parts: Column) -> Column:
    """``base`` joined with path parts; NULL when the last part (the id) is blank."""
    return F.when(F.coalesce(parts[-1], F.lit("")) != "", F.concat_ws("/", F.lit(base.rstrip("/")), *parts))


def tile_xy(lat: Column, lng: Column, zoom: int = 14, tile: int = 256) -> Column:
    """Web-Mercator tile numbers and the pixel of the point inside its tile."""
    n = float(1 << zoom)
    x = (lng + 180) / 360 * n
    rad = F.radians(lat)
    y = (1 - F.ln(F.tan(rad) + 1 / F.cos(rad)) / F.pi()) / 2 * n
    return F.struct(
        F.floor(x).cast("bigint").alias("x"),
        F.floor(y).cast("bigint").alias("y"),
        F.floor((x - F.floor(x)) * tile + 0.5).cast("bigint").alias("px"),
        F.floor((y - F.floor(y)) * tile + 0.5).cast("bigint").alias("py"),
    )


def weather_label(code: Column, hour: Column) -> Column:
    """Icon and description of a weather code; clear sky varies with the hour of the day."""
    codes = {str(k): v for k, v in fixed.WEATHER_CODES.items()}
    key = code.cast("string")
    icon = lookup({k: v[0] for k, v in codes.items()}, key, F.lit(""))
    text_ = lookup({k: v[1] for k, v in codes.items()}, key, F.lit(""))
    clear = code == 0
    by_hour = (
        F.when((hour < 6) | (hour >= 22), F.lit("🌙"))
        .when(hour < 9, F.when(clear, F.lit("🌅")).otherwise(F.lit("🌤️")))
        .when(hour >= 18, F.when(clear, F.lit("🌇")).otherwise(F.lit("🌤️")))
    )
    return F.struct(
        F.coalesce(F.when(code.isin(0, 1), by_hour), icon).alias("icon"), text_.alias("description")
    )


def population_label(pop_m: Column) -> Column:
    return F.when(pop_m >= 1, F.concat(fixed_1(pop_m), F.lit("M"))).otherwise(
        F.concat(_whole(pop_m * 1000), F.lit("K"))
    )


def strip_icon(name: Column) -> Column:
    """Name without one trailing transport icon."""
    hit = reduce(
        lambda acc, icon: acc.when(name.endswith(" " + icon), F.left(name, F.length(name) - F.lit(len(icon) + 1))),
        fixed.NAME_ICONS[1:],
        F.when(name.endswith(" " + fixed.NAME_ICONS[0]),
               F.left(name, F.length(name) - F.lit(len(fixed.NAME_ICONS[0]) + 1))),
    )
    return hit.otherwise(name)


def has_icon(name: Column) -> Column:
    return reduce(lambda a, b: a | b, [name.contains(i) for i in fixed.NAME_ICONS])


def location_label(city: Column, country: Column) -> Column:
    return F.concat_ws(", ", blank_to_null(city), blank_to_null(country))


def preview(c: Column, size: int = 90) -> Column:
    return F.when(F.length(c) > size, F.concat(F.left(c, F.lit(size)), F.lit("…"))).otherwise(c)
