"""Scalar functions over columns: labels for sizes, times and scores, names and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".gif", ".tiff", ".webp", ".heic")
VIDEO_EXTENSIONS = (".mp4", ".avi", ".mov", ".mkv", ".wmv", ".flv", ".webm", ".m4v", ".ts", ".m2ts", ".3gp", ".ogv")
# Labels that the results carry.
UNKNOWN_RESOLUTION = "未知"
COPY_SUFFIX = "副本"


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def extension(name: Column) -> Column:
    """The last dot and what follows, in small letters; leading dots of a name begin no extension."""
    return F.lower(F.regexp_extract(name, r"^\.*[^.].*?(\.[^.]+)$", 1))


def is_image(name: Column) -> Column:
    return extension(name).isin(*IMAGE_EXTENSIONS)


def is_video(name: Column) -> Column:
    return extension(name).isin(*VIDEO_EXTENSIONS)


def media_type(name: Column) -> Column:
    return F.when(is_image(name), "image").when(is_video(name), "video")


def _fixed(x: Column, digits: int) -> Column:
    """A number with so many decimals, rounded by its exact binary value, ties to even, as C's printf does.

    The fraction of a double is a whole number of 2**-82 (of all but tiny values), so the rounding is done in integers.
    """
    v = F.abs(x.cast("double"))
    whole = F.floor(v)
    wide = "decimal(38,0)"
    high = (v - whole) * F.lit(2.0**62)
    low = F.floor((high - F.floor(high)) * F.lit(2.0**20))  # bits of small numbers that 62 places don't hold
    scaled = (F.floor(high).cast("long").cast("decimal(28,0)") * F.lit(2**20).cast("decimal(7,0)") + low.cast("long").cast("decimal(7,0)")).cast(wide) * F.lit(10**digits).cast("decimal(6,0)")
    scaled, unit = scaled.cast(wide), F.lit(str(2**82)).cast(wide)
    rest = scaled % unit
    below = ((scaled - rest) / unit).cast("long")
    up = (rest > unit / 2) | ((rest == unit / 2) & (below % 2 == 1))
    total = whole.cast("long") * 10**digits + below + up.cast("long")
    text = F.concat_ws(".", F.floor(total / 10**digits).cast("string"), F.lpad((total % 10**digits).cast("string"), digits, "0"))
    return F.when(x.isNotNull(), F.concat(F.when((x < 0) & (total > 0), "-").otherwise(""), text))


def rounded(x: Column, digits: int) -> Column:
    """The double nearest to x rounded to so many decimals, by the exact value of x."""
    return _fixed(x, digits).cast("double")


def _sized(size: Column, units: tuple[str, ...]) -> Column:
    """The size in steps of 1024 with one decimal, the last unit having no end. One number is formatted, whatever the unit."""
    s, step, unit = size.cast("double"), None, None
    for power, name in enumerate(units[:-1]):
        near, by = F.abs(s) < 1024.0 ** (power + 1), F.lit(1024.0**power)
        step = F.when(near, by) if step is None else step.when(near, by)
        unit = F.when(near, name) if unit is None else unit.when(near, name)
    return F.concat(_fixed(s / step.otherwise(F.lit(1024.0 ** (len(units) - 1))), 1), F.lit(" "), unit.otherwise(units[-1]))


def format_size(size: Column) -> Column:
    """B, KB, MB or GB, GB being the last; sizes are not negative."""
    return _sized(size, ("B", "KB", "MB", "GB"))


def format_bytes(size: Column) -> Column:
    """B to TB, then PB."""
    return _sized(size, ("B", "KB", "MB", "GB", "TB", "PB"))


def _two(n: Column) -> Column:
    """At least two digits, never cut."""
    text = n.cast("string")
    return F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)


def format_duration(seconds: Column) -> Column:
    """MM:SS, from an hour on H:MM:SS; 00:00 at 0 and below; fractions are cut off."""
    s = seconds.cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    short = F.concat_ws(":", _two(m), _two(r))
    return F.when(seconds <= 0, "00:00").when(h > 0, F.concat_ws(":", h.cast("string"), _two(m), _two(r))).otherwise(short)


def format_milliseconds(ms: Column) -> Column:
    """MM:SS with unbounded minutes."""
    s = F.floor(ms / 1000).cast("long")
    return F.concat_ws(":", _two(F.floor(s / 60)), _two(s % 60))


def format_similarity(score: Column) -> Column:
    return F.concat(_fixed(score * F.lit(100.0), 2), F.lit("%"))


def resolution_label(width: Column, height: Column) -> Column:
    fine = (width > 0) & (height > 0)
    return F.when(fine, F.concat(width.cast("string"), F.lit("x"), height.cast("string"))).otherwise(UNKNOWN_RESOLUTION)


def meta_label(*parts: Column) -> Column:
    """The parts that are not empty, joined by a middle dot."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), " · ")


def has_copy_number(name: Column) -> Column:
    return name.rlike(r"\(\d+\)")


def has_copy_suffix(name: Column) -> Column:
    return name.contains(COPY_SUFFIX)


def progress_percent(current: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.lit(100), F.floor(current / total * 100))).otherwise(0).cast("int")


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def normalised_path(path: Column) -> Column:
    """Small letters and forward slashes, for prefix tests."""
    return F.replace(F.lower(path), F.lit("\\"), F.lit("/"))
