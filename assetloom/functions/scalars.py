"""Column functions for labels and derived values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SENSITIVITY_STEP = 0.05
SWIPE_REACH = 120
#: Whole numbers beyond 64 bits.
WHOLE = "decimal(38,0)"


def is_video(media_type: Column) -> Column:
    return media_type == "video"


def pixel_area(width: Column, height: Column) -> Column:
    """Pixels, computed in 64 bits."""
    return width.cast("bigint") * height.cast("bigint")


def aspect(width: Column, height: Column) -> Column:
    """Width over height; 1 if a side is not positive."""
    return F.when((width > 0) & (height > 0), width.cast("double") / height.cast("double")).otherwise(F.lit(1.0))


def duration_badge(media_type: Column, duration: Column) -> Column:
    """Minutes and seconds of a video, half seconds rounded up; empty for stills."""
    total = F.round(duration).cast("bigint")
    minutes = F.floor(total / 60).cast("bigint")
    return F.when(is_video(media_type), F.format_string("%d:%02d", minutes, total - minutes * 60)).otherwise(F.lit(""))


def date_label(date: Column) -> Column:
    return F.coalesce(F.date_format(date, "d MMMM yyyy"), F.lit("Unknown date"))


def start_of_day(ts: Column) -> Column:
    """The day a local timestamp falls on."""
    return F.to_date(ts).cast("timestamp_ntz")


def sensitivity_threshold(sensitivity: int) -> float:
    """Distance for a sensitivity of 1 to 10."""
    if not 1 <= sensitivity <= 10:
        raise ValueError("sensitivity must be from 1 to 10")
    return sensitivity * SENSITIVITY_STEP


def sensitivity_distance(sensitivity: Column) -> Column:
    """The same for a column; null beyond 1 to 10."""
    return F.when(sensitivity.between(1, 10), sensitivity * F.lit(SENSITIVITY_STEP))


def squared_distance(a: Column, b: Column) -> Column:
    """Squared L2 distance of two float vectors, in single precision."""
    parts = F.zip_with(a, b, lambda x, y: ((x - y) * (x - y)).cast("float"))
    return F.aggregate(parts, F.lit(0.0).cast("float"), lambda acc, x: (acc + x).cast("float"))


def byte_label(size: Column) -> Column:
    """A file size in decimal units: none, one and two decimals from KB, MB and GB up.

    Units are powers of ten, so half a unit of the last place is added and the
    digits are cut: exact, and for sizes beyond 64 bits too.
    """
    whole = F.floor(size).cast(WHOLE)

    def cut(half: int, unit: int, decimals: int) -> list[Column]:
        digits = (whole + half).cast("string")
        parts = [F.left(digits, F.length(digits) - unit)]
        return parts + ([F.lit("."), F.substring(digits, -unit, decimals)] if decimals else [])

    return (
        F.when(whole == 1, F.lit("1 byte"))
        .when(whole < 1_000, F.concat(whole.cast("string"), F.lit(" bytes")))
        .when(whole < 999_500, F.concat(*cut(500, 3, 0), F.lit(" KB")))
        .when(whole < 999_950_000, F.concat(*cut(50_000, 6, 1), F.lit(" MB")))
        .otherwise(F.concat(*cut(5_000_000, 9, 2), F.lit(" GB")))
    )


def count_label(n: Column, one: str = "photo", many: str = "photos") -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, F.lit(f" {one}")).otherwise(F.lit(f" {many}")))


def access_state(status: Column) -> Column:
    """``authorized`` and ``undetermined`` as they are; all else, limited access too, is blocked."""
    return F.when(status == "authorized", "authorized").when(status == "notDetermined", "undetermined").otherwise("blocked")


def swipe_class(dx: Column) -> Column:
    """What a horizontal drag means: beyond the reach, right keeps and left deletes."""
    return F.when(F.abs(dx) > SWIPE_REACH, F.when(dx > 0, "keep").otherwise("delete")).otherwise("none")


def progress(done: Column, total: Column) -> Column:
    return F.when(total > 0, done / total).otherwise(F.lit(0.0))
