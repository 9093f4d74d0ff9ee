"""Column functions over packet bytes, device text and sensor time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def be_bytes(c: Column, n: int) -> Column:
    """The lowest ``n`` bytes of an integer, the highest one first."""
    v = c.cast("long")
    return F.unhex(F.lpad(F.hex(v.bitwiseAND((1 << 8 * n) - 1) if n < 8 else v), 2 * n, "0"))


def le_bytes(c: Column, n: int) -> Column:
    """The lowest ``n`` bytes of an integer, the lowest one first."""
    v = c.cast("long")
    parts = [F.shiftright(v, 8 * i).bitwiseAND(255) for i in range(n)]
    turned = parts[0] if n == 1 else None
    for i, part in enumerate(parts if n > 1 else ()):
        moved = F.shiftleft(part, 8 * (n - 1 - i)) if i < n - 1 else part
        turned = moved if turned is None else turned.bitwiseOR(moved)
    return F.unhex(F.lpad(F.hex(turned), 2 * n, "0"))


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def u_be(payload: Column | str, offset: int, size: int) -> Column:
    """Unsigned big-endian integer of 1 to 7 bytes; null where the payload is too short."""
    part = F.substring(_c(payload), offset + 1, size)
    return F.when(F.octet_length(part) == size, F.conv(F.hex(part), 16, 10).cast("long"))


def u_le(payload: Column | str, offset: int, size: int) -> Column:
    """Unsigned little-endian integer of 1 to 7 bytes."""
    return sum((u_be(payload, offset + i, 1) * F.lit(1 << (8 * i)) for i in range(1, size)), u_be(payload, offset, 1))


def starts_with(payload: Column | str, sync: bytes) -> Column:
    return F.substring(_c(payload), 1, len(sync)) == F.lit(sync)


# Code tables of the two sensor families.
RETURN_MODES = {0: "Dual", 4: "Strongest", 5: "Last", 6: "Nearest"}
TIME_SYNC_MODES = {0: "Internal", 1: "Gps", 2: "Ptp", 3: "Gptp"}
TIME_SYNC_STATUS = {0: "Failed", 1: "Success"}
LIMITING_PERCENT = (3, 6, 9, 12, 16, 21, 25, 27)
TIMESTAMP_MODES = {"internal": "TIME_FROM_INTERNAL_OSC", "sync_pulse_in": "TIME_FROM_SYNC_PULSE_IN", "ptp1588": "TIME_FROM_PTP_1588"}


def named(code: Column | str, table: dict[int, str], default: str) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(_c(code) == k, v).otherwise(out)
    return out


def return_mode(code: Column | str) -> Column:
    return named(code, RETURN_MODES, "Strongest")


def time_sync_mode(code: Column | str) -> Column:
    return named(code, TIME_SYNC_MODES, "Internal")


def time_sync_status(code: Column | str) -> Column:
    return named(code, TIME_SYNC_STATUS, "Failed")


def shot_limiting(code: Column | str, countdown: Column | str) -> Column:
    """Text of a shot-limiting code: normal, imminent with its countdown, reduced by a percentage, or invalid."""
    out = F.concat(F.lit("invalid("), _c(code).cast("string"), F.lit(")"))
    for k, percent in enumerate(LIMITING_PERCENT):
        out = F.when(_c(code) == k + 2, F.lit(f"reduced({percent}%)")).otherwise(out)
    out = F.when(_c(code) == 1, F.concat(F.lit("imminent("), _c(countdown).cast("string"), F.lit("s)"))).otherwise(out)
    return F.when(_c(code) == 0, "normal").otherwise(out)


def shutdown_status(code: Column | str, countdown: Column | str) -> Column:
    out = F.concat(F.lit("invalid("), _c(code).cast("string"), F.lit(")"))
    out = F.when(_c(code) == 1, F.concat(F.lit("imminent("), _c(countdown).cast("string"), F.lit("s)"))).otherwise(out)
    return F.when(_c(code) == 0, "normal").otherwise(out)


def alert_flags(flags: Column | str) -> Column:
    """Bit 6 (overflow) wins over bit 7 (active); the low six bits are the cursor."""
    cursor = _c(flags).bitwiseAND(F.lit(0x3F)).cast("string")
    active = F.when(_c(flags).bitwiseAND(F.lit(0x80)) != 0, F.concat(F.lit("active("), cursor, F.lit(")"))).otherwise("normal")
    return F.when(_c(flags).bitwiseAND(F.lit(0x40)) != 0, F.concat(F.lit("overflow("), cursor, F.lit(")"))).otherwise(active)


def serial_hex(serial: Column | str) -> Column:
    return F.hex(_c(serial))


def dotted(ip: Column | str) -> Column:
    return F.concat_ws(".", *[u_be(ip, i, 1).cast("string") for i in range(4)])


def version_text(version: Column | str) -> Column:
    return F.concat_ws(".", *[u_be(version, i, 1).cast("string") for i in range(3)])


def ros_time(ns: Column | str) -> Column:
    """Integer nanoseconds as struct(sec, nanosec)."""
    return F.struct(F.expr(f"{ns} div 1000000000").cast("int").alias("sec"), (_c(ns) % 1_000_000_000).cast("int").alias("nanosec"))


def timestamp_mode(mode: Column | str) -> Column:
    """The sensor's name of a timestamp mode setting; null if unknown."""
    out = F.lit(None).cast("string")
    for k, v in TIMESTAMP_MODES.items():
        out = F.when(F.lower(_c(mode)) == k, v).otherwise(out)
    return out


def timestamp_setting(name: Column | str) -> Column:
    """The setting of a sensor's timestamp mode name; null if unknown."""
    return F.element_at(F.create_map(*[F.lit(x) for k, v in TIMESTAMP_MODES.items() for x in (v, k)]), _c(name))


def sensor_type(text: Column | str) -> Column:
    """``ouster`` or ``robosense``, whatever the case; null if unknown."""
    name = F.lower(F.trim(_c(text)))
    return F.when(name.isin("ouster", "robosense"), name)
