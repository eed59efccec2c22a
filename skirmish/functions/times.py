"""Time stamps of log lines, and the few display forms of times and amounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed by the log format: "[Fri Feb 27 22:00:07 2026] " is 27 characters.
PREFIX_LEN = 27

_MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"


def strip_prefix(raw: Column) -> Column:
    """The line without its time prefix, even when the date inside is bad."""
    return F.when(
        (F.length(raw) > PREFIX_LEN) & raw.startswith("["),
        F.substring(raw, PREFIX_LEN + 1, 1 << 30),
    ).otherwise(raw)


def parse_log_ts(raw: Column) -> Column:
    """TIMESTAMP_NTZ of the prefix, or null.  The day may be padded by a zero or a space."""
    ok = (F.length(raw) > PREFIX_LEN) & raw.startswith("[")
    text = F.substring(raw, 6, 20)  # after the weekday
    month = F.instr(F.lit(_MONTHS), F.substring(text, 1, 3))
    num = lambda pos, n: F.trim(F.substring(text, pos, n)).try_cast("int")
    return F.when(
        ok & (month > 0) & (month % 3 == 1) & F.substring(text, 7, 1).eqNullSafe(" "),
        F.try_make_timestamp_ntz(
            num(17, 4), ((month + 2) / 3).cast("int"), num(5, 2), num(8, 2), num(11, 2), num(14, 2).cast("decimal(8,6)")
        ),
    )


def to_epoch(naive: Column, zone: str | Column = "UTC", skew: int = 0) -> Column:
    """Epoch seconds of a local time.

    A repeated hour is read as the earlier one, a missing hour shifts forward; ``zone`` may be
    a column, so each stream can have its own.
    """
    if zone != "UTC" if isinstance(zone, str) else True:
        z = F.lit(zone) if isinstance(zone, str) else zone
        naive = F.convert_timezone(z, F.lit("UTC"), naive)
    secs = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), naive)
    return secs + F.lit(skew) if skew else secs


def line_epoch(raw: Column, zone: str | Column = "UTC", skew: int = 0) -> Column:
    return to_epoch(parse_log_ts(raw), zone, skew)


def session_label(ts: Column, offset: int | Column = 0) -> Column:
    """``Mon D, YYYY`` on the streamer's own day."""
    off = F.lit(offset) if isinstance(offset, int) else offset
    naive = F.timestamp_add("SECOND", (ts + off).cast("long"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.date_format(naive, "MMM d, yyyy")


def fmt_k(n: Column) -> Column:
    """``950``, ``1.2K``, ``3M``, in whole-number arithmetic.

    A tie between two tenths is settled as printing the quotient does: by which side of the tie
    the floating-point quotient lies on, to even when it is exact.
    """
    def short(size: int, unit: str) -> Column:
        tenth, half = size // 10, size // 20
        low = F.floor(n / tenth)
        m = (n / half).cast("long")
        q = m / F.lit(20.0)
        s = q * 16.0 + q * 4.0
        side = (s - m) + (q * 4.0 - (s - q * 16.0))
        up = F.when(n % tenth != half, n % tenth > half).otherwise((side > 0) | ((side == 0) & (low % 2 == 1)))
        t = low + up.cast("long")
        whole = F.floor(t / 10).cast("string")
        return F.concat(whole, F.when(t % 10 == 0, "").otherwise(F.concat(F.lit("."), (t % 10).cast("string"))), F.lit(unit))

    return F.when(n >= 1_000_000, short(1_000_000, "M")).when(n >= 1_000, short(1_000, "K")).otherwise(n.cast("string"))


def fmt_duration(secs: Column) -> Column:
    """``2:05`` from a minute up, ``45s`` below."""
    return F.when(
        secs >= 60, F.format_string("%d:%02d", F.floor(secs / 60), (secs % 60).cast("long"))
    ).otherwise(F.concat(secs.cast("string"), F.lit("s")))


def rate(total: Column, secs: Column) -> Column:
    """Rounded amount per second; the duration counts as one millisecond at least."""
    return F.round(total / F.greatest(secs.cast("double"), F.lit(0.001))).cast("long")
