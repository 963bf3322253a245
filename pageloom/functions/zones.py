"""Zone transition tables: for each IANA zone the instants at which its offset or its abbreviation
changes, taken once from the installed time zone database (whose version is kept beside them), and
vectorised conversions through them."""

from __future__ import annotations

import struct
import zoneinfo
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from functools import lru_cache
from pathlib import Path

import numpy as np

#: Tables begin here; after the zone file's last change its closing rule is written out up to TO, more than one
#: cycle of the calendar, and later times are those of 400 years before (the same weekdays, so the same rule).
FROM, TO = datetime(1900, 1, 1, tzinfo=UTC), datetime(2500, 1, 1, tzinfo=UTC)
_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
_END, _CYCLE = int(TO.timestamp()), 146_097 * 86_400
_STEP = timedelta(days=7)


def database_version() -> str:
    for root in zoneinfo.TZPATH:
        p = Path(root, "tzdata.zi")
        if p.exists():
            with p.open() as f:
                return f.readline().rpartition(" ")[2].strip()
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "unknown"


@dataclass(frozen=True)
class ZoneTable:
    zone: str
    version: str
    #: at[i] (seconds since 1970) begins a span with offset[i] seconds; at[0] is before all times.
    at: np.ndarray
    offset: np.ndarray
    #: Abbreviation to its offset, the latest use first.
    names: dict[str, int]

    def offset_at(self, utc: np.ndarray) -> np.ndarray:
        utc = np.where(utc >= _END, utc - _CYCLE * ((utc - _END) // _CYCLE + 1), utc)
        return self.offset[np.searchsorted(self.at, utc, side="right") - 1]

    def to_utc(self, wall: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Instants of wall-clock seconds, whether they exist, and whether there are two (the earlier is given)."""
        a, b = wall - self.offset_at(wall - 86400), wall - self.offset_at(wall + 86400)
        ok_a, ok_b = a + self.offset_at(a) == wall, b + self.offset_at(b) == wall
        return np.where(ok_a & ok_b, np.minimum(a, b), np.where(ok_a, a, b)), ok_a | ok_b, ok_a & ok_b & (a != b)


def _zone_file(zone: str) -> bytes:
    for root in zoneinfo.TZPATH:
        p = Path(root, zone)
        if p.is_file():
            return p.read_bytes()
    from importlib import resources

    return resources.files("tzdata").joinpath("zoneinfo", *zone.split("/")).read_bytes()


def changes_in_file(data: bytes) -> list[int]:
    """Instants of change of a TZif file (RFC 8536), from its block of 64-bit times."""
    counts = struct.unpack(">6l", data[20:44])
    if data[4:5] >= b"2":
        utc, std, leap, times, types, chars = counts
        data = data[44 + times * 5 + types * 6 + chars + leap * 8 + std + utc :]
        return list(struct.unpack(f">{struct.unpack('>6l', data[20:44])[3]}q", data[44 : 44 + 8 * struct.unpack(">6l", data[20:44])[3]]))
    return list(struct.unpack(f">{counts[3]}l", data[44 : 44 + 4 * counts[3]]))


@lru_cache(maxsize=4096)
def zone_table(zone: str) -> ZoneTable:
    tz = zoneinfo.ZoneInfo(zone)

    def state(t: datetime) -> tuple[int, str]:
        x = t.astimezone(tz)
        return int(x.utcoffset().total_seconds()), x.tzname()

    first = int(FROM.timestamp())
    changes = [t for t in changes_in_file(_zone_file(zone)) if first < t < _END]
    # behind the file's last change: the closing rule, whose changes are months apart
    t = max(FROM, _EPOCH + timedelta(seconds=changes[-1])) if changes else FROM
    now = state(t)
    if any(state(t + timedelta(days=30 * i)) != now for i in range(1, 14)):
        while t < TO:
            nxt = t + _STEP
            if (then := state(nxt)) != now:
                lo, hi = t, nxt
                while hi - lo > timedelta(seconds=1):
                    mid = lo + timedelta(seconds=int((hi - lo).total_seconds()) // 2)
                    lo, hi = (mid, hi) if state(mid) == now else (lo, mid)
                changes.append(int(hi.timestamp()))
            t, now = nxt, then
    at, offsets = [-(1 << 60)], [state(FROM)[0]]
    names: dict[str, int] = {state(FROM)[1]: state(FROM)[0]}
    for c in changes:
        offset, name = state(_EPOCH + timedelta(seconds=c))
        names[name] = offset
        at.append(c)
        offsets.append(offset)
    return ZoneTable(zone, database_version(), np.array(at, np.int64), np.array(offsets, np.int64), {k.upper(): v for k, v in names.items() if k.isalpha()})


def zone_tables(zones) -> dict[str, ZoneTable]:
    return {z: zone_table(z) for z in sorted({z for z in zones if z})}
