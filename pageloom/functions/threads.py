"""Discussion pages: threads, their last dates, and which of them are to be archived; tagged regions."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from datetime import datetime, timedelta

from pageloom.operators.timestamps import MONTHS, SHORT_MONTHS

_THREAD = re.compile(r"^== *([^=].*?) *== *$")
_STAMP = re.compile(r"(?P<H>\d{1,2}):(?P<M>\d\d),? (?P<d>\d{1,2})\.? (?P<month>[^\W\d_]+)\.? (?P<y>\d{4}) \((?P<zone>[A-Z]+)\)")
_MONTH_OF = {w: i + 1 for names in (*MONTHS.values(), *SHORT_MONTHS.values()) for i, w in enumerate(names.split())}


@dataclass
class Thread:
    title: str
    content: str
    last: datetime | None

    @property
    def size(self) -> int:
        return len(self.title) + len(self.content) + 12


def last_stamp(text: str) -> datetime | None:
    """The latest signature time of a text."""
    found = []
    for m in _STAMP.finditer(text):
        month = _MONTH_OF.get(m["month"].lower())
        try:
            found.append(datetime(int(m["y"]), month or 0, int(m["d"]), int(m["H"]), int(m["M"])))
        except ValueError:
            continue
    return max(found, default=None)


def split_threads(text: str) -> tuple[str, list[Thread]]:
    """(header, threads) at headings of the second level."""
    header, threads, title, lines = [], [], None, []
    for line in (text or "").splitlines():
        m = _THREAD.match(line)
        if m:
            if title is not None:
                threads.append(Thread(title, "\n".join(lines), last_stamp("\n".join(lines))))
            title, lines = m[1], []
        else:
            (header if title is None else lines).append(line)
    if title is not None:
        threads.append(Thread(title, "\n".join(lines), last_stamp("\n".join(lines))))
    return "\n".join(header), threads


def to_archive(threads: list[Thread], now: datetime, older_than: timedelta, keep: int = 5) -> list[bool]:
    """Which threads are older than this and may go; at least ``keep`` stay."""
    due = [t.last is not None and now - t.last > older_than for t in threads]
    room = len(threads) - keep
    out = []
    for d in due:
        go = d and room > 0
        room -= go
        out.append(go)
    return out


def section_digests(text: str) -> list[tuple[str, int, str]]:
    """(heading, level, md5 of its text) of every section, to see which changed."""
    out, last = [], None
    heads = [*re.finditer(r"^(=+)[ \t]*(.*?)[ \t]*=+[ \t]*$", text or "", re.M)]
    for i, m in enumerate(heads):
        body = text[m.end() : heads[i + 1].start() if i + 1 < len(heads) else len(text)]
        out.append((m[2], len(m[1]), hashlib.md5(body.strip().encode()).hexdigest()))
    return out


def replace_tagged(text: str, tag: str, value: str) -> tuple[str, int]:
    """The region between <!--tag--> and <!--/tag--> with a new value, and how often it was found."""
    return re.subn(rf"(<!--\s*{re.escape(tag)}\s*-->).*?(<!--\s*/{re.escape(tag)}\s*-->)", lambda m: m[1] + value + m[2], text, flags=re.S)


def threads_udf(kind, now: datetime, older_than: timedelta):
    """A column function: array<struct<topic, last_post, old>> of a talk page's threads."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    @F.arrow_udf(kind)
    def found(values):
        rows = [None if v is None else [{"topic": t.title, "last_post": t.last and t.last.isoformat(" "), "old": t.last is not None and now - t.last > older_than} for t in split_threads(v)[1]] for v in values.to_pylist()]
        return pa.array(rows, pa.list_(pa.struct([("topic", pa.string()), ("last_post", pa.string()), ("old", pa.bool_())])))

    return found


_SETTINGS = re.compile(r"\{\{\s*[Aa]rchive\s*((?:\|[^{}]*)?)\}\}")


def archive_settings(text: str) -> dict[str, str]:
    """The parameters of the page's archiving template."""
    m = _SETTINGS.search(text or "")
    return dict(p.strip().split("=", 1) for p in m[1].split("|") if "=" in p) if m else {}


def page_of(header: str, threads: list[Thread]) -> str:
    return "\n".join([header, *(f"== {t.title} ==\n{t.content}" for t in threads)])


def archived(text: str | None, now: datetime, keep: int = 0) -> tuple[str, str | None, list[Thread]] | None:
    """(the page without its old threads, the archive's name, those threads), by the page's own settings:
    algo=old(90d), counter=n, archive=name with %(counter)d. Pages without settings stay as they are."""
    if text is None:
        return None
    s = archive_settings(text)
    age = re.fullmatch(r"old\((\d+)([dh])\)", s.get("algo", "").strip())
    header, threads = split_threads(text)
    if not age:
        return text, None, []
    limit = timedelta(**{"days" if age[2] == "d" else "hours": int(age[1])})
    go = to_archive(threads, now, limit, keep)
    moved = [t for t, g in zip(threads, go) if g]
    name = s.get("archive", "Archive %(counter)d").replace("%(counter)d", s.get("counter", "1").strip())
    return page_of(header, [t for t, g in zip(threads, go) if not g]), name if moved else None, moved


def archiving_udf(kind, now: datetime, keep: int = 0):
    """A column function: struct<moved, rest, archive> of ``archived``."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    @F.arrow_udf(kind)
    def done(values):
        rows = [None if (r := archived(v, now, keep)) is None else {"moved": len(r[2]), "rest": r[0], "archive": r[1]} for v in values.to_pylist()]
        return pa.array(rows, pa.struct([("moved", pa.int32()), ("rest", pa.string()), ("archive", pa.string())]))

    return done
