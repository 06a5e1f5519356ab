"""Small text helpers for reports and status lines (driver side), and their Column forms."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigfig(n: int) -> str:
    """Thousands separated by commas."""
    return f"{n:,}"


def sigfig_column(v: Column) -> Column:
    return F.format_number(v, 0)


def timediff(seconds: float) -> str:
    """[D day(s), ][H:]MM:SS.s"""
    whole = int(seconds)
    rest = whole % 60 + (seconds - whole)
    minutes, hours, days = whole // 60 % 60, whole // 3600 % 24, whole // 86400
    if days:
        return f"{days} day{'s' if days != 1 else ''}, {hours:02d}:{minutes:02d}:{rest:04.1f}"
    if hours:
        return f"{hours}:{minutes:02d}:{rest:04.1f}"
    return f"{minutes}:{rest:04.1f}" if minutes else f"{rest:.1f}"


def speed(seconds: float, count: int) -> str:
    """Records per second, with k or M."""
    if not seconds:
        return "N/A"
    rate = count / seconds
    for limit, unit, suffix in ((1e3, 1, ""), (1e6, 1e3, "k")):
        if rate < limit:
            return f"{rate / unit:.2f}{suffix}"
    return f"{rate / 1e6:.2f}M"


def ellipsize(text: str, most: int = 23, keep: int = 20) -> str:
    """Tick labels: quotes and newlines dropped, long ones cut."""
    text = text.replace('"', "").replace("\n", "")
    return text[:keep] + "..." if len(text) > most else text


def ellipsize_column(v: Column, most: int = 23, keep: int = 20) -> Column:
    clean = F.translate(v, '"\n', "")
    return F.when(F.length(clean) > most, F.concat(F.substring(clean, 1, keep), F.lit("..."))).otherwise(clean)


def common_prefix(texts: list[str]) -> str:
    return os.path.commonprefix(texts)


def cut_cwd(path: str) -> str:
    """The path relative to the working folder if it is inside it."""
    here = os.getcwd() + os.sep
    return path[len(here) :] if path.startswith(here) else path


def index_of(item, items: list) -> int | None:
    """1-based place of an item."""
    return items.index(item) + 1 if item in items else None


def wrap(text: str, width: int = 82) -> str:
    """Break lines longer than ``width``."""
    out = []
    for line in text.split("\n"):
        while len(line) > width:
            out.append(line[:width])
            line = line[width:]
        out.append(line)
    return "\n".join(out)
