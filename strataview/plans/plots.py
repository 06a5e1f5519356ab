"""Plot data: bars of a histogram, ranges of a timeline, and the choice of time ticks."""

from __future__ import annotations

from string import Template

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY = 86400
#: Tick intervals in seconds and their label formats (fixed values), largest first.
TICKS = (
    (DAY * 365 * 50, "%Y"),
    (DAY * 365 * 30, "%Y"),
    (DAY * 365 * 20, "%Y"),
    (DAY * 365 * 10, "%Y"),
    (DAY * 365 * 5, "%Y"),
    (DAY * 365 * 3, "%Y"),
    (DAY * 365 * 2, "%Y"),
    (DAY * 365, "%Y"),
    (DAY * 182, "%Y/%m"),
    (DAY * 30 * 3, "%Y/%m"),
    (DAY * 30 * 2, "%Y/%m"),
    (DAY * 30, "%Y/%m"),
    (DAY * 15, "%Y/%m/%d"),
    (DAY * 10, "%Y/%m/%d"),
    (DAY * 5, "%Y/%m/%d"),
    (DAY * 3, "%Y/%m/%d"),
    (DAY * 2, "%Y/%m/%d"),
    (DAY, "%Y/%m/%d"),
    (43200, "%m/%d %H'"),
    (21600, "%m/%d %H'"),
    (10800, "%m/%d %H'"),
    (7200, "%d. %H:%M"),
    (3600, "%d. %H:%M"),
    (1800, "%d. %H:%M"),
    (1200, "%d. %H:%M"),
    (600, "%d. %H:%M"),
    (300, "%d. %H:%M"),
    (180, "%d. %H:%M"),
    (120, "%d. %H:%M"),
    (60, "%d. %H:%M"),
    (30, "%H:%M:%S"),
    (10, "%H:%M:%S"),
    (0, "%H:%M:%S"),
)
TICK_WIDTH, DEFAULT_WIDTH = 150, 800

HISTOGRAM = Template('set terminal png size $width,300\nset output "$output"\n$logscale\nset style fill solid\nset boxwidth 0.9 relative\nplot "$data" using 1:2 with boxes notitle\n')
RANGES = Template('set terminal png size $width,$height\nset output "$output"\nset xdata time\nset timefmt "%s"\nset format x "$format"\nset xtics $interval\nplot "$data" using 3:0:3:4:ytic(1) with xerrorbars notitle\n')


def tick(first: int, last: int, width: int = DEFAULT_WIDTH) -> tuple[int, str]:
    """Interval and format of the time axis: the largest interval that is not too dense."""
    least = max(1, (last - first) * TICK_WIDTH // width)
    interval, label = next((i, f) for i, f in TICKS if least >= i)
    return max(10, interval), label


def csv_lines(rows: list[tuple]) -> str:
    """Plot rows as lines of comma-separated values."""
    return "\n".join(", ".join('"' + v.replace('"', "") + '"' if isinstance(v, str) else str(v) for v in row) for row in rows)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def timeline(samples: DataFrame, extremes: DataFrame) -> DataFrame:
    """Distinct sampled and extreme values with both timestamps: vtext, n, first_ts, last_ts."""
    columns = ["path", "class", "vtext", "n", "first_ts", "last_ts"]
    rows = samples.select(*columns).unionByName(extremes.select(*columns)).distinct()
    return rows.where(F.col("first_ts").isNotNull() & F.col("last_ts").isNotNull())


def histogram_script(data: str, output: str, width: int = DEFAULT_WIDTH, log: bool = False) -> str:
    return HISTOGRAM.substitute(data=data, output=output, width=width, logscale="set logscale y" if log else "")


def timeline_script(data: str, output: str, first: int, last: int, rows: int, width: int = DEFAULT_WIDTH) -> str:
    interval, label = tick(first, last, width)
    return RANGES.substitute(data=data, output=output, width=width, height=80 + 20 * rows, interval=interval, format=label)
