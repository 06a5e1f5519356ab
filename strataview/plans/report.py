"""HTML report of one node of a post-processed spec."""

from __future__ import annotations

import html
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataview.functions.text import sigfig, wrap
from strataview.operators.binning import bin_count, bin_histogram
from strataview.plans.plots import timeline
from strataview.plans.drawing import histogram_svg, timeline_svg
from strataview.plans.profile import cardinalities
from strataview.plans.render import build, collect_nodes, declaration
from strataview.plans.spec import View

STRIPES = ("#ffffff", "#f0f0f0")


@dataclass
class ReportConfig:
    """Per table: sort column (1-based) and direction; and the page's settings."""

    sort: dict[str, tuple[int, str]] = field(default_factory=dict)
    width: int = 600
    zoom: int = 3
    auto_bins: bool = True
    log_scale: bool = False

    def sort_of(self, table: str) -> tuple[int, str]:
        return self.sort.get(table, (1, "ascending"))

    def click(self, table: str, column: int) -> None:
        """A click on the sorted column turns its direction, on another sorts by it."""
        now, direction = self.sort_of(table)
        self.sort[table] = (column, "descending" if now == column and direction == "ascending" else "ascending")


def sort_table(df: DataFrame, columns: list[str], sort: tuple[int, str]) -> DataFrame:
    """Order by the chosen column, then by the others."""
    number, direction = sort
    first = columns[min(number, len(columns)) - 1]
    rest = [c for c in columns if c != first]
    return df.orderBy(F.col(first).desc_nulls_last() if direction == "descending" else F.col(first).asc_nulls_first(), *rest)


def attributes_present(df: DataFrame) -> list[str]:
    """Which of key and ts any row has."""
    row = df.agg(F.count("first_key").alias("key"), F.count("first_ts").alias("ts")).first()
    return [a for a in ("key", "ts") if row[a]]


def columns_for(present: list[str]) -> list[str]:
    """2, 4 or 6 columns of the samples table."""
    spans = [f"{end}_{a}" for end in ("first", "last") for a in ("ts", "key") if a in present]
    return ["vtext", "n", *spans]


def first_rows(df: DataFrame, most: int) -> tuple[list, str]:
    """The first ``most`` rows, and a remark for the title if there are more."""
    rows = df.limit(most + 1).collect()
    return rows[:most], f" (first {sigfig(most)} of {sigfig(df.count())})" if len(rows) > most else ""


def samples_table(view: View, path: str, name: str, config: ReportConfig, most: int = 10_000) -> tuple[list[str], list[tuple], str]:
    """Columns and rows of a node's samples, and a remark if they are cut; atoms use their exhaustive dictionary."""
    source = view.dictionary if name == "atom" else view.samples
    rows = source.where((F.col("path") == path) & (F.col("class") == name)) if source is not None else None
    if rows is None:
        return ["vtext", "n"], [], ""
    columns = columns_for(attributes_present(rows))
    shown, remark = first_rows(sort_table(rows, columns, config.sort_of("samples")), most)
    return columns, [tuple(r[c] for c in columns) for r in shown], remark


def _table(title: str, columns: list[str], rows: list[tuple]) -> str:
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    body = "".join(f'<tr bgcolor="{STRIPES[k % 2]}">' + "".join(f"<td>{html.escape(wrap('' if v is None else str(v))).replace(chr(10), '<br>')}</td>" for v in row) + "</tr>" for k, row in enumerate(rows))
    return f'<h3>{html.escape(title)}</h3><table cellspacing="0"><tr>{head}</tr>{body}</table>'


def report_page(view: View, path: str, name: str, config: ReportConfig | None = None) -> str:
    """The page of node (path, class)."""
    config = config or ReportConfig()
    here = (F.col("path") == path) & (F.col("class") == name)
    card = cardinalities(view).where(here).first()
    rows = collect_nodes(view.nodes.where(F.col("path").startswith(path)))
    parts = [f'<font size="{config.zoom}"><b>{html.escape(name)}</b><br><code>{html.escape(declaration(build(rows, path, view.meta.get('fields') or (), view.meta.get('records') or ())))}</code>']
    if card:
        parts.append(_table("Properties", ["Property", "Value"], [("Count", sigfig(card["n"])), ("Cardinality", f"{sigfig(card['cardinality'])} ± {sigfig(card['error'])}")]))
    ends = view.extremes.where(here)
    present = attributes_present(ends)
    columns = columns_for(present)
    parts.append(_table("Extremes", ["which", *columns], [tuple(r[c] for c in ("which", *columns)) for r in ends.orderBy(F.desc("which")).collect()]))
    columns, values, remark = samples_table(view, path, name, config)
    parts.append(_table("Samples" + remark, columns, values))
    if "ts" in present and view.samples is not None:
        lines, remark = first_rows(timeline(view.samples.where(here), ends).orderBy("vtext"), 1000)
        lines = [(r["vtext"], r["n"], r["first_ts"], r["last_ts"]) for r in lines]
        parts.append(_table("Timeline of sampled values" + remark, ["Value", "Count", "First", "Last"], lines))
        parts.append(timeline_svg(lines, config.width))
    hist = view.histogram.where(here).select("bucket", "n")
    if hist.limit(1).count():
        shown = bin_histogram(hist, bin_count(config.width)) if config.auto_bins else hist.select(F.col("bucket").alias("mid"), "n")
        bars, remark = first_rows(shown.orderBy("mid"), 10_000)
        parts.append(_table("Histogram" + remark, ["Size", "Count"], [tuple(r) for r in bars]))
        parts.append(histogram_svg([tuple(r) for r in bars], config.width, log=config.log_scale))
    return "<html><head><meta http-equiv=\"Content-Type\" content=\"text/html; charset=UTF-8\"></head><body>" + "<br>".join(parts) + "</font></body></html>"
