"""Drawn plots: bars, axes and ranges are where the data are; report pages say what they leave out."""

import datetime
import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from strataview.plans import report
from strataview.plans.drawing import histogram_svg, number_steps, save_svg, seconds_of, timeline_svg
from strataview.plans.plots import tick
from strataview.plans.profile import profile

NS = "{http://www.w3.org/2000/svg}"


def parts(svg, kind, name=None):
    return [e for e in ET.fromstring(svg).iter(NS + kind) if name is None or e.get("class") == name]


def test_histogram():
    bars = [(1.0, 10), (2.0, 40), (4.0, 20)]
    svg = histogram_svg(bars, 600)
    rects = parts(svg, "rect", "bar")
    heights = [float(r.get("height")) for r in rects]
    assert len(rects) == 3 and abs(heights[1] / heights[0] - 4) < 0.05 and abs(heights[1] / heights[2] - 2) < 0.05
    lefts = [float(r.get("x")) for r in rects]
    assert abs((lefts[2] - lefts[1]) / (lefts[1] - lefts[0]) - 2) < 0.05 and all(float(r.get("x")) + float(r.get("width")) <= 600 for r in rects)
    texts = [t.text for t in parts(svg, "text")]
    assert {"1", "2", "4", "0", "40"} <= set(texts)
    logs = [float(r.get("height")) for r in parts(histogram_svg([(1, 1), (2, 10), (3, 100)], log=True), "rect", "bar")]
    assert logs[0] == 0 and abs(logs[2] / logs[1] - 2) < 0.05
    assert "no values" in histogram_svg([]) and len(parts(histogram_svg([(7.0, 3)]), "rect", "bar")) == 1
    assert number_steps(40) == [0, 10, 20, 30, 40] and number_steps(250, log=True) == [1, 10, 100, 1000]


def test_timeline():
    day = datetime.date(2024, 1, 1)
    rows = [("a <b>", 3, day, datetime.date(2024, 3, 1)), ("late", 1, datetime.datetime(2024, 2, 1, 12), datetime.datetime(2024, 2, 1, 12)), ("none", 1, None, None), ("text", 1, "x", "y")]
    svg = timeline_svg(rows, 800)
    ranges = parts(svg, "line", "range")
    assert len(ranges) == 2 and float(ranges[0].get("x1")) < float(ranges[1].get("x1")) < float(ranges[0].get("x2"))
    interval, label = tick(int(seconds_of(day)), int(seconds_of(datetime.date(2024, 3, 1))), 600)
    ticks = parts(svg, "line", "tick")
    assert len(ticks) in (60 * 86400 // interval, 60 * 86400 // interval + 1)
    names = [t.text for t in parts(svg, "text")]
    assert "a <b>" in names and any(n.startswith("2024/") for n in names) and label.startswith("%Y/")
    assert "no times" in timeline_svg([])


def test_pages_draw_and_say_what_they_cut(spark, tmp_path, monkeypatch):
    df = spark.range(400).selectExpr("concat('v', repeat('x', cast(id % 20 as int))) as txt", "date_add(date'2024-01-01', cast(id as int)) as day")
    view = profile(df, ("txt", {"ts": "day"}), limit=None, samples="all").postproc().persist()
    page = report.report_page(view, "$", "binary")
    assert page.count("<svg") == 2 and 'class="bar"' in page and 'class="range"' in page and "first 1" not in page
    rows, remark = report.first_rows(view.samples.where(F.col("class") == "binary"), 5)
    assert len(rows) == 5 and remark == " (first 5 of 20)"
    _, shown, remark = report.samples_table(view, "$", "binary", report.ReportConfig(), most=7)
    assert len(shown) == 7 and remark == " (first 7 of 20)"
    save_svg(histogram_svg([(1.0, 2)]), f"{tmp_path}/h.svg")
    assert ET.parse(f"{tmp_path}/h.svg").getroot().tag == NS + "svg"
