import datetime

import pytest
from pyspark.sql import functions as F

from strataview.functions import hierarchy as H
from strataview.functions import text
from strataview.functions import timestamps as ts
from strataview.plans.options import make_options
from strataview.plans.profile import probe_facts
from strataview.plans.render import Type, attribute_label, declaration

ALL = make_options(limit=None)


def classes(spark, values, kind):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    rows = probe_facts(df, "v", ALL, None).where("path = '$'").select("vtext", "class").collect()
    return {r["vtext"]: r["class"] for r in rows}


def test_chains():
    assert H.chain("byte") == ["term", "number", "integer", "non_neg_integer", "char", "byte"]
    assert H.chain("0")[-2:] == ["byte", "0"]
    assert H.chain("boolean") == ["term", "atom", "boolean"]
    assert H.chain("<<>>") == ["term", "bitstring", "binary", "<<>>"]
    assert H.chain("#rec/3") == ["term", "tuple", "#rec/3"]
    assert H.chain("fun/2") == ["term", "fun", "fun/2"]
    assert [H.kind(x) for x in ("list", "map", "#r/2", "integer")] == ["union", "generic", "generic", "ordinary"]


def test_integer_classes(spark):
    got = classes(spark, [0, 1, 255, 256, 0x10FFFF, 0x110000, 12345678, -5], "long")
    assert got == {"0": "0", "1": "byte", "255": "byte", "256": "char", "1114111": "char", "1114112": "non_neg_integer", "12345678": "non_neg_integer", "-5": "neg_integer"}


def test_scalar_classes(spark):
    assert classes(spark, [123.45678], "double") == {"123.45678": "float"}
    assert classes(spark, ["", "x"], "string") == {"": "<<>>", "x": "binary"}
    assert classes(spark, [True, False], "boolean") == {"true": "boolean", "false": "boolean"}
    assert classes(spark, [datetime.date(2020, 1, 2)], "date") == {"2020-01-02": "date"}
    assert set(classes(spark, [bytearray(b""), bytearray(b"a")], "binary").values()) == {"<<>>", "binary"}


def test_columns_of_the_hierarchy(spark):
    names = ["byte", "term", "#a/2", "tuple/3", "fun/1", "<<>>", "map"]
    df = spark.createDataFrame([(n,) for n in names], "c string").select("c", H.ancestors_column(F.col("c")).alias("a"), H.parent_column(F.col("c")).alias("p"))
    for r in df.collect():
        assert r["a"] == H.ancestors(r["c"]) and r["p"] == H.parent(r["c"])


def test_timestamps(spark):
    row = spark.range(1).select(
        ts.decode_integer(F.lit(62962922096)).alias("a"),
        ts.decode_integer(F.lit(62962922096000)).alias("b"),
        ts.decode_integer(F.lit(795702896)).alias("c"),
        ts.decode_triple(F.lit(795), F.lit(702896), F.lit(123456)).alias("d"),
        ts.decode_datetime(*map(F.lit, (1995, 3, 20, 12, 34, 56))).alias("e"),
        ts.decode_triple(*map(F.lit, (1995, 3, 20))).alias("f"),
        ts.decode_integer(F.lit(-1)).alias("g"),
        *(ts.to_string(F.lit(v)).alias(f"s{k}") for k, v in enumerate((62962922096, 62962922040, 62962876800))),
        ts.to_unix(F.lit(62962922096)).alias("unix"),
        ts.to_now(F.lit(62962922096)).alias("now"),
        ts.to_date(F.lit(62962922096)).alias("date"),
    ).first()
    assert [row[c] for c in "abcde"] == [62962922096] * 5
    assert row["f"] == 62962876800 and row["g"] is None
    assert (row["s0"], row["s1"], row["s2"]) == ("1995-03-20 12:34:56", "1995-03-20 12:34", "1995-03-20")
    assert row["unix"] == 795702896 and tuple(row["now"]) == (795, 702896, 0) and row["date"] == datetime.date(1995, 3, 20)


def test_text_helpers():
    assert text.sigfig(1234567) == "1,234,567"
    assert [text.timediff(x) for x in (3.25, 63.5, 3661, 90061, 180000)] == ["3.2", "1:03.5", "1:01:01.0", "1 day, 01:01:01.0", "2 days, 02:00:00.0"]
    assert [text.speed(t, n) for t, n in ((0, 5), (2, 5), (1, 2590), (1, 2_500_000))] == ["N/A", "2.50", "2.59k", "2.50M"]
    assert text.ellipsize("x" * 24) == "x" * 20 + "..." and text.ellipsize("x" * 23) == "x" * 23
    assert text.index_of("b", ["a", "b"]) == 2 and text.common_prefix(["abc", "abd"]) == "ab"
    assert text.wrap("x" * 100).split("\n")[0] == "x" * 82


def test_declaration():
    top = Type("$", "term", 0, [
        Type("$", "map"), Type("$", "atom"), Type("$", "[]"), Type("$", "<<>>"), Type("$", "{}"),
        Type("$", "nonempty_list", parameters=[("", Type("$[]", "tuple/2", parameters=[("", Type("a", "atom")), ("", Type("b", "0"))]))]),
        Type("$", "improper_list", parameters=[("", Type("$[]", "term", 0, [Type("x", "atom"), Type("x", "float")])), ("", Type("t", "atom"))]),
        Type("$", "#widget2/4", parameters=[("count", Type("c", "number")), ("type", Type("t", "atom")), ("status", Type("s", "byte"))]),
        Type("$", "tuple", 0, [Type("$", "tuple/2", parameters=[("", Type("a", "atom")), ("", Type("b", "0"))]), Type("$", "{}")]),
    ])
    assert declaration(top) == (
        "map() |\natom() |\n[] |\n<<>> |\n{} |\n[{atom(), 0}] |\nimproper_list(atom() | float(), atom()) |\n"
        "#widget2{count :: number(), type :: atom(), status :: byte()} |\n{atom(), 0} |\n{}\n"
    )
    assert declaration(Type("$", "term")) == "term()\n"
    assert [attribute_label(*a) for a in (("#r/3", 2, "x"), ("tuple/2", 1, ""), ("nonempty_list", 1, "items"))] == ["E2 #r.x", "E1", "items"]


def test_options():
    assert make_options().limit == 1000 and make_options(limit=None).limit is None
    assert make_options(samples=True).samples == 16 and make_options(samples=None).samples is None
    with pytest.warns(UserWarning):
        assert make_options(hll_b=99).hll_b == 8
    with pytest.warns(UserWarning):
        make_options(nonsense=1)
