"""Column functions against the kernel's own values."""

import math

import pytest
from pyspark.sql import functions as F

from scriptmill.functions import js
from scriptmill.kernel import values as v

NUMBERS = [0.0, -0.0, 1.0, -1.5, 2.5, 1e10, -1e10, 4294967295.0, 2147483648.0, 0.1, 123456.789, -7.0]
STRINGS = ["", "abc", "héllo", "h😀llo", " \t12 ", "0x1f", "12px", "-7.5e2", ".5", "5.", "inf", "zz9", "999999999999999999999", "-42abc", "ÀÉ", "aXa", "  3\n"]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([(a, b) for a in NUMBERS for b in (0.0, 1.0, 3.0, 33.0, -2.0)], "a double, b double")


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(s,) for s in STRINGS], "s string")


def same(got, want):
    if want is None or want is v.NOTHING:
        return got is None
    return got == want and (not isinstance(want, float) or math.copysign(1, got) == math.copysign(1, want) or want != 0)


def test_operators(pairs):
    f = {"&": js.bit_and, "|": js.bit_or, "^": js.bit_xor, "<<": js.shift_left, ">>": js.shift_right, ">>>": js.shift_right_unsigned, "/": js.divide, "%": js.remainder}
    rows = pairs.select("a", "b", *[g("a", "b").alias(op) for op, g in f.items()], js.bit_not("a").alias("~"), js.shift_right_unsigned_clamped("a", "b").alias("clamped")).collect()
    for r in rows:
        for op in f:
            want = v.arithmetic(op, r.a, r.b) if op in "/%" else float(v.bitwise(op, v.int32(r.a), v.int32(r.b)))
            assert r[op] == want or want is None and r[op] is None, (op, r)
        assert r["~"] == ~v.int32(r.a) and r.clamped == v.uint32(r.a) >> (v.int32(r.b) & 31)


def test_math(pairs):
    rows = pairs.select("a", js.ceil("a").alias("ceil"), js.floor("a").alias("floor"), js.trunc("a").alias("trunc"), js.round_("a").alias("round"), js.sqrt("a").alias("sqrt"), js.log10("a").alias("log10"), js.minimum("a", 1.0).alias("min"), js.format_number("a").alias("text")).distinct().collect()
    for r in rows:
        for name in ("ceil", "floor", "trunc", "round", "sqrt", "log10"):
            want = v.call_builtin(f"Math.{name}", [r.a])
            assert r[name] is None if want is v.NOTHING else r[name] == pytest.approx(want), (name, r)
        assert r["min"] == min(r.a, 1.0)
        if abs(r.a) >= 1e-3:
            assert r.text == v.format_number(r.a)


def test_numbers_from_text(texts):
    radixes = (2, 8, 10, 16, 36)
    rows = texts.select("s", js.number("s").alias("number"), js.parse_float("s").alias("float"), js.trim("s").alias("trim"), *[js.parse_int("s", r).alias(f"r{r}") for r in radixes]).collect()
    for r in rows:
        assert same(r.number, v.call_builtin("Number", [r.s])), r
        assert same(r.float, v.call_builtin("parseFloat", [r.s])), r
        assert r.trim == r.s.strip(v.BLANKS)
        for radix in radixes:
            assert same(r[f"r{radix}"], v.call_builtin("parseInt", [r.s, float(radix)])), (radix, r)


def test_strings(texts):
    def cases():
        for i in (0, 1, 2, 9, -1):
            yield "charAt", [float(i)], js.char_at("s", F.lit(i))
            yield "charCodeAt", [float(i)], js.char_code_at("s", F.lit(i))
        for t in ("l", "a", "", "😀"):
            if t:
                yield "indexOf", [t], js.index_of("s", F.lit(t))
                yield "lastIndexOf", [t], js.last_index_of("s", F.lit(t))
            yield "includes", [t], js.includes("s", F.lit(t))
        for a, b in ((0, 2), (1, -1), (-3, 9), (4, 1)):
            yield "slice", [float(a), float(b)], js.slice_("s", a, b)
            yield "substring", [float(a), float(b)], js.substring("s", a, b)
        yield "slice", [2.0], js.slice_("s", 2)
        yield "toUpperCase", [], js.upper("s")
        yield "repeat", [3.0], js.repeat("s", 3)
        yield "repeat", [1001.0], js.repeat("s", 1001)
        yield "replace", ["l", "$&"], js.replace_first("s", F.lit("l"), F.lit("$&"))

    for name, a, column in cases():
        for r in texts.select("s", column.alias("x"), js.length("s").alias("n")).collect():
            want = v.call_method(r.s, name, a)
            assert same(r.x, want), (name, a, r, want)
            assert r.n == len(v.units(r.s)) // 2


def test_codecs(spark, texts):
    rows = texts.select("s", js.btoa("s").alias("b"), js.atob("s").alias("a"), js.base64_decode("s").alias("d"), js.lower_first_decode("s").alias("o"), js.rc4(F.encode("s", "UTF-8"), F.lit("k")).alias("r")).collect()
    for r in rows:
        assert same(r.b, v.call_builtin("btoa", [r.s])) and same(r.a, v.call_builtin("atob", [r.s])), r
        assert r.d == v.base64_decode(r.s) and r.o == v.base64_decode(r.s, v.LOWER_FIRST), r
        assert list(r.r) == v.rc4(list(r.s.encode()), "k")
    codes = spark.createDataFrame([([72, 8364, 128512],), ([],), ([0xD800],), ([-1],)], "c array<int>")
    assert [r.x for r in codes.select(js.from_char_code("c").alias("x")).collect()] == ["H€😀", "", None, None]


def test_functions_stay_in_the_jvm(texts):
    plan = texts.select(js.number("s"), js.parse_int("s"), js.index_of("s", F.lit("a")), js.slice_("s", 1), js.atob("s"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_numbers_beyond_doubles_are_shown_whole(spark, tmp_path):
    """F8: from order 7,295,832 on the product is no double any more."""
    from scriptmill.plans.catalogue import QUERIES

    keys = [1, 7_295_831, 7_295_833, 8_999_999, 10**12 + 1]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.o_orderkey: r.whole for r in QUERIES["js_format_number"](spark, str(tmp_path)).collect()}
    assert got == {k: str(k * 1234567891) for k in keys}
