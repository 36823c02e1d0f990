"""JavaScript's scalar semantics as Column functions: JVM-side, null where there is no value.

They follow the rewriter: booleans and null count as 1, 0 and 0 in arithmetic and in all comparisons,
integers of bitwise operators are clamped to 32 bits, string places in indexOf are bytes and elsewhere
UTF-16 units. No function depends on ANSI mode.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptmill.kernel.values import LOWER_FIRST, REPEAT_BYTES, REPEAT_COUNT, STANDARD

BLANKS = r"[ \t\n\r\x0B\f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INF = float("inf")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def finite(x) -> Column:
    """x, or null if it isn't finite."""
    x = _c(x)
    return F.when(~F.isnan(x) & (F.abs(x) < INF), x)


def from_boolean(x) -> Column:
    """A boolean in arithmetic; null is 0."""
    return F.coalesce(_c(x).cast("int").cast("double"), F.lit(0.0))


# -- operators --------------------------------------------------------------------------------------------------------


def add(a, b) -> Column:
    return _c(a) + _c(b)


def subtract(a, b) -> Column:
    return _c(a) - _c(b)


def multiply(a, b) -> Column:
    return _c(a) * _c(b)


def divide(a, b) -> Column:
    """Null for a zero divisor."""
    b = _c(b)
    return F.when(b != 0, F.try_divide(_c(a), b))


def remainder(a, b) -> Column:
    """With the dividend's sign; null for a zero divisor."""
    b = _c(b)
    return F.when(b != 0, F.try_mod(_c(a), b))


def power(a, b) -> Column:
    """The operator **: what isn't finite stays."""
    return F.pow(_c(a), _c(b))


def math_pow(a, b) -> Column:
    """Math.pow: null where the result isn't finite."""
    return finite(power(a, b))


def _numbers(a, b, test) -> Column:
    """A test of two numbers that is false where one is NaN (Spark orders NaN last, and equal to itself)."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    return F.when(a.isNotNull() & b.isNotNull(), ~F.isnan(a) & ~F.isnan(b) & test(a, b))


def equal(a, b) -> Column:
    """== on numbers."""
    return _numbers(a, b, lambda x, y: x == y)


def not_equal(a, b) -> Column:
    """!= on numbers: NaN is unlike everything."""
    return ~equal(a, b)


def strict_equal(a, b) -> Column:
    """=== on numbers; booleans and null are numbers here (from_boolean), so it holds where == does."""
    return _numbers(a, b, lambda x, y: x == y)


def strict_not_equal(a, b) -> Column:
    return ~strict_equal(a, b)


def less(a, b) -> Column:
    return _numbers(a, b, lambda x, y: x < y)


def less_equal(a, b) -> Column:
    return _numbers(a, b, lambda x, y: x <= y)


def greater(a, b) -> Column:
    return _numbers(a, b, lambda x, y: x > y)


def greater_equal(a, b) -> Column:
    return _numbers(a, b, lambda x, y: x >= y)


def int32(x) -> Column:
    """Clamped to 32 bits; NaN is 0."""
    x = _c(x).cast("double")
    return F.when(F.isnan(x), F.lit(0)).otherwise(F.greatest(F.lit(-2147483648.0), F.least(F.lit(2147483647.0), x)).cast("int"))


def bit_and(a, b) -> Column:
    return int32(a).bitwiseAND(int32(b)).cast("double")


def bit_or(a, b) -> Column:
    return int32(a).bitwiseOR(int32(b)).cast("double")


def bit_xor(a, b) -> Column:
    return int32(a).bitwiseXOR(int32(b)).cast("double")


def bit_not(a) -> Column:
    return F.bitwise_not(int32(a)).cast("double")


def _count(b) -> Column:
    return int32(b).bitwiseAND(F.lit(31))


def shift_left(a, b) -> Column:
    return F.call_function("shiftleft", int32(a), _count(b)).cast("double")


def shift_right(a, b) -> Column:
    return F.call_function("shiftright", int32(a), _count(b)).cast("double")


def shift_right_unsigned(a, b) -> Column:
    """As the rewriter folds it: the result is signed again."""
    return F.call_function("shiftrightunsigned", int32(a), _count(b)).cast("double")


def shift_right_unsigned_clamped(a, b) -> Column:
    """As the pure evaluator has it: negative numbers are 0 first."""
    x = _c(a).cast("double")
    x = F.when(F.isnan(x), F.lit(0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(4294967295.0), x)).cast("long"))
    return F.call_function("shiftright", x, _count(b)).cast("double")


def truthy_number(x) -> Column:
    x = _c(x)
    return F.coalesce((x != 0) & ~F.isnan(x), F.lit(False))


def truthy_string(x) -> Column:
    return F.coalesce(_c(x) != "", F.lit(False))


# -- numbers from text ------------------------------------------------------------------------------------------------


def trim(x) -> Column:
    """Unicode blanks on both sides."""
    return F.regexp_replace(_c(x), f"^{BLANKS}+|{BLANKS}+$", "")


def parse_float(x) -> Column:
    """The whole trimmed text as a finite number, or null."""
    t = trim(x)
    return finite(F.when(t.rlike(_DECIMAL), t.try_cast("double")))


def number(x) -> Column:
    """Like parse_float, but blank text is 0."""
    return F.when(trim(x) == "", F.lit(0.0)).otherwise(parse_float(x))


def parse_int(x, radix: int = 10) -> Column:
    """The longest digit prefix in the radix; null if there is none or 64 bits don't hold it."""
    if not 2 <= radix <= 36:
        return F.lit(None).cast("double")
    digits = "0-9"[: 3 if radix > 9 else 0] or f"0-{radix - 1}"
    if radix > 10:
        last = chr(ord("a") + radix - 11)
        digits += f"a-{last}A-{last.upper()}"
    t = trim(x)
    sign = F.when(t.startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    prefix = F.regexp_extract(t, f"^[+-]?([{digits}]+)", 1)
    significant = F.regexp_replace(prefix, "^0+(?=.)", "")
    # conv() works on unsigned 64 bits; longer prefixes than 64 digits can't fit in any radix.
    value = F.conv(F.when(F.length(significant) <= 63, significant), radix, 10).try_cast("decimal(38,0)")
    short = F.length(significant) <= {2: 63, 3: 39, 4: 31, 5: 27, 6: 24, 7: 22, 8: 21, 9: 19, 10: 19, 16: 15}.get(radix, 12)
    return F.when((prefix != "") & short & (value < F.lit("9223372036854775808").cast("decimal(38,0)")), sign * value.cast("double"))


def bound(x: Column, f) -> Column:
    """f of x, with x worked out once however often f mentions it: a transform over an array of one."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def format_number(x) -> Column:
    """Plain decimal text: no exponent, no fraction on whole numbers; NaN, inf and -inf by name."""

    def plain(s: Column) -> Column:
        """A mantissa's digits with the point moved by the exponent."""
        digits, exponent = s["digits"], s["exponent"]
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
        point = exponent + 1
        large = F.when(F.length(digits) <= point, F.rpad(digits, point, F.lit("0"))).otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, F.length(digits))))
        return F.concat(F.when(s["text"].startswith("-"), "-").otherwise(""), F.when(exponent < 0, small).otherwise(large))

    def of(text: Column) -> Column:
        digits = F.regexp_replace(F.regexp_replace(F.substring_index(text, "E", 1), r"[-.]|\.0$", ""), "(?<=.)0+$", "")
        moved = bound(F.struct(text.alias("text"), digits.alias("digits"), F.substring_index(text, "E", -1).try_cast("int").alias("exponent")), plain)
        return F.when(text == "Infinity", "inf").when(text == "-Infinity", "-inf").when(F.contains(text, F.lit("E")), moved).otherwise(F.regexp_replace(text, r"\.0$", ""))

    return bound(_c(x).cast("double").cast("string"), of)


# -- Math -------------------------------------------------------------------------------------------------------------


#: From here on doubles have no fraction.
WHOLE = 9007199254740992.0


def _whole(x, f) -> Column:
    """f, which goes through 64-bit integers, where it may; beyond, and where there is no fraction, x itself. Signs of zeros stay."""
    x = _c(x).cast("double")
    near = f(x).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) >= WHOLE) | (x == 0), x).when((near == 0) & (x < 0), F.lit(-0.0)).otherwise(near)


def ceil(x) -> Column:
    return _whole(x, F.ceil)


def floor(x) -> Column:
    return _whole(x, F.floor)


def trunc(x) -> Column:
    return _whole(x, lambda v: F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)))


def round_(x) -> Column:
    """Halves away from zero: the largest double below a half stays below it."""
    return _whole(x, lambda v: F.signum(v) * (F.floor(F.abs(v)) + F.when(F.abs(v) - F.floor(F.abs(v)) >= 0.5, 1.0).otherwise(0.0)))


def sign(x) -> Column:
    return F.signum(_c(x))


def sqrt(x) -> Column:
    return finite(F.sqrt(_c(x)))


def log(x) -> Column:
    return finite(F.when(_c(x) > 0, F.ln(_c(x))))


def log2(x) -> Column:
    return finite(F.when(_c(x) > 0, F.log2(_c(x))))


def log10(x) -> Column:
    return finite(F.when(_c(x) > 0, F.log10(_c(x))))


def minimum(*x) -> Column:
    return F.least(*map(_c, x))


def maximum(*x) -> Column:
    return F.greatest(*map(_c, x))


# -- strings ----------------------------------------------------------------------------------------------------------


def length(x) -> Column:
    """UTF-16 units."""
    return (F.octet_length(F.encode(_c(x), "UTF-16BE")) / 2).cast("int")


def _units(x, start: Column, count: Column) -> Column:
    """A range of units; null if it cuts a pair."""
    raw = F.substring(F.encode(_c(x), "UTF-16BE"), start * 2 + 1, count * 2)
    cut = F.hex(F.substring(raw, F.lit(1), F.lit(2))).rlike("^D[C-F]") | F.hex(F.substring(raw, F.octet_length(raw) - 1, F.lit(2))).rlike("^D[89AB]")
    return F.when(~cut, F.decode(raw, "UTF-16BE"))


def char_at(x, i) -> Column:
    """Null out of range."""
    i = _c(i)
    return F.when((i >= 0) & (i < length(x)), _units(x, i.cast("int"), F.lit(1)))


def char_code_at(x, i) -> Column:
    i = _c(i)
    raw = F.substring(F.encode(_c(x), "UTF-16BE"), i.cast("int") * 2 + 1, F.lit(2))
    return F.when((i >= 0) & (i < length(x)), F.conv(F.hex(raw), 16, 10).cast("int"))


def index_of(x, t) -> Column:
    """The first place in bytes; -1 if there is none."""
    x, t = _c(x), _c(t)
    at = F.instr(x, t)
    return F.when(at == 0, F.lit(-1)).otherwise(F.octet_length(F.substring(x, F.lit(1), at - 1)))


def last_index_of(x, t) -> Column:
    x, t = _c(x), _c(t)
    at = F.instr(F.reverse(x), F.reverse(t))
    return F.when(at == 0, F.lit(-1)).otherwise(F.octet_length(x) - F.octet_length(F.substring(F.reverse(x), F.lit(1), at - 1)) - F.octet_length(t))


def includes(x, t) -> Column:
    return F.contains(_c(x), _c(t))


def starts_with(x, t) -> Column:
    return F.startswith(_c(x), _c(t))


def ends_with(x, t) -> Column:
    return F.endswith(_c(x), _c(t))


def slice_(x, a: int, b: int | None = None) -> Column:
    """Negative ends count from the text's end."""
    n = length(x)
    end = lambda i: F.least(n, F.lit(i)) if i >= 0 else F.greatest(F.lit(0), n + i)
    lo, hi = end(a), n if b is None else end(b)
    return F.when(hi > lo, _units(x, lo, hi - lo)).otherwise(F.lit(""))


def substring(x, a: int, b: int | None = None) -> Column:
    """Negative ends are 0; ends in the wrong order are swapped."""
    n = length(x)
    lo, hi = F.least(n, F.lit(max(0, a))), n if b is None else F.least(n, F.lit(max(0, b)))
    lo, hi = F.least(lo, hi), F.greatest(lo, hi)
    return F.when(hi > lo, _units(x, lo, hi - lo)).otherwise(F.lit(""))


def lower(x) -> Column:
    return F.lower(_c(x))


def upper(x) -> Column:
    return F.upper(_c(x))


def repeat(x, n: int) -> Column:
    """Null beyond the folding limits."""
    n = max(0, n)
    return F.when((F.lit(n) <= REPEAT_COUNT) & (F.octet_length(_c(x)) * n <= REPEAT_BYTES), F.repeat(_c(x), min(n, REPEAT_COUNT)))


def replace_first(x, a, b) -> Column:
    x, a, b = _c(x), _c(a), _c(b)
    at = F.instr(x, a)
    return F.when(at == 0, x).otherwise(F.concat(F.substring(x, F.lit(1), at - 1), b, F.substring(x, at + F.length(a), F.length(x))))


def from_char_code(codes) -> Column:
    """Code points as text; null if one is no character."""
    codes = _c(codes)
    utf32 = F.array_join(F.transform(codes, lambda c: F.lpad(F.hex(c.cast("long")), 8, "0")), "")
    fine = F.forall(codes, lambda c: (c >= 0) & (c <= 0x10FFFF) & ~c.between(0xD800, 0xDFFF))
    return F.when(fine, F.decode(F.unhex(F.concat(F.lit("0000FEFF"), utf32)), "UTF-32"))


# -- codecs -----------------------------------------------------------------------------------------------------------


def _standard_bytes(sextets: Column) -> Column:
    """Bytes of characters of the standard alphabet alone; a lone last one is dropped."""
    whole = F.when(F.length(sextets) % 4 == 1, F.substring(sextets, F.lit(1), F.length(sextets) - 1)).otherwise(sextets)
    return F.unbase64(F.rpad(whole, F.ceil(F.length(whole) / 4).cast("int") * 4, F.lit("=")))


def base64_decode(x) -> Column:
    """Up to the first =, other characters skipped; bytes as Latin-1."""
    head = F.regexp_replace(F.substring_index(_c(x), "=", 1), "[^A-Za-z0-9+/]", "")
    return F.decode(_standard_bytes(head), "ISO-8859-1")


def base64_decode_with(x, alphabet: str) -> Column:
    """With an alphabet of 64 or 65 characters; others are skipped. Null for other alphabets."""
    if len(alphabet) not in (64, 65):
        return F.lit(None).cast("string")
    own = alphabet[:64]
    skipped = "[^" + "".join("\\" + c if not c.isalnum() else c for c in own) + "]"
    return F.decode(_standard_bytes(F.translate(F.regexp_replace(_c(x), skipped, ""), own, STANDARD)), "ISO-8859-1")


def atob(x) -> Column:
    """Strict: null if there is a character outside the alphabet."""
    t = F.regexp_replace(F.regexp_replace(_c(x), r"[ \t\n\f\r]", ""), "=+$", "")
    return F.when(t.rlike("^[A-Za-z0-9+/]*$"), F.decode(_standard_bytes(t), "ISO-8859-1"))


def base64_encode(x) -> Column:
    """Of binary."""
    return F.regexp_replace(F.base64(_c(x)), "[\r\n]", "")


def btoa(x) -> Column:
    """Of the UTF-8 bytes, where no character is beyond U+00FF."""
    x = _c(x)
    return F.when(x.rlike(r"^[\x{0}-\x{FF}]*$"), base64_encode(F.encode(x, "UTF-8")))


def lower_first_decode(x) -> Column:
    return base64_decode_with(x, LOWER_FIRST)


def rc4(data, key) -> Column:
    """RC4 of binary with a text key (characters modulo 256); an empty key changes nothing. Arrow-batched: a byte of all rows at a time."""
    @F.pandas_udf("binary")
    def run(d: pd.Series, k: pd.Series) -> pd.Series:
        from scriptmill.kernel.values import rc4_of_many

        there = [a is not None and b is not None for a, b in zip(d, k)]
        out = iter(rc4_of_many([bytes(a) for a, t in zip(d, there) if t], [b for b, t in zip(k, there) if t]))
        return pd.Series([next(out) if t else None for t in there], dtype=object)

    return run(_c(data), _c(key))
