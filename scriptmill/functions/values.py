"""JavaScript values that are known without running a script, as Columns: a tag with a number or a text.

A value is a struct (tag, num, str): number, boolean (1 or 0) and null (0) have a number, string has a text, undefined has
neither. No struct at all means that a value isn't known. ``binary``, ``unary`` and ``logical`` follow the rewriter's
constant folding; the operator is a Column, so that rows with different operators share one expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptmill.functions import js

TYPE = "struct<tag:string,num:double,str:string>"
ARITHMETIC = {"+": js.add, "-": js.subtract, "*": js.multiply, "/": js.divide, "%": js.remainder, "**": js.power}
BITWISE = {"|": js.bit_or, "&": js.bit_and, "^": js.bit_xor, "<<": js.shift_left, ">>": js.shift_right, ">>>": js.shift_right_unsigned}
COMPARE = {"<": js.less, "<=": js.less_equal, ">": js.greater, ">=": js.greater_equal, "==": js.equal, "!=": js.not_equal, "===": js.strict_equal, "!==": js.strict_not_equal}


def value(tag: str, num: Column | None = None, text: Column | None = None) -> Column:
    return F.struct(F.lit(tag).alias("tag"), (F.lit(None) if num is None else num).cast("double").alias("num"), (F.lit(None) if text is None else text).cast("string").alias("str"))


def unknown() -> Column:
    return F.lit(None).cast(TYPE)


def literal(kind: Column, num: Column, text: Column, boolean: Column) -> Column:
    """The value of a literal's node."""
    return (
        F.when(kind == "Number", value("number", num))
        .when(kind == "String", value("string", text=text))
        .when(kind == "Boolean", value("boolean", boolean.cast("int")))
        .when(kind == "Null", value("null", F.lit(0.0)))
        .otherwise(unknown())
    )


def _known(num: Column) -> Column:
    """A number, where there is one."""
    return F.when(num.isNotNull(), value("number", num)).otherwise(unknown())


def _cases(op: Column, table: dict, make) -> Column:
    out = None
    for name, f in table.items():
        out = F.when(op == name, make(f)) if out is None else out.when(op == name, make(f))
    return out


def binary(op: Column, a: Column, b: Column) -> Column:
    """Numbers, booleans and null count as numbers in all operators; texts are joined by + and, as numbers, subtracted."""
    x, y = a["num"], b["num"]
    numeric = _cases(op, ARITHMETIC, lambda f: _known(f(x, y))).when(op.isin(*BITWISE), _known(_cases(op, BITWISE, lambda f: f(x, y)))).when(op.isin(*COMPARE), value("boolean", _cases(op, COMPARE, lambda f: f(x, y)).cast("int")))
    left, right = (F.when(v["tag"] == "string", js.number(v["str"])).otherwise(v["num"]) for v in (a, b))
    texts = F.when(op == "+", F.when((a["tag"] == "string") & (b["tag"] == "string"), value("string", text=F.concat(a["str"], b["str"])))).when(op == "-", _known(js.finite(left - right)))
    return F.when(x.isNotNull() & y.isNotNull(), numeric).otherwise(texts)


def truthy(a: Column) -> Column:
    """Null where nothing is said of undefined."""
    return F.when(a["tag"] == "string", js.truthy_string(a["str"])).when(a["num"].isNotNull(), js.truthy_number(a["num"]))


def unary(op: Column, a: Column) -> Column:
    number = F.when(a["tag"] == "string", F.when(op == "+", js.number(a["str"]))).otherwise(a["num"])
    return (
        F.when(op == "!", F.when(truthy(a).isNotNull(), value("boolean", (~truthy(a)).cast("int"))))
        .when(op == "-", _known(-number))
        .when(op == "+", _known(number))
        .when(op == "~", F.when(a["tag"] == "number", _known(js.bit_not(a["num"]))))
        .when((op == "typeof") & (a["tag"] != "undefined"), value("string", text=F.when(a["tag"] == "null", "object").otherwise(a["tag"])))
        .when((op == "void") & (a["tag"] != "undefined"), value("undefined"))
    )


def logical(op: Column, a: Column, b: Column) -> Column:
    """The side that && or || picks; an unknown right side that is picked stays unknown."""
    return F.when(op.isin("&&", "||") & truthy(a).isNotNull(), F.when(truthy(a) == (op == "&&"), b).otherwise(a))


def apply(kind: Column, op: Column, a: Column, b: Column) -> Column:
    """The value of a node of kind Binary, Logical, Unary or Paren over its operands' values (a alone for the last two).

    The four are bound once, by a transform over an array of one: written out in every case they would make an expression too
    large to compile.
    """

    def of(s: Column) -> Column:
        kind, op, a, b = s["kind"], s["op"], s["a"], s["b"]
        return F.when(kind == "Binary", binary(op, a, b)).when(kind == "Logical", logical(op, a, b)).when(kind == "Unary", unary(op, a)).when(kind == "Paren", a)

    return F.get(F.transform(F.array(F.struct(kind.alias("kind"), op.alias("op"), a.alias("a"), b.alias("b"))), of), F.lit(0))


def text(a: Column) -> Column:
    """A value as it is printed."""
    return F.when(a["tag"] == "string", a["str"]).when(a["tag"] == "boolean", F.when(a["num"] == 1, "true").otherwise("false")).when(a["tag"] == "number", js.format_number(a["num"])).otherwise(a["tag"])
