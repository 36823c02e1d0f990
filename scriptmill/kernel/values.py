"""JavaScript's scalar semantics on Python values, as the rewriter has them.

Numbers are floats, strings str, booleans bool, null None and undefined UNDEFINED; NOTHING says that
there is no static value. Integers for bitwise operators are clamped to 32 bits, not wrapped.
"""

from __future__ import annotations

import base64
import math
import re

from scriptmill.kernel.tree import Node, bare, boolean, format_number, number, string, undefined


class _Mark:
    def __init__(self, name: str):
        self.name = name

    def __repr__(self) -> str:
        return self.name


NOTHING, UNDEFINED = _Mark("NOTHING"), _Mark("UNDEFINED")
BLANKS = " \t\n\r\v\f\u0085                 　"
_DECIMAL = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[+-]?(?:inf|infinity|nan)", re.I)


def literal(x: Node):
    """The value of a literal node."""
    k = x.kind
    if k in ("Number", "String", "Boolean"):
        return x.value
    if k == "Null":
        return None
    if k == "Identifier" and x.name == "undefined":
        return UNDEFINED
    return NOTHING


def to_node(v) -> Node:
    if v is None:
        return Node("Null")
    if v is UNDEFINED:
        return undefined()
    if isinstance(v, bool):
        return boolean(v)
    return string(v) if isinstance(v, str) else number(v)


def is_literal(x: Node) -> bool:
    return x.kind in ("Number", "String", "Boolean", "Null")


def truthy(x: Node) -> bool | None:
    """Whether a node's value counts as true, if that is plain from its form."""
    x = bare(x)
    if x.kind == "Number":
        return x.value != 0 and x.value == x.value
    if x.kind == "String":
        return x.value != ""
    if x.kind == "Boolean":
        return x.value
    if x.kind == "Null":
        return False
    return True if x.kind in ("Array", "Object") else None


def parse_decimal(text: str) -> float | None:
    """A whole decimal text as a number."""
    return float(text) if _DECIMAL.fullmatch(text) else None


def numeric_text(text: str) -> float | None:
    text = text.strip(BLANKS)
    return 0.0 if not text else parse_decimal(text)


def coerced(x: Node) -> float | None:
    """Number, boolean or null as a number."""
    v = literal(bare(x))
    if v is None:
        return 0.0
    return float(v) if isinstance(v, (bool, float)) else None


def array_text(x: Node) -> str | None:
    """An array of literals as a string."""
    x = bare(x)
    if x.kind != "Array":
        return None
    out = []
    for i in x.items:
        if i is None or not is_literal(i):
            return None
        v = i.value if i.kind != "Null" else ""
        out.append(format_number(v) if isinstance(v, float) else ("true" if v else "false") if isinstance(v, bool) else v)
    return ",".join(out)


def int32(x: float) -> int:
    if x != x:
        return 0
    return int(max(-(2**31), min(2**31 - 1, x)))


def uint32(x: float) -> int:
    return 0 if x != x else int(max(0, min(2**32 - 1, x)))


def wrap32(n: int) -> int:
    return (n + 2**31) % 2**32 - 2**31


def bitwise(op: str, a: int, b: int) -> int:
    """On 32-bit integers; the result of >>> is signed again."""
    if op == "|":
        return a | b
    if op == "&":
        return a & b
    if op == "^":
        return a ^ b
    if op == "<<":
        return wrap32(a << (b & 31))
    if op == ">>":
        return a >> (b & 31)
    return wrap32((a % 2**32) >> (b & 31))


def remainder(a: float, b: float) -> float:
    return math.nan if math.isinf(a) or b == 0 else a if math.isinf(b) else math.fmod(a, b)


def power(a: float, b: float) -> float:
    try:
        r = a**b if b == b else math.nan
        return math.nan if isinstance(r, complex) or abs(a) == 1 and math.isinf(b) else r
    except OverflowError:
        return -math.inf if a < 0 and b % 2 == 1 else math.inf
    except ZeroDivisionError:
        return math.inf


def compare(op: str, a: float, b: float) -> bool:
    if op in ("==", "==="):
        return a == b
    if op in ("!=", "!=="):
        return a != b
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def arithmetic(op: str, a: float, b: float) -> float | None:
    if op == "+":
        return a + b
    if op == "-":
        return a - b
    if op == "*":
        return a * b
    if op in ("/", "%"):
        return None if b == 0 else a / b if op == "/" else remainder(a, b)
    return power(a, b) if op == "**" else None


# -- strings in UTF-16 units ------------------------------------------------------------------------------------------


def units(text: str) -> bytes:
    return text.encode("utf-16-be", "surrogatepass")


def from_units(raw: bytes) -> str | None:
    """None if a surrogate stands alone."""
    try:
        return raw.decode("utf-16-be")
    except UnicodeDecodeError:
        return None


def unit_at(text: str, i: float) -> bytes | None:
    if i != i or i < 0 or i != int(i):
        return None
    raw = units(text)[2 * int(i) : 2 * int(i) + 2]
    return raw or None


def parse_int(text: str, radix: float = 10.0, hexadecimal: bool = False) -> float | None:
    """The longest digit prefix; None if there is none or 64 bits don't hold it."""
    if radix != radix or not 2 <= radix <= 36:
        return None
    text = text.strip(BLANKS)
    sign = -1 if text[:1] == "-" else 1
    if text[:1] in ("+", "-"):
        text = text[1:]
    if hexadecimal and int(radix) == 16 and text[:2] in ("0x", "0X"):
        text = text[2:]
    n, seen = 0, False
    for c in text:
        d = int(c, 36) if c.isascii() and c.isalnum() else 99
        if d >= int(radix):
            break
        n, seen = n * int(radix) + d, True
    return None if not seen or n >= 2**63 else float(sign * n)


STANDARD = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
LOWER_FIRST = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"


def bits_to_bytes(sextets: list[int]) -> bytes:
    n = len(sextets) * 6 // 8
    total = 0
    for s in sextets:
        total = total << 6 | s
    return (total >> (len(sextets) * 6 - 8 * n)).to_bytes(n, "big") if n else b""


def base64_bytes(text: str, alphabet: str = STANDARD) -> bytes | None:
    """Bytes of base64 text. With the standard alphabet = ends it and others are skipped; with an own one
    (64 or 65 characters) = is data if the alphabet holds it among the first 64."""
    if len(alphabet) not in (64, 65):
        return None
    place = {c: i for i, c in enumerate(alphabet[:64])}
    if alphabet == STANDARD:
        text = text.split("=", 1)[0]
    return bits_to_bytes([place[c] for c in text if c in place])


def base64_decode(text: str, alphabet: str = STANDARD) -> str | None:
    raw = base64_bytes(text, alphabet)
    return None if raw is None else raw.decode("latin-1")


def base64_encode(raw: bytes) -> str:
    return base64.b64encode(raw).decode()


def rc4_of_many(data: list[bytes], keys: list[str]) -> list[bytes]:
    """rc4 of each text under its key: one step of all rows at a time, the longest texts first."""
    import numpy as np

    order = sorted((i for i in range(len(data)) if keys[i] and data[i]), key=lambda i: -len(data[i]))
    out = list(data)
    for lo in range(0, len(order), 4096):
        rows = order[lo : lo + 4096]
        n, every = len(rows), np.arange(len(rows))
        state = np.tile(np.arange(256, dtype=np.uint8), (n, 1))
        raw = [np.array([ord(c) % 256 for c in keys[i]], np.int64) for i in rows]
        size = np.array([len(r) for r in raw])
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        flat = np.concatenate(raw)
        j = np.zeros(n, np.int64)
        for i in range(256):
            j = (j + state[:, i] + flat[start + i % size]) % 256
            state[every, j], state[:, i] = state[:, i].copy(), state[every, j].copy()
        lengths = np.array([len(data[i]) for i in rows])
        stream = np.zeros((n, lengths[0]), np.uint8)
        j = np.zeros(n, np.int64)
        for at in range(lengths[0]):
            live = int(np.searchsorted(-lengths, -at, "left"))  # rows longer than this place
            i, own = (at + 1) % 256, every[:live]
            j[:live] = (j[:live] + state[:live, i]) % 256
            a, b = state[:live, i].copy(), state[own, j[:live]].copy()
            state[:live, i], state[own, j[:live]] = b, a
            stream[:live, at] = state[own, (a.astype(np.int64) + b) % 256]
        for r, i in enumerate(rows):
            out[i] = (np.frombuffer(data[i], np.uint8) ^ stream[r, : lengths[r]]).tobytes()
    return out


def rc4(data: list[int], key: str) -> list[int]:
    k = [ord(c) % 256 for c in key]
    if not k:
        return list(data)
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + k[i % len(k)]) % 256
        s[i], s[j] = s[j], s[i]
    out, i, j = [], 0, 0
    for b in data:
        i = (i + 1) % 256
        j = (j + s[i]) % 256
        s[i], s[j] = s[j], s[i]
        out.append(b ^ s[(s[i] + s[j]) % 256])
    return out


def rc4_text(data: list[int], key: str) -> str:
    raw = bytes(rc4(data, key))
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def base64_rc4_decode(text: str, key: str) -> str | None:
    try:
        inner = base64_bytes(text, LOWER_FIRST).decode("utf-8")
    except UnicodeDecodeError:
        return None
    return rc4_text([ord(c) % 256 for c in inner], key)


# -- built-in calls ---------------------------------------------------------------------------------------------------


def round_away(x: float) -> float:
    return math.copysign(math.floor(abs(x) + 0.5), x) if abs(x) < 2**52 else x


def _math(name: str, a: list[float]) -> float | None:
    one = {"ceil": math.ceil, "floor": math.floor, "trunc": math.trunc, "abs": abs, "round": round_away}
    if name in one and len(a) == 1:
        return float(one[name](a[0])) if math.isfinite(a[0]) else a[0]
    if name == "sign" and len(a) == 1:
        return a[0] if a[0] == 0 or a[0] != a[0] else math.copysign(1.0, a[0])
    if name in ("sqrt", "log", "log2", "log10") and len(a) == 1:
        ok = a[0] >= 0 if name == "sqrt" else a[0] > 0
        return float(getattr(math, name)(a[0])) if ok else None
    if name in ("min", "max") and a:
        return min(a) if name == "min" else max(a)
    return power(a[0], a[1]) if name == "pow" and len(a) == 2 else None


def from_char_code(codes: list) -> object:
    out = []
    for c in codes:
        if not isinstance(c, float) or isinstance(c, bool):
            return NOTHING
        n = uint32(c)
        if n > 0x10FFFF or 0xD800 <= n < 0xE000:
            return NOTHING
        out.append(chr(n))
    return "".join(out)


def call_builtin(name: str, a: list) -> object:
    """A global function or Math, Number and String method on literal values; NOTHING if it isn't folded."""
    is_number = lambda v: isinstance(v, float)
    or_nothing = lambda v: NOTHING if v is None or isinstance(v, float) and not math.isfinite(v) else v
    if name == "String.fromCharCode":
        return from_char_code(a)
    if name.startswith("Math."):
        return or_nothing(_math(name[5:], a)) if all(map(is_number, a)) else NOTHING
    if name in ("parseInt", "Number.parseInt") and a:
        if is_number(a[0]):
            return float(math.trunc(a[0])) if len(a) == 1 and math.isfinite(a[0]) and abs(a[0]) < 2**63 else NOTHING
        if isinstance(a[0], str) and len(a) <= 2:
            if len(a) == 2 and not is_number(a[1]):
                return NOTHING
            return or_nothing(parse_int(a[0], a[1] if len(a) == 2 else 10.0))
        return NOTHING
    if len(a) != 1:
        return NOTHING
    v = a[0]
    if name in ("parseFloat", "Number.parseFloat"):
        return v if is_number(v) else or_nothing(parse_decimal(v.strip(BLANKS))) if isinstance(v, str) else NOTHING
    if name == "Number":
        if isinstance(v, str):
            return or_nothing(numeric_text(v))
        return 0.0 if v is None else float(v) if isinstance(v, (bool, float)) else NOTHING
    if name == "Boolean":
        if v is UNDEFINED:
            return NOTHING
        return bool(v) and v == v
    if name == "atob" and isinstance(v, str):
        text = re.sub("[ \t\n\f\r]", "", v).rstrip("=")
        if not all(c in STANDARD for c in text):
            return NOTHING
        return base64_decode(text)
    if name == "btoa" and isinstance(v, str):
        return base64_encode(v.encode()) if all(ord(c) < 256 for c in v) else NOTHING
    return NOTHING


# -- methods of literals ----------------------------------------------------------------------------------------------

REPEAT_COUNT, REPEAT_BYTES = 1000, 100_000


def _range(text: str, a: list[float], swap: bool) -> object:
    raw = units(text)
    n = len(raw) // 2
    ends = []
    for v in a:
        v = 0.0 if v != v else v
        i = int(max(-(2**53), min(2**53, v)))
        ends.append(max(0, min(n, i + n if i < 0 and not swap else i)))
    lo, hi = ends[0], ends[1] if len(ends) > 1 else n
    if swap and lo > hi:
        lo, hi = hi, lo
    out = from_units(raw[2 * lo : 2 * max(lo, hi)])
    return NOTHING if out is None else out


def call_method(text: str, name: str, a: list) -> object:
    """A string's method on literal arguments; NOTHING if it isn't folded."""
    numbers, texts = all(isinstance(v, float) for v in a), all(isinstance(v, str) for v in a)
    if name in ("charAt", "charCodeAt") and len(a) == 1 and numbers:
        raw = unit_at(text, a[0])
        if raw is None:
            return NOTHING
        if name == "charCodeAt":
            return float(int.from_bytes(raw, "big"))
        one = from_units(raw)
        return NOTHING if one is None else one
    if name in ("indexOf", "lastIndexOf") and len(a) == 1 and texts:  # places in UTF-8
        raw, what = text.encode("utf-8", "surrogatepass"), a[0].encode("utf-8", "surrogatepass")
        return float(raw.find(what) if name == "indexOf" else raw.rfind(what))
    if name in ("includes", "startsWith", "endsWith") and len(a) == 1 and texts:
        return {"includes": a[0] in text, "startsWith": text.startswith(a[0]), "endsWith": text.endswith(a[0])}[name]
    if name in ("slice", "substring") and len(a) in (1, 2) and numbers:
        return _range(text, a, name == "substring")
    if name in ("toLowerCase", "toUpperCase", "trim") and not a:
        return text.lower() if name == "toLowerCase" else text.upper() if name == "toUpperCase" else text.strip(BLANKS)
    if name == "repeat" and len(a) == 1 and numbers:
        n = int(max(0.0, min(a[0], 2.0**53))) if a[0] == a[0] else 0
        return text * n if n <= REPEAT_COUNT and len(text.encode("utf-8", "surrogatepass")) * n <= REPEAT_BYTES else NOTHING
    if name == "replace" and len(a) == 2 and texts:
        return text.replace(a[0], a[1], 1)
    return NOTHING


# -- the pure evaluator -----------------------------------------------------------------------------------------------


def to_number(v) -> float:
    if isinstance(v, str):
        n = numeric_text(v)
        return math.nan if n is None else n
    return math.nan if v is UNDEFINED else 0.0 if v is None else float(v)


def is_true(v) -> bool:
    return v is not UNDEFINED and v is not None and v == v and bool(v)


def _global_call(x: Node) -> str | None:
    c = bare(x.callee)
    if c.kind == "Identifier":
        return c.name
    if c.kind == "Member" and bare(c.object).kind == "Identifier":
        return f"{bare(c.object).name}.{c.name}"
    return None


def evaluate(x: Node) -> object:
    """The value of an expression without effects; NOTHING if it has none. Unlike the rewriting folder, it
    doesn't coerce booleans and null in binary operators, and its >>> clamps to unsigned."""
    x = bare(x)
    k = x.kind
    v = literal(x)
    if v is not NOTHING and k != "Identifier":
        return v
    if k == "Identifier":
        return UNDEFINED if x.name == "undefined" else NOTHING
    if k == "Unary":
        if x.op == "!" and bare(x.value).kind in ("Array", "Object"):
            return False
        if x.op == "typeof" and bare(x.value).kind in ("Function", "Arrow"):
            return "function"
        v = evaluate(x.value)
        if v is NOTHING:
            return NOTHING
        if x.op == "!":
            return not is_true(v)
        if x.op in ("-", "+"):
            return -to_number(v) if x.op == "-" else to_number(v)
        if x.op == "typeof":
            return "undefined" if v is UNDEFINED else "object" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, float) else "string"
        if x.op == "void":
            return UNDEFINED
        return float(~int32(v)) if x.op == "~" and isinstance(v, float) else NOTHING
    if k == "Logical" and x.op != "??":
        v = evaluate(x.left)
        if v is NOTHING:
            return NOTHING
        return evaluate(x.right) if is_true(v) == (x.op == "&&") else v
    if k == "Binary":
        a, b = evaluate(x.left), evaluate(x.right)
        if isinstance(a, str) and isinstance(b, str) and x.op == "+":
            return a + b
        if not isinstance(a, float) or not isinstance(b, float):
            return NOTHING
        if x.op in ("|", "&", "^", "<<", ">>"):
            return float(bitwise(x.op, int32(a), int32(b)))
        if x.op == ">>>":
            return float(uint32(a) >> (uint32(b) & 31))
        if x.op in ("<", "<=", ">", ">=", "==", "!=", "===", "!=="):
            return compare(x.op, a, b)
        r = arithmetic(x.op, a, b)
        return NOTHING if r is None else r
    if k == "Call" and (name := _global_call(x)):
        if any(i.kind == "Spread" for i in x.arguments):
            return NOTHING
        a = [evaluate(i) for i in x.arguments]
        if any(v is NOTHING for v in a):
            return NOTHING
        if name in ("parseInt", "Number.parseInt") and a:
            text = a[0] if isinstance(a[0], str) else format_number(a[0]) if isinstance(a[0], float) else None
            radix = a[1] if len(a) > 1 else 10.0
            if text is None or not isinstance(radix, float):
                return NOTHING
            r = parse_int(text, radix, True)
            return NOTHING if r is None else r
        if name == "atob" and len(a) == 1 and isinstance(a[0], str):
            return base64_decode(a[0])
        if name == "btoa" and len(a) == 1 and isinstance(a[0], str):
            return base64_encode(a[0].encode("latin-1")) if all(ord(c) < 256 for c in a[0]) else NOTHING
        if name in ("Number", "Boolean") and len(a) == 1:
            return to_number(a[0]) if name == "Number" else is_true(a[0])
        if name in ("parseFloat", "Number.parseFloat", "String.fromCharCode"):
            return call_builtin(name, a)
    return NOTHING
