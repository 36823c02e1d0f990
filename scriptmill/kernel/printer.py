"""Trees back to text: four spaces of indent, double quotes, parentheses only where precedence needs them."""

from __future__ import annotations

import math

from scriptmill.kernel.parser import BINARY
from scriptmill.kernel.tree import Node, format_number

#: Binding strength. A child that binds less than its place needs gets parentheses.
SEQUENCE, ASSIGN, CONDITIONAL, OPERATOR, UNARY, POSTFIX, CALL, PRIMARY = 0, 2, 4, 5, 40, 42, 44, 50


def strength(x: Node) -> int:
    k = x.kind
    if k == "Sequence":
        return SEQUENCE
    if k in ("Assignment", "Arrow", "Yield"):
        return ASSIGN
    if k == "Conditional":
        return CONDITIONAL
    if k in ("Binary", "Logical"):
        return OPERATOR + 2 * BINARY[x.op]
    if k in ("Unary", "Await"):
        return UNARY
    if k == "Update":
        return UNARY if x.prefix else POSTFIX
    if k == "Number" and (x.value < 0 or math.copysign(1, x.value) < 0):
        return UNARY
    if k in ("Call", "Member", "Index", "New", "Tagged", "ImportCall"):
        return CALL
    return PRIMARY


def quote(text: str) -> str:
    out = ['"']
    for c in text:
        n = ord(c)
        if c in '"\\':
            out.append("\\" + c)
        elif c in "\n\r\t\b\f\v":
            out.append({"\n": "\\n", "\r": "\\r", "\t": "\t", "\b": "\\b", "\f": "\\f", "\v": "\\v"}[c])
        elif n == 0:
            out.append("\\0")
        elif n < 32 or n == 127 or n in (0x2028, 0x2029, 0xFEFF):
            out.append(f"\\x{n:02x}" if n < 256 else f"\\u{n:04x}")
        elif 0xD800 <= n < 0xE000:
            out.append(f"\\u{n:04x}")
        else:
            out.append(c)
    return "".join(out) + '"'


def _inner(x: Node) -> Node:
    while x.kind == "Paren":
        x = x.value
    return x


class Printer:
    def __init__(self, indent: str = "    "):
        self.indent = indent
        self.level = 0
        self.first: Node | None = None  # what a statement must not begin with as it is

    def pad(self) -> str:
        return self.indent * self.level

    # -- statements --

    def program(self, p: Node) -> str:
        return "".join(f'"{d}";\n' for d in p.directives) + "".join(f"{self.statement(s)}\n" for s in p.body)

    def lines(self, body: list[Node], directives: list[str] = ()) -> str:
        if not body and not directives:
            return "{}"
        self.level += 1
        inside = "".join(f'{self.pad()}"{d}";\n' for d in directives) + "".join(f"{self.pad()}{self.statement(s)}\n" for s in body)
        self.level -= 1
        return f"{{\n{inside}{self.pad()}}}"

    def statement(self, s: Node) -> str:
        return getattr(self, f"s_{s.kind}")(s)

    def nested(self, s: Node) -> str:
        """A body after a head: a block on the same line, else an indented statement."""
        if s.kind == "Block":
            return " " + self.lines(s.body)
        if s.kind == "Empty":
            return ";"
        self.level += 1
        text = f"\n{self.pad()}{self.statement(s)}"
        self.level -= 1
        return text

    def s_ExpressionStatement(self, s: Node) -> str:
        x = _inner(s.expression)
        while x.kind in ("Call", "Member", "Index", "Binary", "Logical", "Conditional", "Assignment", "Sequence", "Tagged", "Update"):
            if x.kind == "Update" and x.prefix:
                break
            first = {"Call": "callee", "Member": "object", "Index": "object", "Conditional": "test", "Assignment": "target", "Tagged": "tag", "Update": "target"}.get(x.kind, "left")
            x = _inner(x.items[0] if x.kind == "Sequence" else getattr(x, first))
        self.first = x if x.kind in ("Object", "Function", "Class") else None
        text = self.expression(s.expression, SEQUENCE)
        return f"({text});" if x.kind == "ObjectPattern" else f"{text};"

    def s_VariableDeclaration(self, s: Node) -> str:
        return self.variables(s) + ";"

    def variables(self, s: Node, no_in: bool = False) -> str:
        return f"{s.word} " + ", ".join(self.target(d.target) + (f" = {self.expression(d.init, ASSIGN)}" if d.init else "") for d in s.declarations)

    def s_FunctionDeclaration(self, s: Node) -> str:
        return self.function(s)

    def s_ClassDeclaration(self, s: Node) -> str:
        return self.class_(s)

    def s_Return(self, s: Node) -> str:
        return f"return {self.expression(s.value, SEQUENCE)};" if s.value else "return;"

    def s_Throw(self, s: Node) -> str:
        return f"throw {self.expression(s.value, SEQUENCE)};"

    def s_If(self, s: Node) -> str:
        text = f"if ({self.expression(s.test, SEQUENCE)})" + self.nested(s.then)
        if s.other is not None:
            text += " else" if s.then.kind == "Block" else f"\n{self.pad()}else"
            text += f" {self.statement(s.other)}" if s.other.kind == "If" else self.nested(s.other)
        return text

    def s_For(self, s: Node) -> str:
        init = "" if s.init is None else self.variables(s.init) if s.init.kind == "VariableDeclaration" else self.expression(s.init, SEQUENCE)
        part = lambda x: f" {self.expression(x, SEQUENCE)}" if x else ""
        return f"for ({init};{part(s.test)};{part(s.update)})" + self.nested(s.body)

    def each(self, s: Node, word: str) -> str:
        left = self.variables(s.left) if s.left.kind == "VariableDeclaration" else self.target(s.left)
        return f"for {'await ' * bool(s.wait)}({left} {word} {self.expression(s.right, ASSIGN if word == 'of' else SEQUENCE)})" + self.nested(s.body)

    def s_ForIn(self, s: Node) -> str:
        return self.each(s, "in")

    def s_ForOf(self, s: Node) -> str:
        return self.each(s, "of")

    def s_While(self, s: Node) -> str:
        return f"while ({self.expression(s.test, SEQUENCE)})" + self.nested(s.body)

    def s_DoWhile(self, s: Node) -> str:
        body = self.nested(s.body)
        return f"do{body}{' ' if s.body.kind == 'Block' else chr(10) + self.pad()}while ({self.expression(s.test, SEQUENCE)});"

    def s_Break(self, s: Node) -> str:
        return f"break {s.label};" if s.label else "break;"

    def s_Continue(self, s: Node) -> str:
        return f"continue {s.label};" if s.label else "continue;"

    def s_Try(self, s: Node) -> str:
        text = f"try {self.lines(s.block.body)}"
        if s.handler is not None:
            text += f" catch {f'({self.target(s.param)}) ' if s.param else ''}{self.lines(s.handler.body)}"
        return text + (f" finally {self.lines(s.finalizer.body)}" if s.finalizer is not None else "")

    def s_Switch(self, s: Node) -> str:
        self.level += 1
        cases = ""
        for c in s.cases:
            cases += self.pad() + (f"case {self.expression(c.test, SEQUENCE)}:" if c.test else "default:")
            if len(c.body) == 1:
                cases += f" {self.statement(c.body[0])}\n"
                continue
            self.level += 1
            cases += "\n" + "".join(f"{self.pad()}{self.statement(b)}\n" for b in c.body)
            self.level -= 1
        self.level -= 1
        return f"switch ({self.expression(s.subject, SEQUENCE)}) {{\n{cases}{self.pad()}}}" if s.cases else f"switch ({self.expression(s.subject, SEQUENCE)}) {{}}"

    def s_Labeled(self, s: Node) -> str:
        return f"{s.label}: {self.statement(s.body)}"

    def s_Block(self, s: Node) -> str:
        return self.lines(s.body)

    def s_Empty(self, s: Node) -> str:
        return ";"

    def s_Debugger(self, s: Node) -> str:
        return "debugger;"

    def names(self, names: list[tuple[str, str]]) -> str:
        return "{ " + ", ".join(a if a == b else f"{a} as {b}" for a, b in names) + " }" if names else "{}"

    def s_Import(self, s: Node) -> str:
        parts = [x for x in (s.default, f"* as {s.star}" if s.star else None, self.names(s.names) if s.names is not None else None) if x]
        return f"import {', '.join(parts)} from {quote(s.source)};" if parts else f"import {quote(s.source)};"

    def s_Export(self, s: Node) -> str:
        return f"export {self.statement(s.declaration)}"

    def s_ExportDefault(self, s: Node) -> str:
        d = s.declaration
        if d.kind in ("FunctionDeclaration", "ClassDeclaration"):
            return f"export default {self.statement(d)}"
        return f"export default {self.expression(d, ASSIGN)};"

    def s_ExportList(self, s: Node) -> str:
        return f"export {self.names(s.names)}" + (f" from {quote(s.source)};" if s.source is not None else ";")

    def s_ExportAll(self, s: Node) -> str:
        return f"export *{f' as {s.name}' if s.name else ''} from {quote(s.source)};"

    # -- functions, classes, patterns --

    def function(self, f: Node) -> str:
        head = f"{'async ' * f.is_async}function{'*' * f.star}"
        return f"{head}{f' {f.name.name}' if f.name else ''}{self.signature(f)}"

    def signature(self, f: Node) -> str:
        return f"({', '.join(map(self.target, f.params))}) {self.lines(f.body.body, f.body.directives)}"

    def class_(self, c: Node) -> str:
        head = f"class{f' {c.name.name}' if c.name else ''}{f' extends {self.expression(c.base, CALL)}' if c.base else ''}"
        if not c.members:
            return f"{head} {{}}"
        self.level += 1
        inside = "".join(f"{self.pad()}{self.class_member(m)}\n" for m in c.members)
        self.level -= 1
        return f"{head} {{\n{inside}{self.pad()}}}"

    def class_member(self, m: Node) -> str:
        if m.kind == "StaticBlock":
            return f"static {self.lines(m.body)}"
        head = "static " * m.static
        if m.role == "field":
            return head + self.key(m) + (f" = {self.expression(m.value, ASSIGN)}" if m.value else "") + ";"
        return head + self.method(m)

    def method(self, m: Node) -> str:
        f = m.value
        return f"{'async ' * f.is_async}{'*' * f.star}{f'{m.role} ' if m.role in ('get', 'set') else ''}{self.key(m)}{self.signature(f)}"

    def key(self, m: Node) -> str:
        if m.computed:
            return f"[{self.expression(m.key, ASSIGN)}]"
        if m.key.kind == "KeyName":
            return m.key.name
        return f"#{m.key.name}" if m.key.kind == "PrivateName" else self.expression(m.key, PRIMARY)

    def target(self, t: Node) -> str:
        k = t.kind
        if k == "Default":
            return f"{self.target(t.target)} = {self.expression(t.value, ASSIGN)}"
        if k == "Rest":
            return f"...{self.target(t.target)}"
        if k == "ArrayPattern":
            return f"[{', '.join('' if i is None else self.target(i) for i in t.items)}]"
        if k == "ObjectPattern":
            if not t.members:
                return "{}"
            return "{ " + ", ".join(self.target(m) if m.kind == "Rest" else self.target(m.value) if self.is_short(m) else f"{self.key(m)}: {self.target(m.value)}" for m in t.members) + " }"
        return self.expression(t, CALL)

    def is_short(self, m: Node) -> bool:
        v = m.value.target if m.value.kind == "Default" else m.value
        return m.short and v.kind == "Identifier" and v.name == m.key.name

    # -- expressions --

    def expression(self, x: Node, least: int) -> str:
        x = _inner(x)
        held = x is self.first
        text = getattr(self, f"e_{x.kind}")(x)
        return f"({text})" if held or strength(x) < least else text

    def e_Identifier(self, x: Node) -> str:
        return x.name

    def e_PrivateName(self, x: Node) -> str:
        return f"#{x.name}"

    def e_Number(self, x: Node) -> str:
        v = x.value
        if v != v:
            return "NaN"
        if math.isinf(v):
            return "Infinity" if v > 0 else "-Infinity"
        if abs(v) >= 1e21 or 0 < abs(v) < 1e-6:
            m, _, e = repr(v).partition("e")
            return f"{m.removesuffix('.0')}e{int(e)}" if e else format_number(v)
        return format_number(v)

    def e_String(self, x: Node) -> str:
        return quote(x.value)

    def e_Boolean(self, x: Node) -> str:
        return "true" if x.value else "false"

    def e_Null(self, x: Node) -> str:
        return "null"

    def e_This(self, x: Node) -> str:
        return "this"

    def e_Super(self, x: Node) -> str:
        return "super"

    def e_Meta(self, x: Node) -> str:
        return x.text

    def e_BigInt(self, x: Node) -> str:
        return x.raw

    e_Regex = e_BigInt

    def e_Template(self, x: Node) -> str:
        return "`" + "".join(p + (f"${{{self.expression(x.values[i], SEQUENCE)}}}" if i < len(x.values) else "") for i, p in enumerate(x.parts)) + "`"

    def e_Tagged(self, x: Node) -> str:
        return self.expression(x.tag, CALL) + self.e_Template(x.template)

    def items(self, items: list[Node | None]) -> str:
        return ", ".join("" if i is None else self.e_Spread(i) if i.kind == "Spread" else self.expression(i, ASSIGN) for i in items)

    def e_Spread(self, x: Node) -> str:
        return f"...{self.expression(x.value, ASSIGN)}"

    def e_Array(self, x: Node) -> str:
        return f"[{self.items(x.items)}{',' * bool(x.items and x.items[-1] is None)}]"

    def e_Object(self, x: Node) -> str:
        if not x.members:
            return "{}"
        if len(x.members) == 1:
            return "{ " + self.property(x.members[0]) + " }"
        self.level += 1
        inside = ",\n".join(f"{self.pad()}{self.property(m)}" for m in x.members)
        self.level -= 1
        return f"{{\n{inside}\n{self.pad()}}}"

    def property(self, m: Node) -> str:
        if m.kind == "Spread":
            return self.e_Spread(m)
        if m.role != "init":
            return self.method(m)
        return m.key.name if self.is_short(m) else f"{self.key(m)}: {self.expression(m.value, ASSIGN)}"

    def e_Function(self, x: Node) -> str:
        return self.function(x)

    def e_Class(self, x: Node) -> str:
        return self.class_(x)

    def e_Arrow(self, x: Node) -> str:
        head = f"{'async ' * x.is_async}({', '.join(map(self.target, x.params))}) => "
        if x.body.kind == "Body":
            return head + self.lines(x.body.body, x.body.directives)
        text = self.expression(x.body, ASSIGN)
        return head + (f"({text})" if text.startswith("{") else text)

    def e_Unary(self, x: Node) -> str:
        text = self.expression(x.value, UNARY)
        return f"{x.op}{' ' * (x.op.isalpha() or x.op in '+-' and text[:1] == x.op)}{text}"

    def e_Await(self, x: Node) -> str:
        return f"await {self.expression(x.value, UNARY)}"

    def e_Yield(self, x: Node) -> str:
        return "yield" + "*" * x.star + (f" {self.expression(x.value, ASSIGN)}" if x.value else "")

    def e_Update(self, x: Node) -> str:
        return x.op + self.target(x.target) if x.prefix else self.target(x.target) + x.op

    def e_Binary(self, x: Node) -> str:
        # Left chains may be thousands of operands long: no recursion along them.
        parts, own = [], strength(x)
        while True:
            right_first = x.op == "**"
            left = _inner(x.left)
            least_right = own if right_first else own + 1
            if x.kind == "Logical" and _inner(x.right).kind == "Logical" and (x.op == "??") != (_inner(x.right).op == "??"):
                least_right = UNARY
            parts.append(f" {x.op} {self.expression(x.right, least_right)}")
            if left.kind in ("Binary", "Logical") and strength(left) == own and not right_first:
                x = left
                continue
            least = UNARY + 1 if right_first else own
            if x.kind == "Logical" and left.kind == "Logical" and (x.op == "??") != (left.op == "??"):
                least = UNARY
            parts.append(self.expression(left, least))
            return "".join(reversed(parts))

    e_Logical = e_Binary

    def e_Assignment(self, x: Node) -> str:
        return f"{self.target(x.target)} {x.op} {self.expression(x.value, ASSIGN)}"

    def e_Conditional(self, x: Node) -> str:
        return f"{self.expression(x.test, CONDITIONAL + 1)} ? {self.expression(x.then, ASSIGN)} : {self.expression(x.other, ASSIGN)}"

    def e_Sequence(self, x: Node) -> str:
        return ", ".join(self.expression(i, ASSIGN) for i in x.items)

    def e_Call(self, x: Node) -> str:
        return f"{self.expression(x.callee, CALL)}{'?.' * bool(x.optional)}({self.items(x.arguments)})"

    def e_ImportCall(self, x: Node) -> str:
        return f"import({self.items(x.arguments)})"

    def e_New(self, x: Node) -> str:
        c = _inner(x.callee)
        while c.kind in ("Member", "Index"):
            c = _inner(c.object)
        callee = self.expression(x.callee, CALL)
        return f"new {f'({callee})' if c.kind in ('Call', 'ImportCall') else callee}({self.items(x.arguments)})"

    def e_Member(self, x: Node) -> str:
        text = self.expression(x.object, CALL)
        if _inner(x.object).kind == "Number" and text.isdigit():
            text += "."
        return f"{text}{'?.' if x.optional else '.'}{x.name}"

    def e_Index(self, x: Node) -> str:
        return f"{self.expression(x.object, CALL)}{'?.' * bool(x.optional)}[{self.expression(x.index, SEQUENCE)}]"

    def e_ObjectPattern(self, x: Node) -> str:
        return self.target(x)

    e_ArrayPattern = e_ObjectPattern


def render(program: Node, indent: str = "    ") -> str:
    return Printer(indent).program(program)
