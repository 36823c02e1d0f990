"""A parser for ECMAScript modules, by recursive descent over a scanner that reads on demand.

The parser asks for the next token, and says for a slash whether a value may start there, so that division
and regular expressions never mix. Parentheses stay in the tree. Cover grammars (arrow parameters and
destructuring targets) are read as expressions and turned into patterns once the arrow or the assignment
is seen.
"""

from __future__ import annotations

import re
import sys

from scriptmill.kernel.tree import Node

sys.setrecursionlimit(max(sys.getrecursionlimit(), 60_000))


class SyntaxFault(ValueError):
    """The text is no program."""


_SKIP = re.compile(r"(?:[ \t\r\n\v\f\u00a0\ufeff\u2028\u2029\u1680\u2000-\u200a\u202f\u205f\u3000]+|//[^\n\r\u2028\u2029]*|/\*.*?\*/|<!--[^\n\r]*)", re.S)
_NAME = re.compile(r"(?:[^\W\d]|[$_]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:\w|[$\u200c\u200d]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*")
_NUMBER = re.compile(r"0[xX][0-9a-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:[0-9][0-9_]*)?\.[0-9][0-9_]*(?:[eE][+-]?[0-9_]+)?|[0-9][0-9_]*(?:n|\.?(?:[eE][+-]?[0-9_]+)?)")
_PUNCTUATOR = re.compile(r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?![0-9])|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@#]")
_REGEX = re.compile(r"/(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*")
_STRING = {"'": re.compile(r"'((?:[^'\\\n\r]|\\.|\\\r\n)*)'", re.S), '"': re.compile(r'"((?:[^"\\\n\r]|\\.|\\\r\n)*)"', re.S)}
_ESCAPE = re.compile(r"\\(u\{[0-9a-fA-F]+\}|u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|[0-7]{1,3}|\r\n|.)", re.S)
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "\n": "", "\r": "", "\r\n": "", "\u2028": "", "\u2029": ""}

RESERVED = frozenset("break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with enum".split())
BINARY = {op: p for p, ops in enumerate(("??", "||", "&&", "|", "^", "&", "== != === !==", "< > <= >= instanceof in", "<< >> >>>", "+ -", "* / %", "**"), 1) for op in ops.split()}
ASSIGNMENTS = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())


def unescape(text: str) -> str:
    if "\\" not in text:
        return text

    def one(m: re.Match) -> str:
        c = m[1]
        if c[0] == "u" and len(c) > 1:
            return chr(int(c[2:-1] if c[1] == "{" else c[1:], 16))
        if c[0] == "x" and len(c) == 3:
            return chr(int(c[1:], 16))
        if c[0] in "01234567":
            return chr(int(c, 8))
        return _PLAIN.get(c, c)

    out = _ESCAPE.sub(one, text)
    # Two escaped halves are one character.
    return re.sub("[\ud800-\udbff][\udc00-\udfff]", lambda m: chr(0x10000 + ((ord(m[0][0]) - 0xD800) << 10) + ord(m[0][1]) - 0xDC00), out)


class Parser:
    def __init__(self, text: str):
        self.text, self.at = text, 0
        self.kind = self.value = ""
        self.start = self.end = 0
        self.new_line = False
        self.allow_in = True
        self.in_function = self.in_async = self.in_generator = False
        self.advance()

    # -- tokens --

    def advance(self) -> None:
        text, at = self.text, self.end
        self.previous_end = at
        self.new_line = False
        while m := _SKIP.match(text, at):
            if any(c in m[0] for c in "\n\r\u2028\u2029"):
                self.new_line = True
            at = m.end()
        self.start = at
        if at >= len(text):
            self.kind, self.value, self.end = "end", "", at
            return
        c = text[at]
        if c in _STRING:
            m = _STRING[c].match(text, at)
            self.kind = "string"
        elif c.isdigit() or c == "." and text[at + 1 : at + 2].isdigit():
            m = _NUMBER.match(text, at)
            self.kind = "number"
        elif c == "`":
            self.kind, self.value, self.end = "template", "`", at + 1
            return
        elif m := _NAME.match(text, at):
            self.kind = "name"
            self.value, self.end = unescape(m[0]), m.end()
            if "\\" not in m[0] and self.value in RESERVED:
                self.kind = "word"
            return
        else:
            m = _PUNCTUATOR.match(text, at)
            self.kind = "mark"
        if not m:
            raise SyntaxFault(f"unexpected character at {at}")
        self.value, self.end = m[0], m.end()
        if self.kind == "number" and (n := _NAME.match(text, self.end)):
            raise SyntaxFault(f"a name follows a number at {n.start()}")

    def save(self) -> tuple:
        return (self.end, self.kind, self.value, self.start, self.new_line, self.previous_end)

    def restore(self, state: tuple) -> None:
        self.end, self.kind, self.value, self.start, self.new_line, self.previous_end = state

    def fail(self, what: str = "unexpected token") -> SyntaxFault:
        return SyntaxFault(f"{what} {self.value!r} at {self.start}")

    def mark(self, value: str) -> bool:
        return self.kind == "mark" and self.value == value

    def word(self, value: str) -> bool:
        return self.kind in ("word", "name") and self.value == value

    def take(self, value: str) -> bool:
        if self.kind in ("mark", "word", "name") and self.value == value:
            self.advance()
            return True
        return False

    def expect(self, value: str) -> None:
        if not self.take(value):
            raise self.fail(f"expected {value!r}, found")

    def semicolon(self) -> None:
        if not self.take(";") and not (self.new_line or self.kind == "end" or self.mark("}")):
            raise self.fail()

    def any_name(self) -> str:
        if self.kind not in ("name", "word"):
            raise self.fail()
        v = self.value
        self.advance()
        return v

    def binding_name(self) -> Node:
        if self.kind != "name" or self.value == "await" or self.in_generator and self.value == "yield":
            raise self.fail()
        n = Node("Identifier", name=self.value, symbol=None)
        self.advance()
        return n

    # -- statements --

    def program(self) -> Node:
        directives, body = self.with_directives(lambda: self.kind == "end")
        return Node("Program", directives=directives, body=body)

    def with_directives(self, done) -> tuple[list[str], list[Node]]:
        directives: list[str] = []
        while self.kind == "string" and not done():
            state, raw = self.save(), self.value
            self.advance()
            if self.mark(";") or self.mark("}") or self.kind == "end" or self.new_line and not (self.kind == "mark" and self.value not in ("{", "!", "~", ";", "++", "--", "#", "@")) and not self.word("in") and not self.word("instanceof") and self.kind != "template":
                self.take(";")
                directives.append(raw[1:-1])
            else:
                self.restore(state)
                break
        body = []
        while not done():
            if self.kind == "end":
                raise self.fail()
            body.append(self.statement())
        return directives, body

    def statements(self) -> list[Node]:
        out = []
        while not self.mark("}"):
            if self.kind == "end":
                raise self.fail()
            out.append(self.statement())
        return out

    def block(self) -> Node:
        self.expect("{")
        body = self.statements()
        self.expect("}")
        return Node("Block", body=body)

    def statement(self) -> Node:
        v = self.value
        if self.kind == "mark":
            if v == "{":
                return self.block()
            if v == ";":
                self.advance()
                return Node("Empty")
            if v == "@":
                raise self.fail()
        elif self.kind == "word":
            m = getattr(self, f"s_{v}", None)
            if m and not (v == "import" and self.text[self.end :].lstrip()[:1] in ("(", ".")):
                return m()
            if v == "with":
                raise self.fail()
        elif self.kind == "name":
            if v == "let" and self.declares():
                return self.variables("let", True)
            if v == "async":
                state = self.save()
                self.advance()
                if self.word("function") and not self.new_line:
                    return self.function("FunctionDeclaration", True)
                self.restore(state)
            state = self.save()
            self.advance()
            if self.mark(":"):
                self.advance()
                return Node("Labeled", label=v, body=self.statement())
            self.restore(state)
        x = self.expression()
        self.semicolon()
        return Node("ExpressionStatement", expression=x)

    def declares(self) -> bool:
        """Whether ``let`` starts a declaration here."""
        state = self.save()
        self.advance()
        yes = self.kind == "name" or self.mark("[") or self.mark("{")
        self.restore(state)
        return yes

    def variables(self, kind: str, end: bool) -> Node:
        self.advance()
        out = []
        while True:
            target = self.binding()
            init = self.assignment() if self.take("=") else None
            out.append(Node("Declarator", target=target, init=init))
            if not self.take(","):
                break
        if end:
            self.semicolon()
        return Node("VariableDeclaration", word=kind, declarations=out)

    def s_var(self) -> Node:
        return self.variables("var", True)

    def s_const(self) -> Node:
        return self.variables("const", True)

    def s_function(self) -> Node:
        return self.function("FunctionDeclaration", False)

    def s_class(self) -> Node:
        return self.class_("ClassDeclaration")

    def s_if(self) -> Node:
        self.advance()
        test = self.in_parentheses()
        then = self.statement()
        return Node("If", test=test, then=then, other=self.statement() if self.take("else") else None)

    def in_parentheses(self) -> Node:
        self.expect("(")
        x = self.expression()
        self.expect(")")
        return x

    def s_while(self) -> Node:
        self.advance()
        return Node("While", test=self.in_parentheses(), body=self.statement())

    def s_do(self) -> Node:
        self.advance()
        body = self.statement()
        self.expect("while")
        test = self.in_parentheses()
        self.take(";")
        return Node("DoWhile", body=body, test=test)

    def s_for(self) -> Node:
        self.advance()
        wait = self.take("await")
        self.expect("(")
        init = None
        old, self.allow_in = self.allow_in, False
        if not self.mark(";"):
            if self.word("var") or self.word("const") or self.word("let") and self.declares():
                init = self.variables(self.value, False)
            else:
                init = self.expression()
        self.allow_in = old
        for kind, word in (("ForIn", "in"), ("ForOf", "of")):
            if self.word(word):
                self.advance()
                left = init if init.kind == "VariableDeclaration" else self.pattern(init)
                right = self.expression() if kind == "ForIn" else self.assignment()
                self.expect(")")
                return Node(kind, left=left, right=right, body=self.statement(), wait=wait)
        self.expect(";")
        test = None if self.mark(";") else self.expression()
        self.expect(";")
        update = None if self.mark(")") else self.expression()
        self.expect(")")
        return Node("For", init=init, test=test, update=update, body=self.statement())

    def jump(self, kind: str) -> Node:
        self.advance()
        label = None
        if self.kind == "name" and not self.new_line:
            label = self.value
            self.advance()
        self.semicolon()
        return Node(kind, label=label)

    def s_break(self) -> Node:
        return self.jump("Break")

    def s_continue(self) -> Node:
        return self.jump("Continue")

    def s_return(self) -> Node:
        self.advance()
        value = None if self.mark(";") or self.mark("}") or self.kind == "end" or self.new_line else self.expression()
        self.semicolon()
        return Node("Return", value=value)

    def s_throw(self) -> Node:
        self.advance()
        if self.new_line:
            raise self.fail()
        value = self.expression()
        self.semicolon()
        return Node("Throw", value=value)

    def s_try(self) -> Node:
        self.advance()
        block, param, handler = self.block(), None, None
        if self.take("catch"):
            if self.take("("):
                param = self.binding()
                self.expect(")")
            handler = self.block()
        finalizer = self.block() if self.take("finally") else None
        if not handler and not finalizer:
            raise self.fail()
        return Node("Try", block=block, param=param, handler=handler, finalizer=finalizer)

    def s_switch(self) -> Node:
        self.advance()
        subject = self.in_parentheses()
        self.expect("{")
        cases = []
        while not self.take("}"):
            test = None
            if self.take("case"):
                test = self.expression()
            else:
                self.expect("default")
            self.expect(":")
            body = []
            while not (self.mark("}") or self.word("case") or self.word("default")):
                body.append(self.statement())
            cases.append(Node("Case", test=test, body=body))
        return Node("Switch", subject=subject, cases=cases)

    def s_debugger(self) -> Node:
        self.advance()
        self.semicolon()
        return Node("Debugger")

    def module_name(self) -> str:
        if self.kind in ("name", "word"):
            return self.any_name()
        if self.kind != "string":
            raise self.fail()
        v = self.value
        self.advance()
        return v

    def name_list(self) -> list[tuple[str, str]]:
        self.expect("{")
        out = []
        while not self.take("}"):
            a = self.module_name()
            out.append((a, self.module_name() if self.take("as") else a))
            if not self.take(",") and not self.mark("}"):
                raise self.fail()
        return out

    def source(self) -> str:
        if self.kind != "string":
            raise self.fail()
        v = unescape(self.value[1:-1])
        self.advance()
        return v

    def s_import(self) -> Node:
        self.advance()
        default = star = names = None
        if self.kind == "string":
            out = Node("Import", default=None, star=None, names=None, source=self.source(), locals=[])
            self.semicolon()
            return out
        if self.kind == "name":
            default = self.any_name()
            self.take(",")
        if self.take("*"):
            self.expect("as")
            star = self.any_name()
        elif self.mark("{"):
            names = self.name_list()
        self.expect("from")
        source = self.source()
        self.semicolon()
        own = [n for n in (default, star, *(b for _, b in names or [])) if n]
        return Node("Import", default=default, star=star, names=names, source=source, locals=own)

    def s_export(self) -> Node:
        self.advance()
        if self.take("default"):
            if self.word("function"):
                d = self.function("FunctionDeclaration", False, named=False)
            elif self.word("class"):
                d = self.class_("ClassDeclaration", named=False)
            else:
                d = self.assignment()
                self.semicolon()
            return Node("ExportDefault", declaration=d)
        if self.take("*"):
            name = self.module_name() if self.take("as") else None
            self.expect("from")
            out = Node("ExportAll", name=name, source=self.source())
            self.semicolon()
            return out
        if self.mark("{"):
            names = self.name_list()
            source = self.source() if self.take("from") else None
            self.semicolon()
            return Node("ExportList", names=names, source=source)
        return Node("Export", declaration=self.statement())

    # -- functions and classes --

    def function(self, kind: str, is_async: bool, named: bool = True) -> Node:
        self.expect("function")
        star = self.take("*")
        name = None
        if self.kind == "name":
            name = Node("Identifier", name=self.value, symbol=None)
            self.advance()
        elif kind == "FunctionDeclaration" and named:
            raise self.fail()
        return self.rest_of_function(kind, name, is_async, star)

    def rest_of_function(self, kind: str, name: Node | None, is_async: bool, star: bool) -> Node:
        old = self.in_function, self.in_async, self.in_generator, self.allow_in
        self.in_function, self.in_async, self.in_generator, self.allow_in = True, is_async, star, True
        params = self.parameters()
        body = self.body()
        self.in_function, self.in_async, self.in_generator, self.allow_in = old
        return Node(kind, name=name, params=params, body=body, is_async=is_async, star=star)

    def parameters(self) -> list[Node]:
        self.expect("(")
        out = []
        while not self.take(")"):
            if self.take("..."):
                out.append(Node("Rest", target=self.binding()))
            else:
                t = self.binding()
                out.append(Node("Default", target=t, value=self.assignment()) if self.take("=") else t)
            if not self.take(",") and not self.mark(")"):
                raise self.fail()
        return out

    def body(self) -> Node:
        self.expect("{")
        directives, body = self.with_directives(lambda: self.mark("}"))
        self.expect("}")
        return Node("Body", directives=directives, body=body)

    def class_(self, kind: str, named: bool = True) -> Node:
        self.expect("class")
        name = None
        if self.kind == "name":
            name = self.binding_name()
        base = self.unary_or_call() if self.take("extends") else None
        self.expect("{")
        members = []
        while not self.take("}"):
            if self.take(";"):
                continue
            members.append(self.class_member())
        return Node(kind, name=name, base=base, members=members)

    def class_member(self) -> Node:
        static = False
        if self.word("static"):
            state = self.save()
            self.advance()
            if self.mark("(") or self.mark("=") or self.mark(";") or self.mark("}"):
                self.restore(state)
            else:
                static = True
                if self.mark("{"):
                    return Node("StaticBlock", body=self.block().body)
        kind, is_async, star, key, computed = self.member_head()
        if kind != "method" and not self.mark("("):
            raise self.fail()
        if self.mark("("):
            value = self.rest_of_function("Function", None, is_async, star)
            return Node("ClassMember", key=key, value=value, computed=computed, static=static, role=kind)
        value = self.assignment() if self.take("=") else None
        self.semicolon()
        return Node("ClassMember", key=key, value=value, computed=computed, static=static, role="field")

    def member_head(self) -> tuple[str, bool, bool, Node, bool]:
        """Role (method, get or set), async, generator, key, computed."""
        kind, is_async, star = "method", False, False
        for word in ("async", "get", "set"):
            if self.word(word):
                state = self.save()
                self.advance()
                if any(self.mark(m) for m in "(,=;}:") or self.kind == "end" or word == "async" and self.new_line:
                    self.restore(state)
                elif word == "async":
                    is_async = True
                else:
                    kind = word
                break
        if self.take("*"):
            star = True
        key, computed = self.key()
        return kind, is_async, star, key, computed

    def key(self) -> tuple[Node, bool]:
        if self.take("["):
            x = self.with_in(self.assignment)
            self.expect("]")
            return x, True
        if self.kind == "string":
            n = Node("String", value=unescape(self.value[1:-1]))
        elif self.kind == "number":
            return self.number(), False
        elif self.mark("#"):
            self.advance()
            return Node("PrivateName", name=self.any_name()), False
        elif self.kind in ("name", "word"):
            n = Node("KeyName", name=self.value)
        else:
            raise self.fail()
        self.advance()
        return n, False

    # -- patterns --

    def binding(self) -> Node:
        if self.take("["):
            items: list[Node | None] = []
            while not self.take("]"):
                if self.take(","):
                    items.append(None)
                    continue
                if self.take("..."):
                    items.append(Node("Rest", target=self.binding()))
                else:
                    t = self.binding()
                    items.append(Node("Default", target=t, value=self.with_in(self.assignment)) if self.take("=") else t)
                if not self.mark("]"):
                    self.expect(",")
            return Node("ArrayPattern", items=items)
        if self.take("{"):
            members = []
            while not self.take("}"):
                if self.take("..."):
                    members.append(Node("Rest", target=self.binding()))
                else:
                    word = self.kind == "name"
                    key, computed = self.key()
                    short = False
                    if self.take(":"):
                        t = self.binding()
                    elif word and key.kind == "KeyName":
                        short, t = True, Node("Identifier", name=key.name, symbol=None)
                    else:
                        raise self.fail()
                    if self.take("="):
                        t = Node("Default", target=t, value=self.with_in(self.assignment))
                    members.append(Node("Property", key=key, value=t, computed=computed, short=short, role="init"))
                if not self.mark("}"):
                    self.expect(",")
            return Node("ObjectPattern", members=members)
        return self.binding_name()

    def pattern(self, x: Node, binds: bool = False) -> Node:
        """An expression read as an assignment target."""
        k = x.kind
        if k == "Paren" and not binds:
            inner = x.value
            if inner.kind in ("Identifier", "Member", "Index", "Paren"):
                return self.pattern(inner)
        if k == "Identifier" or k in ("Member", "Index") and not binds and not x.optional or k in ("ArrayPattern", "ObjectPattern", "Default", "Rest"):
            return x
        if k == "Assignment" and x.op == "=":
            return Node("Default", target=self.pattern(x.target, binds), value=x.value)
        if k == "Array":
            return Node("ArrayPattern", items=[None if i is None else self.pattern(i, binds) for i in x.items])
        if k == "Spread":
            return Node("Rest", target=self.pattern(x.value, binds))
        if k == "Object":
            out = []
            for m in x.members:
                if m.kind == "Spread":
                    out.append(Node("Rest", target=self.pattern(m.value, binds)))
                elif m.role == "init":
                    out.append(Node("Property", key=m.key, value=self.pattern(m.value, binds), computed=m.computed, short=m.short, role="init"))
                else:
                    raise self.fail("no target before")
            return Node("ObjectPattern", members=out)
        raise self.fail("no target before")

    # -- expressions --

    def with_in(self, f):
        old, self.allow_in = self.allow_in, True
        try:
            return f()
        finally:
            self.allow_in = old

    def expression(self) -> Node:
        x = self.assignment()
        if not self.mark(","):
            return x
        items = [x]
        while self.take(","):
            items.append(self.assignment())
        return Node("Sequence", items=items)

    def assignment(self) -> Node:
        if self.kind == "name" or self.mark("("):
            if self.value == "yield" and self.in_generator:
                return self.yield_()
            if (arrow := self.try_arrow()) is not None:
                return arrow
        elif self.word("yield") and self.in_generator:
            return self.yield_()
        left = self.conditional()
        if self.kind == "mark" and self.value in ASSIGNMENTS:
            op = self.value
            if op == "=":
                target = self.pattern(left)
            else:
                target = left
                while target.kind == "Paren":
                    target = target.value
                if target.kind not in ("Identifier", "Member", "Index"):
                    raise self.fail("no target before")
            self.advance()
            return Node("Assignment", op=op, target=target, value=self.assignment())
        return left

    def yield_(self) -> Node:
        self.advance()
        star = not self.new_line and self.take("*")
        value = None
        if star or not (self.new_line or self.kind == "end" or any(self.mark(m) for m in ")]},;:")):
            value = self.assignment()
        return Node("Yield", star=star, value=value)

    def try_arrow(self) -> Node | None:
        state = self.save()
        is_async = False
        if self.word("async"):
            self.advance()
            if not self.new_line and (self.kind == "name" or self.mark("(")):
                is_async = True
            else:
                self.restore(state)
        if self.kind == "name":
            name = self.value
            self.advance()
            if self.mark("=>") and not self.new_line:
                return self.arrow([Node("Identifier", name=name, symbol=None)], is_async)
            self.restore(state)
            return None
        if self.mark("(") and self.arrow_follows():
            try:
                params = self.with_in(self.parameters)
            except SyntaxFault:
                self.restore(state)
                return None
            if self.mark("=>") and not self.new_line:
                return self.arrow(params, is_async)
        self.restore(state)
        return None

    def arrow_follows(self) -> bool:
        """Whether the parenthesis here is closed before an arrow."""
        text, at, depth = self.text, self.start, 0
        while at < len(text):
            c = text[at]
            if m := _SKIP.match(text, at):
                at = m.end()
                continue
            if c in _STRING and (m := _STRING[c].match(text, at)):
                at = m.end()
                continue
            if c == "`":
                at = self.skip_template(at)
                continue
            if c == "/" and (m := _REGEX.match(text, at)) and text[:at].rstrip()[-1:] in "(,=:[!&|?{};+-*%~^<>":
                at = m.end()
                continue
            if c in "([{":
                depth += 1
            elif c in ")]}":
                depth -= 1
                if not depth:
                    at += 1
                    while m := _SKIP.match(text, at):
                        at = m.end()
                    return text.startswith("=>", at)
            at += 1
        return False

    def skip_template(self, at: int) -> int:
        text = self.text
        at += 1
        while at < len(text) and text[at] != "`":
            if text[at] == "\\":
                at += 1
            elif text.startswith("${", at):
                depth = 0
                while at < len(text):
                    if text[at] == "{":
                        depth += 1
                    elif text[at] == "}":
                        depth -= 1
                        if not depth:
                            break
                    elif text[at] == "`":
                        at = self.skip_template(at) - 1
                    at += 1
            at += 1
        return at + 1

    def arrow(self, params: list[Node], is_async: bool) -> Node:
        self.expect("=>")
        old = self.in_function, self.in_async, self.in_generator
        self.in_function, self.in_async, self.in_generator = True, is_async, False
        if self.mark("{"):
            body = self.with_in(self.body)
        else:
            body = self.assignment()
        self.in_function, self.in_async, self.in_generator = old
        return Node("Arrow", params=params, body=body, is_async=is_async)

    def conditional(self) -> Node:
        test = self.binary(0)
        if not self.take("?"):
            return test
        then = self.with_in(self.assignment)
        self.expect(":")
        return Node("Conditional", test=test, then=then, other=self.assignment())

    def binary(self, least: int) -> Node:
        if self.mark("#"):
            self.advance()
            left = Node("PrivateName", name=self.any_name())
        else:
            left = self.unary()
        while True:
            op = self.value
            p = BINARY.get(op, 0) if self.kind in ("mark", "word") else 0
            if p <= least or op == "in" and not self.allow_in:
                return left
            if op == "**" and left.kind in ("Unary", "Await"):
                raise self.fail()
            self.advance()
            right = self.binary(p - 1 if op == "**" else p)
            left = Node("Logical" if op in ("&&", "||", "??") else "Binary", op=op, left=left, right=right)

    def unary(self) -> Node:
        v = self.value
        if self.kind == "mark" and v in ("!", "~", "+", "-") or self.kind == "word" and v in ("typeof", "void", "delete"):
            self.advance()
            return Node("Unary", op=v, value=self.unary())
        if self.kind == "mark" and v in ("++", "--"):
            self.advance()
            return Node("Update", op=v, prefix=True, target=self.pattern(self.unary()))
        if v == "await" and self.kind == "name" and (self.in_async or not self.in_function):
            self.advance()
            return Node("Await", value=self.unary())
        x = self.unary_or_call()
        if self.kind == "mark" and self.value in ("++", "--") and not self.new_line:
            x = Node("Update", op=self.value, prefix=False, target=self.pattern(x))
            self.advance()
        return x

    def arguments(self) -> list[Node]:
        self.expect("(")
        out = []
        while not self.take(")"):
            if self.take("..."):
                out.append(Node("Spread", value=self.with_in(self.assignment)))
            else:
                out.append(self.with_in(self.assignment))
            if not self.take(",") and not self.mark(")"):
                raise self.fail()
        return out

    def unary_or_call(self) -> Node:
        x = self.new() if self.word("new") else self.primary()
        return self.suffixes(x, True)

    def new(self) -> Node:
        self.advance()
        if self.take("."):
            return Node("Meta", text=f"new.{self.any_name()}")
        callee = self.new() if self.word("new") else self.primary()
        callee = self.suffixes(callee, False)
        return Node("New", callee=callee, arguments=self.arguments() if self.mark("(") else [])

    def suffixes(self, x: Node, calls: bool) -> Node:
        while True:
            if self.mark("."):
                self.advance()
                x = self.member(x, False)
            elif self.mark("?.") and calls:
                self.advance()
                if self.mark("("):
                    x = Node("Call", callee=x, arguments=self.arguments(), optional=True)
                elif self.take("["):
                    i = self.with_in(self.expression)
                    self.expect("]")
                    x = Node("Index", object=x, index=i, optional=True)
                else:
                    x = self.member(x, True)
            elif self.mark("["):
                self.advance()
                i = self.with_in(self.expression)
                self.expect("]")
                x = Node("Index", object=x, index=i, optional=False)
            elif self.mark("(") and calls:
                x = Node("Call", callee=x, arguments=self.arguments(), optional=False)
            elif self.kind == "template":
                x = Node("Tagged", tag=x, template=self.template())
            else:
                return x

    def member(self, x: Node, optional: bool) -> Node:
        private = self.take("#")
        return Node("Member", object=x, name=("#" if private else "") + self.any_name(), optional=optional)

    def number(self) -> Node:
        raw = self.value
        self.advance()
        text = raw.replace("_", "").lower()
        if text.endswith("n") and not text.startswith("0x") or text.startswith("0x") and text.endswith("n"):
            return Node("BigInt", raw=raw)
        if text[:2] in ("0x", "0o", "0b"):
            value = float(int(text, 0))
        elif len(text) > 1 and text[0] == "0" and text.isdigit():
            raise SyntaxFault("an octal number in a module")
        else:
            value = float(text)
        return Node("Number", value=value, raw=raw)

    def template(self) -> Node:
        text, at = self.text, self.end
        parts, values = [], []
        begin = at
        while True:
            if at >= len(text):
                raise SyntaxFault("a template without end")
            c = text[at]
            if c == "\\":
                at += 2
            elif c == "`":
                parts.append(text[begin:at])
                self.end = at + 1
                self.advance()
                return Node("Template", parts=parts, values=values)
            elif c == "$" and text.startswith("${", at):
                parts.append(text[begin:at])
                self.end = at + 2
                self.advance()
                values.append(self.with_in(self.expression))
                if not self.mark("}"):
                    raise self.fail()
                at = begin = self.end
            else:
                at += 1

    def primary(self) -> Node:
        k, v = self.kind, self.value
        if k == "number":
            return self.number()
        if k == "string":
            self.advance()
            return Node("String", value=unescape(v[1:-1]))
        if k == "template":
            return self.template()
        if k == "name":
            if v == "async":
                state = self.save()
                self.advance()
                if self.word("function") and not self.new_line:
                    return self.function("Function", True)
                self.restore(state)
            self.advance()
            return Node("Identifier", name=v, symbol=None)
        if k == "mark":
            if v == "(":
                self.advance()
                x = self.with_in(self.expression)
                self.expect(")")
                return Node("Paren", value=x)
            if v == "[":
                return self.array()
            if v == "{":
                return self.object()
            if v in ("/", "/="):
                m = _REGEX.match(self.text, self.start)
                if not m:
                    raise self.fail()
                self.end = m.end()
                self.advance()
                return Node("Regex", raw=m[0])
            raise self.fail()
        if k == "word":
            if v == "function":
                return self.function("Function", False)
            if v == "class":
                return self.class_("Class")
            if v in ("this", "super", "null", "true", "false"):
                self.advance()
                return Node("Boolean", value=v == "true") if v in ("true", "false") else Node({"this": "This", "super": "Super", "null": "Null"}[v])
            if v == "import":
                self.advance()
                if self.take("."):
                    return Node("Meta", text=f"import.{self.any_name()}")
                return Node("ImportCall", arguments=self.arguments())
        raise self.fail()

    def array(self) -> Node:
        self.advance()
        items: list[Node | None] = []
        while not self.take("]"):
            if self.take(","):
                items.append(None)
                continue
            if self.take("..."):
                items.append(Node("Spread", value=self.with_in(self.assignment)))
            else:
                items.append(self.with_in(self.assignment))
            if not self.mark("]"):
                self.expect(",")
        return Node("Array", items=items)

    def object(self) -> Node:
        self.advance()
        members = []
        while not self.take("}"):
            if self.take("..."):
                members.append(Node("Spread", value=self.with_in(self.assignment)))
            else:
                members.append(self.property())
            if not self.mark("}"):
                self.expect(",")
        return Node("Object", members=members)

    def property(self) -> Node:
        plain = self.kind == "name"
        role, is_async, star, key, computed = self.member_head()
        if self.mark("("):
            return Node("Property", key=key, value=self.rest_of_function("Function", None, is_async, star), computed=computed, short=False, role=role)
        if self.take(":"):
            return Node("Property", key=key, value=self.with_in(self.assignment), computed=computed, short=False, role="init")
        if not plain or key.kind != "KeyName" or computed:
            raise self.fail()
        value = Node("Identifier", name=key.name, symbol=None)
        if self.mark("="):  # only if this turns out to be a target
            self.advance()
            value = Node("Default", target=value, value=self.with_in(self.assignment))
        return Node("Property", key=key, value=value, computed=False, short=True, role="init")


def parse(text: str) -> Node:
    """The program's tree, or a SyntaxFault."""
    try:
        return Parser(text).program()
    except RecursionError as e:
        raise SyntaxFault("nested too deeply") from e
