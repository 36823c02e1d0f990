"""Names for the modules of a bundle, and notes at the places that load them."""

from __future__ import annotations

import re

from scriptmill.kernel.fixpoint import FINALIZE, LAST, Rule
from scriptmill.kernel.tree import Node, bare, identifier


def path_name(path: str) -> str:
    """A module's path as an identifier."""
    path = re.sub(r"^(?:\.\./)+", "", path)
    path = path.removeprefix("./").removesuffix(".js")
    name = "".join(c if c.isascii() and (c.isalnum() or c in "_$") else "_" for c in path)
    return f"module_{name}" if not name or name[0].isdigit() else name


def module_names(dependencies: dict[int, list[tuple[str, int]]]) -> dict[int, str]:
    """Each module's name: from the shortest path that leads to it (of equal lengths the first in order), or its number."""
    paths: dict[int, list[str]] = {}
    for own in dependencies.values():
        for path, to in own:
            paths.setdefault(to, []).append(path)
    return {m: path_name(min(paths[m], key=lambda p: (len(p.encode()), p))) if m in paths else f"module_{m}" for m in dependencies}


def _key(m: Node) -> int | None:
    if m.kind != "Property" or m.computed:
        return None
    if m.key.kind == "Number" and m.key.value == int(m.key.value):
        return int(m.key.value)
    return int(m.key.value) if m.key.kind == "String" and re.fullmatch("[0-9]+", m.key.value) else None


def modules_of(s: Node) -> Node | None:
    """The modules' object of !function(a, b, c) {...}({...}, x, y)."""
    x = s.expression if s.kind == "ExpressionStatement" else None
    if x is None or x.kind != "Unary" or x.op != "!" or x.value.kind != "Call" or bare(x.value.callee).kind != "Function" or len(bare(x.value.callee).params) != 3 or len(x.value.arguments) != 3 or x.value.arguments[0].kind != "Object":
        return None
    o = x.value.arguments[0]
    fine = [m for m in o.members if _key(m) is not None and m.value.kind == "Array" and len(m.value.items) == 2 and m.value.items[0] is not None and m.value.items[0].kind in ("Function", "Arrow") and m.value.items[1] is not None and m.value.items[1].kind == "Object"]
    return o if fine else None


def dependencies_of(o: Node) -> dict[int, list[tuple[str, int]]]:
    out = {}
    for m in o.members:
        k = _key(m)
        if k is None or m.value.kind != "Array" or not m.value.items:
            continue
        own = m.value.items[1] if len(m.value.items) > 1 else None
        out[k] = [(p.key.value if p.key.kind == "String" else p.key.name, int(p.value.value)) for p in (own.members if own is not None and own.kind == "Object" else ()) if p.kind == "Property" and p.key.kind in ("String", "KeyName") and p.value.kind == "Number"]
    return out


class BrowserifyAnnotation(Rule):
    name = "BrowserifyAnnotation"
    phase = FINALIZE
    priority = LAST
    interests = ("statements",)

    def enter_statements(self, body: list[Node]) -> bool:
        changed = False
        for s in body:
            o = modules_of(s)
            if o is None:
                continue
            names = module_names(dependencies_of(o))
            for m in o.members:
                k = _key(m)
                f = m.value.items[0] if k is not None and m.value.kind == "Array" and m.value.items else None
                if f is not None and f.kind == "Function" and f.name is None:
                    f.name = identifier(names.get(k, f"module_{k}"))
                    changed = True
        return changed


_HEAD = re.compile(r"function [\w$]+\(([\w$]+)[^)]*\) \{")
_PAIR = re.compile(r'"(\.\.?/[^"]*)": (\d+)|"([^"]*)": \d+')


def annotate_requires(code: str) -> str:
    """Notes with the module's name before what loads a relative path: before ``var`` on its line, else before the call."""
    names = sorted({m[1] for m in _HEAD.finditer(code)}, key=len, reverse=True)
    if not names or not any(m[1] for m in _PAIR.finditer(code)):
        return code
    call = re.compile(rf'(?<![\w$.])(?:{"|".join(map(re.escape, names))})\("(\.\.?/[^"]*)"\)')
    out = []
    for line in code.split("\n"):
        m = call.search(line)
        if m:
            note = f"/** @type {{{path_name(m[1])}}} */ "
            at = line.find("var ")
            at = at if 0 <= at < m.start() else m.start()
            line = line[:at] + note + line[at:]
        out.append(line)
    return "\n".join(out)


