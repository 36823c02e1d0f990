"""The builder: a set of rules with options, run on one text, a column or a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

from scriptmill.kernel.fixpoint import Diagnostics, Rule
from scriptmill.kernel.presets import ALIASES, PRESETS, resolve
from scriptmill.operators import rewrite as op


class Deobfuscator:
    """Rule classes (or functions that give a rule) in order, with options.

    Rules are made anew for each script, so nothing leaks from row to row and results don't depend on how rows
    are dealt out.
    """

    def __init__(self, rules: Iterable[Callable[[], Rule]] | None = None):
        self._rules: list[Callable[[], Rule]] = list(PRESETS["generic"] if rules is None else rules)
        self._presets: tuple[str, ...] = ()
        self._max_iterations: int | None = None
        self._indent = "    "
        self._on_diagnostics: Callable[[Diagnostics], None] | None = None

    @classmethod
    def empty(cls) -> Deobfuscator:
        return cls(())

    @classmethod
    def with_preset(cls, *presets: str) -> Deobfuscator:
        """Presets one after another; an unknown name is a ValueError."""
        names = op.presets_of(presets)
        own = cls([r for p in names for r in PRESETS[p]])
        own._presets = names
        return own

    def add_transformer(self, rule: Callable[[], Rule]) -> Deobfuscator:
        self._rules.append(rule)
        return self

    def add_transformers(self, rules: Iterable[Callable[[], Rule]]) -> Deobfuscator:
        self._rules.extend(rules)
        return self

    def with_max_iterations(self, n: int) -> Deobfuscator:
        """Rounds of main passes to convergence and one finalize pass; 0 only prints anew."""
        self._max_iterations = n
        return self

    def with_indent(self, indent: str) -> Deobfuscator:
        self._indent = indent
        return self

    def with_diagnostics(self, f: Callable[[Diagnostics], None]) -> Deobfuscator:
        """Called on the driver by deobfuscate(); for columns the diagnostics are part of the result."""
        self._on_diagnostics = f
        return self

    def make_rules(self) -> list[Rule]:
        return [r() for r in self._rules]

    def deobfuscate(self, source: str) -> str:
        r = op.run_one(source, self._presets, self._max_iterations, self.make_rules, self._indent)
        if self._on_diagnostics is not None:
            self._on_diagnostics(r.diagnostics)
        return r.code

    def column(self, source):
        rules, presets = list(self._rules), self._presets
        return op.rewritten(source, presets or "generic", self._max_iterations, lambda: [r() for r in rules], self._indent)

    def transform(self, scripts: DataFrame, source: str = "source") -> DataFrame:
        """For a table or a stream: all columns with code, parse_ok, converged and diagnostics."""
        return scripts.withColumn("__r", self.column(source)).select("*", "__r.*").drop("__r")


def deobfuscate(source: str) -> str:
    """With the default rules."""
    return Deobfuscator().deobfuscate(source)


def preset_names() -> list[str]:
    return list(ALIASES)


def preset_from_name(name: str) -> str | None:
    return resolve(name)
