"""Named sets of rules."""

from __future__ import annotations

from scriptmill.kernel.fixpoint import Rule
from scriptmill.kernel.rules import bundles, flow, folding, inlining, shaping, strings

DEFAULT: tuple[type[Rule], ...] = (
    shaping.VariableDeclarationSplit,
    shaping.VarHoisting,
    shaping.GlobalAliasSimplification,
    shaping.DeclarationMerge,
    inlining.ConstantInlining,
    inlining.ProxyFunctionInlining,
    shaping.BlockNormalization,
    folding.BitwiseSimplification,
    folding.ConstantFolding,
    folding.StringConcatenation,
    folding.BuiltinEvaluation,
    folding.LiteralMethodEvaluation,
    shaping.Comma,
    shaping.Member,
    shaping.ControlFlow,
    shaping.FunctionDeclaration,
    shaping.TernaryToIf,
    shaping.LogicalToIf,
    shaping.SequenceStatement,
    inlining.DeadCode,
    inlining.UnusedVariable,
    inlining.VariableRenaming,
)

#: Names and other names of the presets (fixed values).
ALIASES = {
    "generic": ("default",),
    "obfuscator-io": ("obfuscator_io", "javascript-obfuscator"),
    "akamai": ("akamai-bot-manager", "abm"),
    "datadome": ("data-dome", "data_dome"),
    "debundler": ("de-bundler", "unbundler"),
    "jsfuck": (),
}


OBFUSCATOR_IO = (strings.StringArrayRC4Decoder, strings.StringArrayDecoder, strings.StringArrayRotation, flow.ControlFlowArray, flow.ControlFlowFlattening, *DEFAULT)

#: Rules of each preset, in order. Rules of one priority run in this order.
PRESETS: dict[str, tuple[type[Rule], ...]] = {
    "generic": DEFAULT,
    "obfuscator-io": OBFUSCATOR_IO,
    "akamai": (flow.InitializerInlining, flow.SwitchDispatch, *DEFAULT),
    "datadome": (flow.SetTimeoutUnwrap, *OBFUSCATOR_IO),
    "debundler": (bundles.BrowserifyAnnotation,),
    "jsfuck": DEFAULT,
}


def resolve(name: str) -> str | None:
    """The preset of a name or other name, in any case."""
    low = name.lower()
    return next((p for p, others in ALIASES.items() if low == p or low in others), None)


def rules_of(*presets: str) -> list[Rule]:
    """New rule objects of the presets, one after another; rules in several of them come several times."""
    out: list[Rule] = []
    for p in presets:
        name = resolve(p)
        if name is None:
            raise ValueError(f"no preset {p!r}; there are {', '.join(ALIASES)}")
        out += [rule() for rule in PRESETS[name]]
    return out
