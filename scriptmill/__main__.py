"""python -m scriptmill INPUT [-o OUTPUT] [--presets a,b] [--max-iterations N] [--diagnostics]: one file, or - for stdin."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from scriptmill.api import Deobfuscator, preset_names


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="scriptmill", description="Simplify a script.")
    p.add_argument("input")
    p.add_argument("-o", "--output")
    p.add_argument("--presets", default="generic", help=f"one or more of {', '.join(preset_names())}")
    p.add_argument("--max-iterations", type=int)
    p.add_argument("--diagnostics", action="store_true")
    a = p.parse_args(args)
    try:
        source = sys.stdin.read() if a.input == "-" else Path(a.input).read_text("utf-8")
        d = Deobfuscator.with_preset(*(x.strip() for x in a.presets.split(",")))
    except (OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    if a.max_iterations is not None:
        d.with_max_iterations(a.max_iterations)
    if a.diagnostics:
        d.with_diagnostics(lambda x: print(x.report(), file=sys.stderr))
    code = d.deobfuscate(source)
    if a.output:
        Path(a.output).write_text(code, "utf-8")
    else:
        sys.stdout.write(code)
    return 0


if __name__ == "__main__":
    sys.exit(main())
