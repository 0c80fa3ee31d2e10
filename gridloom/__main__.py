"""python -m gridloom version | env [--json] | audit SPEC.json"""

from __future__ import annotations

import argparse
import json
import platform
import sys
from importlib.metadata import version
from pathlib import Path

from gridloom import __version__
from gridloom.operators.splits import audit_spec


def main(arguments: list[str] | None = None) -> int:
    """0, or 2 if a check of the specification fails."""
    parser = argparse.ArgumentParser(prog="gridloom")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("version", help="print the version")
    commands.add_parser("env", help="print what it runs on").add_argument("--json", action="store_true")
    commands.add_parser("audit", help="check a split specification for leakage").add_argument("spec")
    chosen = parser.parse_args(arguments)
    if chosen.command == "version":
        print(f"gridloom {__version__}")
        return 0
    if chosen.command == "env":
        found = {"gridloom": __version__, "python": platform.python_version(), "platform": platform.platform()} | {p: version(p) for p in ("pyspark", "pyarrow", "numpy")}
        print(json.dumps(found) if chosen.json else "\n".join(f"{k}: {v}" for k, v in found.items()))
        return 0
    checks = audit_spec(json.loads(Path(chosen.spec).read_text()))
    for c in checks:
        print(f"{'ok  ' if c['ok'] else 'FAIL'} {c['check']} {c['detail']}".rstrip())
    return 0 if all(c["ok"] for c in checks) else 2


if __name__ == "__main__":
    sys.exit(main())
