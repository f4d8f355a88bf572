"""Command line: validate a JSON or YAML file against a policy.

Exit codes: 0 the file passes, 1 it doesn't, 2 something went wrong.
"""

from __future__ import annotations

import argparse
import json
import sys
import time
import tracemalloc
from contextlib import contextmanager
from pathlib import Path

from .api import Policy
from .functions import values as v
from .lang.errors import PolicyError
from .sources.catalog import load_document

#: The rules that a query is inferred from: the first that the policy has.
DENY, ALLOW = ("deny", "violations", "violation", "errors", "error"), "allow"


class Profile:
    """Wall time and traced memory of each phase."""

    def __init__(self, on: bool) -> None:
        self.on, self.rows = on, []
        if on:
            tracemalloc.start()

    @contextmanager
    def phase(self, name: str):
        began, before = time.perf_counter(), tracemalloc.get_traced_memory()[0] if self.on else 0
        yield
        if self.on:
            self.rows.append((name, 1000 * (time.perf_counter() - began), tracemalloc.get_traced_memory()[0] - before))

    def show(self) -> None:
        for name, ms, size in self.rows:
            print(f"profile {name}: {ms:.2f} ms, {size / 1024:+.1f} KiB", file=sys.stderr)


def shaped(value: object) -> list[str]:
    """The errors that a decision stands for; ``value`` is a document value, None is undefined."""
    if value is None:
        return ["undefined"]
    if value is v.TRUE:
        return []
    if isinstance(value, (tuple, frozenset)):
        return [v.text(x) for x in (sorted(value, key=v.order) if isinstance(value, frozenset) else value)]
    if isinstance(value, v.Doc):
        return [v.text(value)] if value else []
    return [v.text(value)]


def infer_query(policy: Policy) -> str:
    for name in (*DENY, ALLOW):
        if name in policy.rules:
            return f"data.{policy.package}.{name}"
    raise PolicyError("no default query: the policy has neither a deny nor an allow rule")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sparkpolicy-validate", description="Validate a file against a policy.")
    p.add_argument("--policy", required=True)
    p.add_argument("--config", required=True)
    p.add_argument("--query")
    p.add_argument("--format", choices=("text", "json"), default="text")
    p.add_argument("--yaml-aliases", action="store_true")
    p.add_argument("--profile", action="store_true")
    try:
        args = p.parse_args(argv)
    except SystemExit as e:
        return 0 if e.code == 0 else 2
    profile = Profile(args.profile)
    try:
        with profile.phase("load"):
            text, config = Path(args.policy).read_text(encoding="utf-8"), load_document(args.config, aliases=args.yaml_aliases)
        with profile.phase("compile"):
            policy = Policy(text)
        with profile.phase("evaluate"):
            result = policy.evaluate(config, None, args.query or infer_query(policy))
    except (PolicyError, OSError, ValueError) as e:
        shown = e.to_dict() if isinstance(e, PolicyError) else {"type": type(e).__name__, "message": str(e)}
        if args.format == "json":
            print(json.dumps({"success": False, "error": shown}))
        else:
            print(f"error: {e}", file=sys.stderr)
        return 2
    finally:
        profile.show()
    errors = shaped(None if result is None else v.value(result.value))
    if args.format == "json":
        print(json.dumps({"success": not errors, "errors": errors, "result": None if result is None else result.to_dict()["value"]}, ensure_ascii=False))
    else:
        print("pass" if not errors else "\n".join(["fail", *(f"- {e}" for e in errors)]))
    return 1 if errors else 0


if __name__ == "__main__":
    sys.exit(main())
