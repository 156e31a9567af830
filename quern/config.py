"""Settings from a YAML or JSON file and the command line."""

from __future__ import annotations

import argparse
import json
import os
from types import SimpleNamespace


def read_settings(path: str) -> dict:
    """The file's mapping, $NAME in its top-level strings replaced from the environment. YAML needs PyYAML; JSON does not."""
    with open(path, encoding="utf-8") as file:
        if path.endswith(".json"):
            found = json.load(file)
        else:
            import yaml

            found = yaml.safe_load(file)
    return {k: os.path.expandvars(v) if isinstance(v, str) else v for k, v in (found or {}).items()}


def settings(file: str, argv: list[str] | None = None, /, **flags: type) -> SimpleNamespace:
    """The file's settings with those of the command line over them. ``flags`` names options and their types; unknown ones are ignored."""
    parser = argparse.ArgumentParser(allow_abbrev=False)
    for name, kind in flags.items():
        parser.add_argument(f"--{name}", type=kind, default=None)
    given, _ = parser.parse_known_args(argv)
    return SimpleNamespace(**(read_settings(file) | {k: v for k, v in vars(given).items() if v is not None}))
