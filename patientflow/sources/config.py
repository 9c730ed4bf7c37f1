"""Configuration files: JSON, INI, and flat YAML of scalars and lists."""

from __future__ import annotations

import configparser
import json
from pathlib import Path


def _scalar(text: str):
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return None if text.lower() in ("", "null", "~") else text


def read_yaml(text: str) -> dict:
    """Keys with a scalar, an inline list or a list on the following lines; comments and blank lines are skipped."""
    out: dict = {}
    key = None
    for raw in text.splitlines():
        line = raw.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#") or line.strip() == "---":
            continue
        if line.lstrip().startswith("- ") and key is not None:
            if not isinstance(out[key], list):
                out[key] = []
            out[key].append(_scalar(line.lstrip()[2:]))
            continue
        name, _, value = line.partition(":")
        key, value = name.strip(), value.strip()
        out[key] = [_scalar(x) for x in value[1:-1].split(",") if x.strip()] if value.startswith("[") and value.endswith("]") else _scalar(value)
    return out


def read_config(path: str) -> dict:
    """By the file's ending: .json, .yaml/.yml, else INI with sections as dictionaries."""
    text = Path(path).read_text()
    if path.endswith(".json"):
        return json.loads(text)
    if path.endswith((".yaml", ".yml")):
        return read_yaml(text)
    ini = configparser.ConfigParser()
    ini.read_string(text)
    return {s: dict(ini[s]) for s in ini.sections()}
