"""Conversion options: validation, and layers with the source of each value."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields
from pathlib import Path

from leafpress.functions.text import CLASSICAL_AGGRESSIVE, CLASSICAL_SAFE

#: The options, their defaults and choices.
DEFAULTS: dict[str, object] = {
    "output": None, "output_dir": None, "force": False, "ocr_mode": "off", "ocr_engine": "tesseract", "ocr_layout": "auto", "zh_script": "keep",
    "classical_zh_postprocess": False, "key_content_fallback": False, "split_preset": None, "split_every": None, "workers": None,
}
CHOICES = {
    "ocr_mode": ("off", "auto", "strict"), "ocr_engine": ("rapidocr", "tesseract"), "ocr_layout": ("auto", "vertical", "horizontal"), "zh_script": ("keep", "hant", "hans"),
}
SPLIT_PRESETS = (10, 20, 50, 100)
FLAGS = ("force", "classical_zh_postprocess", "key_content_fallback")
YES, NO = ("1", "true", "yes", "on"), ("0", "false", "no", "off")
LAYERS = ("default", "profile", "env", "cli")


class OptionError(ValueError):
    """A value or a combination of values that isn't allowed (exit code 2)."""


def checked(key: str, value: object) -> object:
    """The option's value in its own type."""
    bad = OptionError(f"Invalid {key}: {value!r}")
    if key in ("output", "output_dir", "profile"):
        if not isinstance(value, str) or not value.strip():
            raise bad
        return value.strip()
    if key in FLAGS:
        word = value.strip().lower() if isinstance(value, str) else None
        if isinstance(value, bool) or word in YES or word in NO:
            return value if isinstance(value, bool) else word in YES
        raise bad
    if key in ("split_preset", "split_every", "workers"):
        word = str(value).strip()
        if isinstance(value, bool) or not isinstance(value, int | str) or not word.isdigit() or int(word) <= 0 or (key == "split_preset" and int(word) not in SPLIT_PRESETS):
            raise bad
        return int(word)
    if key in CHOICES:
        word = value.strip().lower() if isinstance(value, str) else None
        if word not in CHOICES[key]:
            raise bad
        return word
    raise OptionError(f"Unsupported option: {key}")


def layered(cli: dict, env: dict, profile: dict) -> tuple[dict[str, object], dict[str, str]]:
    """Each option's value from the highest layer that has it, and that layer. Of the two split options the one from the
    higher layer counts; both from one layer is an error."""
    values, source = {}, {}
    for key, default in DEFAULTS.items():
        source[key], values[key] = next(((name, layer[key]) for name, layer in (("cli", cli), ("env", env), ("profile", profile)) if key in layer), ("default", default))
    if None not in (values["split_preset"], values["split_every"]):
        ranks = [LAYERS.index(source[k]) for k in ("split_preset", "split_every")]
        if ranks[0] == ranks[1]:
            raise OptionError("Choose only one split mode: split_preset or split_every.")
        loser = "split_every" if ranks[0] > ranks[1] else "split_preset"
        values[loser], source[loser] = None, "default"
    return values, source


def read_config(path: str | Path) -> dict:
    """A config file's object; a missing file is empty, anything but an object is an error."""
    if not Path(path).exists():
        return {}
    try:
        out = json.loads(Path(path).read_text("utf-8"))
    except json.JSONDecodeError as e:
        raise OptionError(f"Bad config {path}: {e}") from e
    if not isinstance(out, dict):
        raise OptionError(f"Bad config {path}: not an object")
    unknown = set(out) - set(DEFAULTS) - {"profile", "profiles"}
    if unknown:
        raise OptionError(f"Unknown config keys: {sorted(unknown)}")
    return out


def write_config(path: str | Path, config: dict) -> None:
    Path(path).write_text(json.dumps(config, indent=2, sort_keys=True) + "\n", "utf-8")


def profile_values(config: dict, name: str | None = None) -> dict:
    """The root's options, then those of the selected profile. Without any profiles a name is ignored."""
    out = {k: checked(k, v) for k, v in config.items() if k in DEFAULTS and v is not None}
    name = name or config.get("profile")
    if name and "profiles" in config:
        if name not in config["profiles"]:
            raise OptionError(f"Unknown profile: {name}")
        out |= {k: checked(k, v) for k, v in config["profiles"][name].items() if v is not None}
    return out


def env_profile(prefix: str = "LEAFPRESS_", env: dict | None = None) -> str | None:
    return (os.environ if env is None else env).get(prefix + "PROFILE") or None


def env_values(prefix: str = "LEAFPRESS_", env: dict | None = None) -> dict:
    env = os.environ if env is None else env
    return {k: checked(k, env[prefix + k.upper()]) for k in DEFAULTS if prefix + k.upper() in env}


@dataclass(frozen=True)
class ConvertOptions:
    """Options of one conversion; every task gets its own copy, so nothing is shared between conversions."""

    ocr_mode: str = "off"
    ocr_engine: str = "tesseract"
    ocr_layout: str = "auto"
    ocr_profile: str = "none"
    zh_script: str = "keep"
    classical_zh_postprocess: bool = False
    key_content_fallback: bool = False
    split_preset: int | None = None
    split_every: int | None = None
    max_pages: int | None = None
    restart_numbers: bool = False
    force: bool = False
    safe_rules: tuple[tuple[str, str], ...] = CLASSICAL_SAFE
    aggressive_rules: tuple[tuple[str, str], ...] = CLASSICAL_AGGRESSIVE

    def __post_init__(self):
        for f in fields(self):
            v = getattr(self, f.name)
            if f.name in DEFAULTS and v is not None:
                object.__setattr__(self, f.name, checked(f.name, v))
        if self.split_preset and self.split_every:
            raise OptionError("Choose only one split mode: split_preset or split_every.")
        if self.max_pages is not None and self.max_pages <= 0:
            raise OptionError(f"Invalid max_pages: {self.max_pages!r}")

    @property
    def every(self) -> int | None:
        return self.split_every or self.split_preset
