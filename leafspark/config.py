"""Options of the page flow: defaults, then a file's sections, then the environment, then the caller's."""

from __future__ import annotations

import dataclasses
import os
from dataclasses import dataclass, field
from typing import Any


@dataclass
class Layout:
    conf: float = 0.25
    iou: float = 0.40
    conf_bubble: float = 0.25
    conf_narration: float = 0.40
    conf_sfx: float = 0.18
    y_tolerance: float = 50.0
    min_width: int = 20
    min_height: int = 15
    max_page_coverage: float = 0.70
    class_ids: tuple[int, ...] = ()


@dataclass
class Ocr:
    det_threshold: float = 0.30
    rec_threshold: float = 0.50
    backend: str = "auto"
    max_side: int = 2560


@dataclass
class Inpaint:
    dilation: int = 12
    feather: int = 8
    simple_fill: float = 0.92
    border: int = 12


@dataclass
class Render:
    font_min: int = 9
    font_max: int = 42
    line_spacing: float = 1.22
    padding_ratio: float = 0.12
    padding_min: int = 6
    supersample: int = 2
    min_edge: int = 4


@dataclass
class Translate:
    max_tokens: int = 256
    timeout: float = 90.0
    retries: int = 2
    context: int = 3


@dataclass
class Run:
    force: bool = False
    dry_run: bool = False
    skip: tuple[str, ...] = ()
    gate_below: float = 0.70
    gate_above: float = 0.75
    formats: tuple[str, ...] = (".jpg", ".jpeg", ".png", ".webp", ".bmp")


@dataclass
class Options:
    layout: Layout = field(default_factory=Layout)
    ocr: Ocr = field(default_factory=Ocr)
    inpaint: Inpaint = field(default_factory=Inpaint)
    render: Render = field(default_factory=Render)
    translate: Translate = field(default_factory=Translate)
    run: Run = field(default_factory=Run)


def parse(value: str, like: Any) -> Any:
    """A text as the type of like. Raises ValueError for what isn't one; unlike a truth test, `false` and 0 do count."""
    if isinstance(like, bool):
        known = {"1": True, "true": True, "yes": True, "on": True, "0": False, "false": False, "no": False, "off": False}
        if value.strip().lower() not in known:
            raise ValueError(f"no truth value: {value!r}")
        return known[value.strip().lower()]
    if isinstance(like, tuple):
        kind = type(like[0]) if like else str
        return tuple(kind(v) for v in value.split(",") if v)
    return type(like)(value)


def override(options: Options, values: dict[str, dict[str, Any]]) -> Options:
    """A copy with values by section and name; unknown ones are ignored, texts are parsed."""
    out = {}
    for section in dataclasses.fields(options):
        now = getattr(options, section.name)
        given = {k: v for k, v in values.get(section.name, {}).items() if k in {f.name for f in dataclasses.fields(now)}}
        out[section.name] = dataclasses.replace(now, **{k: parse(v, getattr(now, k)) if isinstance(v, str) and not isinstance(getattr(now, k), str) else v for k, v in given.items()})
    return Options(**out)


def from_environment(options: Options, environ: dict[str, str] | None = None, prefix: str = "LEAFSPARK_") -> tuple[Options, list[str]]:
    """Options with PREFIX_SECTION_NAME variables applied, and the names of variables that can't be parsed (left out)."""
    bad: list[str] = []
    for key, value in sorted((os.environ if environ is None else environ).items()):
        section, _, name = key.removeprefix(prefix).lower().partition("_")
        if key.startswith(prefix) and hasattr(options, section) and hasattr(getattr(options, section), name):
            try:
                options = override(options, {section: {name: value}})
            except ValueError:
                bad.append(key)
    return options, bad


def fingerprint(options: Options) -> str:
    """First 12 digits of the MD5 of the options as JSON with sorted keys."""
    import hashlib
    import json

    return hashlib.md5(json.dumps(dataclasses.asdict(options), sort_keys=True).encode()).hexdigest()[:12]
