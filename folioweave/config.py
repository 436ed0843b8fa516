"""Settings with their bounds; the defaults are part of the results' meaning."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import tomllib
from dataclasses import dataclass, field
from difflib import get_close_matches
from typing import Any


class ConfigError(ValueError):
    """A setting that is unknown, of the wrong type or out of bounds."""


# The settings of each section, as name | default | bounds; [ and ] include the bound, ( and ) don't, choices stand apart by blanks.
SETTINGS = """
[typography]
heading_candidate_mode | font | position font position_and_font
body_font_text_coverage | 0.95 | (0, 1]
body_font_max_words | 20 | [1,
max_headings_per_page | 0 | [0,
size_class_depth | 0 | [0,
position_min_repeated_pages | 5 | [1,
line_y_tolerance_ratio | 0.55 | (0,
min_tier_count | 5 | [1,
max_heading_tier | 3 | [1,
max_heading_length | 160 | [1,
min_heading_confidence | 0.45 | [0, 1]
heading_merge_gap_ratio | 1.5 | (0,
bpe_min_pair_count | 15 | [1,
bpe_max_iterations | 50 | [1,
bpe_max_node_words | 30 | [1,
bpe_level_pollution_ratio | 0.3 | [0, 1]
margin_band_ratio | 0.12 | (0, 0.25]
margin_position_tolerance_ratio | 0.015 | (0,
margin_min_consecutive_pages | 10 | [2,
margin_min_repeated_lines | 3 | [1,
margin_max_page_number | 3000 | [1,
position_fallback_enabled | true |
position_fallback_tolerance | 2.0 | (0,
position_fallback_min_isolation_ratio | 1.0 | [0,
position_fallback_body_font_ratio_low | 0.97 | (0,
position_fallback_body_font_ratio_high | 1.03 | (0,
position_fallback_title_dedupe_threshold | 0.8 | [0, 1]
[markdown]
enabled | true |
max_words | 10000 | [1,
max_words_coverage | 0.95 | (0, 1]
prefer | coarsest | coarsest
[outline_quality]
min_item_count | 4 | [0,
max_item_to_page_ratio | 0.9 | (0,
flag_numeric_only_titles | true |
replace_when_low_quality | false |
[processing]
skip_existing_bookmarks | true |
write_artifacts | true |
ocr_policy | never | never
markdown_content_mode | direct | direct inclusive
"""


@dataclass(frozen=True)
class Rule:
    """What a setting may be: of the kind of its default, one of the choices, or within the bounds."""

    default: Any
    choices: tuple[str, ...] = ()
    low: float | None = None
    high: float | None = None
    open_low: bool = False

    def accepts(self, value: Any) -> bool:
        if isinstance(self.default, bool) or isinstance(value, bool):
            return isinstance(self.default, bool) and isinstance(value, bool)
        if self.choices:
            return value in self.choices
        if not isinstance(value, (int, float)) or isinstance(self.default, int) and not isinstance(value, int):
            return False
        above = self.low is None or value > self.low or value == self.low and not self.open_low
        return above and (self.high is None or value <= self.high)


def _rules(text: str) -> dict[str, dict[str, Rule]]:
    sections: dict[str, dict[str, Rule]] = {}
    for line in text.strip().splitlines():
        if line.startswith("["):
            here = sections.setdefault(line.strip("[]"), {})
            continue
        name, default, limits = (part.strip() for part in line.split("|"))
        if default in ("true", "false") or default[0].isdigit():
            low, _, high = limits[1:].rstrip("]").partition(",")
            bounds = {"low": float(low), "high": float(high) if high.strip() else None, "open_low": limits[0] == "("} if limits else {}
            here[name] = Rule(json.loads(default), **bounds)
        else:
            here[name] = Rule(default, choices=tuple(limits.split()))
    return sections


RULES = _rules(SETTINGS)


def _checked(section: str):
    def check(self) -> None:
        for name, rule in RULES[section].items():
            if not rule.accepts(getattr(self, name)):
                raise ConfigError(f"{name}: {getattr(self, name)!r} is no value that {section} takes")
        if section == "typography" and self.position_fallback_body_font_ratio_low > self.position_fallback_body_font_ratio_high:
            raise ConfigError("position_fallback_body_font_ratio_low is above position_fallback_body_font_ratio_high")

    return check


def _section(name: str, section: str, parts: tuple[tuple[str, type], ...] = ()) -> type:
    fields = [(k, type(r.default), field(default=r.default, metadata={"rule": r})) for k, r in RULES[section].items()]
    return dataclasses.make_dataclass(name, [*fields, *((k, t, field(default=t())) for k, t in parts)], frozen=True, namespace={"__post_init__": _checked(section), "__module__": __name__})


TypographyConfig = _section("TypographyConfig", "typography")
MarkdownSplitConfig = _section("MarkdownSplitConfig", "markdown")
OutlineQualityConfig = _section("OutlineQualityConfig", "outline_quality")
ProcessingConfig = _section("ProcessingConfig", "processing", (("typography", TypographyConfig), ("markdown", MarkdownSplitConfig), ("outline_quality", OutlineQualityConfig)))


SECTIONS = {"typography": TypographyConfig, "markdown": MarkdownSplitConfig, "outline_quality": OutlineQualityConfig}


def to_data(config: ProcessingConfig) -> dict[str, Any]:
    """Plain sections: processing, typography, markdown, outline_quality."""
    own = {f.name: getattr(config, f.name) for f in dataclasses.fields(config) if f.name not in SECTIONS}
    return {"schema_version": 1, "processing": own, **{s: dataclasses.asdict(getattr(config, s)) for s in SECTIONS}}


def _known(section: str, values: dict[str, Any], names: set[str]) -> None:
    for key in values:
        if key not in names:
            near = get_close_matches(key, names, 1)
            raise ConfigError(f"unknown setting {section}.{key}" + (f"; did you mean {near[0]}?" if near else ""))


def from_data(data: dict[str, Any]) -> ProcessingConfig:
    _known("config", data, {"schema_version", "processing", *SECTIONS})
    if data.get("schema_version", 1) != 1:
        raise ConfigError("schema_version 1 expected")
    own = {f.name for f in dataclasses.fields(ProcessingConfig)} - set(SECTIONS)
    _known("processing", data.get("processing", {}), own)
    parts = {}
    for s, kind in SECTIONS.items():
        _known(s, data.get(s, {}), {f.name for f in dataclasses.fields(kind)})
        parts[s] = kind(**data.get(s, {}))
    return ProcessingConfig(**data.get("processing", {}), **parts)


def parse_override(text: str) -> tuple[str, str, Any]:
    """``section.key=value``; the value is a TOML literal, or else a string."""
    name, sep, raw = text.partition("=")
    section, dot, key = name.strip().partition(".")
    if not sep or not dot:
        raise ConfigError(f"section.key=value expected, got {text!r}")
    try:
        value = tomllib.loads(f"v = {raw}")["v"]
    except tomllib.TOMLDecodeError:
        value = raw
    return section, key, value


def resolve(toml_text: str | None = None, options: dict[str, dict[str, Any]] | None = None, overrides: tuple[str, ...] = ()) -> ProcessingConfig:
    """Defaults, then a TOML text, then options, then single overrides."""
    data = to_data(ProcessingConfig())
    layers: list[dict[str, Any]] = [tomllib.loads(toml_text)] if toml_text else []
    layers += [options] if options else []
    for text in overrides:
        section, key, value = parse_override(text)
        layers.append({section: {key: value}})
    for layer in layers:
        for section, values in layer.items():
            if isinstance(values, dict):
                data.setdefault(section, {})
                data[section] = {**data[section], **values}
            else:
                data[section] = values
    return from_data(data)


def config_hash(config: ProcessingConfig) -> str:
    """SHA-256 of the canonical JSON: sorted keys, no blanks, characters as they are."""
    return hashlib.sha256(json.dumps(to_data(config), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def schema() -> dict[str, Any]:
    """JSON Schema of the settings."""

    def of(f: dataclasses.Field) -> dict[str, Any]:
        r = f.metadata["rule"]
        kind = next(n for t, n in ((bool, "boolean"), (int, "integer"), (float, "number"), (str, "string")) if isinstance(r.default, t))
        bounds = {"enum": list(r.choices) or None, "exclusiveMinimum" if r.open_low else "minimum": r.low, "maximum": r.high}
        return {"type": kind, "default": r.default, **{k: v for k, v in bounds.items() if v is not None}}

    parts = {s: {"type": "object", "additionalProperties": False, "properties": {f.name: of(f) for f in dataclasses.fields(k)}} for s, k in SECTIONS.items()}
    own = {f.name: of(f) for f in dataclasses.fields(ProcessingConfig) if f.name not in SECTIONS}
    return {"type": "object", "additionalProperties": False, "properties": {"schema_version": {"const": 1}, "processing": {"type": "object", "additionalProperties": False, "properties": own}, **parts}}


def to_toml(config: ProcessingConfig) -> str:
    """The settings as a TOML template."""

    def lit(v: Any) -> str:
        return "true" if v is True else "false" if v is False else json.dumps(v)

    out = ["schema_version = 1"]
    for section, values in to_data(config).items():
        if isinstance(values, dict):
            out += ["", f"[{section}]", *(f"{k} = {lit(v)}" for k, v in values.items())]
    return "\n".join(out) + "\n"


def explain(name: str) -> dict[str, Any]:
    """What ``section.key`` may be: its default, choices and bounds, with the layers that can set it."""
    section, _, key = name.partition(".")
    _known(section, {key: None}, set(RULES.get(section, {})))
    if section not in RULES:
        raise ConfigError(f"unknown section {section}")
    r = RULES[section][key]
    return {"name": name, "default": r.default, "choices": list(r.choices), "low": r.low, "high": r.high, "open_low": r.open_low, "layers": ["defaults", "TOML file", "options", "single overrides"]}


def validate(toml_text: str) -> list[str]:
    """Faults of a TOML text, one message each; none for a good one."""
    try:
        resolve(toml_text)
    except (ConfigError, tomllib.TOMLDecodeError, TypeError) as e:
        return [str(e)]
    return []
