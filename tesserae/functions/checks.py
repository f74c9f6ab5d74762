"""Checks of parameters before anything runs."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

#: Words that stand for true and false.
TRUE, FALSE = ("1", "true", "t", "yes", "y", "on"), ("0", "false", "f", "no", "n", "off")


@dataclass(frozen=True)
class Parameter:
    name: str
    kind: type = str
    default: object = None
    required: bool = False
    choices: tuple[str, ...] = ()
    aliases: tuple[str, ...] = ()


@dataclass
class Checked:
    errors: list[str] = field(default_factory=list)
    values: dict[str, object] = field(default_factory=dict)
    given: set[str] = field(default_factory=set)

    @property
    def passed(self) -> bool:
        return not self.errors


def _read(kind: type, value: object) -> object:
    if kind is bool:
        if value is None:  # a flag
            return True
        word = str(value).strip().lower()
        if word not in TRUE + FALSE:
            raise ValueError("expects boolean (true/false)")
        return word in TRUE
    if value is None:
        return None
    try:
        return kind(value)
    except (TypeError, ValueError):
        raise ValueError({int: "expects integer", float: "expects float"}.get(kind, "can't be read")) from None


def checked(parameters: list[Parameter], given: dict[str, object]) -> Checked:
    """Values by kind, defaults where none is given, and every error: unknown names, unreadable values, missing ones, values that are no choice."""
    known = {alias: p for p in parameters for alias in (p.name, *p.aliases)}
    out = Checked([f"Unknown parameter: {k}" for k in given if k not in known])
    own = {known[k].name: v for k, v in given.items() if k in known}
    for p in parameters:
        try:
            value = _read(p.kind, own[p.name]) if p.name in own else p.default
        except ValueError as error:
            out.errors.append(f"{p.name} {error}")
            continue
        if p.required and value in (None, ""):
            out.errors.append(f"Missing required parameter: {p.name}")
        if p.choices and value is not None and str(value) not in p.choices:
            out.errors.append(f"{p.name} must be one of: {' | '.join(p.choices)}")
        out.values[p.name] = value
        if p.name in own:
            out.given.add(p.name)
    return out


def time_range(start: float | None, end: float | None) -> tuple[float, float | None]:
    """Seconds from and to; a missing start is 0, a missing end is the video's."""
    start = 0.0 if start is None else start
    if start < 0:
        raise ValueError("start_time cannot be negative")
    if end is not None and end < 0:
        raise ValueError("end_time cannot be negative")
    if end is not None and end <= start:
        raise ValueError("end_time must be greater than start_time")
    return start, end


def transforms(value: str | None, presets: dict[str, list[str]], known: set[str]) -> list[str]:
    """The transforms of a preset's name, or of a JSON list of known names. Nothing given: none."""
    if not value:
        return []
    if value in presets:
        return list(presets[value])
    try:
        found = json.loads(value)
    except ValueError:
        raise ValueError(f"{value} is neither a preset ({', '.join(sorted(presets))}) nor a JSON list") from None
    if not isinstance(found, list) or not all(isinstance(x, str) for x in found):
        raise ValueError("a JSON list of names is expected")
    if unknown := [x for x in found if x not in known]:
        raise ValueError(f"unknown transforms: {', '.join(unknown)}")
    return found
