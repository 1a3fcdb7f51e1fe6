"""Options of plugins: schemas, and a value's way from an override over a file to the default."""

from __future__ import annotations

import tomllib
from typing import NamedTuple


class Option(NamedTuple):
    key: str
    kind: str  # number, select, bool, text
    default: object
    low: float | None = None
    high: float | None = None
    choices: tuple[str, ...] = ()


SCHEMAS: dict[str, tuple[Option, ...]] = {
    "netscan": (Option("top_ports", "number", 100, 1, 750),),
    "web": (Option("pages", "number", 64, 1, 10_000), Option("depth", "number", 2, 0, 16)),
    "report": (Option("format", "select", "text", choices=("text", "summary", "json", "markdown", "junit", "sarif", "pdf")),),
    "secrets": (Option("show", "bool", False),),
}


def checked(option: Option, value: object) -> object:
    """The value as the option's kind; ValueError if it isn't one or is out of range."""
    if option.kind == "number":
        number = float(value)  # ValueError for others
        if (option.low is not None and number < option.low) or (option.high is not None and number > option.high):
            raise ValueError(f"{option.key}: {value} is outside {option.low} to {option.high}")
        return int(number) if number == int(number) else number
    if option.kind == "bool":
        if str(value).lower() not in ("true", "false"):
            raise ValueError(f"{option.key}: {value!r} is neither true nor false")
        return str(value).lower() == "true"
    if option.kind == "select" and value not in option.choices:
        raise ValueError(f"{option.key}: {value!r} is none of {', '.join(option.choices)}")
    return str(value)


def option(plugin: str, key: str) -> Option:
    found = next((o for o in SCHEMAS.get(plugin, ()) if o.key == key), None)
    if found is None:
        raise ValueError(f"no option {plugin}.{key}")
    return found


def resolved(plugin: str, key: str, override: object = None, config: str = "") -> object:
    """An override, else what the TOML text says under [plugin], else the default; each is checked."""
    o = option(plugin, key)
    if override is not None:
        return checked(o, override)
    said = tomllib.loads(config).get(plugin, {}).get(key)
    return checked(o, said if said is not None else o.default)
