"""A project's settings: small JSON files beside a manuscript, read on the driver.

Damaged files give defaults and a message; a comma before a closing bracket is forgiven. A
house file, up to four folders above a project, has defaults that the project's own go over."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from pathlib import Path

#: The house's file, and how many folders up it is looked for.
HOUSE, UP = "house.json", 4
_STRINGS = re.compile(r'"(?:[^"\\\\]|\\\\.)*"|,(?=\s*[}\]])')


def parse(text: str) -> tuple[object, str]:
    """(data, note): the note says what was forgiven. ValueError where it is no JSON even so."""
    text = text.lstrip("\ufeff")
    try:
        return json.loads(text), ""
    except json.JSONDecodeError as first:
        repaired = _STRINGS.sub(lambda m: "" if m[0] == "," else m[0], text)
        if repaired != text:
            try:
                return json.loads(repaired), "read with a trailing comma ignored"
            except json.JSONDecodeError:
                pass
        raise ValueError(f"{first.msg} at line {first.lineno} column {first.colno}") from first


def read(path: Path, default: object) -> tuple[object, str]:
    """(data, problem): the default where the file is missing or damaged or of another kind."""
    if not path.exists():
        return default, ""
    try:
        data, note = parse(path.read_text(encoding="utf-8-sig"))
    except (ValueError, UnicodeDecodeError, OSError) as e:
        return default, f"{path.name}: {e}"
    if not isinstance(data, type(default)):
        return default, f"{path.name}: expected {type(default).__name__}"
    return data, f"{path.name}: {note}" if note else ""


def house_of(folder: Path) -> Path | None:
    """The nearest house file in a folder or up to four above it."""
    for at in [folder, *folder.parents][: UP + 1]:
        if (at / HOUSE).is_file():
            return at / HOUSE
    return None


@dataclass
class Settings:
    style: str = ""
    terms: list[str] = field(default_factory=list)
    rules: list[dict] = field(default_factory=list)
    glossary_titles: list[str] = field(default_factory=list)
    options: dict = field(default_factory=dict)
    problems: list[str] = field(default_factory=list)


def merged(*lists: Sequence) -> list:
    """All entries once, in order."""
    return list(dict.fromkeys(x for one in lists for x in one))


def effective(house: dict, project: dict) -> Settings:
    """The project's settings over the house's: lists are joined, rules override by id, options by name."""
    rules: dict = {}
    for one in (house, project):
        for r in one.get("rules") or []:
            if isinstance(r, dict) and r.get("id"):
                rules[r["id"]] = {**rules.get(r["id"], {}), **r}
    joined = "\n\n".join(x for x in (str(house.get("style") or "").strip(), str(project.get("style") or "").strip()) if x)
    both = lambda k: merged(house.get(k) or [], project.get(k) or [])
    return Settings(joined, both("terms"), list(rules.values()), both("glossary_titles"), {**(house.get("options") or {}), **(project.get("options") or {})})


def opened(folder: str | Path, name: str = "project.json") -> Settings:
    """A project folder's settings; what is damaged is named in `problems`."""
    at = Path(folder)
    project, said = read(at / name, {})
    house, told = read(found, {}) if (found := house_of(at)) else ({}, "")
    out = effective(house, project)
    out.problems = [x for x in (told, said) if x]
    return out


def own_options(options: dict, house: dict) -> dict:
    """The options to write for a project: those that differ from the house's."""
    return {k: v for k, v in options.items() if (house.get("options") or {}).get(k) != v}


def budget_lines(carried: Sequence[str], spent: int, limit: int, price: float = 0.0) -> list[str]:
    """What a request holds, for its meter: the ceiling, the price of a million tokens, the list."""
    lines = [f"{spent:,} of {limit:,} tokens"]
    if price:
        lines.append(f"about {spent * price / 1e6:.4f}")
    return lines + [f"- {x}" for x in carried]


def input_budget(window: int, reserve: int) -> int:
    """Tokens for the input: a window less the reserve for the answer, which is 64 at least and half the window at most; 8192 where no window is known."""
    return window - max(64, min(reserve, window // 2)) if window else 8192
