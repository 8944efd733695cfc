"""Rule files and format settings: small JSON files that the driver reads."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from pathlib import Path

from ..functions.text import fold

#: Kinds of conditions: the zones they count in, how many listed cards they need, and whether they forbid instead.
CONDITIONS: dict[str, tuple[bool, bool, int, bool]] = {
    "InMainboard": (True, False, 1, False),
    "InSideboard": (False, True, 1, False),
    "InMainOrSideboard": (True, True, 1, False),
    "OneOrMoreInMainboard": (True, False, 1, False),
    "OneOrMoreInSideboard": (False, True, 1, False),
    "OneOrMoreInMainOrSideboard": (True, True, 1, False),
    "TwoOrMoreInMainboard": (True, False, 2, False),
    "TwoOrMoreInSideboard": (False, True, 2, False),
    "TwoOrMoreInMainOrSideboard": (True, True, 2, False),
    "DoesNotContain": (True, True, 1, True),
    "DoesNotContainMainboard": (True, False, 1, True),
    "DoesNotContainSideboard": (False, True, 1, True),
}


@dataclass(frozen=True)
class Condition:
    """``listed`` counts the names of the file; those that no card has are missing from ``cards``."""

    kind: str
    cards: tuple[int, ...]
    listed: int


@dataclass(frozen=True)
class Rule:
    name: str
    with_color: bool
    conditions: tuple[Condition, ...]
    variants: tuple[Rule, ...] = ()


@dataclass(frozen=True)
class Fallback:
    name: str
    with_color: bool
    cards: tuple[int, ...]


@dataclass(frozen=True)
class Definitions:
    """A format's rules. Their order is that of the files."""

    format: str
    rules: tuple[Rule, ...]
    fallbacks: tuple[Fallback, ...] = ()
    land_colors: dict[int, str] = field(default_factory=dict)
    nonland_colors: dict[int, str] = field(default_factory=dict)
    version: str = ""


@dataclass
class Audit:
    """Names that only their folded form found, and one entry for each reference that failed."""

    by_fold: dict[str, int] = field(default_factory=dict)
    unresolved: list[str] = field(default_factory=list)


#: A string of JSON, or a comma that nothing but a closing bracket follows.
_STRING_OR_LAST_COMMA = re.compile(r'"(?:[^"\\]|\\.)*"|,(?=\s*[\]}])')


def relaxed_json(content: str) -> dict:
    """A JSON object that may have commas before closing brackets and a byte order mark."""
    strict = _STRING_OR_LAST_COMMA.sub(lambda m: m[0] if m[0] != "," else "", content.lstrip("\ufeff"))
    found = json.loads(strict)
    if not isinstance(found, dict):
        raise ValueError("a rule file holds one object")
    return found


def fold_index(names: Iterable[tuple[str, int]]) -> dict[str, int | None]:
    """Cards by folded name; None where several cards share one."""
    cards: dict[str, set[int]] = {}
    for name, card in names:
        cards.setdefault(fold(name), set()).add(card)
    return {key: next(iter(ids)) if len(ids) == 1 else None for key, ids in cards.items()}


def version_of(files: Iterable[Path], semantics: str) -> str:
    """Names a set of rules: what the files are called, what is in them, and how they are read."""
    contents = {f"{p.parent.name}/{p.name}": hashlib.sha256(p.read_bytes()).hexdigest() for p in files}
    manifest = json.dumps({"semantics": semantics, "files": contents}, sort_keys=True)
    return f"rules-{hashlib.sha256(manifest.encode()).hexdigest()[:12]}"


def load_definitions(
    root: str | Path,
    format_name: str,
    resolve: Callable[[str], int | None],
    folded: dict[str, int | None] | None = None,
    semantics: str = "1",
    without: frozenset[str] = frozenset(),
    audit: Audit | None = None,
) -> Definitions:
    """``<root>/<format>/Archetypes``, ``Fallbacks``, ``color_overrides.json`` and ``<root>/card_colors.json``.

    ``without``: stems of rule files that are left out. A colour file that is not
    there counts as empty; names in it that no card has are passed over.
    """
    audit, folded, root = audit if audit is not None else Audit(), folded or {}, Path(root)

    def card(name: str) -> int | None:
        found = resolve(name)
        if found is None and (found := folded.get(fold(name))) is not None:
            audit.by_fold[name] = found
        elif found is None:
            audit.unresolved.append(name)
        return found

    def cards(names: list[str]) -> tuple[int, ...]:
        return tuple(c for c in map(card, names) if c is not None)

    def condition(raw: dict) -> Condition:
        if raw["Type"] not in CONDITIONS:
            raise ValueError(f"unknown condition type {raw['Type']!r}")
        single = not raw["Type"].startswith(("OneOrMore", "TwoOrMore"))
        names = (raw.get("Cards") or [])[: 1 if single else None]
        return Condition(raw["Type"], cards(names), len(names))

    def rule(raw: dict) -> Rule:
        variants = tuple(rule(v) for v in raw.get("Variants") or [])
        return Rule(raw["Name"], bool(raw.get("IncludeColorInName")), tuple(map(condition, raw.get("Conditions") or [])), variants)

    here = root / format_name
    files = [p for p in sorted((here / "Archetypes").glob("*.json")) if p.stem not in without]
    rules = tuple(rule(relaxed_json(p.read_text("utf-8"))) for p in files)
    fallbacks, fallback_files = [], sorted((here / "Fallbacks").glob("*.json"))
    for p in fallback_files:
        raw = relaxed_json(p.read_text("utf-8"))
        fallbacks.append(Fallback(raw["Name"], bool(raw.get("IncludeColorInName")), cards(raw.get("CommonCards") or [])))
    color_files = [p for p in (root / "card_colors.json", here / "color_overrides.json") if p.exists()]
    lands, others = color_tables([relaxed_json(p.read_text("utf-8")) for p in color_files], resolve)
    return Definitions(
        format_name, rules, tuple(fallbacks), lands, others, version_of([*files, *fallback_files, *color_files], semantics)
    )


def color_tables(files: list[dict], resolve: Callable[[str], int | None]) -> tuple[dict[int, str], dict[int, str]]:
    """Colours of lands and of other cards; later entries win."""
    out: dict[str, dict[int, str]] = {"Lands": {}, "NonLands": {}}
    for raw in files:
        for section, table in out.items():
            for entry in raw.get(section) or []:
                if (found := resolve(entry["Name"])) is not None:
                    table[found] = entry["Color"]
    for color in {c for table in out.values() for c in table.values()}:
        if set(color) - set("WUBRG"):
            raise ValueError(f"unknown colour letters in {color!r}")
    return out["Lands"], out["NonLands"]


@dataclass(frozen=True)
class Format:
    game: str
    name: str
    imported: bool
    slug_tokens: tuple[str, ...]
    board_zones: tuple[str, ...] = ("main", "side")
    expected_mainboard_min: int = 60
    expected_sideboard_max: int = 15
    vector_exclude_type_line_prefixes: tuple[str, ...] = ()


def load_formats(path: str | Path) -> list[Format]:
    """Formats of all games in a settings file."""
    found = []
    for game in json.loads(Path(path).read_text("utf-8"))["games"]:
        for f in game["formats"]:
            found.append(
                Format(
                    game["name"], f["name"], bool(f["import"]), tuple(f["slug_tokens"]), tuple(f["board_zones"]),
                    f["expected_mainboard_min"], f["expected_sideboard_max"], tuple(f["vector_exclude_type_line_prefixes"]),
                )
            )
    return found
