"""The settings of the annotation: eighteen fields with defaults, overridden by name."""

from __future__ import annotations

from ..functions.text import THEMES

#: Fields and their defaults.
DEFAULTS: dict[str, bool | int | str] = {
    "enabled": True,
    "showOnProfile": True, "showOnSearch": True, "showOnDetail": True,
    "showPreprint": True, "showTags": True, "showCcf": True, "showCore": True, "showTop": True, "showEi": True, "showCas": True, "showJcr": False, "showIf": True, "showWarn": True,
    "theme": "soft", "badgeScale": 100, "boldBadges": False,
    "showUnmatched": False,
}
#: Which field switches which place of a page.
PLACES = {"profile": "showOnProfile", "search": "showOnSearch", "detail": "showOnDetail"}
_TRUE, _FALSE = ("true", "1", "on", "yes"), ("false", "0", "off", "no", "")


def _coerced(name: str, value: object) -> bool | int | str:
    """A value as the field's kind; text of a form or a URL counts as what it says."""
    kind = type(DEFAULTS[name])
    if kind is bool:
        if isinstance(value, str):
            if value.strip().lower() not in _TRUE + _FALSE:
                raise ValueError(f"{name}: {value!r} is neither true nor false")
            return value.strip().lower() in _TRUE
        return bool(value)
    if kind is int:
        return int(float(str(value).strip()))
    return str(value)


def settings(overrides: dict | None = None) -> dict[str, bool | int | str]:
    """All fields; an override of null keeps the default, an unknown theme becomes the default one, an unknown field is an error."""
    given = {k: v for k, v in (overrides or {}).items() if v is not None}
    if unknown := sorted(set(given) - set(DEFAULTS)):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    out = DEFAULTS | {k: _coerced(k, v) for k, v in given.items()}
    if out["theme"] not in THEMES:
        out["theme"] = DEFAULTS["theme"]
    return out


def from_query(text: str) -> dict[str, bool | int | str]:
    """Settings of a query string ('theme=mono&showJcr=true'); fields it does not know are passed over."""
    from urllib.parse import parse_qsl

    return settings({k: v for k, v in parse_qsl(text.lstrip("?"), keep_blank_values=True) if k in DEFAULTS})


def changed(before: dict, after: dict) -> list[str]:
    """Fields whose value differs: pages annotated under `before` are to be annotated again if there is any."""
    return [k for k in DEFAULTS if settings(before)[k] != settings(after)[k]]


def label_switches(full: dict) -> dict[str, bool]:
    """Switches of the labels by their key."""
    names = ("preprint", "tags", "ccf", "core", "top", "ei", "cas", "jcr", "if", "warn", "unmatched")
    return {n: bool(full["show" + n[0].upper() + n[1:]]) for n in names}


def style(full: dict) -> dict[str, str]:
    """Class names and font size of the line of labels."""
    scale = int(full["badgeScale"])
    classes = ["sr-row", f"sr-theme-{full['theme']}", *["sr-bold"] * bool(full["boldBadges"])]
    return {"class": " ".join(classes), "style": f"font-size:{11 * scale / 100:.1f}px" if scale not in (0, 100) else ""}
