"""The model that reads chunks: a callable to plug in, and a deterministic stand-in.

A caller takes (task, text, frames) and gives a dictionary of entity lists as ``schema.ENTITIES`` names them, with
``usage`` counters. It must be picklable, as it is called where the chunks are.
"""

from __future__ import annotations

import re
from typing import Any, Protocol


class Caller(Protocol):
    def __call__(self, task: str, text: str, frames: list[int]) -> dict[str, Any]: ...


class TooLong(Exception):
    """The reply didn't fit; the caller's user asks again for halves."""


class FakeCaller:
    """Reads a screen from each frame and a requirement from each sentence said: the same for the same text."""

    def __init__(self, most_frames: int = 1_000_000):
        self.most_frames = most_frames

    def __call__(self, task: str, text: str, frames: list[int]) -> dict[str, Any]:
        if len(frames) > self.most_frames:
            raise TooLong
        said = re.findall(r"Frame (\d+) from [^\n]*\nSaid: ([^\n]*)", text)
        out: dict[str, Any] = {"screens": [], "fields": [], "actions": [], "journey": [], "requirements": [], "questions": []}
        for frame, words in ((int(f), w) for f, w in said):
            screen = f"S{frame % 4 + 1:02d}"
            at = {"timestamp": float(frame), "keyframe_index": frame}
            out["screens"].append({"id": screen, "name": f"Screen {screen}", "purpose": "Seen", "keyframe_indexes": [frame], "first_seen": float(frame), "field_ids": [], "action_ids": []})
            out["journey"].append({"order": frame + 1, "screen_id": screen, "description": f"Step {frame}", "actor": None, **at})
            if words != "(nothing said)":
                out["requirements"].append({"id": f"R{frame:03d}", "statement": f"The system must support: {words[:80]}", "source_quote": words, "screen_id": screen, "kind": "functional", "priority": "unknown", "confidence": "high", **at})
        out["usage"] = {"model": "fake", "calls": 1, "input_tokens": len(text) // 4, "output_tokens": 10, "cache_read_input_tokens": 0, "cache_creation_input_tokens": 0}
        return out


def read_in_halves(caller: Caller, task: str, parts: list[tuple[int, str]]) -> list[dict[str, Any]]:
    """Replies for frames and their texts; where a reply gets too long, for either half on its own."""
    try:
        return [caller(task, "\n\n".join(t for _, t in parts), [f for f, _ in parts])]
    except TooLong:
        if len(parts) < 2:
            raise
        middle = len(parts) // 2
        return read_in_halves(caller, task, parts[:middle]) + read_in_halves(caller, task, parts[middle:])


# What a node of a reduced schema may hold, and the formats of strings.
KEPT = ("type", "description", "enum", "format", "nullable", "items", "properties", "required", "minItems", "maxItems", "minimum", "maximum")
FORMATS = ("date-time", "enum")


class NotExpressible(ValueError):
    """A schema that has no reduced form: references that don't resolve or that go round, unions of several types."""


def reduced_schema(schema: dict[str, Any]) -> dict[str, Any]:
    """A JSON schema in the subset that some model services take: references put in place, what may be null marked as
    such, choices only of strings, properties in their order, and nothing else."""
    return _Reducer(schema.get("$defs", {})).node(schema, ())


class _Reducer:
    def __init__(self, known: dict[str, Any]):
        self.known = known

    def resolved(self, node: dict[str, Any], inside: tuple[str, ...]) -> tuple[dict[str, Any], tuple[str, ...]]:
        while ref := node.get("$ref"):
            lead, _, name = ref.rpartition("/")
            if lead != "#/$defs" or name not in self.known:
                raise NotExpressible(f"no definition for {ref}")
            if name in inside:
                raise NotExpressible(f"{name} refers to itself")
            node, inside = self.known[name] | {k: v for k, v in node.items() if k != "$ref"}, (*inside, name)
        return node, inside

    def single(self, node: dict[str, Any], inside: tuple[str, ...]) -> tuple[dict[str, Any], tuple[str, ...]]:
        """The one type of a choice between it and null."""
        choices = [self.resolved(c, inside) for c in node.get("anyOf") or node.get("oneOf") or []]
        if not choices:
            return node, inside
        real = [c for c in choices if c[0].get("type") != "null"]
        if len(real) != 1:
            raise NotExpressible("a union of " + ", ".join(str(c.get("type")) for c, _ in real))
        around = {k: v for k, v in node.items() if k not in ("anyOf", "oneOf", "default", "title")}
        null = {"nullable": True} if len(real) < len(choices) else {}
        return around | real[0][0] | null, real[0][1]

    def node(self, node: dict[str, Any], inside: tuple[str, ...]) -> dict[str, Any]:
        node, inside = self.single(*self.resolved(node, inside))
        types = node.get("type")
        types = types if isinstance(types, list) else [types]
        real = [t for t in types if t not in (None, "null")]
        enum = node.get("enum", [node["const"]] if "const" in node else None)
        kind = real[0] if len(real) == 1 else "object" if not real and "properties" in node else "string" if real or enum or "null" in types else None
        out = {k: node[k] for k in KEPT if k in node and k not in ("enum", "format", "items", "properties", "required")}
        if kind:
            out["type"] = kind
        if "null" in types or (enum and kind == "string" and None in enum):
            out["nullable"] = True
        if enum and kind == "string":
            out["enum"] = [str(v) for v in enum if v is not None]
        if kind == "string" and node.get("format") in FORMATS:
            out["format"] = node["format"]
        if kind == "object":
            inner = node.get("properties", {})
            out |= {"properties": {k: self.node(v, inside) for k, v in inner.items()}, "propertyOrdering": list(inner)}
            if "required" in node:
                out["required"] = [k for k in node["required"] if k in inner]
        if kind == "array":
            items = node.get("items")
            items = items[0] if isinstance(items, list) and items else items
            out["items"] = self.node(items, inside) if isinstance(items, dict) else {"type": "string"}
        return out
