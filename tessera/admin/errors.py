"""Error texts for people: the first template whose pattern is found."""

from __future__ import annotations

import json
import re
import traceback


class Renderer:
    """templates: pairs of a regular expression and a message."""

    def __init__(self, templates: list[tuple[str, str]], with_stack: bool = False):
        self.templates = [(re.compile(p, re.S), m) for p, m in templates]
        self.with_stack = with_stack

    @classmethod
    def from_json(cls, text: str, **options) -> Renderer:
        found = json.loads(text)
        return cls(list(found.items()) if isinstance(found, dict) else [(e["template"], e["msg"]) for e in found], **options)

    def matches(self, error: BaseException) -> bool:
        return any(p.search(str(error)) for p, _ in self.templates)

    def format(self, error: BaseException) -> str:
        text = str(error)
        out = next((m for p, m in self.templates if p.search(text)), text)
        return out + "\n" + "".join(traceback.format_exception(error)) if self.with_stack else out
