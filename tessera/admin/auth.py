"""Authorisation by YAML rules.

A rule file lists resources with the verbs that users may or may not use. File
paths match by beginning, without case; other names match exactly. An allowing
rule wins over a denying one; a resource that no rule names is allowed.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from pathlib import Path

import yaml


class AccessDenied(PermissionError):
    """A user may not use a resource."""


@dataclass(frozen=True)
class Use:
    """What a statement is about to touch."""

    kind: str  # file, jdbc, hive, system, ...
    path: str
    verb: str  # load, save, run, ...


@dataclass(frozen=True)
class Rule:
    """Users that may, or may not, use a resource by some verbs."""

    kind: str
    path: str
    verbs: frozenset[str]
    allows: frozenset[str]
    denies: frozenset[str]
    closed: bool  # whether those it does not name are denied

    def concerns(self, use: Use) -> bool:
        if self.kind != use.kind or not self.verbs & {"*", use.verb.lower()}:
            return False
        return use.path.lower().startswith(self.path.lower()) if self.kind == "file" else self.path == use.path


def _names(entries) -> frozenset[str]:
    return frozenset(str(e["name"]) for e in entries or [])


class Policy:
    """Documents with a ``userView`` (users and their resources) and a ``resourceView`` (resources and their users)."""

    def __init__(self, documents: list[dict]):
        self.rules: list[Rule] = []
        for document in documents:
            for view in document.get("userView") or []:
                users = _names(view["metadata"]["users"])
                for rule in (r["rule"] for r in view.get("rules") or []):
                    verbs = frozenset(str(v).lower() for v in rule.get("verbs") or ["*"])
                    named = rule.get("resources") or {}
                    for r in named.get("allows") or []:
                        self.rules.append(Rule(r["name"], r["path"], verbs, users, frozenset(), False))
                    for r in named.get("denies") or []:
                        self.rules.append(Rule(r["name"], r["path"], verbs, frozenset(), users, False))
            for view in document.get("resourceView") or []:
                for rule in (r["rule"] for r in view.get("rules") or []):
                    verbs = frozenset(str(v).lower() for v in rule.get("verbs") or ["*"])
                    users = rule.get("users") or {}
                    allows = _names(users.get("allows"))
                    for r in view["metadata"]["resources"]:
                        self.rules.append(Rule(r["name"], r["path"], verbs, allows, _names(users.get("denies")), bool(allows)))

    def allowed(self, user: str, use: Use) -> bool:
        own = [r for r in self.rules if r.concerns(use)]
        if any(user in r.allows for r in own):
            return True
        return not any(user in r.denies or r.closed for r in own)

    def check(self, user: str, uses: list[Use]) -> None:
        bad = [u for u in uses if not self.allowed(user, u)]
        if bad:
            raise AccessDenied("; ".join(f"{user} may not {u.verb} {u.kind} {u.path}" for u in bad))


class PolicyStore:
    """Rule files in a folder, each named by the digest of its text."""

    def __init__(self, folder: str):
        self.folder = Path(folder)
        self.policy = Policy([])
        self.reload()

    def reload(self) -> Policy:
        texts = [p.read_text() for p in sorted(self.folder.glob("*.yml"))] if self.folder.is_dir() else []
        self.policy = Policy([d for t in texts for d in yaml.safe_load_all(t) if d])
        return self.policy

    def add(self, text: str) -> str:
        yaml.safe_load(text)
        name = hashlib.md5(text.encode()).hexdigest() + ".yml"
        self.folder.mkdir(parents=True, exist_ok=True)
        (self.folder / name).write_text(text)
        self.reload()
        return name

    def delete(self, name: str) -> bool:
        path = self.folder / Path(name).name
        there = path.is_file()
        if there:
            path.unlink()
            self.reload()
        return there

    def query(self) -> list[tuple[str, str]]:
        return [(p.name, p.read_text()) for p in sorted(self.folder.glob("*.yml"))]
