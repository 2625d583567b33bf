"""robots.txt: groups, the rules for one agent, and wildcard patterns."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field


@dataclass
class Group:
    agents: list[str] = field(default_factory=list)
    rules: list[tuple[bool, str]] = field(default_factory=list)
    delay: float | None = None


@dataclass
class Rules:
    """(allow, pattern) pairs and the crawl delay that hold for one agent."""

    rules: list[tuple[bool, str]] = field(default_factory=list)
    delay: float | None = None

    def allowed(self, target: str) -> bool:
        """The longest matching pattern (in bytes) decides, allow before disallow among equals; without one, all is allowed."""
        best = max(((len(p.encode()), allow) for allow, p in self.rules if matches(p, target)), default=(0, True))
        return best[1]


def crawl_delay(text: str) -> float | None:
    try:
        d = float(text)
    except ValueError:
        return None
    return d if "_" not in text and math.isfinite(d) and 0 <= d <= 86400 else None


def groups(text: str) -> list[Group]:
    """A group is a run of user-agent lines with the directives up to the next run."""
    out: list[Group] = []
    open_run = False
    for raw in re.split(r"\r?\n", text):
        name, colon, value = raw.partition("#")[0].strip().partition(":")
        name, value = name.lower(), value.strip()
        if not colon:
            continue
        if name == "user-agent":
            if not open_run:
                out.append(Group())
                open_run = True
            out[-1].agents.append(value.lower())
        elif out and name in ("allow", "disallow", "crawl-delay"):
            open_run = False
            if name == "crawl-delay":
                d = crawl_delay(value)
                out[-1].delay = d if d is not None else out[-1].delay
            elif value:
                out[-1].rules.append((name == "allow", value))
    return out


def rules_for(text: str | None, agent: str) -> Rules:
    """All groups that name the agent or its product token; else all for *; a missing text allows everything."""
    full = agent.lower()
    token = re.split(r"[/ ]", full, maxsplit=1)[0]
    found = groups(text or "")
    chosen = [g for g in found if full in g.agents or token in g.agents] or [g for g in found if "*" in g.agents]
    return Rules([r for g in chosen for r in g.rules], next((g.delay for g in chosen if g.delay is not None), None))


def pattern_regex(pattern: str) -> str:
    """The pattern as a regular expression that Java and Python read alike: * is any text, a last $ the end."""
    anchored = pattern.endswith("$")
    body = pattern[:-1] if anchored else pattern
    text = ".*".join(re.sub(r"([^A-Za-z0-9_/ \u0080-\U0010ffff])", r"\\\1", part) for part in body.split("*"))
    return f"(?s)^{text}" + (r"\z" if anchored else "")


def matches(pattern: str, target: str) -> bool:
    """Whether a pattern holds for a path with its query, matched leftmost part by part."""
    anchored = pattern.endswith("$")
    first, *rest = (pattern[:-1] if anchored else pattern).split("*")
    if not target.startswith(first):
        return False
    at, end = len(first), len(target)
    if not rest:
        return not anchored or at == end
    if anchored:
        last = rest.pop()
        if not target.endswith(last) or end - len(last) < at:
            return False
        end -= len(last)
    for part in rest:
        at = target.find(part, at, end)
        if at < 0:
            return False
        at += len(part)
    return True


def sitemaps(text: str) -> list[str]:
    """URLs of the Sitemap lines."""
    out = []
    for raw in re.split(r"\r?\n", text):
        name, colon, value = raw.partition("#")[0].strip().partition(":")
        if colon and name.strip().lower() == "sitemap" and value.strip():
            out.append(value.strip())
    return out
