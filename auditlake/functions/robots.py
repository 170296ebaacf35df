"""robots.txt matching: the longest rule of the most specific group wins, allow wins ties."""

from __future__ import annotations

import re
from urllib.parse import quote


def agent_name(agent: str) -> str:
    """The name by which groups are found: lower case, without a version."""
    return agent.lower().split("/")[0].strip()


def groups(text: str) -> list[tuple[list[str], list[tuple[bool, str]]]]:
    out: list[tuple[list[str], list[tuple[bool, str]]]] = []
    fresh = False
    for line in text.splitlines():
        key, _, value = line.split("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            if not fresh:
                out.append(([], []))
            out[-1][0].append(agent_name(value))
            fresh = True
        elif key in ("allow", "disallow"):
            fresh = False
            if out and value:
                out[-1][1].append((key == "allow", value))
    return out


def written(rule: str) -> str:
    """A rule as paths are written: what an url would encode is encoded."""
    return quote(rule, safe="!#$%&'()*+,/:;=?@[]~-._")


def literal(rule: str) -> str:
    """What a path must begin with for a rule to match."""
    return re.split(r"[*$]", rule, maxsplit=1)[0]


def pattern(rule: str) -> str | None:
    """A regular expression for rules that are more than their beginning; null for plain ones."""
    if "*" not in rule and not rule.endswith("$"):
        return None
    end = "$" if rule.endswith("$") else ""
    return "^" + "".join(".*" if c == "*" else re.escape(c) for c in rule.removesuffix("$")) + end


def rules_for(parsed: list, agent: str) -> list[tuple[bool, str]]:
    """The rules of an agent's own groups, else of the groups for all."""
    name = agent_name(agent)
    mine = [r for a, r in parsed if name in a] or [r for a, r in parsed if "*" in a]
    return [x for r in mine for x in r]


def allowed(text: str, agent: str, path: str) -> bool:
    best = (-1, True)
    for allow, rule in rules_for(groups(text), agent):
        rule = written(rule)
        if path.startswith(literal(rule)) and ((p := pattern(rule)) is None or re.match(p, path)):
            best = max(best, (len(rule), allow))
    return best[1]


def sitemaps(text: str, origin: str) -> list[str]:
    return re.findall(r"(?im)^\s*sitemap:\s*(\S+)", text) or [f"{origin}/sitemap.xml", f"{origin}/sitemap_index.xml"]
