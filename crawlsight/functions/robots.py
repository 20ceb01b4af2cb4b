"""robots.txt rules for one agent, applied to URLs.

Two readings. ``first``, the default, is that of the common library reader, which the
crawl's model uses: rules are tried in their order, the first whose path starts the URL's
path decides, and ``*`` or ``$`` are plain characters. ``longest`` is the published standard's:
the longest matching rule decides, allowing wins a tie, ``*`` matches anything and a final ``$``
the end. Both compare paths with percent escapes decoded.
"""

from __future__ import annotations

import functools
import re
from urllib.parse import unquote, urlsplit
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

POLICIES = ("first", "longest")
#: Texts whose rules a worker keeps compiled.
KEPT_TEXTS = 256


def rules_for(text: str, agent: str = "*") -> list[tuple[str, bool]]:
    """(path pattern, allowed) of the groups that name the agent; of the wildcard groups if none does."""
    groups: list[tuple[list[str], list[tuple[str, bool]]]] = []
    open_ = False
    for line in text.splitlines():
        key, colon, value = line.split("#", 1)[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            continue
        if key == "user-agent":
            if not open_:
                groups.append(([], []))
            groups[-1][0].append(value.lower())
            open_ = True
        elif key in ("allow", "disallow"):
            open_ = False
            if groups and value:
                groups[-1][1].append((value, key == "allow"))
    own = [r for names, r in groups if agent.lower() in names]
    general = [r for names, r in groups if "*" in names]
    return [rule for group in (own or general) for rule in group]


class LongestRules:
    """The longest matching rule decides; patterns are compiled once."""

    def __init__(self, text: str, agent: str = "*"):
        self.rules = []
        for pattern, allow in rules_for(text, agent):
            pattern = unquote(pattern)
            body = ".*".join(map(re.escape, pattern.removesuffix("$").split("*")))
            self.rules.append((re.compile(body + ("$" if pattern.endswith("$") else ""), re.S), len(pattern), allow))

    def blocks(self, url: str) -> bool:
        parts = urlsplit(url)
        path = unquote((parts.path or "/") + (f"?{parts.query}" if parts.query else ""))
        best = max(((size, allow) for rule, size, allow in self.rules if rule.match(path)), default=(0, True))
        return not best[1]


class FirstRules:
    """The first matching rule decides, as the common library reader has it."""

    def __init__(self, text: str, agent: str = "*"):
        self.agent, self.reader = agent, RobotFileParser()
        self.reader.parse(text.splitlines())

    def blocks(self, url: str) -> bool:
        return not self.reader.can_fetch(self.agent, url)


@functools.lru_cache(KEPT_TEXTS)
def compiled(text: str, policy: str = "first", agent: str = "*") -> FirstRules | LongestRules:
    """The rules of one text."""
    if policy not in POLICIES:
        raise ValueError(f"policy is one of {POLICIES}")
    return (FirstRules if policy == "first" else LongestRules)(text, agent)


def blocks(text: str | None, url: str, policy: str = "first") -> bool:
    """Whether the rules keep any agent from a URL; without a text nothing does, nor where the URL can't be read."""
    try:
        return bool(text) and compiled(text, policy).blocks(url)
    except ValueError:
        return False


def blocked_paths(url: str, robots: str, policy: str = "first") -> Column:
    """Whether a URL is disallowed for any agent; the texts of robots.txt are compiled once per worker."""

    @F.pandas_udf("boolean")
    def blocked(addresses: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([blocks(t, u or "", policy) for u, t in zip(addresses, texts)], dtype="bool")

    return blocked(F.col(url), F.col(robots))
