"""Path globs of scan profiles, as patterns for columns and for plain names."""

from __future__ import annotations

import re
from collections.abc import Callable


def _part(text: str) -> str:
    return "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in text)


def glob_regex(pattern: str) -> str:
    """A path glob as an anchored regular expression: ** spans folders, * and ? don't."""
    out, parts = [], pattern.split("/")
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            out.append("(?:.*)" if last else "(?:[^/]+/)*")
        else:
            out.append(_part(part) + ("" if last else "/"))
    return "^" + "".join(out) + "$"


def match_regex(pattern: str) -> str:
    """A glob matched from the right, where ** is like *: one folder."""
    return "(?:^|/)" + "/".join("[^/]*" if p == "**" else _part(p) for p in pattern.split("/")) + "$"


def token(pattern: str) -> str:
    """What is left of a glob, stars taken off, in lower case."""
    return pattern.replace("**/", "").replace("/**", "").replace("*", "").strip("/").lower()


def excludes(globs: list[str]) -> Callable[..., bool]:
    """A test of relative paths: matched from the right by a glob, or having a glob's token anywhere.

    For a folder (with a slash at its end) it holds only if it holds for all that can be in it: if the token is there.
    """
    matches = [re.compile(match_regex(g)) for g in globs]
    tokens = [t for t in map(token, globs) if t]

    def test(path: str, folder: bool = False) -> bool:
        low = path.lower()
        return any(t in low for t in tokens) or not folder and any(rx.search(path) for rx in matches)

    return test
