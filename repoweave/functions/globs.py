"""File globs as regular expressions, for matching in a Column."""

from __future__ import annotations

import re


def glob_regex(glob: str, dot: bool = False) -> str:
    """Anchored regex for a shell glob: ``*``, ``?``, ``[..]``, ``{a,b}`` and ``**`` directories.

    Without ``dot`` a wildcard never matches a leading dot of a path segment.
    """
    segments = glob.split("/")
    out = []
    for i, segment in enumerate(segments):
        last = i == len(segments) - 1
        if segment == "**":
            step = r"[^/]+" if dot else r"[^/.][^/]*"
            out.append(f"{step}(?:/{step})*" if last else f"(?:{step}/)*")
        else:
            out.append(_segment_regex(segment, dot) + ("" if last else "/"))
    return "^" + "".join(out) + r"\z"


def _segment_regex(segment: str, dot: bool) -> str:
    out, i = "", 0
    while i < len(segment):
        ch = segment[i]
        if ch == "*":
            while segment[i:i + 1] == "*":
                i += 1
            rest = segment[i:]
            if out:
                out += "[^/]*"
            elif dot:
                out += "[^/]*" if rest else "[^/]+"
            elif not rest or rest.startswith("."):
                out += "[^/.][^/]*"
            else:
                out += "(?:[^/.][^/]*)?"
            continue
        if ch == "?":
            out += "[^/]" if out or dot else "[^/.]"
        elif ch == "[" and "]" in segment[i + 2:]:
            end = segment.index("]", i + 2)
            body = segment[i + 1:end]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", r"\\") + "]"
            i = end
        elif ch == "{" and "}" in segment[i:]:
            end = segment.index("}", i)
            out += "(?:" + "|".join(re.escape(x) for x in segment[i + 1:end].split(",")) + ")"
            i = end
        else:
            out += re.escape(ch)
        i += 1
    return out


def any_glob_regex(globs: list[str], dot: bool = False) -> str:
    return "|".join(glob_regex(g, dot) for g in globs)
