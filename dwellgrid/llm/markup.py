"""Tags of a page, found in one pass over its characters whatever they are.

Attributes are read as browsers read them: an unquoted value runs to white
space or the tag's end and may hold quotes, a stray quote after a value begins
another name, a quoted value without its end and a tag without its end run to
the end of the page. No position is looked at more than a fixed number of
times, so a page costs what its length says.
"""

from __future__ import annotations

import re

_OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|!--|[!?])")
# one attribute: the tag's end, or a name and perhaps a value
_NEXT = re.compile(r"[\s/]*(?:(>)|(=?[^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>\"'][^\s>]*)?))?)")
_COMMENT = re.compile(r"-->|--!>")


class Tag:
    """``page[start:end]``: a tag, or a comment or declaration with no name."""

    __slots__ = ("start", "end", "closing", "name", "attributes", "empty")

    def __init__(self, start: int, end: int, closing: bool, name: str, attributes: dict[str, str], empty: bool):
        self.start, self.end, self.closing, self.name, self.attributes, self.empty = start, end, closing, name, attributes, empty


def next_tag(page: str, at: int) -> Tag | None:
    """The first tag, comment or declaration from ``at`` on."""
    m = _OPEN.search(page, at)
    if m is None:
        return None
    size = len(page)
    if m[2] is None:
        if m[0] == "<!--":
            if page.startswith((">", "->"), m.end()):
                return Tag(m.start(), page.index(">", m.end()) + 1, False, "", {}, False)
            end = _COMMENT.search(page, m.end())
            return Tag(m.start(), end.end() if end else size, False, "", {}, False)
        end = page.find(">", m.end())
        return Tag(m.start(), end + 1 if end >= 0 else size, False, "", {}, False)
    found: dict[str, str] = {}
    at, name = m.end(), m[2].lower()
    while at < size:
        a = _NEXT.match(page, at)
        if a[1]:
            return Tag(m.start(), a.end(), bool(m[1]), name, found, page[a.end() - 2] == "/")
        if a.end() == at:
            break
        if a[2]:
            found.setdefault(a[2].lower(), a[3] or a[4] or a[5] or "")  # of two attributes of one name the first counts
        at = a.end()
    return Tag(m.start(), size, bool(m[1]), name, found, False)


def raw_end(page: str, name: str, at: int) -> int:
    """Where the text of a script, style or the like that begins at ``at`` is over, behind its end tag."""
    m = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
    return m.end() if m else len(page)
