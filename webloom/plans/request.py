"""Query strings to typed requests."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from webloom.functions.text import STOP_WORDS

#: Operators of the query language and the request fields they set.
MODIFIERS = {"site": "site", "tld": "tld", "inurl": "inurl", "filetype": "file_type", "author": "author", "language": "language"}
_SEPARATORS = str.maketrans({c: " " for c in "/\\;:,.!?()[]{}<>|&=*"})


@dataclass
class Request:
    terms: list[str] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)
    phrases: list[str] = field(default_factory=list)
    excluded_phrases: list[str] = field(default_factory=list)
    site: str | None = None
    tld: str | None = None
    inurl: str | None = None
    file_type: str | None = None
    author: str | None = None
    language: str | None = None
    near: bool = False
    newest_first: bool = False
    offset: int = 0
    limit: int = 10
    since: str | None = None
    until: str | None = None


def _unique(words: list[str]) -> list[str]:
    return list(dict.fromkeys(words))


def words_of(text: str) -> list[str]:
    """Lower-case words; those of one character go when longer ones are there."""
    words = _unique([w for w in text.lower().translate(_SEPARATORS).replace('"', " ").split() if w.strip("-+")])
    long = [w for w in words if len(w) > 1]
    return long or words


def parse(raw: str, limit: int = 10, offset: int = 0) -> Request:
    """Quotes make phrases, a leading - excludes, name:value sets a filter, /near and /date switch modes."""
    request = Request(limit=max(1, min(int(limit), 500)), offset=max(0, int(offset)))
    for sign, quoted, bare in re.findall(r'([+-]?)(?:"([^"]*)"|(\S+))', raw or ""):
        if quoted:
            words = quoted.lower().split()
            if not words:
                continue
            (request.excluded_phrases if sign == "-" else request.phrases).append(" ".join(words))
            (request.excluded if sign == "-" and len(words) == 1 else request.terms if sign != "-" else []).extend(words)
            continue
        if not bare:
            continue
        name, _, value = bare.partition(":")
        if value and name.lower() in MODIFIERS and not sign:
            setattr(request, MODIFIERS[name.lower()], value.lower())
        elif bare.lower() == "/near":
            request.near = True
        elif bare.lower() == "/date":
            request.newest_first = True
        else:
            (request.excluded if sign == "-" else request.terms).extend(words_of(bare))
    request.terms = [t for t in _unique(request.terms) if t not in request.excluded]
    request.excluded = _unique(request.excluded)
    return request


def validated(request: Request) -> Request:
    """Defaults and bounds; a pattern that cannot be compiled is an error of the caller."""
    if request.inurl:
        re.compile(re.escape(request.inurl))
    if request.since and request.until and request.since > request.until:
        raise ValueError("since is after until")
    return request


def requirements(request: Request) -> list[tuple[int, str]]:
    """Different content terms with their places; stop words drop out unless there is nothing else."""
    numbered = list(enumerate(_unique(request.terms)))
    content = [(i, t) for i, t in numbered if t not in STOP_WORDS]
    return content or numbered
