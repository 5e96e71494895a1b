"""Lines of texts as Arrow arrays, with the keys by which lines are compared.

All functions here work on one batch; they hold no state besides small caches.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: What a line looks like, as far as its own characters tell.
EMPTY, PROSE, TITLE, SHORT, VALUE, HEADING = 0, 1, 2, 3, 4, 5
#: A page with this many different long prose lines has a body of its own.
LONG_CHARS = 150

_BULLET = re.compile(r"^(?:[*•·–»#-]+\s+)+")
_DATE = re.compile(r"(\S*)\s*\b0([-./])0\2(?:0\b)")
_MARKS = re.compile(r"[:>»/|›→] ")
_LABEL = re.compile(r"^([^\s:]+(?: [^\s:]+){0,2}?)( ?:| [>»/|›→])(?= )")
_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-ÞА-ЯЁ][\w'’-]*\.?$")


def key64(text: str) -> int:
    """A signed 64-bit hash."""
    value = xxhash.xxh3_64_intdigest(text)
    return value - (1 << 64) if value >= 1 << 63 else value


def normalised(lines: pa.Array) -> pa.Array:
    """Lower case, single spaces, every number as 0."""
    low = pc.utf8_lower(pc.utf8_trim_whitespace(lines))
    return pc.replace_substring_regex(pc.binary_join(pc.utf8_split_whitespace(low), " "), r"[0-9]+", "0")


def shape(norm: str) -> int:
    """The look of a normalised line."""
    if not norm:
        return EMPTY
    if norm[0] == ">":
        return PROSE
    if norm[0] == "#" and norm[:7].lstrip("#")[:1] == " ":
        return HEADING
    words = norm.count(" ") + 1
    if words >= 12 and norm.rstrip("\"'”»)")[-1:] in ".!?…" or words >= 20 and ". " in norm:
        return PROSE
    if " = " in norm:
        return VALUE
    return TITLE if words >= 4 and norm[-1] not in ".!" else SHORT


def is_long(norm: str, kind: int) -> bool:
    return kind == PROSE and len(norm) >= LONG_CHARS


def patterns(raw: str, norm: str, kind: int) -> tuple[int, int, int]:
    """Keys of what a line of at most 260 characters shares with lines of the same make; 0 where there is none.

    They stand for the union-free expression of the line: a label before a text slot,
    a slot before a date or a slot of two or three names, and a slot between a fixed
    beginning and a fixed end.
    """
    label = form = middle = 0
    words = norm.split(" ")
    if kind != PROSE:
        if _MARKS.search(norm) and (m := _LABEL.match(_BULLET.sub("", norm))):
            label = key64("L " + m.group(1) + m.group(2))
        if len(words) <= 9:
            if "0" in norm and (m := _DATE.search(norm)):
                form = key64("D " + m.group(1))
            elif 2 <= len(words) <= 3 and all(_CAPITAL.match(t) for t in raw.split()):
                form = key64("N")
    if 7 <= len(words) <= 40:
        middle = key64(f"M {len(words)} {words[0]} {words[1]} {words[2]} … {words[-3]} {words[-2]} {words[-1]}")
    return label, form, middle


def title_keys(titles: list[str | None]) -> list[int]:
    """Keys of the pages' titles, to know the heading that repeats one."""
    norms = normalised(pa.array([t or "" for t in titles], pa.string())).to_pylist()
    return [key64(n) if n else 0 for n in norms]


@dataclass
class Places:
    """Lines of several pages one after the other: page i has those from offsets[i] to offsets[i + 1]."""

    offsets: np.ndarray
    keys: np.ndarray
    kinds: np.ndarray
    patterns: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def page(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.offsets))


class Lines:
    """The lines of a batch of texts; equal lines are looked at once."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        parts = pc.split_pattern(pc.fill_null(texts, ""), "\n")
        self.offsets = np.asarray(parts.offsets)
        coded = parts.flatten().dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False)
        self.raw = coded.dictionary
        self.norm = normalised(self.raw).to_pylist()
        self.keys = np.fromiter((key64(n) for n in self.norm), dtype=np.int64, count=len(self.norm))
        self.kinds = np.fromiter((shape(n) for n in self.norm), dtype=np.int8, count=len(self.norm))
        self.lengths = np.fromiter((len(n) for n in self.norm), dtype=np.int32, count=len(self.norm))
        self._patterns: np.ndarray | None = None

    @property
    def patterns(self) -> np.ndarray:
        """label, form and middle key of each different line."""
        if self._patterns is None:
            self._patterns = np.zeros((len(self.norm), 3), dtype=np.int64)
            few = np.flatnonzero((self.lengths <= 260) & np.isin(self.kinds, (TITLE, SHORT, PROSE)))
            raw = self.raw.take(pa.array(few)).to_pylist()
            rows = [patterns(r, self.norm[i], k) for r, i, k in zip(raw, few.tolist(), self.kinds[few].tolist())]
            if rows:
                self._patterns[few] = rows
        return self._patterns

    @property
    def longs(self) -> np.ndarray:
        return (self.kinds == PROSE) & (self.lengths >= LONG_CHARS)

    def places(self) -> Places:
        """The lines of all texts in order, as keys."""
        codes = self.codes
        return Places(self.offsets, self.keys[codes], self.kinds[codes], self.patterns[codes])

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def of(self, i: int) -> np.ndarray:
        """Codes of the lines of text i, in order."""
        return self.codes[self.offsets[i] : self.offsets[i + 1]]
