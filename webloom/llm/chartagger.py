"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Weights are trained by pii_train.py and stored beside this module. A text is tagged line
by line; long lines are read in overlapping windows whose scores are blended, and one
Viterbi pass per line reconciles them.
"""

from __future__ import annotations

import io
import pkgutil
import unicodedata
from pathlib import Path

import numpy as np

KINDS = ("email", "phone", "identity", "address", "name")
#: Tag 0 is outside; 1 + 2k begins kind k, 2 + 2k continues it.
TAGS = 1 + 2 * len(KINDS)
WINDOW, OVERLAP = 320, 64
WEIGHTS = Path(__file__).with_name("pii_weights.npz")

_PUNCTUATION = " \n\t.,;:!?-_'\"()[]{}<>@+/\\|&#=*%$~^`°º№–—…«»„“”’"
_LATIN = "abcdefghijklmnopqrstuvwxyz"
_CYRILLIC = "абвгдежзийклмнопрстуфхцчшщъыьэюя"
#: ids: 0 padding, 1 other symbol, 2 other letter, 3 digit, then the listed characters.
VOCABULARY = 4 + len(_PUNCTUATION) + len(_LATIN) + len(_CYRILLIC)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.ones(0x10000, dtype=np.uint8)
    upper = np.zeros(0x10000, dtype=np.uint8)
    accent = np.zeros(0x10000, dtype=np.uint8)
    place = {c: 4 + i for i, c in enumerate(_PUNCTUATION + _LATIN + _CYRILLIC)}
    for code in range(0x10000):
        if 0xD800 <= code < 0xE000:
            continue
        char = chr(code)
        low = char.lower()
        base = unicodedata.normalize("NFKD", low)[:1]
        if char.isspace() and char not in place:
            base = " "
        if low in place:
            ids[code] = place[low]
        elif base in place:
            ids[code] = place[base]
            accent[code] = base.isalpha()
        elif char.isdigit():
            ids[code] = 3
        elif char.isalpha():
            ids[code] = 2
        upper[code] = char.isupper()
    ids[ord("0") : ord("9") + 1] = 3
    return ids, upper, accent


IDS, UPPER, ACCENT = _tables()
#: One row of input weights per character id, per id in upper case and per accented id.
INPUTS = 2 * VOCABULARY


def encode(text: str) -> np.ndarray:
    """A row number of the input weights for each character; beyond the BMP: other symbol."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = np.where(codes < 0x10000, codes, 1)
    return IDS[codes].astype(np.int32) + VOCABULARY * UPPER[codes].astype(np.int32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Tagger:
    def __init__(self, path: Path | str | None = None):
        source = path or io.BytesIO(pkgutil.get_data(__package__, WEIGHTS.name))
        with np.load(source) as stored:
            self.weights = {k: stored[k].astype(np.float32) for k in stored.files}
        self.hidden = self.weights["recur_f"].shape[0]

    def _direction(self, codes: np.ndarray, name: str) -> np.ndarray:
        """codes: steps x rows. Hidden states: steps x rows x hidden."""
        w, u = self.weights["input_" + name], self.weights["recur_" + name]
        steps, rows = codes.shape
        size = self.hidden
        h = np.zeros((rows, size), dtype=np.float32)
        c = np.zeros((rows, size), dtype=np.float32)
        out = np.empty((steps, rows, size), dtype=np.float32)
        for t in range(steps):
            z = h @ u
            z += w[codes[t]]
            gates = z[:, : 3 * size]
            np.multiply(gates, 0.5, out=gates)
            np.tanh(z, out=z)
            gates *= 0.5
            gates += 0.5
            c *= z[:, size : 2 * size]
            c += z[:, :size] * z[:, 3 * size :]
            h = z[:, 2 * size : 3 * size] * np.tanh(c)
            out[t] = h
        return out

    def scores(self, windows: list[np.ndarray]) -> list[np.ndarray]:
        """Tag scores of each window; windows of like length are read together."""
        out: list[np.ndarray] = [np.zeros((0, TAGS), dtype=np.float32)] * len(windows)
        order = sorted(range(len(windows)), key=lambda i: len(windows[i]))
        at = 0
        while at < len(order):
            longest = len(windows[order[min(at + 255, len(order) - 1)]])
            chosen = order[at : at + 256]
            at += 256
            forward = np.zeros((longest, len(chosen)), dtype=np.int32)
            backward = np.zeros((longest, len(chosen)), dtype=np.int32)
            for k, i in enumerate(chosen):
                forward[: len(windows[i]), k] = windows[i]
                backward[: len(windows[i]), k] = windows[i][::-1]
            f = self._direction(forward, "f") @ self.weights["out_f"]
            b = self._direction(backward, "b") @ self.weights["out_b"]
            for k, i in enumerate(chosen):
                n = len(windows[i])
                out[i] = f[:n, k] + b[:n, k][::-1] + self.weights["bias"]
        return out

    def best_tags(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi over whole lines."""
        move, start = self.weights["move"], self.weights["start"]
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int8)] * len(scores)
        order = sorted((i for i in range(len(scores)) if len(scores[i])), key=lambda i: len(scores[i]))
        for at in range(0, len(order), 256):
            chosen = order[at : at + 256]
            lengths = np.array([len(scores[i]) for i in chosen])
            steps = int(lengths.max())
            if len(chosen) > 1 and steps * len(chosen) > 2_000_000:
                half = len(chosen) // 2
                for part in (chosen[:half], chosen[half:]):
                    for i, tags in zip(part, self.best_tags([scores[i] for i in part])):
                        out[i] = tags
                continue
            table = np.zeros((steps, len(chosen), TAGS), dtype=np.float32)
            for k, i in enumerate(chosen):
                table[: lengths[k], k] = scores[i]
            back = np.zeros((steps, len(chosen), TAGS), dtype=np.int8)
            best = table[0] + start
            rows = np.arange(len(chosen))
            last = np.zeros((len(chosen), TAGS), dtype=np.float32)
            last[lengths == 1] = best[lengths == 1]
            for t in range(1, steps):
                both = best[:, :, None] + move[None]
                back[t] = both.argmax(axis=1)
                best = both.max(axis=1) + table[t]
                ends = lengths == t + 1
                last[ends] = best[ends]
            for k, i in enumerate(chosen):
                n = lengths[k]
                tags = np.empty(n, dtype=np.int8)
                tags[-1] = last[k].argmax()
                for t in range(n - 1, 0, -1):
                    tags[t - 1] = back[t, k, tags[t]]
                out[i] = tags
            del rows
        return out

    def spans(self, lines: list[str]) -> list[list[tuple[int, int, str]]]:
        """(begin, end, kind) of each line, from one reconciled tag sequence."""
        codes = [encode(line) for line in lines]
        windows, places = [], []
        for i, row in enumerate(codes):
            begin = 0
            while True:
                end = min(len(row), begin + WINDOW)
                windows.append(row[begin:end])
                places.append((i, begin))
                if end == len(row):
                    break
                begin = end - OVERLAP
        whole: list[np.ndarray] = [np.zeros((len(row), TAGS), dtype=np.float32) for row in codes]
        ramp = np.linspace(0, 1, OVERLAP + 2, dtype=np.float32)[1:-1, None]
        for (i, begin), score in zip(places, self.scores(windows)):
            if begin:
                score = score.copy()
                score[:OVERLAP] *= ramp[: len(score)]
                whole[i][begin : begin + OVERLAP] *= ramp[::-1][: len(score)]
            whole[i][begin : begin + len(score)] += score
        return [_spans_of(tags) for tags in self.best_tags(whole)]


def _spans_of(tags: np.ndarray) -> list[tuple[int, int, str]]:
    out = []
    marked = np.flatnonzero(tags)
    if not len(marked):
        return out
    begin, kind = -1, -1
    for t in [*marked.tolist(), len(tags)]:
        tag = int(tags[t]) if t < len(tags) else 0
        this = (tag - 1) // 2 if tag else -1
        if begin >= 0 and (t != end or this != kind or tag % 2 == 1):
            out.append((begin, end, KINDS[kind]))
            begin = -1
        if tag:
            if begin < 0:
                begin, kind = t, this
            end = t + 1
    return out
