"""Languages of pages and of foreign lines, by compression.

Per language a raw-content zstandard dictionary is filled with sentences that function
words place beyond doubt, from a bounded sample of pages. A line belongs to the language
whose dictionary leaves the smallest frame; narrow margins are rejected. A page's main
language is the one most words of its main body are written in.
"""

from __future__ import annotations

import random
import re

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.features import Residuals
from webloom.llm.frames import Wrappers
from webloom.llm.pages import LANGUAGE_FIELD, hashed_sample, page_facts
from webloom.llm.words import FUNCTION_WORDS, WORD, language_of_label

LANGUAGES = tuple(FUNCTION_WORDS)
#: Pages from whose text the dictionaries are filled, and the size of each.
SAMPLE_PAGES = 4_000
DICTIONARY_BYTES = 128 * 1024
LEVEL = 3
#: The second smallest frame must be larger than the smallest by this share.
MARGIN = 0.04
LEAST_WORDS = 8

_SENTENCE = re.compile(r"(?<=[.!?…])\s+")
_MENU = re.compile(r"\s*[|•/·]\s*|[\s ]{3,}")
_TRAIL = re.compile(r"^\s*[^>»›/]{1,40}\s[>»›/]\s[^>»›/]{1,40}\s[>»›/]\s")
_TAGS = re.compile(r"^\s*[^\s:?]+(?:\s[^\s:?]+)?\s*:\s*[^\s,]+(?:,\s*[^\s,]+)+\s*$")
_SETS = {k: frozenset(v) for k, v in FUNCTION_WORDS.items()}


def prepared(text: str) -> str:
    """Lower-case words with single spaces around them."""
    return " " + " ".join(WORD.findall(text.lower())) + " "


def vote(words: list[str]) -> str | None:
    """The language whose function words stand out, or None."""
    counts = sorted(((sum(w in known for w in words), k) for k, known in _SETS.items()), reverse=True)
    return counts[0][1] if counts[0][0] >= 2 and counts[0][0] >= 1.5 * counts[1][0] else None


def dictionaries(texts: list[str]) -> dict[str, bytes]:
    """Content of each language's dictionary: sentences with different beginnings, after the function words."""
    heads: dict[str, dict[str, str]] = {k: {} for k in LANGUAGES}
    sizes = dict.fromkeys(LANGUAGES, 0)
    for text in texts:
        for line in text.split("\n"):
            if len(line) < 25:
                continue
            for sentence in _SENTENCE.split(line):
                clean = prepared(sentence)
                words = clean.split()
                head = " ".join(words[:4])
                if len(words) < 4 or any(head in heads[k] for k in LANGUAGES):
                    continue
                if (k := vote(words)) and sizes[k] < 4 * DICTIONARY_BYTES:
                    heads[k][head] = clean
                    sizes[k] += len(clean)
    out = {}
    for k in LANGUAGES:
        body = "".join(_varied(list(heads[k].values()))).encode()[:DICTIONARY_BYTES]
        out[k] = " ".join(FUNCTION_WORDS[k]).encode() + b" " + body
    return out


def _varied(sentences: list[str]) -> list[str]:
    """Sentences of mostly new word pairs first, so that every make of sentence gets in."""
    random.Random(5).shuffle(sentences)
    known: set[tuple[str, str]] = set()
    first, rest = [], []
    for sentence in sentences:
        words = sentence.split()
        pairs = set(zip(words, words[1:]))
        fresh = pairs - known
        (first if 2 * len(fresh) >= len(pairs) else rest).append(sentence)
        known |= fresh
    return first + rest


def fit_dictionaries(pages: DataFrame) -> dict[str, bytes]:
    """Dictionaries from the pages of least hash, SAMPLE_PAGES at most."""
    rows = hashed_sample(pages.select("page_id", "text"), "page_id", SAMPLE_PAGES, pages.count())
    return dictionaries([r.text for r in rows if r.text])


_CYRILLIC = re.compile("[\u0400-\u04ff]")


class Classifier:
    """The smallest of the frames that the dictionaries leave.

    A text without one Cyrillic letter is not held against the Russian dictionary.
    """

    def __init__(self, contents: dict[str, bytes]):
        self.names = list(contents)
        self.compressors = []
        for content in contents.values():
            raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False))
        self.known: dict[str, tuple[str | None, float]] = {}

    def __call__(self, clean: str) -> tuple[str | None, float]:
        """Language and margin of a prepared text; None where the margin is narrow."""
        if (found := self.known.get(clean)) is not None:
            return found
        data = clean.encode()
        latin = not _CYRILLIC.search(clean)
        sizes = [len(c.compress(data)) if not (latin and name == "ru") else 1 << 30 for name, c in zip(self.names, self.compressors)]
        order = sorted(range(len(sizes)), key=sizes.__getitem__)
        margin = (sizes[order[1]] - sizes[order[0]]) / sizes[order[0]]
        found = (self.names[order[0]] if margin >= MARGIN else None, margin)
        if len(clean) < 240:
            if len(self.known) > 60_000:
                self.known.clear()
            self.known[clean] = found
        return found


def is_list(raw: str) -> bool:
    """Is a line a menu, a breadcrumb or a list of tags?"""
    if _TRAIL.match(raw) or _TAGS.match(raw):
        return True
    parts = _MENU.split(raw.strip())
    return len(parts) >= 3 and max(len(p.split()) for p in parts) <= 3


_STRUCT = pa.list_(pa.struct([("line_no", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("named", pa.string())]))


def _column(contents: dict[str, bytes]):
    """Makes the function that gives each page of a batch its language and its lines in another one."""

    def make():
        classify = Classifier(contents)

        def column(batch: pa.RecordBatch, residual: Residuals) -> pa.Array:
            lines, masks = residual.lines, residual.masks
            low = pc.utf8_lower(lines.raw)
            clean = pc.utf8_trim_whitespace(pc.replace_substring_regex(low, r"[^\p{L}'’-]+", " ")).to_pylist()
            counts = pc.count_substring_regex(low, r"\p{L}+").to_pylist()
            seen: dict[int, tuple[str | None, float]] = {}

            def language(code: int) -> tuple[str | None, float]:
                if code not in seen:
                    seen[code] = classify(f" {clean[code]} ")
                return seen[code]

            out = []
            for i, label in enumerate(batch.column("language").to_pylist()):
                codes = lines.of(i).tolist()
                main = _main_language(codes, masks[i], counts, language) if any(counts[c] for c in codes) else None
                if main is None:
                    out.append([])
                    continue
                named = language_of_label(label)
                rows = [(-1, *main, named)]
                for at, code in enumerate(codes):
                    if counts[code] >= LEAST_WORDS:
                        lang, margin = language(code)
                        if lang and lang != main[0] and not is_list(lines.raw[code].as_py()):
                            rows.append((at, lang, margin, named))
                out.append([dict(zip(("line_no", "lang", "confidence", "named"), r)) for r in rows])
            return pa.array(out, _STRUCT)

        return column

    return make


def _main_language(codes: list[int], mask: list[bool], counts: list[int], language) -> tuple[str, float] | None:
    """Language of most words of the main body (of the whole page where the body tells nothing)."""
    for body in (True, False):
        words: dict[str, float] = {}
        margins: dict[str, float] = {}
        for code, framed in zip(codes, mask):
            if (body and framed) or counts[code] < 3:
                continue
            lang, margin = language(code)
            if lang:
                words[lang] = words.get(lang, 0) + counts[code]
                margins[lang] = margins.get(lang, 0) + counts[code] * margin
        if words:
            best = max(words, key=lambda k: (words[k], k))
            return best, words[best] / sum(words.values()) * min(1.0, margins[best] / words[best])
    return None


def page_facts_with_languages(pages: DataFrame, wrappers: Wrappers) -> DataFrame:
    """page_facts with each page's languages, in one reading of the texts."""
    return page_facts(pages, wrappers, _column(fit_dictionaries(pages)), LANGUAGE_FIELD)


def languages(facts: DataFrame) -> DataFrame:
    """page_id, line_no, lang, confidence, named (by the label): -1 for the page, then its lines in another language."""
    return facts.select("page_id", F.explode("languages").alias("l")).select("page_id", "l.*")


def wrong_or_foreign(found: DataFrame) -> DataFrame:
    """Pages whose label names no or another language, and all foreign lines."""
    return found.where("line_no >= 0 OR named IS NULL OR named <> lang").select("page_id", "line_no", "lang", "confidence")
