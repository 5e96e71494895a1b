"""What is left of pages without their frames, as arrays: spam features and residue evidence."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from webloom.llm import residue
from webloom.llm.frames import FrameReader
from webloom.llm.lines import EMPTY, HEADING, title_keys
from webloom.llm.words import FUNCTION_WORD_SET

FEATURES = (
    "words",
    "function_share",
    "sentence_share",
    "dull_share",
    "top_pair",
    "top_word",
    "distinct_share",
    "separator_rate",
    "tag_rate",
    "link_line_share",
    "short_line_share",
    "links_per_word",
    "long_word_share",
    "title_function_share",
    "title_pair",
    "repeated_line_share",
    "sentence_function_share",
    "top_triple",
)


def _top_share(page: np.ndarray, code: np.ndarray, pages: int) -> tuple[np.ndarray, np.ndarray]:
    """Per page the count of its most frequent code, and its number of different codes."""
    top, different = np.zeros(pages), np.zeros(pages)
    if len(page):
        with np.errstate(over="ignore"):
            mixed = code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        both = np.sort(page.astype(np.uint64) << np.uint64(40) | mixed >> np.uint64(24))
        first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
        counts = np.diff(np.r_[first, len(both)])
        owner = (both[first] >> np.uint64(40)).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        top[owner[starts]] = np.maximum.reduceat(counts, starts)
        different[owner[starts]] = np.diff(np.r_[starts, len(owner)])
    return top, different


class Words:
    """Tokens of many short texts: function words, lengths and codes by dictionary."""

    def __init__(self, low: pa.Array):
        letters = pc.replace_substring_regex(low, r"[^\p{L}'’]+", " ")
        parts = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(letters))
        lengths = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
        coded = parts.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.owner = np.repeat(np.arange(len(low)), lengths)
        table = lambda test: np.fromiter((test(w) for w in words), dtype=bool, count=len(words))
        real = table(bool)[self.codes] if len(words) else np.zeros(0, bool)
        self.codes, self.owner = self.codes[real], self.owner[real]
        self.function = (table(FUNCTION_WORD_SET.__contains__) | table(lambda w: w.split("'")[-1] in FUNCTION_WORD_SET or w.split("'")[0] in FUNCTION_WORD_SET))[self.codes] if len(words) else real
        self.latin = table(residue.LATIN.__contains__)[self.codes] if len(words) else real
        self.long = table(lambda w: len(w) > 16)[self.codes] if len(words) else real
        self.size = max(1, len(words))

    def per(self, flags: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(self.owner[flags], minlength=n).astype(float)

    def triples(self, unit_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Three words in a row of one unit, not all function words: owner and code."""
        ok = (self.owner[2:] == self.owner[:-2]) & ~(self.function[2:] & self.function[1:-1] & self.function[:-2])
        with np.errstate(over="ignore"):
            code = (self.codes[:-2] * self.size + self.codes[1:-1]) * np.int64(1_000_003) + self.codes[2:]
        return unit_of[self.owner[2:][ok]], code[ok]

    def pairs(self, unit_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Adjacent tokens of one unit, neither a function word: owner and code."""
        ok = (self.owner[1:] == self.owner[:-1]) & ~self.function[1:] & ~self.function[:-1]
        return unit_of[self.owner[1:][ok]], self.codes[:-1][ok] * self.size + self.codes[1:][ok]


class Residuals:
    """One batch of pages without their frames."""

    def __init__(self, reader: FrameReader, texts: pa.RecordBatch | pa.Array, titles: list[str | None], links: np.ndarray):
        self.pages = len(titles)
        lines, masks = reader(texts, title_keys(titles))
        self.lines, self.masks = lines, masks
        framed = np.fromiter((f for m in masks for f in m), dtype=bool, count=len(lines.codes))
        keep = ~framed & (lines.kinds[lines.codes] != EMPTY)
        page_of_line = np.repeat(np.arange(self.pages), np.diff(lines.offsets))[keep]
        codes = lines.codes[keep]
        self.page_of_line, self.line_codes = page_of_line, codes
        text = lines.raw.take(pa.array(codes))
        self.text = text
        low = pc.utf8_lower(pc.utf8_trim_whitespace(text))
        self.low = low
        broken = pc.split_pattern(pc.replace_substring_regex(low, r"([.!?…])[\s\p{Z}]+", r"\1" + "\n"), "\n")
        line_of_sentence = np.repeat(np.arange(len(codes)), pc.list_value_length(broken).to_numpy(zero_copy_only=False))
        sentences = broken.flatten()
        self.line_of_sentence, self.sentences = line_of_sentence, sentences
        self.words = Words(sentences)
        self.titles, self.links = titles, links

    def long_lines(self) -> np.ndarray:
        """Different long prose lines of each page."""
        longs = self.lines.longs[self.line_codes]
        return _top_share(self.page_of_line[longs], self.line_codes[longs].astype(np.int64), self.pages)[1]

    def features(self) -> np.ndarray:
        pages, lines, words = self.pages, len(self.line_codes), self.words
        every = np.ones(len(words.codes), bool)
        page_of_sentence = self.page_of_line[self.line_of_sentence] if lines else np.zeros(0, int)
        by_page = lambda owner, weight=None: np.bincount(owner, weights=weight, minlength=pages).astype(float)
        n_sentences = len(self.sentences)
        in_sentence, functions = words.per(every, n_sentences), words.per(words.function, n_sentences)
        in_line, line_functions = (np.bincount(self.line_of_sentence, weights=x, minlength=lines) for x in (in_sentence, functions))
        total = by_page(page_of_sentence, in_sentence)
        count = np.maximum(1, total)
        ended = pc.match_substring_regex(self.sentences, r"[.!?…][\"'”»)]*$").to_numpy(zero_copy_only=False).astype(bool) if n_sentences else np.zeros(0, bool)
        real = ended & (in_sentence >= 5) & (functions >= 0.12 * in_sentence)
        dull = (in_line >= 4) & (line_functions < 0.1 * in_line)
        short = (in_line < 7) & (in_line > 0)
        if lines:
            short &= ~pc.match_substring_regex(self.low, r"[.!?]$| = ").to_numpy(zero_copy_only=False).astype(bool)
            separators = pc.count_substring_regex(self.low, r"[,;|/·•]|[\s\p{Z}][-–][\s\p{Z}]").to_numpy(zero_copy_only=False)
            tags = pc.count_substring_regex(self.low, r"(?:^|\s)[#+][^\s#+]{2,}").to_numpy(zero_copy_only=False)
            linked = pc.match_substring_regex(self.low, r"https?://|\]\(").to_numpy(zero_copy_only=False).astype(float)
        else:
            separators = tags = linked = np.zeros(0)
        n_lines = np.maximum(1, by_page(self.page_of_line))
        content = ~words.function
        page_of_word = page_of_sentence[words.owner]
        pair_top = _top_share(*words.pairs(page_of_sentence), pages)[0]
        word_top, word_kinds = _top_share(page_of_word[content], words.codes[content], pages)
        line_kinds = _top_share(self.page_of_line, self.line_codes.astype(np.int64), pages)[1]
        titles = Words(pc.utf8_lower(pa.array([t or "" for t in self.titles], pa.string())))
        title_words = titles.per(np.ones(len(titles.codes), bool), pages)
        columns = [
            np.minimum(total, 5000),
            by_page(page_of_sentence, functions) / count,
            by_page(page_of_sentence[real], in_sentence[real]) / count,
            by_page(self.page_of_line[dull], in_line[dull]) / count,
            2 * np.maximum(0, pair_top - 2) / count,
            word_top / count,
            word_kinds / np.maximum(1, by_page(page_of_word[content])),
            by_page(self.page_of_line, separators) / count,
            by_page(self.page_of_line, tags) / count,
            by_page(self.page_of_line, linked) / n_lines,
            by_page(self.page_of_line[short]) / n_lines,
            np.minimum(20, self.links / count),
            by_page(page_of_word[words.long]) / count,
            titles.per(titles.function, pages) / np.maximum(1, title_words),
            self._title_pairs() / count,
            1 - line_kinds / n_lines,
            by_page(page_of_sentence[real], functions[real]) / np.maximum(1, by_page(page_of_sentence[real], in_sentence[real])),
            3 * np.maximum(0, _top_share(*words.triples(page_of_sentence), pages)[0] - 2) / count,
        ]
        return np.stack(columns, axis=1)

    def _title_pairs(self) -> np.ndarray:
        """Twice the places of the title's first content pair in the residual."""
        out = np.zeros(self.pages)
        joined: list[list[str]] = [[] for _ in range(self.pages)]
        hard = [t.lower().split() for t in (t or "" for t in self.titles)]
        want = {i: " ".join(w[:2]) for i, w in enumerate(hard) if len(w) >= 2 and not (w[0] in FUNCTION_WORD_SET or w[1] in FUNCTION_WORD_SET)}
        if not want:
            return out
        chosen = np.isin(self.page_of_line, np.fromiter(want, dtype=np.int64, count=len(want)))
        for page, line in zip(self.page_of_line[chosen].tolist(), self.low.filter(pa.array(chosen)).to_pylist()):
            joined[page].append(line)
        for i, pair in want.items():
            out[i] = 2 * sum(line.count(pair) for line in joined[i])
        return out

    def placeholders(self) -> np.ndarray:
        """Unfilled placeholders in title and residual."""
        out = np.zeros(self.pages)
        for i, title in enumerate(self.titles):
            if title:
                out[i] += residue.placeholders(title)
        if len(self.text):
            hits = pc.match_substring_regex(self.text, r"[{\[$%@_<]|undefined").to_numpy(zero_copy_only=False).astype(bool)
            for page, line in zip(self.page_of_line[hits].tolist(), self.text.filter(pa.array(hits)).to_pylist()):
                out[page] += residue.placeholders(line)
        return out

    def notices(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Characters of the residual's notices, of all its content lines, and for each line: is it a notice?"""
        lines = len(self.line_codes)
        if not lines:
            return np.zeros(self.pages), np.zeros(self.pages), np.zeros(0, bool)
        n = len(self.sentences)
        every = np.ones(len(self.words.codes), bool)
        in_sentence, latin = self.words.per(every, n), self.words.per(self.words.latin, n)
        marked = (in_sentence >= 4) & (latin >= 0.8 * in_sentence)
        maybe = pc.match_substring_regex(self.sentences, residue.STEMS).to_numpy(zero_copy_only=False).astype(bool) & ~marked
        maybe &= ~self._beyond_doubt(maybe | marked)[self.page_of_line[self.line_of_sentence]]
        marked[maybe] = [bool(residue.NOTICE.search(" ".join(s.split()))) for s in self.sentences.filter(pa.array(maybe)).to_pylist()]
        chars = pc.utf8_length(self.sentences).to_numpy(zero_copy_only=False).astype(float)
        length = np.bincount(self.line_of_sentence, weights=chars, minlength=lines)
        in_notice = np.bincount(self.line_of_sentence, weights=chars * marked, minlength=lines)
        whole = (in_notice > 0) & (length <= residue.NOTICE_LINE)
        in_notice[whole] = length[whole]
        title = np.array(title_keys(self.titles), dtype=np.int64)
        keys, kinds = self.lines.keys[self.line_codes], self.lines.kinds[self.line_codes]
        neutral = ~whole & ((kinds == HEADING) | (keys == title[self.page_of_line]))
        shorts = np.flatnonzero(~whole & (length < 60))
        neutral[shorts] |= np.array([residue.is_stamp(t) for t in self.low.take(pa.array(shorts, pa.int64())).to_pylist()], dtype=bool)
        length[neutral] = 0
        by_page = lambda w: np.bincount(self.page_of_line, weights=w, minlength=self.pages)
        self.open_lines = np.flatnonzero((length >= residue.LEARNED_CHARS) & (in_notice <= 0.5 * length))
        self.line_length = length
        return by_page(in_notice), by_page(length), in_notice > 0.5 * np.maximum(1, length)

    def _beyond_doubt(self, maybe: np.ndarray) -> np.ndarray:
        """Pages with a body of which less than half could be notices even if every possible sentence were one: no need to look closer."""
        lines = len(self.line_codes)
        chars = pc.utf8_length(self.sentences).to_numpy(zero_copy_only=False).astype(float)
        length = np.bincount(self.line_of_sentence, weights=chars, minlength=lines)
        most = np.bincount(self.line_of_sentence, weights=chars * maybe, minlength=lines)
        most = np.where((most > 0) & (length <= residue.NOTICE_LINE), length, most)
        title = np.array(title_keys(self.titles), dtype=np.int64)
        sure = (length >= 60) & (self.lines.kinds[self.line_codes] != HEADING) & (self.lines.keys[self.line_codes] != title[self.page_of_line])
        by_page = lambda w: np.bincount(self.page_of_line, weights=w, minlength=self.pages)
        return (by_page(most) < 0.5 * by_page(length * sure)) & (self.long_lines() >= 2)

    def bodyless_lines(self) -> pa.Array:
        """Of pages without a body of their own: key and characters of the lines that are no notice yet (after notices())."""
        bare = self.long_lines() < 2
        rows: list[list[dict]] = [[] for _ in range(self.pages)]
        for at in getattr(self, "open_lines", np.zeros(0, int)).tolist():
            if bare[self.page_of_line[at]]:
                rows[self.page_of_line[at]].append({"key": int(self.lines.keys[self.line_codes[at]]), "chars": float(self.line_length[at])})
        return pa.array(rows, pa.list_(pa.struct([("key", pa.int64()), ("chars", pa.float64())])))
