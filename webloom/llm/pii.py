"""Personal information in free text: found by the character tagger, replaced by typed placeholders.

Every line of every text is read by the tagger (chartagger.py). Its spans are then snapped
to whole tokens and checked for what their kind must hold; nothing is found beside it.
Null and empty texts hold nothing; equal lines of a batch are read once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from webloom.llm.chartagger import KINDS, Tagger
from webloom.llm.sizes import chunks

#: Abbreviations whose full stop belongs to an address.
_ABBREVIATIONS = ("ave.", "st.", "str.", "rd.", "blvd.", "dr.", "ln.", "sq.")
_EMAIL = re.compile(
    r"[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}"
    r"|[\w.+-]+ ?(?:[(\[{<] ?(?:at|arroba|ät|собака) ?[)\]}>]|\b(?:AT|ARROBA)\b) ?[\w-]+(?:(?: ?(?:[(\[{<] ?(?:dot|punkt|point|punto|ponto|точка) ?[)\]}>]|\b(?:DOT|PUNKT|POINT|PUNTO|PONTO)\b) ?|\.)[\w-]+)+",
    re.IGNORECASE,
)
_EDGES = " \t ,;:!?\"'«»„“”…"


def _tokens(line: str, begin: int, end: int) -> tuple[int, int]:
    """The span widened to whole tokens."""
    while begin > 0 and not line[begin - 1].isspace() and line[begin - 1] not in "=;<>(|\"«„“,:":
        begin -= 1
    while end < len(line) and not line[end].isspace() and line[end] not in "=;<>)|\"»“”,":
        end += 1
    while begin < end and line[begin] in _EDGES:
        begin += 1
    while end > begin and line[end - 1] in _EDGES:
        end -= 1
    return begin, end


def _email_at(line: str, begin: int, end: int) -> tuple[int, int] | None:
    for m in _EMAIL.finditer(line):
        if m.start() < end and m.end() > begin:
            return m.span()
    return None


def checked(line: str, begin: int, end: int, kind: str) -> tuple[int, int] | None:
    """The exact span of an item, or None where it lacks what its kind must hold."""
    if kind == "email":
        return _email_at(line, begin, end)
    begin, end = _tokens(line, begin, end)
    if kind == "phone":
        while begin < end and not (line[begin].isdigit() or line[begin] in "+("):
            begin += 1
        if line[begin:end].count("(") < line[begin:end].count(")") and begin and line[begin - 1] == "(":
            begin -= 1
        while end > begin and not line[end - 1].isdigit():
            end -= 1
        digits = sum(c.isdigit() for c in line[begin:end])
        return (begin, end) if 7 <= digits <= 15 and not any(c.isalpha() for c in line[begin:end]) else None
    if kind == "identity":
        while begin < end and not line[begin].isalnum():
            begin += 1
        while end > begin and not line[end - 1].isalnum():
            end -= 1
        return (begin, end) if sum(c.isdigit() for c in line[begin:end]) >= 4 else None
    value = line[begin:end]
    if kind == "address":
        if value.endswith(".") and not value.lower().endswith(_ABBREVIATIONS):
            end -= 1
        value = line[begin:end]
        return (begin, end) if any(c.isdigit() for c in value) and any(c.isupper() for c in value) else None
    if value.endswith("."):
        end -= 1
    words = re.split(r"[\s,]+", line[begin:end])
    if len(words) < 2 or not all(w[:1].isupper() for w in words) or any(c.isdigit() for c in line[begin:end]):
        return None
    return begin, end


def found_in(tagger: Tagger, lines: list[str]) -> list[list[tuple[int, int, str]]]:
    """Checked spans of each line, in order and without overlap."""
    out = []
    for line, spans in zip(lines, tagger.spans(lines)):
        kept: list[tuple[int, int, str]] = []
        for begin, end, kind in spans:
            if kind != "email" and (mail := _email_at(line, begin, end)) and "@" in line[slice(*mail)] and mail[0] <= begin:
                exact, kind = mail, "email"  # a name in an address is part of the address
            else:
                exact = checked(line, begin, end, kind)
            if exact and (not kept or exact[0] >= kept[-1][1]):
                kept.append((*exact, kind))
        out.append(kept)
    return out


def _spans_of_texts(tagger: Tagger, texts: list[str | None]) -> list[list[list[tuple[int, int, str]]]]:
    """For each text, for each of its lines, the spans."""
    split = [t.split("\n") if t else [] for t in texts]
    different = list({line: None for lines in split for line in lines if line.strip()})
    known = dict(zip(different, found_in(tagger, different)))
    return [[known.get(line, []) for line in lines] for lines in split]


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tagger = Tagger()
    for whole in batches:
        for batch in chunks(whole, "text", 400_000):
            texts = batch.column("text").to_pylist()
            rows = []
            for doc, text, lines in zip(batch.column("doc_id").to_pylist(), texts, _spans_of_texts(tagger, texts)):
                items = {(kind, line[b:e]) for line, spans in zip((text or "").split("\n"), lines) for b, e, kind in spans}
                rows += [(doc, kind, value) for kind, value in items]
            columns = list(zip(*rows)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()))], names=["doc_id", "kind", "value"])


def _redacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tagger = Tagger()
    for whole in batches:
        for batch in chunks(whole, "text", 400_000):
            texts = batch.column("text").to_pylist()
            new, counts = [], []
            for text, lines in zip(texts, _spans_of_texts(tagger, texts)):
                out, n = [], 0
                for line, spans in zip((text or "").split("\n"), lines):
                    for b, e, kind in reversed(spans):
                        line = f"{line[:b]}[{kind.upper()}]{line[e:]}"
                    n += len(spans)
                    out.append(line)
                new.append(None if text is None else "\n".join(out) if text else text)
                counts.append(n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(new, pa.string()), pa.array(counts, pa.int32())], names=["doc_id", "text", "replaced"])


def personal_items(df: DataFrame) -> DataFrame:
    """doc_id, kind and value of each different item of a text; a document stored twice gives its items once."""
    return df.select("doc_id", "text").mapInArrow(_found, "doc_id long, kind string, value string").distinct()


def redacted(df: DataFrame) -> DataFrame:
    """doc_id, text with [EMAIL], [PHONE], [IDENTITY], [ADDRESS], [NAME] in place of items, and their number."""
    return df.select("doc_id", "text").mapInArrow(_redacted, "doc_id long, text string, replaced int")


__all__ = ["KINDS", "personal_items", "redacted"]
