"""Small crawls with known frames, bodies and oddities."""

from __future__ import annotations

import random

_A, _B = "bra cor del fen gim hal jor kel lum mor nep ost pril quin rav".split(), "ack bit cur dan eft gol hum ist jam lop".split()
NOUNS = [a + b for a in _A for b in _B] + [a + b + "er" for a in _A for b in _B]
VERBS = [b + a + "s" for a in _A for b in _B]
TEMPLATES = (
    "The {n} {v} the {n} of {n} {d} before the {n} {v} it again.",
    "If a {n} {v} {d} of our {n} rows, then the {n} and the {n} stay as they are.",
    "Nobody knows why {n} {v} when the {n} is not in the {n} for {d} days.",
    "We have {d} of them on {n}, but this {n} {v} only what the {n} gives to it.",
    "After the {n} there is a {n} that {v} by {d}, so the {n} was left in its {n}.",
)
FRAMES = {
    "alpha.test": ["Skip to content", "Home | News | Contact | Torvix", "Cookies help us deliver this service to measure how the site is used. OK, got it!", "© 2025 Alpha"],
    "beta.test": ["- Home", "- Archive", "- Contact", "All rights reserved – Beta zork; see our terms of use and privacy statement.", "Beta is run by volunteers. Imprint, privacy, accessibility."],
    "gamma.test": ["* [Blog](/0)", "* [Search](/1)", "Gamma > Docs > about", "Enter your address to get the weekly digest"],
}


def sentence(rng: random.Random) -> str:
    parts = rng.choice(TEMPLATES).replace("{n}", "\0").replace("{v}", "\1").replace("{d}", "\2")
    return "".join(rng.choice(NOUNS) if c == "\0" else rng.choice(VERBS) if c == "\1" else str(rng.randrange(9999)) if c == "\2" else c for c in parts)


def paragraph(rng: random.Random, n: int = 4) -> str:
    return " ".join(sentence(rng) for _ in range(n))


def title(rng: random.Random) -> str:
    return f"Why the {rng.choice(NOUNS)} {rng.choice(VERBS)} every {rng.choice(NOUNS)} ({rng.randrange(9999)})"


def page(rng: random.Random, host: str, paragraphs: list[str], head: str) -> tuple[str, list[int]]:
    """A text and the places of its frame lines."""
    frame = FRAMES[host]
    lines = [(x, True) for x in frame[:-1]] + [(head, False)] + [(f"By Mira Quillane on {rng.randrange(1, 28)}.0{rng.randrange(1, 9)}.2024", True)]
    lines += [(p, False) for p in paragraphs[:2]] + [(f"{rng.choice(NOUNS)}.{rng.choice(NOUNS)} = {rng.randrange(99)}", False)] + [("Related posts »", True)] + [(f"* {title(rng)}", True) for _ in range(3)]
    lines += [(p, False) for p in paragraphs[2:]] + [(f"Tags: {rng.choice(NOUNS)}, {rng.choice(NOUNS)}", True), (frame[-1], True)]
    return "\n".join(t for t, _ in lines), [i for i, (_, f) in enumerate(lines) if f]


def crawl(n: int = 90, seed: int = 4) -> list[dict]:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        host = list(FRAMES)[i % 3]
        head = title(rng)
        body = [paragraph(rng) for _ in range(5)]
        text, framed = page(rng, host, body, head)
        out.append({"id": i, "url": f"https://www.{host}/p/{i}", "title": head, "text": text, "framed": framed, "body": body})
    return out


RESULT_SCHEMA = "result_id long, request_id string, base_url string, url string, raw_content string, text string, host_key string, key int, a int, class_id string"
PAGE_SCHEMA = "page_id long, url string, title string, text string, links array<string>, language string, record_id int, line_no string, spam string, features int, lang double"


def results_frame(spark, rows: list[tuple]):
    """(result_id, url, raw_content) with columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, "r", "https://base.test/", u, t, "x", "y", 1, 2, "z") for i, u, t in rows], RESULT_SCHEMA)


def pages_frame(spark, rows: list[tuple]):
    """(page_id, url, title, text, links, language) with clashing columns."""
    return spark.createDataFrame([(*r, 1, "x", "y", 2, 0.5) for r in rows], PAGE_SCHEMA)


ODD_TEXTS = [None, "", " ", "\n\n\n", "word", "Skip to content", "x" * 200_000, ("long line. " * 4000).strip(), " ", "a\tb", "🙂 🙂 🙂"]
