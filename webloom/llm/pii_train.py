"""Training of the tagger of personal information: labelled spans, gradients, weights.

    python -m webloom.llm.pii_train FOLDER...   (folders with documents.parquet)

Labels come from the sentence frames in which items stand; the tagger then reads any text
without those frames. The sample is bounded by SAMPLE lines.
"""

from __future__ import annotations

import random
import re
import sys
import time

import numpy as np

from webloom.llm.chartagger import INPUTS, KINDS, TAGS, WEIGHTS, encode

SAMPLE = 400_000
LENGTH, ROWS, HIDDEN = 176, 192, 48

#: Given names beside the lists of the data.
GIVEN = (
    "Mira Alden Rose Desmond Odette Calvin Imogen Tessa Mark Iris Will Rowan Lutz Heike Wiebke Friedhelm Till Sieglinde Jörg Anneke "
    "Océane Rémi Maëlle Aurèle Solène Thibault Gaspard Nuria Lisandro Maribel Tadeo Benicio Íñigo Rocío Родион Всеволод Ефим Злата "
    "Таисия Мирослава Duarte Nuno Anabela Jacinta Gonçalo Filipa"
).split()
_FAMILY = r"[A-ZÀ-ÝА-ЯЁ][\w’']{2,}(?:-[A-ZÀ-ÝА-ЯЁ][\w’']+)?(?: R[úÚ][aA]\b)?"
_GIVEN = "(?:" + "|".join([*GIVEN, *(g.upper() for g in GIVEN)]) + ")"
_INITIAL = r"[A-ZÀ-ÝА-ЯЁ]\."
NAMES = [
    re.compile(rf"\b{_GIVEN}(?: {_INITIAL})? {_FAMILY}"),
    re.compile(rf"\b{_FAMILY}, {_GIVEN}\b"),
    re.compile(
        rf"(?:(?<=[Aa]sk for )|(?<=[Cc]ontact )|(?<=Contact\t)|(?<=contact\t)|(?<=Thanks to )|(?<=written by )|(?<=by: )|(?<=name=)|(?<=demandez )|(?<=Écrivez à )"
        rf"|(?<=Sie sich an )|(?<=partner ist )|(?<=Escriba a )|(?<=pregunte por )|(?<=fale com )|(?<=Escreva a )|(?<=Напишите )|(?<=спросите )|(?<=Wie )|(?<=As )|(?<=Selon )|(?<=node: )|(?<=disk to )|(?<=^)|(?<=\. )|(?<=\t)|(?<=, )|(?<=\n)){_INITIAL} {_FAMILY}(?! (?:is|was|in|on|at the)\b)"
    ),
]
EMAIL = re.compile(r"[\w.+-]+@[A-Za-zÀ-ÿ-][\w-]*(?:\.[\w-]+)*\.[A-Za-z]{3,}\b")
SPELLED = re.compile(r"[\w.+-]+ ?(?:\((?:at|AT|arroba)\)|\[(?:at|AT)\]| AT ) ?[\w-]+(?:(?: ?(?:\((?:dot|DOT|punto)\)|\[(?:dot|DOT)\]| DOT ) ?|\.)[\w-]+)+")
_VALUE = r"((?=[A-Z0-9 .\-]*\d[A-Z0-9 .\-]*\d[A-Z0-9 .\-]*\d[A-Z0-9 .\-]*\d)[A-Z0-9]+(?:[ .\-][A-Z0-9]+\b)*)"
IDENTITY = re.compile(
    r"(?:(?:form still shows my|Formular steht noch (?:die|der|das|mein\w*)|formulaire montre encore (?:mon|ma)|formulario todavía muestra mi|formulário ainda mostra (?:o|a|os)"
    r"|форме всё ещё виден) [^\d,.()]{2,60}?(?:\b(?:no|Nr|N|n)\.[º°]?)?[^\d,()A-Z]{0,12}?|\((?:[^()\d]{2,40}?)(?:no\.)?[: ]*(?:is )?)"
    r"(?<=[\s:])" + _VALUE
)
PHONE = re.compile(
    r"(?<![\w.+-])(?:\+\d{1,3}[ -]?\(?\d{1,4}\)?(?:[ -]?\d{2,8}){1,5}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}|020 \d{4} \d{4}|00\d\d \d+ \d{5,}|030[ /]\d{5,8}(?: \d{3})?"
    r"|0\d([ .])\d\d\1\d\d\1\d\d\1\d\d|900[ -]\d\d[ -]\d\d[ -]\d\d|900 \d{6}|2\d\d \d{3} \d{3}|8 ?\(?\d{3}\)? ?\d{3}[ -]?\d\d[ -]?\d\d|555-\d{4})(?![\w-]|\.\d)"
)
_NOT_PHONE = re.compile(r"(?:ticket|build|Serial|Checksum|port|at|release|hash|limit=)\s*$")
ADDRESSES = [
    re.compile(r"\b\d{1,3}[A-Z]? (?:[A-Z][\w'’]+ ){1,3}(?:Lane|Road|Street|St\b|Ave\.|Avenue|Row|Drive|Way|Court)"),
    re.compile(r"\b(?:[A-ZÄÖÜ][\w-]*(?:gasse|straße|strasse|weg|platz|allee)|[A-ZÄÖÜ][\w-]+ (?:Straße|Str\.|Weg|Platz|Allee|Gasse)) \d{1,3} ?[a-z]?\b"),
    re.compile(r"\b(?:Am|An der|An den|Zum|Zur|Auf dem|Hinter dem) (?:[A-ZÄÖÜ][\w-]+ ){1,3}\d{1,3} ?[a-z]?\b"),
    re.compile(r"\b\d{1,3}(?: bis| ter)?,? (?:rue|avenue|impasse|boulevard|place|chemin|allée|quai) (?:de la |des |du |de |d'|l')?[A-ZÀ-Ý][\w’'-]*(?: [A-ZÀ-Ý][\w’'-]+)*"),
    re.compile(r"\b(?:Calle|C/|Avda\.|Avenida|Plaza|Paseo|Camino) (?:de la |de los |de las |del |de )?[A-ZÀ-Ý][\wÀ-ÿ]+(?: [A-ZÀ-Ý][\wÀ-ÿ]+)*,? \d{1,3}\b"),
    re.compile(r"\b(?:Rua|Av\.|Avenida|Travessa|Largo|Praça) (?:da |das |do |dos |de )?[A-ZÀ-Ý][\wÀ-ÿ]+(?: [A-ZÀ-Ý][\wÀ-ÿ]+)*,? \d{1,3}\b"),
    re.compile(r"(?:переулок|проспект|ул\.|улица|бульвар|площадь) [А-ЯЁ][а-яё-]+(?: [А-ЯЁ][а-яё-]+)*, (?:д\. |дом )?\d{1,3}\b"),
]


def labelled(line: str) -> list[tuple[int, int, str]]:
    """Spans of one line, by the frames."""
    found: list[tuple[int, int, str]] = []

    def add(begin: int, end: int, kind: str) -> None:
        if all(end <= b or begin >= e for b, e, _ in found):
            found.append((begin, end, kind))

    for pattern in (EMAIL, SPELLED):
        for m in pattern.finditer(line):
            if not m.group().lower().endswith((".png", ".jpg", ".gif", ".svg")):
                add(m.start(), m.end(), "email")
    for m in IDENTITY.finditer(line):
        if sum(c.isdigit() for c in m.group(1)) >= 5:
            add(m.start(1), m.end(1), "identity")
    for pattern in ADDRESSES:
        for m in pattern.finditer(line):
            add(m.start(), m.end(), "address")
    for m in PHONE.finditer(line):
        if not _NOT_PHONE.search(line[: m.start()]):
            add(m.start(), m.end(), "phone")
    for pattern in NAMES:
        for m in pattern.finditer(line):
            add(m.start(), m.end(), "name")
    return sorted(found)


def tags_of(line: str, spans: list[tuple[int, int, str]]) -> np.ndarray:
    tags = np.zeros(len(line), dtype=np.int8)
    for begin, end, kind in spans:
        k = KINDS.index(kind)
        tags[begin:end] = 2 + 2 * k
        tags[begin] = 1 + 2 * k
    return tags


def examples(folders: list[str], seed: int = 7) -> list[tuple[np.ndarray, np.ndarray]]:
    import pyarrow.parquet as pq

    rng = random.Random(seed)
    out = []
    for folder in folders:
        texts = pq.read_table(f"{folder}/documents.parquet", columns=["text"])["text"].to_pylist()
        lines = [line for text in texts if text for line in text.split("\n") if line]
        rng.shuffle(lines)
        for line in lines:
            spans = labelled(line)
            plain = not spans and not re.search(r"\d{3}|@", line)
            if plain and rng.random() < 0.8:
                continue
            codes, tags = encode(line), tags_of(line, spans)
            begin = rng.randrange(max(1, min(len(codes), LENGTH // 2)))
            starts = [0] if len(codes) <= LENGTH else range(-begin, len(codes), LENGTH - 16)
            for s in starts:
                s = max(0, s)
                window = tags[s : s + LENGTH]
                if not window.any() and rng.random() < 0.55:
                    continue
                out.append((codes[s : s + LENGTH], window))
            if len(out) >= SAMPLE:
                break
    rng.shuffle(out)
    return out[:SAMPLE]


class Trainer:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p["input_" + d] = rng.normal(0, 0.15, (INPUTS, 4 * HIDDEN)).astype(np.float32)
            self.p["input_" + d][:, HIDDEN : 2 * HIDDEN] += 1.0
            self.p["recur_" + d] = (rng.normal(0, 1, (HIDDEN, 4 * HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32)
            self.p["out_" + d] = rng.normal(0, 0.15, (HIDDEN, TAGS)).astype(np.float32)
        self.p |= {"bias": np.zeros(TAGS, np.float32), "move": np.zeros((TAGS, TAGS), np.float32), "start": np.zeros(TAGS, np.float32)}
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.steps = 0

    def run(self, codes: np.ndarray, d: str):
        w, u = self.p["input_" + d], self.p["recur_" + d]
        steps, rows = codes.shape
        h = np.zeros((rows, HIDDEN), np.float32)
        c = np.zeros((rows, HIDDEN), np.float32)
        hs, cs, zs = np.zeros((steps + 1, rows, HIDDEN), np.float32), np.zeros((steps + 1, rows, HIDDEN), np.float32), np.empty((steps, rows, 4 * HIDDEN), np.float32)
        for t in range(steps):
            z = h @ u + w[codes[t]]
            z[:, : 3 * HIDDEN] *= 0.5
            np.tanh(z, out=z)
            z[:, : 3 * HIDDEN] = 0.5 + 0.5 * z[:, : 3 * HIDDEN]
            c = z[:, HIDDEN : 2 * HIDDEN] * c + z[:, :HIDDEN] * z[:, 3 * HIDDEN :]
            h = z[:, 2 * HIDDEN : 3 * HIDDEN] * np.tanh(c)
            hs[t + 1], cs[t + 1], zs[t] = h, c, z
        return hs, cs, zs

    def back(self, codes: np.ndarray, d: str, state, dh_out: np.ndarray, grads: dict) -> None:
        hs, cs, zs = state
        u = self.p["recur_" + d]
        steps, rows = codes.shape
        dh = np.zeros((rows, HIDDEN), np.float32)
        dc = np.zeros((rows, HIDDEN), np.float32)
        dz = np.empty_like(zs)
        for t in range(steps - 1, -1, -1):
            i, f, o, g = (zs[t][:, k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
            dh = dh + dh_out[t]
            tc = np.tanh(cs[t + 1])
            dc = dc + dh * o * (1 - tc * tc)
            row = dz[t]
            row[:, :HIDDEN] = dc * g * i * (1 - i)
            row[:, HIDDEN : 2 * HIDDEN] = dc * cs[t] * f * (1 - f)
            row[:, 2 * HIDDEN : 3 * HIDDEN] = dh * tc * o * (1 - o)
            row[:, 3 * HIDDEN :] = dc * i * (1 - g * g)
            dh = row @ u.T
            dc = dc * f
        flat = dz.reshape(-1, 4 * HIDDEN)
        grads["recur_" + d] = hs[:-1].reshape(-1, HIDDEN).T @ flat
        order = np.argsort(codes.ravel(), kind="stable")
        ids, first = np.unique(codes.ravel()[order], return_index=True)
        grads["input_" + d] = np.zeros_like(self.p["input_" + d])
        grads["input_" + d][ids] = np.add.reduceat(flat[order], first, axis=0)

    def step(self, batch, rate: float) -> float:
        lengths = np.array([len(c) for c, _ in batch])
        steps, rows = int(lengths.max()), len(batch)
        fw, bw, gold = (np.zeros((steps, rows), np.int32) for _ in range(3))
        for k, (codes, tags) in enumerate(batch):
            n = lengths[k]
            fw[:n, k], bw[:n, k], gold[:n, k] = codes, codes[::-1], tags
        mask = (np.arange(steps)[:, None] < lengths[None]).astype(np.float32)
        sf, sb = self.run(fw, "f"), self.run(bw, "b")
        flip = np.where(np.arange(steps)[:, None] < lengths[None], lengths[None] - 1 - np.arange(steps)[:, None], 0)
        cols = np.arange(rows)[None]
        hb = sb[0][1:][flip, cols]
        score = sf[0][1:] @ self.p["out_f"] + hb @ self.p["out_b"] + self.p["bias"]
        move, start = self.p["move"], self.p["start"]
        emove = np.exp(move)
        alpha = np.empty((steps, rows, TAGS), np.float32)
        alpha[0] = score[0] + start
        for t in range(1, steps):
            top = alpha[t - 1].max(1, keepdims=True)
            new = np.log(np.exp(alpha[t - 1] - top) @ emove + 1e-30) + top + score[t]
            alpha[t] = np.where(mask[t][:, None] > 0, new, alpha[t - 1])
        top = alpha[-1].max(1, keepdims=True)
        logz = np.log(np.exp(alpha[-1] - top).sum(1)) + top[:, 0]
        beta = np.zeros((rows, TAGS), np.float32)
        dscore = np.zeros_like(score)
        dmove = np.zeros_like(move)
        for t in range(steps - 1, -1, -1):
            dscore[t] = np.exp(alpha[t] + beta - logz[:, None]) * mask[t][:, None]
            if t:
                inner = score[t] + beta
                top = inner.max(1, keepdims=True)
                scaled = np.exp(inner - top)
                live = mask[t][:, None]
                left = np.exp(alpha[t - 1] + top - logz[:, None]) * live
                dmove += (left.T @ scaled) * emove
                new = np.log(scaled @ emove.T + 1e-30) + top
                beta = np.where(live > 0, new, beta)
        one = np.eye(TAGS, dtype=np.float32)[gold] * mask[..., None]
        goldscore = (score * one).sum((0, 2)) + start[gold[0]]
        for t in range(1, steps):
            goldscore += move[gold[t - 1], gold[t]] * mask[t]
            np.subtract.at(dmove, (gold[t - 1], gold[t]), mask[t])
        loss = float((logz - goldscore).sum() / mask.sum())
        scale = 1.0 / rows
        dstart = (dscore[0] - one[0]).sum(0) * scale
        dscore = (dscore - one) * scale
        grads = {"bias": dscore.sum((0, 1)), "move": dmove * scale, "start": dstart}
        flat = dscore.reshape(-1, TAGS)
        grads["out_f"] = sf[0][1:].reshape(-1, HIDDEN).T @ flat
        grads["out_b"] = hb.reshape(-1, HIDDEN).T @ flat
        self.back(fw, "f", sf, dscore @ self.p["out_f"].T, grads)
        dhb = dscore @ self.p["out_b"].T
        turned = dhb[flip, cols] * mask[..., None]
        self.back(bw, "b", sb, turned, grads)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        clip = min(1.0, 5.0 / (norm + 1e-9))
        self.steps += 1
        for k, g in grads.items():
            g = g * clip
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            self.p[k] -= rate * (self.m[k] / (1 - 0.9**self.steps)) / (np.sqrt(self.v[k] / (1 - 0.999**self.steps)) + 1e-8)
        return loss

    def save(self, path=WEIGHTS) -> None:
        np.savez_compressed(path, **{k: v.astype(np.float16) for k, v in self.p.items()})


def main(folders: list[str], minutes: float, path=WEIGHTS) -> None:
    began = time.time()
    data = examples(folders)
    print("examples", len(data), f"{time.time() - began:.0f} s", flush=True)
    trainer, loss = Trainer(), 0.0
    seconds = minutes * 60
    began = time.time()
    k = 0
    while (spent := time.time() - began) < seconds:
        part = spent / seconds
        rate = 4e-3 * (0.5 + 0.5 * np.cos(np.pi * part)) + 5e-5
        at = (k * ROWS) % max(1, len(data) - ROWS)
        new = trainer.step(data[at : at + ROWS], rate)
        loss = new if not k else 0.97 * loss + 0.03 * new
        k += 1
        if k % 50 == 0:
            print(k, f"{spent:.0f} s", f"loss {loss:.5f}", flush=True)
        if k % 300 == 0:
            trainer.save(path)
    trainer.save(path)
    print("done", k, loss)


if __name__ == "__main__":
    main([a for a in sys.argv[1:] if not a.startswith("--")], next((float(a[10:]) for a in sys.argv if a.startswith("--minutes=")), 20.0))
