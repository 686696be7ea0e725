"""Small helpers of these tests."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter


def lower(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def alnum_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def space_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def crc(i) -> int:
    return zlib.crc32(str(i).encode())


def nearest_language(model, text: str | None, size: int) -> tuple[str, float, bool]:
    """Language, score and whether it is rejected, by plain loops over a model's centroids."""
    low = []
    for c in text or "":
        one = c.lower() if len(c.lower()) == 1 else c
        low.append(ord(one) if c.isalpha() else 0)
    letters = sum(x > 0 for x in low)
    runs = [x for i, x in enumerate(low) if x or not i or low[i - 1]]
    line, counts = [0, *runs, 0], Counter()
    for i in range(len(line) - 1):
        two = (line[i] * 0x9E3779B1 + line[i + 1] * 0x85EBCA77) % 2**32
        for x in [two] + ([(two * 0xC2B2AE3D + line[i + 2] * 0x27D4EB2F) % 2**32] if i + 2 < len(line) else []):
            x = ((x ^ (x >> 15)) * 0x2C1B3C6D) % 2**32
            counts[(x >> 16) & (size - 1)] += 1
    vector = {k: math.log1p(c) * float(model.idf[k]) for k, c in counts.items()}
    norm = math.sqrt(sum(v * v for v in vector.values())) or 1.0
    cos = [sum(v / norm * float(centre[k]) for k, v in vector.items()) for centre in model.centroids]
    if not letters or not cos:
        return "und", 0.0, True
    best = max(range(len(cos)), key=cos.__getitem__)
    total = sum(counts.values())
    floor = model.floors[model.owner[best]][0 if total < 32 else 1 if total < 128 else 2 if total < 512 else 3]
    return model.langs[model.owner[best]], cos[best], cos[best] < floor


def window_score(net, words: list[str], rows) -> float:
    """A window's logit, a word and a number at a time. rows: table rows of a word and of its n-grams."""
    p, h = net.p, len(net.p["v"])
    squash = lambda x: x / (1 + abs(x))
    gate = lambda x: squash(x) / 2 + 0.5
    states = [[0.0] * 2 * h for _ in words]
    for d, order, at in (("f", range(len(words)), 0), ("b", range(len(words) - 1, -1, -1), h)):
        s = [0.0] * h
        for i in order:
            word, grams = rows(words[i])
            x = [float(p["word"][word][e]) + sum(float(p["gram"][g][e]) for g in grams) / math.sqrt(len(grams)) for e in range(len(p["word"][0]))]
            g = [sum(x[e] * float(p[f"w{d}"][e][j]) for e in range(len(x))) + float(p[f"c{d}"][j]) for j in range(3 * h)]
            u = [[float(v) for v in row] for row in p[f"u{d}"]]
            z, r = ([gate(g[a + j] + sum(s[k] * u[k][a + j] for k in range(h))) for j in range(h)] for a in (0, h))
            c = [squash(g[2 * h + j] + sum(r[k] * s[k] * u[k][2 * h + j] for k in range(h))) for j in range(h)]
            s = [a + b * (y - a) for a, b, y in zip(s, z, c, strict=True)]
            states[i][at : at + h] = s
    if not words:
        return float(p["z"][0])
    e = [sum(squash(sum(state[k] * float(p["a"][k][j]) for k in range(2 * h))) * float(p["v"][j]) for j in range(h)) for state in states]
    w = [math.exp(x - max(e)) for x in e]
    pooled = [sum(a * state[k] for a, state in zip(w, states, strict=True)) / sum(w) for k in range(2 * h)]
    return sum(a * float(b) for a, b in zip(pooled, p["o"], strict=True)) + float(p["z"][0])


def word_rows(toxicity):
    """Table rows of a word and of its n-grams, as Inputs gives them for that word alone."""
    from stratafold.llm._text import ALNUM, Words

    def rows(word: str):
        found = Words([word.encode()], ALNUM)
        inputs = toxicity.Inputs(found.hashes, found.strings(0, 1))
        return int(inputs.word[0]), inputs.grams.tolist()

    return rows


def text_score(toxicity, net, text: str | None) -> float:
    """A text's score: that of its highest window."""
    words, rows, size, step = alnum_words(text), word_rows(toxicity), toxicity.WINDOW, toxicity.STRIDE
    starts = [0] if len(words) <= size else [*range(0, len(words) - size, step), len(words) - size]
    return 1 / (1 + math.exp(-max(window_score(net, words[a : a + size], rows) for a in starts)))
