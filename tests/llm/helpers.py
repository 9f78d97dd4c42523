"""Small tables and plain computations for the tests of the operators."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, score double, node string"


def lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def shingles(text: str | None, words: int) -> set[tuple]:
    parts = WORD.findall(lower(text or ""))
    if not parts:
        return set()
    size = min(words, len(parts))
    return {tuple(parts[i : i + size]) for i in range(len(parts) - size + 1)}


def reach(nodes, linked) -> dict:
    """The smallest node that each reaches over ``linked(x, y)``."""
    label = {x: x for x in nodes}
    changed = True
    pairs = [(x, y) for x in nodes for y in nodes if x < y and linked(x, y)]
    while changed:
        changed = False
        for x, y in pairs:
            least = min(label[x], label[y])
            if label[x] != least or label[y] != least:
                label[x] = label[y] = least
                changed = True
    return label


def row(doc_id, text, source="a"):
    return (doc_id, text, "en", source, 0, 1.5, "clash")


def texts(seed: int, n: int, words: int = 60) -> list[str]:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 6))) for _ in range(400)]
    return [" ".join(rng.choices(vocabulary, k=words)) for _ in range(n)]


def near_copy(text: str, seed: int, changes: int) -> str:
    rng = random.Random(seed)
    words = text.split(" ")
    for i in rng.sample(range(len(words)), changes):
        words[i] = f"new{seed}x{i}"
    return " ".join(words)


def odd_documents() -> list[tuple]:
    """Copies, near copies in chains, nulls, empties, ties, repeated rows and a long text."""
    base = texts(1, 12)
    rows = [row(i, t) for i, t in enumerate(base)]
    rows += [row(100 + i, near_copy(base[i % 3], i, 1 + i % 9), "b") for i in range(40)]
    chain = base[5]
    for i in range(6):
        chain = near_copy(chain, 50 + i, 2)
        rows.append(row(200 + i, chain, "c"))
    rows += [row(300, None), row(301, ""), row(302, " \t\n"), row(303, "One"), row(304, "one"), row(305, "é É ß x"), row(306, "a"), row(307, "a a")]
    rows += [row(None, base[7]), row(None, "nobody"), row(7, base[7]), row(7, base[7])]
    rows += [row(400, base[0].upper(), None), row(401, " ".join(texts(2, 1, 20_000)), None)]
    return rows
