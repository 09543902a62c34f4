"""Small inputs made from a seed."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def vocabulary(seed: int, size: int = 400) -> list[str]:
    made = random.Random(seed)
    return ["".join(made.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(made.randint(3, 9))) for _ in range(size)]


def prose(made: random.Random, words: list[str], n: int) -> list[str]:
    return [made.choice(words) for _ in range(n)]


def near_copies(seed: int = 5, groups: int = 12) -> list[tuple]:
    """Documents with copies at various distances, in shuffled order; nulls, empties and short texts among them."""
    made = random.Random(seed)
    words = vocabulary(seed)
    texts: list[str | None] = [None, "", "   ", "one", "one two three", "ONE two three", "one two three"]
    for g in range(groups):
        base = prose(made, words, made.randint(20, 120))
        for k in range(made.randint(1, 6)):
            copy = list(base)
            for _ in range(k * (1 + g % 3)):
                copy[made.randrange(len(copy))] = made.choice(words)
            texts.append(" ".join(copy))
    made.shuffle(texts)
    return [(n * 3, t, "en", "s", len(t or "")) for n, t in enumerate(texts)]


def components_of(nodes, links) -> dict:
    """Smallest reachable id of each node, by union-find."""
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}
