"""Collocations by counting every phrase of every text."""

from __future__ import annotations

import re
from collections import Counter


def brute(rows, depth: int = 3, least: int = 10, top: int = 2000) -> list[tuple]:
    """``lang, rank, phrase, a, l, r, n, score`` of ``(text, lang)`` rows."""
    counts: dict[str, Counter] = {}
    for text, lang in rows:
        if text is None:
            continue
        lowered = text.encode().lower().decode()
        of = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, depth + 1):
                of.update(zip(*(words[i:] for i in range(k))))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        covered: dict = {}
        for p, c in candidates.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    covered[p[i : i + m]] = max(covered.get(p[i : i + m], 0), c)
        found = []
        for p, a in candidates.items():
            if 100 * covered.get(p, 0) >= 50 * a and p in covered:
                continue
            cuts = [(1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), a, f[p[:k]], f[p[k:]], score))
        for rank, (_, _, phrase, a, left, right, score) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), a, left, right, n, score))
    return out
