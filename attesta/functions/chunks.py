"""Cutting texts: pieces of provided text (T2) and overlapping chunks of whole sentences."""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

PIECE, CHUNK_WORDS, OVERLAP_WORDS = 650, 150, 30


def all_sentences(text: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.!?])\s+", " ".join(text.split())) if s]


def pieces(text: str | None, limit: int = PIECE) -> list[str]:
    """Everything, in pieces of at most `limit` characters; short sentences share a piece, long ones are cut. Null is empty."""
    out: list[str] = []
    for sentence in all_sentences(text or ""):
        for k in range(0, len(sentence), limit):
            part = sentence[k : k + limit]
            if out and len(out[-1]) + 1 + len(part) <= limit:
                out[-1] += " " + part
            else:
                out.append(part)
    return out


def chunks(text: str | None, words: int = CHUNK_WORDS, overlap: int = OVERLAP_WORDS) -> list[str]:
    """Runs of whole sentences of at most `words` words (one longer sentence stands alone). The next run goes back over sentences until `overlap` words repeat, never beyond twice that, and starts later than the last."""
    parts = all_sentences(text or "")
    upto, out, i = [0, *accumulate(len(p.split()) for p in parts)], [], 0
    while i < len(parts):
        j = max(i + 1, bisect_right(upto, upto[i] + words) - 1)
        out.append(" ".join(parts[i:j]))
        if j == len(parts):
            break
        k = j
        while k - 1 > i and upto[j] - upto[k] < overlap and upto[j] - upto[k - 1] <= 2 * overlap:
            k -= 1
        i = k
    return out
