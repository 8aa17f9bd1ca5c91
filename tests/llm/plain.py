"""Plain single-process versions that the operators are held against."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash


def removed_repeats(rows, length=100, characters=False):
    """{id: (bytes, removed, spans, kept)} by looking at every window in order."""
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            window = raw[s:s + length]
            if window in seen:
                gone[s:s + length] = b"\1" * length
            seen.add(window)
        if characters:
            at = 0
            for char in (text or ""):
                n = len(char.encode())
                if not all(gone[at:at + n]):
                    gone[at:at + n] = bytes(n)
                at += n
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[doc] = (len(raw), sum(gone), spans, bytes(b for b, g in zip(raw, gone) if not g))
    return out


def fingerprint(text, shingle=4):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def linked(prints, bits=4):
    """Class (smallest position) of each fingerprint, by comparing all pairs."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    a = np.array(prints, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1:] ^ a[i]) <= bits) + i + 1:
            x, y = find(i), find(int(j))
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def shingles(text, words=5):
    parts = (text or "").encode().lower().split()
    return {b" ".join(parts[i:i + words]) for i in range(max(1, len(parts) - words + 1))} if parts else set()


def contained(docs, items, threshold=0.8):
    """(doc position, item position) pairs, by comparing all pairs."""
    wanted = [shingles(t) for t in items]
    out = set()
    for d, text in enumerate(docs):
        have = shingles(text)
        out |= {(d, k) for k, want in enumerate(wanted) if want and len(want & have) >= threshold * len(want)}
    return out


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
