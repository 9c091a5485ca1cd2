"""Plain statements of what the operators return, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import xxhash

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = r"[^\x20\x09-\x0D]+"


def simhash(docs):
    """{id: (fingerprint, component)} for [(id, text)]."""
    prints = []
    for _, text in docs:
        words = re.findall(SPACED, (text or "").translate(ASCII))
        grams = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return {doc: (f"{prints[i]:016x}", least[find(i)]) for i, (doc, _) in enumerate(docs)}


def windows(items, size, get=lambda x: x):
    """Counter of all windows and the windows of each item."""
    held = {key: [tuple(seq[i : i + size]) for i in range(len(seq) - size + 1)] for key, seq in items}
    return Counter(w for ws in held.values() for w in ws), held


def repeated_words(docs, size=35):
    """{id: (n_words, n_removed, sha)}: every word of a window seen twice goes."""
    split = [(doc, re.findall(SPACED, text or "")) for doc, text in docs]
    count, held = windows(split, size)
    out = {}
    for doc, words in split:
        gone = set()
        for i, w in enumerate(held[doc]):
            if count[w] > 1:
                gone.update(range(i, i + size))
        kept = [w for i, w in enumerate(words) if i not in gone]
        out[doc] = (len(words), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def repeated_bytes(docs, size=100):
    """{id: (n_bytes, n_removed, n_spans, sha)}: bytes of later copies go; docs in id order."""
    seen, out = set(), {}
    for doc, text in docs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - size + 1):
            w = data[i : i + size]
            if w in seen:
                gone[i : i + size] = b"\1" * size
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[doc] = (len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def contamination(docs, items, window=13):
    """{id: (n_words, n_hit, n_items, sha, contaminated)}."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    read = lambda text: word.findall((text or "").translate(ASCII))
    held = {}
    for item, text in items:
        words = read(text)
        n = min(window, len(words))
        for i in range(len(words) - n + 1) if n else ():
            held.setdefault(tuple(words[i : i + n]), set()).add(str(item))
    sizes = {len(w) for w in held}
    out = {}
    for doc, text in docs:
        words, hit, found = read(text), set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if (w := tuple(words[i : i + n])) in held:
                    hit.update(range(i, i + n))
                    found |= held[w]
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[doc] = (len(words), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(words))
    return out
