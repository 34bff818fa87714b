"""Plain Python versions of the operators, for small inputs."""

import collections
import hashlib
import re

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FOLD = str.maketrans(UPPER, UPPER.lower())


def remove_repeats(rows, length=100):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of (doc_id, text) rows with distinct ids."""
    seen, out = set(), []
    for doc, text in sorted(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            piece = raw[i:i + length]
            if piece in seen:
                gone[i:i + length] = b"\1" * length
            else:
                seen.add(piece)
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        out.append((doc, len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i:i + width]) for i in range(len(words) - width + 1))


def near_groups(rows, width=4, percent=85):
    """(doc_id, n_shingles, component_id) of (doc_id, text) rows with distinct ids."""
    sets = {doc: shingles(text, width) for doc, text in rows}
    parent = {doc: doc for doc in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = collections.defaultdict(list)
    for doc, s in sets.items():
        for x in s:
            where[x].append(doc)
    for doc, s in sets.items():
        shared = collections.Counter(o for x in s for o in where[x] if o < doc)
        for other, both in shared.items():
            if 100 * both >= percent * (len(s) + len(sets[other]) - both):
                a, b = find(doc), find(other)
                parent[max(a, b)] = min(a, b)
    return [(doc, len(s), find(doc)) for doc, s in sorted(sets.items())]


def tokens(text):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())


def tiled(item, text, least):
    """Words of ``item`` that greedy string tiling covers: always the longest free match next."""
    free_i, free_t, covered = [True] * len(item), [True] * len(text), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for t in range(len(text)):
                n = 0
                while i + n < len(item) and t + n < len(text) and item[i + n] == text[t + n] and free_i[i + n] and free_t[t + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, t)
        n, i, t = best
        if n < least:
            return covered
        free_i[i:i + n] = free_t[t:t + n] = [False] * n
        covered += n
