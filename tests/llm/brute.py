"""Plain versions of what the operators compute, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import xxhash


def fingerprint(text: str | None) -> int:
    lower = (text or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)}))
    words = lower.encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def cleaned(text: str | None) -> str:
    """The text without lines that are noisy, lists of links or notices."""

    def fails(line: str) -> bool:
        words = [w for w in re.split("[ \t\n\v\f\r]+", line) if w]
        noisy = sum(any(c in w for c in "#*$%&<>") or bool(re.search("[!?]{2}", w)) for w in words)
        separators = sum(w in list("|>»•·") for w in words)
        notice = re.search("all rights reserved|cookie policy|privacy policy|terms of (use|service)|accept (all )?cookies|subscribe to our newsletter|click here|licensed under|share on (facebook|twitter)|skip to (main )?content|^copyright |^©", line, re.I | re.A)
        return bool(words) and (noisy >= 0.3 * len(words) or (separators > 1 and 5 * separators >= len(words)) or (bool(notice) and len(words) <= 30))

    return "\n".join(x for x in (text or "").split("\n") if not fails(x))


def components(prints: dict[int, int], bits: int = 2) -> dict[int, int]:
    """The smallest id reachable over pairs of at most bits differing bits."""
    parent = {k: k for k in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in ids}


def shingle_set(text):
    words = (text or "").lower().split()
    return {" ".join(words[k : k + 5]) for k in range(len(words) - 4)}


def stays(texts):
    """The smallest id of each component over fingerprints within two bits and similarities of 0.8 or more."""
    of = components({k: fingerprint(t) for k, t in texts.items()})
    sets = {k: shingle_set(t) for k, t in texts.items()}
    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 9 * common >= 4 * (len(sets[a]) + len(sets[b])) and of[a] != of[b]:
                low, high = sorted((of[a], of[b]))
                of = {k: low if v == high else v for k, v in of.items()}
    return set(of.values())


def removed(docs: dict[int, bytes], least: int) -> dict[int, tuple[int, int, int, str]]:
    starts = Counter(t[i : i + least] for t in docs.values() for i in range(len(t) - least + 1))
    out = {}
    for k, t in docs.items():
        gone = bytearray(len(t))
        for i in range(len(t) - least + 1):
            if starts[t[i : i + least]] > 1:
                gone[i : i + least] = b"\1" * least
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[k] = (len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out
