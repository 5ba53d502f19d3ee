"""Plain, slow versions of the operators' contracts."""
from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def ascii_lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


SPACE = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def occurrences(docs: list[tuple], items: list[tuple], window: int = 13) -> list[tuple]:
    pats: dict[tuple, set] = {}
    for item, text in items:
        w = WORD.findall(ascii_lower(text or ""))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            pats.setdefault(tuple(w[k : k + window]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w = WORD.findall(ascii_lower(text or ""))
        hit, met = [False] * len(w), set()
        for n in {len(p) for p in pats}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in pats:
                    met |= pats[tuple(w[k : k + n])]
                    hit[k : k + n] = [True] * n
        n = sum(hit)
        out.append((doc, len(w), n, len(met), sha(",".join(sorted(met))), n > 0 and 20 * n >= len(w)))
    return out


def simhash(text: str | None) -> int:
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    parts = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_components(prints: list[tuple[int, int]], limit: int) -> dict[int, int]:
    """Smallest id that each id reaches over fingerprints within ``limit`` bits."""
    label = {i: i for i, _ in prints}
    changed = True
    while changed:
        changed = False
        for i, a in prints:
            for j, b in prints:
                if (a ^ b).bit_count() <= limit and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _valid(kind: str, hit: str) -> bool:
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "phone":
        return 8 <= len(digits) <= 15
    if kind == "card":
        total = 0
        for i, c in enumerate(reversed(digits)):
            d = int(c) * (1 + i % 2)
            total += d - 9 if d > 9 else d
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return True


def base_pii(text: str | None) -> tuple[list[int], str]:
    counts, listed = [], []
    for kind, pattern in PII.items():
        own = [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text or "") if _valid(kind, m[0])]
        counts.append(len(own))
        listed += own
    return counts, ",".join(listed)


def cut_repeats(docs: list[tuple], window: int = 50) -> list[tuple]:
    words = [(d, SPACE.findall(t or "")) for d, t in docs]
    first: dict[tuple, int] = {}
    for d, w in words:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if d is not None:
                first[k] = min(d, first.get(k, d))
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out.append((d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def conversations(rows: list[tuple]) -> list[tuple]:
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    out = []
    for c, g in by.items():
        g.sort(key=lambda r: r[1])
        said = "".join(r[3] or "" for r in g if r[2] == "assistant")
        out.append((c, len(g), sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in g)), len(said), sha(said)))
    return sorted(out)


def remainder(doc_id: int, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n


def token_bytes(tokenizer, text: str | None) -> bytes:
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4").tobytes()


def toxic_terms(text: str | None) -> dict[str, int]:
    """Words cut to four letters, with counts."""
    out: dict[str, int] = {}
    word = ""
    for c in (text or "").lower() + " ":
        if c.isalnum():
            word += c
            continue
        if word:
            out[word[:4]] = out.get(word[:4], 0) + 1
        word = ""
    return out


MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15
POWERS = [pow(BASE, i, 1 << 64) for i in range(64)]


def spread(h: int) -> int:
    h ^= h >> 31
    h = h * 0x7FB5D329728EA185 & MASK
    h ^= h >> 27
    h = h * 0x81DADEF4BC2DD44D & MASK
    return h ^ h >> 33


def hashed(text: str) -> int:
    """Hash of a short text by the polynomial of its code points."""
    return spread(sum((ord(c) + 1) * p for c, p in zip(text, POWERS)) & MASK)


def keyed(counted: dict[str, int]) -> list[tuple[str, int]]:
    return [(w, hashed(w)) for w in counted]


def syncmers(text: str, k: int = 12, s: int = 6) -> list[tuple[int, str]]:
    inner = [hashed(text[i : i + s]) for i in range(len(text) - s + 1)]
    out = []
    for i in range(len(text) - k + 1):
        part = inner[i : i + k - s + 1]
        if min(part) in (part[0], part[-1]):
            out.append((i, text[i : i + k]))
    return out or ([(0, text)] if text else [])


def linked(text: str) -> Counter:
    at = syncmers(text)
    pairs = [(a, b, q - p) for (p, a), (q, b) in zip(at, at[1:])] or [(a,) for _, a in at]
    return Counter(pairs)


def dice(a: str, b: str) -> float:
    x, y = linked(a), linked(b)
    total = sum(x.values()) + sum(y.values())
    return 2 * sum(min(n, y.get(p, 0)) for p, n in x.items()) / total if total else 1.0


def digest(text: str, size: int = 64) -> str:
    low = sorted({hashed(a) >> 32 for _, a in syncmers(text)})[:size]
    return "".join(f"{h:08x}" for h in low)


def idf(counted: list[dict[str, int]]) -> dict[str, float]:
    n: dict[str, int] = {}
    for t in counted:
        for w in t:
            n[w] = n.get(w, 0) + 1
    return {w: float(np.log((2 + len(counted)) / (1 + k))) for w, k in n.items()}


def neighbours(text: str, sample: list[tuple], idf: dict[str, float]) -> list[tuple[float, int]]:
    """Cosine to every example within the terms of the examples, with the example's id."""
    parts = [toxic_terms(t) for _, t in sample]
    space = set().union(*parts)

    def vector(counted):
        v = {w: c * idf[w] for w, c in counted.items() if w in space}
        size = sum(x * x for x in v.values()) ** 0.5 or 1.0
        return {w: x / size for w, x in v.items()}

    own = vector(toxic_terms(text))
    return [(sum(x * v.get(w, 0.0) for w, x in own.items()), i) for (i, _), v in zip(sample, map(vector, parts))]
