"""Plain versions of the operators, a document at a time, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile("[^\x20\x09-\x0d]+")


def low(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def roots(n: int, links) -> list[int]:
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def fingerprint(text: str | None, shingle: int = 3) -> int:
    words = WORD.findall(low(text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + shingle]).encode(), 42) for i in range(max(1, len(words) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(docs: list[tuple[int, str | None]], radius: int = 2) -> set[tuple]:
    docs = sorted(docs, key=lambda d: d[0])
    prints = [fingerprint(t) for _, t in docs]
    links = [(i, j) for i in range(len(docs)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= radius]
    return {(d, f"{p:016x}", docs[r][0]) for (d, _), p, r in zip(docs, prints, roots(len(docs), links))}


def substring(docs: list[tuple[int, str | None]], window: int = 35) -> list[tuple]:
    words = [WORD.findall(t or "") for _, t in docs]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(docs, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def exact(docs: list[tuple[int, str | None]]) -> list[tuple]:
    groups = defaultdict(list)
    norm = lambda t: re.sub("[\x20\x09-\x0d]", "", t or "")
    for d, t in docs:
        groups[norm(t)].append((-len(t or ""), d))
    return [(d, min(groups[norm(t)])[1], len(groups[norm(t)]), min(groups[norm(t)])[1] == d, sha(norm(t))) for d, t in docs]


def lines(docs: list[tuple[int, str | None]]) -> list[tuple]:
    key = lambda line: low(line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n"):
            holders[key(line)].add(d)
    out = []
    for d, t in docs:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == d]
        out.append((d, len(all_), len(all_) - len(kept), sha("\n".join(kept))))
    return out
