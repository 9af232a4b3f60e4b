"""Plain Python versions of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = -(2**63)


def words(text):
    return WORD.findall(text or "")


def order(docs):
    return sorted(docs, key=lambda d: LOW if d[0] is None else d[0])


def substring(docs, size=20):
    first = {}
    for doc, text in order(docs):
        w = words(text)
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            first.setdefault(k, (doc, i))
    out = []
    for doc, text in docs:
        w, gone = words(text), set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] != (doc, i):
                gone |= set(range(i, i + size))
        left = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return out


def base_rules(text):
    t = text or ""
    w = words(t)
    n = len(w)
    grams = [tuple(w[i : i + 3]) for i in range(n - 2)]
    count = Counter(grams)
    covered = {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + 3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed


def fold(line):
    return re.sub(r"[\x20\x09-\x0D]+", " ", line.lower()).strip(" ")


def quality(docs, max_docs=20, share=0.3):
    holders = defaultdict(set)
    for doc, text, source in docs:
        for line in (text or "").split("\n"):
            if WORD.search(line):
                holders[source or "", fold(line)].add(doc)
    out = []
    for doc, text, source in docs:
        base = base_rules(text)
        gone = sum(len(words(x)) for x in (text or "").split("\n") if WORD.search(x) and len(holders[source or "", fold(x)]) > max_docs)
        left = base[0] - gone
        out.append((doc, *base, not base[5] and left >= 50 and left >= share * base[0]))
    return out


def simhash(text, size=3):
    import xxhash

    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = words(low)
    if not w:
        return 0
    grams = [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(docs, distance=2):
    fp = {i: simhash(t) for i, (_, t) in enumerate(docs)}
    ids = [LOW if d is None else d for d, _ in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= distance:
                parent[root(i)] = root(j)
    least = defaultdict(lambda: 2**63)
    for i in range(len(docs)):
        least[root(i)] = min(least[root(i)], ids[i])
    return [(docs[i][0], f"{fp[i]:016x}", None if least[root(i)] == LOW else least[root(i)]) for i in range(len(docs))]


def similar_lines(docs):
    """Kept text by document: a line goes if an earlier one has Jaccard 4/5 or more with it."""
    earlier, out = [], []
    for doc, text in order(docs):
        kept, lines, removed = [], 0, 0
        for line in (text or "").split("\n"):
            s = frozenset(words(line.lower()))
            if not s:
                kept.append(line)
                continue
            lines += 1
            if any(5 * len(s & e) >= 4 * len(s | e) for e in earlier):
                removed += 1
            else:
                kept.append(line)
            earlier.append(s)
        out.append((doc, lines, removed, "\n".join(kept)))
    return out


def token_ids(texts, path, end=None):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    return [e.ids + ([] if end is None else [end]) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def files(docs, path):
    rows = order(docs)
    out, start = [], 0
    for (doc, _), ids in zip(rows, token_ids([t for _, t in rows], path, 0)):
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        out.append((doc, start, len(ids), zlib.crc32(raw)))
        start += len(ids)
    return out
