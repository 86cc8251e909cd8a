"""Plain single-process versions of the operators, for comparison only."""

import hashlib
import re
import zlib

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def exact(rows):
    by = {}
    for d, t in rows:
        by.setdefault((t or "").translate(UP), []).append(d)
    out = []
    for t, ids in by.items():
        known = [d for d in ids if d is not None]
        keep = max(known) if known else None
        out += [(d, keep, len(ids), d == keep, hashlib.sha256(t.encode()).hexdigest()) for d in ids]
    return out


def url(u, rules):
    at = (u or "").find("://")
    rest = u[at + 3 :] if u and at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(UP)
    best = max((r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])), key=lambda r: (len(r[1] + r[2]), len(r[1])), default=None)
    return host, path, best[1] + best[2] if best else None, best[0] if best else "allow"


def base(text):
    w = words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    count = {}
    for i in range(len(w) - 2):
        count[tuple(w[i : i + 3])] = count.get(tuple(w[i : i + 3]), 0) + 1
    hit = {j for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(hit), failed


def near(rows, n=5, least=75):
    sets = {}
    for d, t in rows:
        w = words((t or "").translate(UP))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    where = {}
    for d, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(d)
    shared = {}
    for ids in where.values():
        for i, a in enumerate(ids):
            for b in ids[i + 1 :]:
                shared[a, b] = shared.get((a, b), 0) + 1
    for (a, b), k in shared.items():
        if 100 * k >= least * (len(sets[a]) + len(sets[b]) - k):
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def repeats(rows, n=50):
    first = {}
    texts = {d: (t or "").encode() for d, t in rows}
    for d in sorted(texts):
        for i in range(len(texts[d]) - n + 1):
            first.setdefault(texts[d][i : i + n], d)
    out = {}
    for d, b in texts.items():
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if first[b[i : i + n]] < d:
                gone[i : i + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d] = (len(b), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(kept).hexdigest())
    return out


def crc_ids(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def likelihood(rows, good, buckets, threshold):
    """(doc_id, text, score) by plain counting: every document is scored by the half it is not in."""
    import re
    import struct
    from collections import Counter
    from math import log

    import xxhash

    def grams(text):
        h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        return len(h), [x % buckets for x in h] + [(a ^ (b >> 20)) % buckets for a, b in zip(h, h[1:])]

    def half(doc):
        seed = 42 if doc is None else xxhash.xxh64_intdigest(struct.pack("<q", doc), 42)
        x = xxhash.xxh64_intdigest(struct.pack("<i", 7), seed)
        return (x - (1 << 64) if x >> 63 else x) % 2

    raw, target, known = [Counter(), Counter()], [Counter(), Counter()], []
    for doc, text in rows:
        n, found = grams(text)
        known.append((doc, text, n, found))
        raw[half(doc)].update(found)
        if doc in good:
            target[half(doc)].update(found)
    out, trusted = [], []
    for doc, text, n, found in known:
        r, t = raw[1 - half(doc)], target[1 - half(doc)]
        share = sum(t.values()) / max(sum(r.values()), 1)
        ratio = sum(log((t[g] + 0.5) / (r[g] * share + 0.5)) for g in found) / len(found) if found else 0.0
        out.append((doc, text, ratio))
        if doc in good and n >= 50:
            trusted.append(ratio)
    trusted.sort()
    move = threshold - trusted[max(0, -(-len(trusted) * 5 // 1000) - 1)] if trusted else 0.0
    return [(d, t, x + move) for d, t, x in out]
