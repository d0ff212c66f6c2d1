"""Brute-force versions, written apart from the operators."""

import hashlib
import math
import re
import string
from collections import Counter, defaultdict

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def union_find(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or {tuple(words)}


def near_duplicates(docs):
    """{doc_id: (size, component)} of (doc_id, text)."""
    sets = {d: shingles(t) for d, t in docs}
    where = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            where[g].append(d)
    common = Counter()
    for ds in where.values():
        common.update((a, b) for i, a in enumerate(sorted(ds)) for b in sorted(ds)[i + 1 :])
    links = [(a, b) for (a, b), n in common.items() if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)]
    parts = union_find(links, sets)
    return {d: (len(s), parts[d]) for d, s in sets.items()}


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(docs, items, width=10):
    windows = defaultdict(set)
    for i, t in items:
        w = WORD.findall((t or "").translate(LOWER))
        for k in range(max(len(w) - width + 1, 1) if w else 0):
            windows[tuple(w[k : k + width])].add("" if i is None else str(i))
    lengths = {len(k) for k in windows}
    out = []
    for d, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (its := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= its
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def repeats(texts, length=200):
    """(n_bytes, n_removed, n_spans, sha of what stays) of each text, by counting windows."""
    raw = [(t or "").encode() for t in texts]
    often = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if often[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


PII = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def personal(text):
    """The base spans (start, rank, kind, end) of a text."""
    text, out = text or "", []
    for rank, (kind, pattern) in enumerate(PII):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def chunked(data, c):
    """The chunks of some bytes, by one rolling hash over all of them."""
    gear = [int(x) for x in c.GEAR]
    out, last, h = [], 0, 0
    for i, byte in enumerate(data):
        h = ((h << 1) + gear[byte]) & 0xFFFFFFFF
        cut = i + 1
        if (h >> (c.WINDOW - c.BITS)) & ((1 << c.BITS) - 1) == 0 and cut >= c.WINDOW and cut - last >= c.MIN:
            while cut - last > c.MAX:
                out.append((last, last + c.MAX))
                last += c.MAX
            if cut - last >= c.MIN:
                out.append((last, cut))
                last = cut
    while len(data) > last:
        out.append((last, min(last + c.MAX, len(data))))
        last = out[-1][1]
    return out


ADDED = (
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("secret", re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")),
)


def more_personal(text):
    """All spans (start, rank, kind, end) of a text: the base ones, account numbers that pass
    their check, and social security numbers and keys with a word that says so within 40 characters."""
    text, out = text or "", personal(text)
    for rank, (kind, pattern) in enumerate(ADDED, len(PII)):
        found = list(pattern.finditer(text))
        for i, m in enumerate(found):
            if kind == "iban":
                plain = m[0].replace(" ", "")
                if not 15 <= len(plain) <= 34 or int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 != 1:
                    continue
            else:
                before = text[found[i - 1].end() if i else 0 : m.start()][-40:]
                after = text[m.end() : found[i + 1].start() if i + 1 < len(found) else len(text)][:40]
                if kind == "secret":
                    if not re.search("[0-9]", m[0]) or not re.search("[A-Za-z]", m[0]) or not re.search("(?i)token|secret|passw|key|credential|bearer", f"{before} {after}"):
                        continue
                elif re.match("000|666|9", m[0]) or "-00-" in m[0] or m[0].endswith("-0000") or not re.search("(?i)ssn|social|security|tax", f"{before} {after}"):
                    continue
            out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def joined(spans):
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in spans)


def without_chunks(docs, c):
    """{doc_id: (n_bytes, n_chunks, n_repeated, n_removed, n_spans, sha of what stays)}: chunk
    by chunk in the order of doc_id, with a set of what has been seen."""
    seen, out = set(), {}
    for d, t in sorted(docs):
        data = (t or "").encode()
        parts = chunked(data, c)
        runs, repeated = [], 0
        for lo, hi in parts:
            if data[lo:hi] in seen:
                repeated += hi - lo
                if runs and runs[-1][1] == lo:
                    runs[-1][1] = hi
                else:
                    runs.append([lo, hi])
            seen.add(data[lo:hi])
        runs = [r for r in runs if r[1] - r[0] >= c.MIN_RUN or r[1] - r[0] == len(data)]
        kept, at = b"", 0
        for lo, hi in runs:
            kept, at = kept + data[at:lo], hi
        kept += data[at:]
        out[d] = (len(data), len(parts), repeated, len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest())
    return out


WIDE = 2**64 - 1
GOLDEN = 0x9E3779B97F4A7C15


def mixed(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & WIDE
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & WIDE
    return x ^ x >> 31


def word_hash(word):
    if len(word) > 32:
        return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    h = mixed((len(word) * GOLDEN + 1) & WIDE)
    for i in range(0, len(word), 8):
        h = mixed(h ^ int.from_bytes(word[i : i + 8], "little"))
    return h


def quality_features(text, bits, back=4):
    """{index: value} of a text: the share of each n-gram in its family."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    salts = [mixed((i * GOLDEN + mixed(31)) & WIDE) for i in range(1, 6)]
    hashes = [word_hash(bytes(b + 32 if 65 <= b <= 90 else b for b in w)) for w in words]
    shapes = []
    for w in words:
        code = min((len(w) + 1).bit_length() - 1, 7)
        for pattern in (rb"[A-Z]", rb"[a-z]", rb"[0-9]", rb"[!-/:-@\[-`{-~]"):
            code = code * 4 + min(len(re.findall(pattern, w)), 3)
        shapes.append(mixed(code + 977))
    families = [[] for _ in range(5)]
    for i, h in enumerate(hashes):
        same = next((d for d in range(1, back + 1) if i >= d and hashes[i - d] == h), 0)
        families[0].append(h)
        families[2].append(shapes[i])
        families[4].append(mixed(same * 8191 + 13))
        if i:
            families[1].append((h * GOLDEN + hashes[i - 1]) & WIDE)
            families[3].append((shapes[i] * GOLDEN + shapes[i - 1]) & WIDE)
    out = Counter({1 << bits: 1.0})
    for salt, keys in zip(salts, families):
        for key in keys:
            out[mixed(key ^ salt) >> (64 - bits)] += 1 / len(keys)
    return out


def sigmoid(x):
    return 1 / (1 + math.exp(-max(min(x, 35), -35)))


def ftrl(rows, epochs, alpha, beta, l1, l2):
    """The weight of an index after passes over (features, label), an index at a time."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for features, label in rows:
            w = {i: weight(i) for i in features}
            p = sigmoid(sum(w[i] * x for i, x in features.items()))
            for i, x in features.items():
                g = (p - label) * x
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    return weight
