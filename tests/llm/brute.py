"""Plain versions of the operators, to hold them against."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict


def held_out(doc_id, modulus, remainder):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus == remainder


def ascii_lower(text):
    return re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode())


def plain_words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", ascii_lower(text))


def components(ids, texts, percent=85, size=4):
    """(set sizes, component ids)"""
    sets = []
    for t in texts:
        w = plain_words(t)
        sets.append({tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)})
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    lists = defaultdict(list)
    for i, s in enumerate(sets):
        met = defaultdict(int)
        for k in s:
            for j in lists[k]:
                met[j] += 1
            lists[k].append(i)
        for j, c in met.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                up[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            r = find(i)
            least[r] = min(least.get(r, d), d)
    return [len(s) for s in sets], [least.get(find(i)) for i in range(len(sets))]


def removed(ids, texts, length=50):
    """For each row: mask of removed bytes."""
    raw = [(t or "").encode() for t in texts]
    first = {}
    for d, b in zip(ids, raw):
        for s in range(len(b) - length + 1) if d is not None else ():
            k = b[s : s + length]
            first[k] = min(first.get(k, d), d)
    out = []
    for d, b in zip(ids, raw):
        gone = [False] * len(b)
        for s in range(len(b) - length + 1) if d is not None else ():
            if first[b[s : s + length]] < d:
                gone[s : s + length] = [True] * length
        out.append(gone)
    return out


def spans(mask):
    return sum(1 for k, m in enumerate(mask) if m and (k == 0 or not mask[k - 1]))


def kept(text, mask):
    return bytes(b for b, m in zip((text or "").encode(), mask) if not m)


def item_words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))


def contamination(text, items, n=10):
    """(words, hit words, item ids)"""
    w = item_words(text)
    hit, found = set(), set()
    for item, t in items:
        v = item_words(t)
        size = min(n, len(v))
        for k in range(len(v) - size + 1) if v else ():
            want = v[k : k + size]
            for i in range(len(w) - size + 1):
                if w[i : i + size] == want:
                    hit.update(range(i, i + size))
                    found.add(item)
    return len(w), len(hit), found


def sha(data):
    return hashlib.sha256(data).hexdigest()


def digest(text):
    """(quartile of each of 512 buckets, length step) of a text's byte triplets at 0, 5 and 11."""
    raw = (text or "").encode()
    counts = [0] * 512
    for k in range(len(raw)):
        at = lambda j: raw[k + j] if k + j < len(raw) else 0  # noqa: E731, B023
        h = (at(0) | at(5) << 8 | at(11) << 16) * 0x9E3779B1 & 0xFFFFFFFF
        h ^= h >> 15
        counts[(h * 0x85EBCA77 & 0xFFFFFFFF) >> 23] += 1
    ranked = sorted(counts)
    return [sum(c > ranked[q * 128 - 1] for q in (1, 2, 3)) for c in counts], int(math.log(len(raw) + 1) / math.log(1.1))


def digest_hex(text):
    quartiles, step = digest(text)
    return bytes([*(sum(quartiles[4 * k + j] << 2 * j for j in range(4)) for k in range(128)), step]).hex()


def digest_likeness(a, b):
    (u, m), (v, n) = digest(a), digest(b)
    cost = [0, 1, 2, 6]
    bound = min(1.625 * 512, sum(cost[max(x, y)] for x, y in zip(u, v)))
    apart = sum(cost[abs(x - y)] for x, y in zip(u, v)) / bound if bound else 0
    return min(1, max(0, 1 - apart - 0.2 * min(abs(m - n), 16) / 16 / 1.625))


def follow_the_leader(rows, features, epochs, alpha, beta, l1, l2):
    """Per-coordinate FTRL-proximal with dictionaries; (weights, bias).

    `features` lists the feature numbers of a text, repeated as often as they occur.
    """
    z, n = defaultdict(float), defaultdict(float)
    zb = nb = 0.0

    def weight(k):
        return 0.0 if abs(z[k]) <= l1 else -(z[k] - math.copysign(l1, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)

    for _ in range(epochs):
        for text, label in rows:
            got = Counter(features(text))
            size = math.sqrt(max(1, sum(got.values())))
            bias = -zb / ((beta + math.sqrt(nb)) / alpha)
            p = 1 / (1 + math.exp(-(sum(weight(k) * c / size for k, c in got.items()) + bias)))
            for k, c in got.items():
                g, w = (p - label) * c / size, weight(k)
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / alpha * w
                n[k] += g * g
            g = p - label
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / alpha * bias
            nb += g * g
    return {k: weight(k) for k in z}, -zb / ((beta + math.sqrt(nb)) / alpha)


def letters(text):
    """Lower-cased letters with single gaps between, none first."""
    out = ""
    for c in text or "":
        if c.isalpha():
            low = c.lower()
            out += low if len(low) == 1 else c
        elif out and out[-1] != " ":
            out += " "
    return out


class KneserNey:
    """Interpolated Kneser-Ney over letters with dictionaries, a model for each language."""

    def __init__(self, rows, order=4):
        self.order, self.names = order, sorted({k for _, k in rows})
        seen = {k: [Counter() for _ in range(order + 1)] for k in self.names}
        for text, lang in rows:
            s = " " * (order - 1) + letters(text)
            for end in range(order - 1, len(s)):
                for n in range(1, order + 1):
                    seen[lang][n][s[end - n + 1 : end + 1]] += 1
        self.floor = 1 / (len({g for k in self.names for g in seen[k][1]}) + 1)
        self.counts, self.cut, self.total, self.kinds = {}, {}, {}, {}
        for k in self.names:
            for n in range(1, order + 1):
                c = seen[k][n] if n == order else Counter(g[1:] for g in seen[k][n + 1])
                once, twice = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
                self.counts[k, n] = c
                self.cut[k, n] = min(0.95, max(0.1, once / max(once + 2 * twice, 1) if once else 0.5))
                self.total[k, n], self.kinds[k, n] = Counter(), Counter()
                for g, v in c.items():
                    self.total[k, n][g[:-1]] += v
                    self.kinds[k, n][g[:-1]] += 1

    def probability(self, lang, gram):
        n = len(gram)
        lower = self.floor if n == 1 else self.probability(lang, gram[1:])
        total, cut = self.total[lang, n][gram[:-1]], self.cut[lang, n]
        if not total or (n == 1 and total <= 1):
            return lower
        return max(self.counts[lang, n][gram] - cut, 0) / total + cut * self.kinds[lang, n][gram[:-1]] / total * lower

    def entropy(self, lang, text):
        s = " " * (self.order - 1) + letters(text)
        places = range(self.order - 1, len(s))
        return -sum(math.log(self.probability(lang, s[e - self.order + 1 : e + 1])) for e in places) / len(places)
