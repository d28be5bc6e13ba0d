"""Plain versions of the operators on whole small tables."""

import collections
import hashlib
import re
import zlib

import pandas as pd


def documents(sf_dir):
    return pd.read_parquet(f"{sf_dir}/documents.parquet")


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def sha(s):
    return hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


def luhn(d):
    d = [int(c) for c in d][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def pii(text):
    out = {}
    for kind, p in PATTERNS.items():
        out[kind] = []
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else True, "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out[kind].append((m.start(), m.end()))
    return out


def repeats(rows, length=100):
    """{doc_id: (n_bytes, n_removed, n_spans, kept_sha256)} for rows (doc_id, text)."""
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        cover = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                cover[i : i + length] = b"\1" * length
            else:
                seen.add(w)
        out[d] = (len(b), sum(cover), len(re.findall(b"\1+", bytes(cover))), sha(bytes(x for x, c in zip(b, cover) if not c)))
    return out


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def leaks(texts, items, window=10):
    """Per text: (n_words, n_hit, item ids)."""
    grams = collections.defaultdict(set)
    for i, t in items:
        w = tuple(WORD.findall(lower(t or "")))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            grams[w[k : k + window]].add(str(i))
    sizes = {len(g) for g in grams}
    out = []
    for t in texts:
        w = tuple(WORD.findall(lower(t or "")))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if w[k : k + n] in grams:
                    hit |= set(range(k, k + n))
                    found |= grams[w[k : k + n]]
        out.append((len(w), len(hit), sorted(found)))
    return out


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows, percent=85):
    """{doc_id: (n_shingles, component)} by comparing all pairs that share a shingle."""
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = collections.defaultdict(list)
    for d, s in sets.items():
        for g in s:
            where[g].append(d)
    done = set()
    for ds in where.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                if (a, b) not in done:
                    done.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                        x, y = sorted((root(a), root(b)))
                        parent[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}


def quality(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    c = collections.Counter(grams)
    cover = set()
    for i, g in enumerate(grams):
        if c[g] > 1:
            cover |= set(range(i, i + 8))
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w)


def crc(s):
    return zlib.crc32(s.encode() if isinstance(s, str) else s)
