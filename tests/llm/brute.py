"""Plain second implementations of the operators' contracts."""

import hashlib
import re
from collections import defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def sha(b):
    return hashlib.sha256(b).hexdigest()


def windows(docs, width=20):
    """doc_id -> (n_words, n_removed, sha256) for (doc_id, text) rows of unique ids."""
    first, out = {}, {}
    for doc_id, text in sorted(docs, key=lambda x: x[0]):
        words = WORDS.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - width + 1):
            if first.setdefault(tuple(words[i : i + width]), (doc_id, i)) != (doc_id, i):
                gone[i : i + width] = [True] * width
        out[doc_id] = (len(words), sum(gone), sha(" ".join(w for w, g in zip(words, gone) if not g).encode()))
    return out


def strings(docs, length=200):
    """doc_id -> (n_bytes, n_removed, n_spans, sha256)."""
    count = defaultdict(int)
    texts = [(d, (t or "").encode()) for d, t in docs]
    for _, t in texts:
        for i in range(len(t) - length + 1):
            count[hashlib.md5(t[i : i + length]).digest()] += 1
    out = {}
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[hashlib.md5(t[i : i + length]).digest()] > 1:
                gone[i : i + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[d] = (len(t), sum(gone), spans, sha(bytes(b for b, g in zip(t, gone) if not g)))
    return out


def shingles(text, n=5):
    words = WORDS.findall(text or "")
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def jaccard_links(docs, threshold=0.8):
    """doc_id -> the ids of other documents at least so similar; texts without words have none."""
    sets = {d: shingles(t) for d, t in docs}
    ids = sorted(sets)
    out = {d: set() for d in ids}
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) >= threshold * max(len(x), len(y)):
                both = len(x & y)
                if both >= threshold * (len(x) + len(y) - both):
                    out[a].add(b)
                    out[b].add(a)
    return out


def components(links):
    """id -> the least id that it is linked with, directly or not."""
    out = {}
    for d in sorted(links):
        if d in out:
            continue
        todo, out[d] = [d], d
        while todo:
            for e in links[todo.pop()]:
                if e not in out:
                    out[e] = d
                    todo.append(e)
    return out


def contaminated(docs, items, width=13):
    """doc_id -> (n_words, n_hit, items, contaminated), items without an id as one None at the end."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: word.findall(re.sub("[A-Z]+", lambda m: m.group().lower(), t or ""))
    cut = defaultdict(set)
    for item, text in items:
        w = lower(text)
        n = min(len(w), width)
        for i in range(len(w) - n + 1 if n else 0):
            cut[tuple(w[i : i + n])].add(item)
    out = {}
    for d, text in docs:
        w, found = lower(text), set()
        hit = [False] * len(w)
        for n in {len(c) for c in cut}:
            for i in range(len(w) - n + 1):
                if (c := tuple(w[i : i + n])) in cut:
                    found |= cut[c]
                    hit[i : i + n] = [True] * n
        out[d] = (len(w), sum(hit), tuple(sorted(found - {None})) + (None,) * (None in found), sum(hit) > 0 and 20 * sum(hit) >= len(w))
    return out


def units(text):
    return re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text or "")


def cut_in_middle(doc_id, text, seed=42):
    """(n, form, prefix_chars, middle_chars, output)."""
    u, text = units(text), text or ""
    hexa = sha(f"{seed}:{'' if doc_id is None else doc_id}".encode())
    h1, h2, h3, h4 = (int(hexa[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 50:
        return len(u), "plain", None, None, text
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h4 % 100 < 80:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def word_runs(w, least=6, repeats=4):
    """(start, length, period) of all runs by start and period, straight from their definition."""
    found = {}
    for q in range(1, len(w) // repeats + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, repeats * q):
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted((i, n, q) for (i, n), q in found.items())


def planted_words(doc_id, text):
    import zlib

    w = WORDS.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    g = h // 10
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]


def collapsed(w, runs):
    gone = [False] * len(w)
    for i, n, q in runs:
        gone[i + q : i + n] = [True] * (n - q)
    return " ".join(x for x, g in zip(w, gone) if not g)
