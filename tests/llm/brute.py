"""Plain Python versions of what the queries return, straight from their definitions."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def warc(pages):
    first = {}
    for p, _, html in pages:
        if p is not None:
            first[html or ""] = min(p, first.get(html or "", p))
    out = []
    for p, _, html in pages:
        raw = (html or "").encode()
        r = first.get(html or "")
        revisit = p is not None and p > r
        out.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", r if revisit else None))
    return out


def chat(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = []
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        out.append((c, len(turns), sha("".join(f"{r}\n{x}\n" for *_, r, x in turns)), len(loss), sha(loss)))
    return out


def _tokens(name, texts):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return [e.ids + [2] for e in t.encode_batch(list(texts), add_special_tokens=False)]


def pieces(docs):
    out = []
    for (d, *_), ids in zip(docs, _tokens("byte_bpe_50k.json", [x[1] or "" for x in docs])):
        at, to, n = 0, len(ids) % 1024 or 1024, 0
        while at < len(ids):
            out.append((d, n, at, to - at, zlib.crc32(np.array(ids[at:to], dtype="<u4").tobytes())))
            n, at, to = n + 1, to, to + 1024
    return out


def token_store(docs):
    out, start = [], 0
    for d, text in sorted(((x[0], x[1] or "") for x in docs), key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = _tokens("word_bpe_49k.json", [text])[0]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def jaccard(docs):
    sets = []
    for d, text, *_ in docs:
        w = WORD.findall((text or "").translate(UPPER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    at = {}
    for i, s in enumerate(sets):
        for x in s:
            at.setdefault(x, []).append(i)
    common = Counter((i, j) for v in at.values() for a, i in enumerate(v) for j in v[a + 1 :])
    for (i, j), n in common.items():
        if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, *_) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least.get(find(i), d)) for i, ((d, *_), s) in enumerate(zip(docs, sets))]


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(re.sub("[^0-9]", "", s))):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def pii_base(text):
    digits = lambda m: len(re.sub("[^0-9]", "", m))
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= digits(m) <= 19 and luhn(m)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= digits(m) <= 15),
    )
    found = [(m.start(), i, m.end()) for i, (_, rx, ok) in enumerate(rules) for m in re.finditer(rx, text) if ok(m[0])]
    return sorted(found), [k for k, *_ in rules]


def pii(docs):
    out = []
    for d, text, *_ in docs:
        found, kinds = pii_base(text or "")
        n = Counter(k for _, k, _ in found)
        out.append((d, *(n[i] for i in range(4)), sha(",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in found))))
    return out


def contamination(docs, items):
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, text in items:
        w = rx.findall((text or "").translate(UPPER))
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add("null" if i is None else str(i))
    sizes = {len(w) for w in windows}
    out = []
    for d, text, *_ in docs:
        w = rx.findall((text or "").translate(UPPER))
        hit, got = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    got |= ids
        out.append((d, len(w), len(hit), len(got), sha(",".join(sorted(got))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def quality(docs):
    out = []
    for d, text, *_ in docs:
        text = text or ""
        w = WORD.findall(text)
        seen, dup = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        at = {}
        for i in range(len(w) - 7):
            at.setdefault(tuple(w[i : i + 8]), []).append(i)
        rep = len({k for v in at.values() if len(v) > 1 for i in v for k in range(i, i + 8)})
        out.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, rep, len(w) < 20 or 100 * rep > 30 * len(w)))
    return out


def line_dedup(docs, least=20):
    """docs: (id, text) with different ids. The text left of each, and how many lines went: those in a run of neighbouring
    lines (blank ones do not count, nor white space at ends) of `least` words that an earlier document has too."""
    strip = " \t\n\v\f\r"
    earlier, out = [], []
    for d, text in sorted(docs):
        raw = (text or "").split("\n")
        lines = [(i, x.strip(strip)) for i, x in enumerate(raw) if x.strip(strip)]
        words = [len(WORD.findall(x)) for _, x in lines]
        gone = set()
        for other, at in earlier:
            i = 0
            while i < len(lines):
                longest = 0
                for k in at.get(lines[i][1], ()):
                    n = 0
                    while i + n < len(lines) and k + n < len(other) and lines[i + n][1] == other[k + n]:
                        n += 1
                    longest = max(longest, n)
                if sum(words[i : i + longest]) >= least:
                    gone.update(j for j, _ in lines[i : i + longest])
                i += 1
        out.append((d, text if not gone else "\n".join(x for j, x in enumerate(raw) if j not in gone), len(gone)))
        at = {}
        for k, (_, x) in enumerate(lines):
            at.setdefault(x, []).append(k)
        earlier.append(([x for _, x in lines], at))
    return out


def clusters(vectors, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    order = sorted(kept, key=lambda r: (sha(f"1:{'' if r[0] is None else r[0]}"), r[1]))
    centroids = np.array([v for _, v in order[:k]], dtype=np.int64)
    x = np.array([v for _, v in kept], dtype=np.int64)
    for last in [False] * rounds + [True]:
        d = ((x[:, None, :] - centroids[None]) ** 2).sum(axis=2)
        of = d.argmin(axis=1)
        if not last:
            for c in set(of.tolist()):
                centroids[c] = x[of == c].sum(axis=0) // (of == c).sum()
    near = d.min(axis=1)
    return [(i, int(c), int(n), int(near[of == c].sum()), int(near.sum()), sha(",".join(map(str, centroids[c].tolist())))) for (i, _), c, n in zip(kept, of, near)]


def word_runs(w):
    """(start, length, period) of every run, from the definition: each period over the whole list."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and not any(all(w[x] == w[x + d] for x in range(i, j + q - d)) for d in range(1, q)):
                out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periods(docs):
    out = []
    for d, text in docs:
        w = WORD.findall(text or "")
        n = len(w)
        h = zlib.crc32(str(d).encode()) if d is not None else 1
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
        runs = word_runs(w)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
        out.append((d, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out
