"""Plain versions of the operators, for small inputs."""

import collections
import hashlib
import re
from pathlib import Path

DATA = Path("/root/testdata")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
TOKEN = re.compile("[^\x20\x09-\x0d]+")


def decontamination(docs, items):
    windows = collections.defaultdict(set)
    for item, text in items:
        w = WORD.findall((text or "").translate(LOW))
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add(str(item))
    sizes, out = {len(w) for w in windows}, []
    for _, text in docs:
        w = WORD.findall((text or "").translate(LOW))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    found |= own
                    hit |= set(range(k, k + n))
        ids = ",".join(sorted(found))
        out.append((len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def without_hits(docs, items):
    """Texts with the words of benchmark windows cut out; rows left without words go."""
    windows = set()
    for _, text in items:
        w = WORD.findall((text or "").translate(LOW))
        windows |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12) if w else 0)}
    sizes, out = {len(w) for w in windows}, []
    for row, text in docs:
        spans = [m.span() for m in WORD.finditer((text or "").translate(LOW))]
        w = [(text or "").translate(LOW)[a:b] for a, b in spans]
        hit = [False] * len(w)
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit[k : k + n] = [True] * n
        if any(hit):
            if all(hit):
                continue
            cut, k = set(), 0
            while k < len(w):
                if hit[k]:
                    end = k
                    while end + 1 < len(w) and hit[end + 1]:
                        end += 1
                    cut |= set(range(spans[k][0], spans[end][1]))
                    k = end
                k += 1
            text = "".join(c for i, c in enumerate(text) if i not in cut)
        out.append((row, text))
    return out


def repeats(texts, span):
    raw = [(t or "").encode() for t in texts]
    count = collections.Counter(b[i : i + span] for b in raw for i in range(len(b) - span + 1))
    out = []
    for b in raw:
        cut = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if count[b[i : i + span]] > 1:
                cut[i : i + span] = b"\1" * span
        kept = bytes(x for x, c in zip(b, cut) if not c)
        out.append((len(b), sum(cut), sum(1 for i in range(len(b)) if cut[i] and (i == 0 or not cut[i - 1])), hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore")))
    return out


def stripped(texts, span, words):
    """Texts without strings of ``span`` bytes that start anywhere else too and without runs of ``words`` words that another text holds; None where nothing is left of a cut text."""
    raw = [(t or "").encode() for t in texts]
    count = collections.Counter(b[i : i + span] for b in raw for i in range(len(b) - span + 1))
    holders, places = collections.defaultdict(set), []
    for row, t in enumerate(texts):
        found = [(m.group(), len((t or "")[: m.start()].encode()), len((t or "")[: m.end()].encode())) for m in WORD.finditer((t or "").translate(LOW))]
        places.append(found)
        for k in range(len(found) - words + 1):
            holders[tuple(w for w, _, _ in found[k : k + words])].add(row)
    out = []
    for t, b, found in zip(texts, raw, places, strict=True):
        cut = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if count[b[i : i + span]] > 1:
                cut[i : i + span] = b"\1" * span
        for k in range(len(found) - words + 1):
            if len(holders[tuple(w for w, _, _ in found[k : k + words])]) > 1:
                lo, hi = found[k][1], found[k + words - 1][2]
                cut[lo:hi] = b"\1" * (hi - lo)
        kept = bytes(x for x, c in zip(b, cut) if not c).decode(errors="ignore")
        out.append(t if not any(cut) else kept or None)
    return out


def similar(docs, threshold=90, shingle=3):
    """doc_id to (size of its set, least doc_id that it reaches)."""
    sets = {}
    for i, text in docs:
        w = TOKEN.findall((text or "").translate(LOW))
        sets[i] = {tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))} if w else set()
    comp = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    while True:
        before = dict(comp)
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
        if before == comp:
            return {i: (len(sets[i]), comp[i]) for i in sets}
