"""Plain versions of the operators, written apart from them, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash


def line_dedup(docs, min_chars=20, min_docs=3):
    """{doc_id: (n_lines, n_dropped, kept)}"""
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in re.sub(r"^[\x20\x09-\x0d]+|[\x20\x09-\x0d]+$", "", line))

    holders = defaultdict(set)
    for doc_id, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(doc_id)
    out = {}
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == doc_id]
        out[doc_id] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def simhash(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(docs, radius=4):
    """{doc_id: (fingerprint, component)} by comparing all pairs."""
    prints = {d: simhash(t) for d, t in docs}
    ids = sorted(prints)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (prints[d], find(d)) for d in ids}


def winnow(text, rolled, k, window):
    """[(hash, position)] with one pass over each window; ``rolled`` gives the 32-bit hash of a gram."""
    if not text:
        return []
    k = min(k, len(text))
    hashes = [rolled(text[i : i + k]) for i in range(len(text) - k + 1)]
    chosen = []
    for start in range(max(1, len(hashes) - window + 1)):
        part = hashes[start : start + window]
        at = start + max(i for i, h in enumerate(part) if h == min(part))
        if not chosen or chosen[-1] != (hashes[at], at):
            chosen.append((hashes[at], at))
    return chosen


def library_ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def token_rows(tokenizer, docs, end=2):
    """{doc_id: (start, n, crc32)} in ascending order of the ids."""
    out, start = {}, 0
    for doc_id, text in sorted(docs):
        ids = [*library_ids(tokenizer, text), end]
        out[doc_id] = (start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        start += len(ids)
    return out


def unigram(docs, held_out):
    """{doc_id: (n_tokens, n_known, N, base)}"""
    import math

    tokens = {d: [w for w in re.findall(r"[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))] + [None] for d, t in docs}
    counts = Counter(w for d, ws in tokens.items() if not held_out(d) for w in ws)
    n, v = sum(counts.values()), len(counts)
    return {d: (len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for d, ws in tokens.items()}


def base_spans(text):
    """kind:start:end of the fixed patterns, straight from their statement."""
    text, found = text or "", []
    assign = re.compile(r"""(?a:((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
    for m in assign.finditer(text):
        if m[1].isascii() and len(m[2]) >= 8:
            found.append((m.start(), 0, "assign", m.end()))
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))
