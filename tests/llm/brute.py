"""Plain versions of the operators, over lists of (doc_id, text)."""

from __future__ import annotations

import hashlib
import re
import zlib

SECRET = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
}


def luhn(text: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(re.sub("[^0-9]", "", text))):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits(text: str) -> int:
    return len(re.sub("[^0-9]", "", text))


PERSONAL = {
    "email": (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    "ip": (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    "card": (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 14 <= digits(m[0]) <= 19 and luhn(m[0])),
    "phone": (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 10 <= digits(m[0]) <= 15),
}


def spans(text: str | None, kinds: dict) -> list[tuple[str, int, int]]:
    found = [(m.start(), rank, m.end(), kind) for rank, (kind, (pattern, ok)) in enumerate(kinds.items()) for m in pattern.finditer(text or "") if ok(m)]
    return [(kind, start, end) for start, _, end, kind in sorted(found)]


def span_row(text: str | None, kinds: dict) -> tuple:
    found = spans(text, kinds)
    joined = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
    return (*(sum(k == x for k, _, _ in found) for x in kinds), hashlib.sha256(joined.encode()).hexdigest())


def tokens(rows, path: str, end: int) -> list[tuple]:
    """(doc_id, start, n_tokens, crc32) in ascending doc_id order."""
    import numpy as np
    from tokenizers import Tokenizer

    own, at, out = Tokenizer.from_file(path), 0, []
    own.encode_special_tokens = True
    for doc, text in sorted(rows, key=lambda r: r[0]):
        ids = own.encode(text or "", add_special_tokens=False).ids + [end]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def bpe(rows, path: str, pattern: str) -> dict:
    import numpy as np
    import tiktoken

    from sitegrain.llm.byte_bpe import ranks

    coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})
    out = {}
    for doc, text in rows:
        ids = coder.encode_ordinary(text or "")
        out[doc] = len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()
    return out


def exact(rows) -> dict:
    groups: dict[str, list[int]] = {}
    for doc, text in rows:
        groups.setdefault(re.sub(r"[ \t-\r]+", " ", text or ""), []).append(doc)
    return {doc: (min(own), len(own), doc == min(own), hashlib.sha256(norm.encode()).hexdigest()) for norm, own in groups.items() for doc in own}


def shingles(text: str | None, width: int) -> frozenset:
    words = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < width:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def near(rows, width: int, percent: int = 80) -> dict:
    """doc_id -> (n_shingles, component_id), by comparing every pair that shares a shingle."""
    sets = {doc: shingles(text, width) for doc, text in rows}
    root = {doc: doc for doc in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders: dict[tuple, list[int]] = {}
    for doc in sorted(sets):
        shared: dict[int, int] = {}
        for s in sets[doc]:
            for other in holders.setdefault(s, []):
                shared[other] = shared.get(other, 0) + 1
            holders[s].append(doc)
        for other, both in shared.items():
            if 100 * both >= percent * (len(sets[doc]) + len(sets[other]) - both):
                a, b = sorted((find(doc), find(other)))
                root[b] = a
    return {doc: (len(own), find(doc)) for doc, own in sets.items()}


def perplexity(trusted: list[str], text: str) -> tuple[int, float]:
    """Characters and summed negative log-probability under the interpolated modified Kneser-Ney model of four characters."""
    import math
    from collections import Counter, defaultdict

    def prepared(t: str) -> str:
        t = re.sub(r"[ \t-\r]+", " ", t).translate(str.maketrans("123456789", "000000000")).strip(" ")
        return "    " + "".join(c if ord(c) < 0x10000 else "￿" for c in t)

    counts = {4: Counter()}
    for t in trusted:
        t = prepared(t)
        counts[4].update(t[i - 3 : i + 1] for i in range(4, len(t)))
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cut = {}
    for k in counts:
        n1, n2, n3, n4 = (sum(v == i for v in counts[k].values()) or 1 for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        cut[k] = [0] + [min(max(i - (i + 1) * y * b / a, 0.05 * i), 0.95 * i) for i, (a, b) in enumerate([(n1, n2), (n2, n3), (n3, n4)], 1)]
    after = {k: defaultdict(list) for k in counts}
    for k in counts:
        for g, n in counts[k].items():
            after[k][g[:-1]].append(n)

    def p(g: str) -> float:
        k = len(g)
        own = after[k].get(g[:-1])
        lower = (lambda: p(g[1:])) if k > 1 else (lambda: 1 / (len(counts[1]) + 1))
        if not own:
            return lower()
        d = lambda n: cut[k][min(n, 3)]
        n = counts[k].get(g, 0)
        return (n - d(n) + sum(map(d, own)) * lower()) / sum(own)

    t = prepared(text)
    return len(t) - 4, -sum(math.log(p(t[i - 3 : i + 1])) for i in range(4, len(t)))
