"""Plain-Python versions of the operators' results, and awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import re

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

LONG = " ".join(f"wort{i % 977} {i}" for i in range(30_000))
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, rid long, n long, node long, rank int, words string, "
          "size string, kept string, score string, lang_pred string, digest string, text_sha256 string, h1 long, i int, ln int")


def odd_rows() -> list[tuple]:
    """Null ids and texts, empty and very long texts, repeated rows, and columns named like the operators' own."""
    texts = [(1, "The quick brown fox\njumps over"), (1, "The quick brown fox\njumps over"), (2, None), (3, ""), (None, "the quick BROWN fox\njumps over"),
             (4, LONG), (5, " \t\n "), (6, "12 345 !!"), (None, None), (7, "einwort"), (8, "EINWORT"), (9, LONG + " end"), (1, "ein ganz anderer Text"), (10, "é ß 日本語 \U0001F600")]
    rest = (99, 98, 97, 3, "x", "x", "x", "x", "x", "x", "x", 5, 6, 7)
    return [(i, t, None if k % 5 == 0 else "en" if k % 2 else "de", None if k % 4 == 0 else f"s{k % 3}", None if t is None else len(t), *rest)
            for k, (i, t) in enumerate(texts)]


def odd(spark, rows: list[tuple] | None = None):
    return spark.createDataFrame(odd_rows() if rows is None else rows, SCHEMA).repartition(3)


def shingles(text: str | None, width: int = 2) -> frozenset:
    w = SPACED.findall((text or "").translate(UP))
    return frozenset(tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def near_components(rows: list[tuple], width: int = 2) -> list[tuple]:
    """(doc_id, n_shingles, component_id, kept) of (doc_id, text) rows."""
    sets = [shingles(t, width) for _, t in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                top[find(i)] = find(j)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        ids = least.setdefault(find(i), [])
        if d is not None:
            ids.append(d)
    return [(d, len(s), c := min(least[find(i)], default=None), d == c) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def copied_lines(rows: list[tuple], min_words: int) -> list[set[int]]:
    """Per (doc_id, text) row the lines that lie in a repeated run with an earlier copy."""
    lines = [t.split("\n") if t is not None else [] for _, t in rows]
    places = [(i, k) for i in range(len(rows)) for k in range(len(lines[i]))]
    gone: list[set[int]] = [set() for _ in rows]
    for b, (i, k) in enumerate(places):
        for j, m in places[:b]:
            if k and m and lines[i][k - 1] == lines[j][m - 1]:
                continue                               # not the start of the run
            n = 0
            while k + n < len(lines[i]) and m + n < len(lines[j]) and lines[i][k + n] == lines[j][m + n]:
                n += 1
            if n and sum(len(SPACED.findall(x)) for x in lines[i][k:k + n]) >= min_words:
                gone[i].update(range(k, k + n))
    return gone


def near_copies(n: int, edits: int, seed: int, base_words: int = 120) -> list[str]:
    """n texts that differ from a base in `edits` words each."""
    rng = random.Random(seed)
    base = [f"w{seed}x{rng.randrange(10 ** 6)}" for _ in range(base_words)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(base_words)] = f"e{rng.randrange(10 ** 6)}"
        out.append(" ".join(words))
    return out


def mix_targets(sizes: list[int]) -> list[float]:
    """Targets of sources in code point order by filling up: weights 1, 2, 3, at most 3 times a source's size."""
    total, target = sum(sizes), [0.0] * len(sizes)
    free, left = set(range(len(sizes))), float(sum(sizes))
    while free and total:
        level = left / sum(i % 3 + 1 for i in free)
        full = {i for i in free if level * (i % 3 + 1) >= 3 * sizes[i]}
        if not full:
            for i in free:
                target[i] = level * (i % 3 + 1)
            break
        for i in full:
            target[i] = 3.0 * sizes[i]
            left -= target[i]
        free -= full
    return target


def mixed_rows(rows: list[tuple], block: int = 64, golden: int = 1327217885, period: int = 1 << 31) -> list[tuple]:
    """(doc_id, text) of every pass of the mix over (doc_id, text, source) rows with distinct ids, slot by slot."""
    size = {d: len(SPACED.findall(t)) for d, t, _ in rows}
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    members = [[(d, t) for d, t, s in rows if s == x] for x in sources]
    sizes = [sum(size[d] for d, _ in m) for m in members]
    target, total, cuts, at = mix_targets(sizes), sum(sizes), [], 0.0
    for i, x in enumerate(target):
        low, high = math.floor(at / total * period), math.floor((at + x) / total * period)
        at += x
        if x > 0:
            cuts.append([i, low, high])
    cuts[-1][2] = period
    used: dict = {}
    taken = [0] * len(sources)
    for j in range(-(-total // block)):
        point = j * golden % period
        i = next(i for i, low, high in cuts if low <= point < high)
        n = -(-sizes[i] // block)
        used.setdefault((i, taken[i] // n), set()).add(taken[i] % n)
        taken[i] += 1
    out = []
    for i, m in enumerate(members):
        at = 0
        for d, t in sorted(((d, t) for d, t in m if size[d]), key=lambda x: (hashlib.md5(f"mix:{x[0]}".encode()).hexdigest(), x[0])):
            for turn in range(3):
                n = sum(k // block in used.get((i, turn), ()) for k in range(at, at + size[d]))
                if n:
                    out.append((d, t if n == size[d] else t[:[w.end() for w in SPACED.finditer(t)][n - 1]]))
            at += size[d]
    return sorted(out)
