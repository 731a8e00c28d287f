"""Plain-Python statement of the chunking rules, used as a brute-force oracle in tests."""

from __future__ import annotations


def keep_split(text: str, sep: str) -> list[str]:
    if sep == "":
        return list(text)
    parts = text.split(sep)
    pieces = [parts[0]] + [sep + p for p in parts[1:]]
    return [p for p in pieces if p]


def merge(pieces: list[str], size: int, overlap: int) -> list[str]:
    chunks: list[str] = []
    window: list[str] = []
    total = 0
    for p in pieces:
        if window and total + len(p) > size:
            joined = "".join(window).strip()
            if joined:
                chunks.append(joined)
            while total > overlap or (total + len(p) > size and total > 0):
                total -= len(window.pop(0))
        window.append(p)
        total += len(p)
    joined = "".join(window).strip()
    if joined:
        chunks.append(joined)
    return chunks


def line_merge(text: str, size: int, overlap: int) -> list[str]:
    return merge(keep_split(text, "\n"), size, overlap)


def recursive(text: str, size: int, overlap: int, seps: list[str] | None = None) -> list[str]:
    seps = seps if seps is not None else ["\n\n", "\n", " ", ""]
    sep, rest = seps[-1], []
    for i, s in enumerate(seps):
        if s == "":
            sep = s
            break
        if s in text:
            sep, rest = s, seps[i + 1:]
            break
    out: list[str] = []
    good: list[str] = []
    for p in keep_split(text, sep):
        if len(p) < size:
            good.append(p)
            continue
        if good:
            out += merge(good, size, overlap)
            good = []
        out += recursive(p, size, overlap, rest) if rest else [p]
    if good:
        out += merge(good, size, overlap)
    return out
