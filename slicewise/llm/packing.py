"""Packing by power-of-two decomposition.

A document of n ids is cut, from its start, into as many `max_len` pieces as fit and
then into the binary digits of the rest, longest first. Every piece is a
sequence of its own whose length is a power of two, so no sequence crosses
documents and none is padded; sequences of one length form a bucket, from which a
trainer draws equal-length batches (`write_buckets` stores one folder per
length).

Ids come from the tokenizer named in `vocabulary`, with id `END` after each
document. Texts of plain Latin characters are split by the vocabulary's own
word pattern and each distinct word is encoded once per worker (at most
`CACHE_WORDS` words, and as many runs between white space, are held, then the table is emptied);
any other text goes through the tokenizer whole. Both ways give the tokenizer's ids.

Sequence ids: (partition << 33) + running number, unique in a run and equal in
reruns over the same splits; no shuffle, and memory is bounded by one batch of texts.

Defined cases: null text is empty (one piece: the end id); empty table: empty
result; null or repeated doc_ids: every row is packed for itself; only doc_id
and text are read, so further columns play no part.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MAX_LEN = 2048
END = 1
CACHE_WORDS = 1_200_000
VOCABULARY = "word_bpe_49k.json"

# Characters for which this module splits words itself; fixed by the vocabulary's own pattern and lower-casing.
_PLAIN = re.compile(r"[\t\n\x0b\x0c\r -~À-ÖØ-öø-ÿ]*")
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class Encoder:
    """Little-endian 32-bit ids of whole texts."""

    def __init__(self, path: str):
        import numpy as np
        from tokenizers import Tokenizer
        self.tokenizer, self.known, self.words = Tokenizer.from_file(path), {}, {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        import numpy as np
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """As `_encode` of each word, but a text of many words at a time, parted where a word's last piece ends."""
        import numpy as np
        out: list[bytes] = []
        for i in range(0, len(words), 4096):
            part = words[i:i + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(stops) == len(part):
                raw = ids.tobytes()
                out += [raw[a:b] for a, b in zip([0, *stops], stops, strict=False)]
            else:
                out += self._encode(part)
        return out

    def _encode_runs(self, runs: list[str]) -> list[bytes]:
        """Ids of runs without white space: each is split into words, each new word encoded once."""
        split = list(map(_WORD.findall, runs))
        new = [w for w in dict.fromkeys(chain.from_iterable(split)) if w not in self.words]
        if len(self.words) + len(new) > CACHE_WORDS:
            self.words.clear()
            new = list(dict.fromkeys(chain.from_iterable(split)))
        self.words.update(zip(new, self._encode_words(new), strict=True))
        look = self.words.__getitem__
        return [look(s[0]) if len(s) == 1 else b"".join(map(look, s)) for s in split]

    def __call__(self, texts: list[str]) -> list[bytes]:
        # words never reach over white space, so what stands between it is looked up as one
        split = [t.lower().split() if _PLAIN.fullmatch(t) and "<|" not in t else None for t in texts]
        runs, stops = [], [0]
        for s in split:
            runs += s or ()
            stops.append(len(runs))
        parts = list(map(self.known.get, runs))
        missing = [i for i, part in enumerate(parts) if part is None]
        if missing:
            new = list(dict.fromkeys([runs[i] for i in missing]))
            codes = dict(zip(new, self._encode_runs(new), strict=True))
            for i in missing:
                parts[i] = codes[runs[i]]
            if len(self.known) + len(codes) > CACHE_WORDS:
                self.known.clear()
            self.known.update(codes)
        rest = iter(self._encode([t for t, s in zip(texts, split, strict=True) if s is None]))
        return [next(rest) if s is None else b"".join(parts[a:b]) for s, a, b in zip(split, stops, stops[1:], strict=False)]


def cuts(n: int, max_len: int = MAX_LEN) -> list[int]:
    """Piece lengths of a document of n ids: whole `max_len`, then the binary digits of the rest."""
    rest = n % max_len
    return [max_len] * (n // max_len) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


_DIGEST = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
           ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]


def pack(docs: DataFrame, path: str | None = None, max_len: int = MAX_LEN, end: int = END, with_ids: bool = True) -> DataFrame:
    """One row per piece; with_ids adds the ids themselves (array of int)."""
    if max_len & (max_len - 1) or max_len < 1:
        raise ValueError("max_len must be a power of two")
    path = path or vocabulary_path()
    schema = pa.schema(_DIGEST + ([("ids", pa.list_(pa.int32()))] if with_ids else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext
        encode, tail = Encoder(path), int(end).to_bytes(4, "little")
        sequence = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            step, i = 1 << 21, 0
            while i < len(ids):
                j, chars = i, 0
                while j < len(ids) and (j == i or chars < step):
                    chars += len(texts[j] or "")
                    j += 1
                rows = []
                for doc_id, coded in zip(ids[i:j], encode([t or "" for t in texts[i:j]]), strict=True):
                    coded += tail
                    n, at = len(coded) // 4, 0
                    for length in cuts(n, max_len):
                        piece = coded[4 * at:4 * (at + length)]
                        row = (doc_id, at, length, zlib.crc32(piece), n, sequence, 0)
                        rows.append(row + (np.frombuffer(piece, "<u4").astype(np.int32),) if with_ids else row)
                        sequence += 1
                        at += length
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                i = j

    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(run, fields + (", ids array<int>" if with_ids else "")))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder per sequence length."""
    pieces.withColumn("bucket", F.col("length")).write.partitionBy("bucket").parquet(path)


def op3_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False)
