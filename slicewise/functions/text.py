"""Native string expressions shared by the operators (all JVM-side, no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must agree with the reference's observable behaviour.
# ---------------------------------------------------------------------------
# Characters removed by Python's str.strip(): Unicode White_Space plus U+001C..U+001F.
STRIP_CLASS = (
    r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
# Default token pattern of the TF-IDF vectoriser: runs of two or more word characters.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
# Default separators of the recursive splitter, in order.
DEFAULT_SEPARATORS = ["\n\n", "\n", " ", ""]
# Cut applied to a rendered prompt before it is sent (characters).
PROMPT_MAX_CHARS = 8192
# ---------------------------------------------------------------------------


# The same characters as a set, for trim(BOTH <set> FROM ...): no regex, codegen'd.
STRIP_CHARS = "".join(chr(c) for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
                                       *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


def py_strip(col: Column) -> Column:
    """Python `str.strip()` semantics (Spark's default trim only removes U+0020)."""
    return F.trim(col, F.lit(STRIP_CHARS))


def java_literal(sep: str) -> str:
    """Regex matching `sep` literally (for split)."""
    if "\\E" in sep:
        return "".join("\\" + ch if not ch.isalnum() else ch for ch in sep)
    return "\\Q" + sep + "\\E"


def tokens(col: Column) -> Column:
    """Lower-cased word tokens as the default TF-IDF vectoriser sees them."""
    return F.regexp_extract_all(F.lower(col), F.lit(TOKEN_PATTERN), 0)


def collection_name(file_type: Column, strategy: Column, run_id: Column) -> Column:
    """Collection name of a (file type, strategy, run) triple.

    lower-case, spaces and '-' -> '_', append the run id, cut to 60 characters,
    every character that is not a letter/digit, '_' or '.' -> '_'; if the first
    or last character is not a letter/digit, replace both ends by 'c'.
    """
    ft = F.lower(F.replace(file_type, F.lit(" "), F.lit("_")))
    st = F.lower(F.replace(strategy, F.lit(" "), F.lit("_")))
    raw = F.replace(F.concat(ft, F.lit("_"), st), F.lit("-"), F.lit("_"))
    raw = F.concat(raw, F.lit("_"), run_id)
    cut = F.substring(raw, 1, 60)
    clean = F.regexp_replace(cut, r"[^\p{L}\p{N}_.]", "_")
    ends_ok = clean.rlike(r"^[\p{L}\p{N}]") & clean.rlike(r"[\p{L}\p{N}]$")
    return F.when(ends_ok, clean).otherwise(
        F.concat(F.lit("c"), F.substring(clean, F.lit(2), F.greatest(F.length(clean) - 2, F.lit(0))), F.lit("c")))


def collection_id(file_type: Column, strategy: Column, run_id: Column) -> Column:
    """Key of a collection: a hash of the whole triple, so long names that are cut alike stay apart."""
    return F.sha2(F.concat_ws("\u0001", file_type, strategy, run_id), 256)


def chunk_id(collection: Column, doc_id: Column, chunk_index: Column) -> Column:
    """Deterministic chunk id from its collection's key, document and position."""
    return F.sha2(F.concat_ws("\u0001", collection, doc_id.cast("string"), chunk_index.cast("string")), 256)


def file_stem(path: Column) -> Column:
    """File name without directory and last extension."""
    base = F.regexp_extract(path, r"([^/\\]+)$", 1)
    return F.when(base.rlike(r"^.+\.[^.]*$"), F.regexp_extract(base, r"^(.+)\.[^.]*$", 1)).otherwise(base)
