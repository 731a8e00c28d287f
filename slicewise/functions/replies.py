"""Model replies -> columns (P7, P8, P10, P11, P12), all native expressions.

JSON is parsed with VARIANT functions. Python's json.loads accepts exactly
one value; Spark's parsers accept trailing text, so a value is parsed as the
first of two elements of an array and accepted only when that array has
exactly two and ends with the marker (`{..} {..}`, `{..} junk` and `{..}],[{..}`
then fail as in Python). Duplicate keys keep the
last value (`spark.sql.variant.allowDuplicateKeys`, set by the session).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slicewise.functions.text import STRIP_CLASS

_WS = STRIP_CLASS  # Python's \s for str patterns is the same set as str.strip()

# ---------------------------------------------------------------------------
# Tolerant-extraction patterns of the reference (Python `re`
# semantics, DOTALL), restated with an explicit whitespace class.
# ---------------------------------------------------------------------------
QA_OBJECT_PATTERN = (r'(?s)\{' + _WS + r'*"question"' + _WS + r'*:' + _WS + r'*".*?"' + _WS + r'*,'
                     + _WS + r'*"answers"' + _WS + r'*:' + _WS + r'*\[.*?\]' + _WS + r'*\}')
SCORE_PATTERN = r'(?s)"score"' + _WS + r'*:' + _WS + r'*(\d+(\.\d+)?)'
JUSTIFICATION_PATTERN = r'(?s)"justification"' + _WS + r'*:' + _WS + r'*"(.*?)"'
VALID_SCORES = (0, 1, 2)
# ---------------------------------------------------------------------------

_MARKER = "end of value 5f0c6b1e"       # closes the array that a value is parsed in


def one_json(text: Column) -> Column:
    """Parse exactly one JSON value (as Python's json.loads); SQL NULL if it does not parse."""
    arr = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_MARKER}"]'))), "$", "array<variant>")
    whole = (F.size(arr) == 2) & (F.try_variant_get(F.try_element_at(arr, F.lit(2)), "$", "string") == _MARKER)
    return F.when(whole, F.element_at(arr, 1))


def vtype(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_object(v: Column) -> Column:
    return v.isNotNull() & vtype(v).startswith("OBJECT")


def is_array(v: Column) -> Column:
    return v.isNotNull() & vtype(v).startswith("ARRAY")


def has_key(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant").isNotNull()


# --------------------------------------------------------------------------- P7 / P8
def chat_envelope(body: Column) -> Column:
    """Chat response body -> struct(valid, tokens_used, gen_model, ans_content, thinking_content)."""
    v = one_json(body)
    return F.struct(
        v.isNotNull().alias("valid"),
        F.try_variant_get(v, "$.usage.total_tokens", "bigint").alias("tokens_used"),
        F.try_variant_get(v, "$.model", "string").alias("gen_model"),
        F.try_variant_get(v, "$.choices[0].message.content", "string").alias("ans_content"),
        F.try_variant_get(v, "$.choices[0].message.reasoning_content", "string").alias("thinking_content"))


def embedding_envelope(body: Column) -> Column:
    """Embedding response body -> struct(valid, tokens_used, model, embedding array<double>)."""
    v = one_json(body)
    return F.struct(
        v.isNotNull().alias("valid"),
        F.try_variant_get(v, "$.usage.total_tokens", "bigint").alias("tokens_used"),
        F.try_variant_get(v, "$.model", "string").alias("model"),
        F.try_variant_get(v, "$.data[0].embedding", "array<double>").alias("embedding"))


# --------------------------------------------------------------------------- P10
def _is_qa(item: Column) -> Column:
    return is_object(item) & has_key(item, "question") & is_array(F.try_variant_get(item, "$.answers", "variant"))


def qa_items(reply: Column) -> Column:
    """P10: free text -> array<variant> of {question, answers:list} objects, plus the branch used.

    From the first `[`/`{` to the last `]`/`}` (else the whole text), `\\"` -> `"`,
    literal `\\n` and newlines removed, then parsed: a list keeps its valid items,
    one valid object becomes a one-item list, anything else is empty. When the
    text does not parse, QA-shaped objects are searched in the original text
    and parsed one by one.
    """
    span = F.regexp_extract(reply, r"(?s)[\[{].*[\]}]", 0)
    span = F.when(span == "", reply).otherwise(span)
    clean = F.replace(F.replace(F.replace(span, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("")),
                      F.lit("\n"), F.lit(""))
    parsed = one_json(clean)
    primary = (F.when(is_array(parsed), F.filter(F.try_variant_get(parsed, "$", "array<variant>"), _is_qa))
               .when(_is_qa(parsed), F.array(parsed))
               .otherwise(F.array().cast("array<variant>")))
    fallback = F.filter(F.transform(F.regexp_extract_all(reply, F.lit(QA_OBJECT_PATTERN), 0), one_json), _is_qa)
    return F.struct(F.when(parsed.isNull(), fallback).otherwise(primary).alias("items"),
                    F.when(parsed.isNull(), F.lit("fallback")).otherwise(F.lit("json")).alias("branch"))


def qa_question(item: Column) -> Column:
    return F.try_variant_get(item, "$.question", "string")


def qa_answers(item: Column) -> Column:
    return F.try_variant_get(item, "$.answers", "array<string>")


# --------------------------------------------------------------------------- P11 / P12
def judgement(reply: Column) -> Column:
    """P11 + P12: judge reply -> struct(valid, score bigint, justification, branch).

    First `{` to last `}` (else the whole text), `\\'` -> `'`, literal `\\n` and
    newlines removed, then parsed; an object with both keys gives the pair.
    When the text does not parse, both fields are searched in the original
    text and an integral score becomes an integer. Valid: both present, score
    an integer (JSON true/false count, as Python's bool is an int) in {0,1,2}.
    """
    span = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    span = F.when(span == "", reply).otherwise(span)
    clean = F.replace(F.replace(F.replace(span, F.lit("\\'"), F.lit("'")), F.lit("\\n"), F.lit("")),
                      F.lit("\n"), F.lit(""))
    parsed = one_json(clean)
    json_ok = is_object(parsed) & has_key(parsed, "score") & has_key(parsed, "justification")
    sv = F.try_variant_get(parsed, "$.score", "variant")
    st = vtype(sv)
    json_int = F.when(st == "BIGINT", F.try_variant_get(sv, "$", "bigint")).when(
        st == "BOOLEAN", F.try_variant_get(sv, "$", "boolean").cast("bigint"))
    json_just = F.try_variant_get(parsed, "$.justification", "string")

    score_txt = F.regexp_extract(reply, SCORE_PATTERN, 1)
    just_found = reply.rlike(JUSTIFICATION_PATTERN)
    rx_ok = (score_txt != "") & just_found
    score_num = F.when(score_txt != "", score_txt.try_cast("double"))
    rx_int = F.when(score_num == F.floor(score_num), F.floor(score_num).cast("bigint"))
    rx_just = F.regexp_extract(reply, JUSTIFICATION_PATTERN, 1)

    is_json = parsed.isNotNull()
    present = F.when(is_json, json_ok).otherwise(rx_ok)
    score = F.when(is_json & json_ok, json_int).when(~is_json & rx_ok, rx_int)
    valid = present & score.isNotNull() & score.isin(*VALID_SCORES)
    return F.struct(F.coalesce(valid, F.lit(False)).alias("valid"),
                    F.when(valid, score).alias("score"),
                    F.when(valid, F.when(is_json, json_just).otherwise(rx_just)).alias("justification"),
                    F.when(is_json, F.lit("json")).otherwise(F.lit("fallback")).alias("branch"))
