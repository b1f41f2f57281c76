"""Explicit schemas of the tables that the stages pass on. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _s(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


_str, _int, _dbl, _bool = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
_strs = T.ArrayType(T.StringType())

RAW_CHUNKS = _s(
    ("chunk_type", _str), ("page_num", _int), ("ordinal", _int), ("raw_text", _str), ("raw_image", T.BinaryType()),
    ("bbox", T.ArrayType(_dbl)), ("source_file", _str), ("parse_error", _str),
)
CORRECTED = _s(("structured_text", _str), ("intuition_summary", _str), ("key_concepts", _strs), ("confidence", _dbl), ("agent_notes", _str))
CHUNK_VALIDATION = _s(("is_valid", _bool), ("issues", _strs), ("corrected", CORRECTED), ("verdict_score", _dbl), ("validator_notes", _str))
CROSS_LINK = _s(("source_chunk_id", _str), ("target_chunk_id", _str), ("link_type", _str), ("confidence", _dbl), ("description", _str))
PROCESSED_CHUNKS = _s(
    ("chunk_id", _str), ("chunk_type", _str), ("page_num", _int), ("source_file", _str), ("structured_text", _str),
    ("intuition_summary", _str), ("key_concepts", _strs), ("confidence", _dbl), ("agent_notes", _str), ("extract_status", _str),
)
STORE = _s(
    ("chunk_id", _str), ("page_num", _int), ("source_file", _str), ("structured_text", _str), ("intuition_summary", _str),
    ("key_concepts", _strs), ("confidence", _dbl), ("agent_notes", _str), ("validation_score", _dbl), ("validation_issues", _str),
    ("embedding", T.ArrayType(_dbl)), ("chunk_type", _str),
)
SOURCE_CHUNK = _s(("chunk_id", _str), ("type", _str), ("file", _str), ("page", _int), ("score", _dbl), ("summary", _str), ("text", _str))
ANSWER_VALIDATION = _s(("is_grounded", _bool), ("hallucinations", _strs), ("revised_answer", _str), ("verdict_score", _dbl), ("validator_notes", _str))
QUESTIONS = _s(("qid", T.LongType()), ("question", _str), ("embedding", T.ArrayType(_dbl)))
TRACE_EVENTS = _s(("trace_id", _str), ("span", _str), ("level", _str), ("message", _str), ("elapsed_ms", _dbl))
SCORES = _s(("trace_id", _str), ("name", _str), ("value", _dbl), ("data_type", _str), ("comment", _str))
