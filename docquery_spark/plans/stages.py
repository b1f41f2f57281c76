"""Queries of whole stages: ingest, checkpoints, store, answers, links, sinks and settings, with SQL for each.

Models whose replies are to be known answer with what their input holds: an extractor with the part of
the content after an arrow, a judge with the original. The rows of both engines are those of
``catalogue.FIXTURES``, or whole tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Settings
from ..functions import model_output as m
from ..functions import text
from ..operators import answer, ingest, linking, sinks
from ..operators.store import ChunkStore, storable
from ..operators.tracing import Trace
from ..schemas import RAW_CHUNKS, SCORES
from ..sources import binary, documents
from ..tables import file_system, shared_folder
from .catalogue import FIXTURES, HITS, PLAIN, STRIP, _chunks, _plain, _questions, _stripped, _t, fixture, query, values

FIXTURES |= {
    "asked_chunks": ("page_num int, chunk_type string, raw_text string", [
        (i, *x) for i, x in enumerate([
            ("text", 'long text→{"structured_text": "t", "intuition_summary": "s", "key_concepts": ["a", "b"], "confidence": 0.9, "agent_notes": "n"}'),
            ("text", "x" * 2100 + "→no reply"), ("text", 'again→{"confidence": 0.4, "structured_text": "first"}→{"confidence": 0.2, "structured_text": "second"}'),
            ("text", 'again→{"confidence": 0.1}→nothing'), ("text", "broken→boom"), ("text", '→{"confidence": null, "key_concepts": "lone"}'),
            ("table", '| a |→{"schema":{"columns":["a"]},"structured_text":"table"}'), ("table", "| b |→"), ("table", '| c |→{"confidence": 0.5}'),
            ("figure", '→{"figure_type": "bar", "agent_notes": "n"}'), ("figure", "→a chart of " + "y" * 1100), ("figure", "caption→boom"), ("figure", '→{"figure_type": "", "confidence": 0.3}→{"figure_type": "map"}'),
        ])
    ]),
    "judged_chunks": ("page_num int, chunk_type string, raw_text string, confidence double", [
        (i, *x) for i, x in enumerate([
            ("text", '{"is_valid": true, "verdict_score": 0.8}', 0.9), ("text", '{"is_valid": true}', 0.24), ("text", '{"is_valid": true}', 0.25), ("table", "what?", 0.9), ("table", "boom", 0.9), ("text", "boom", 0.2),
            ("text", '{"is_valid": false, "verdict_score": 0.1, "corrected_structured_text": "fixed", "corrected_key_concepts": ["k"], "issues": ["i", "j"], "validator_notes": "v"}', 0.9),
            ("figure", '<think>no {x}</think>{"is_valid": false, "corrected_structured_text": "", "corrected_intuition_summary": null, "issues": "lone"}', 0.1), ("text", '{"is_valid": "FALSE"}', 0.9),
        ])
    ]),
    "judged_answers": ("aid int, reply string", [
        (i, x) for i, x in enumerate([
            '{"is_grounded": true, "verdict_score": 0.9}', '{"is_grounded": false, "revised_answer": "better", "hallucinations": ["h", "g"], "verdict_score": 0.2, "validator_notes": "v"}',
            '{"is_grounded": false, "revised_answer": "NULL"}', '{"is_grounded": false, "revised_answer": "", "hallucinations": "lone"}', '{"verdict_score": "0.3"}', '{"verdict_score": "high"}', "what?", "boom",
            '<think>{"is_grounded": false}</think> {"is_grounded": true}',
        ])
    ]),
    "loose": ("lid int, reply string", [
        (i, x) for i, x in enumerate([
            '{"b": true, "l": ["x", "y"], "n": 0.5, "t": "null"}', '{"b": "false", "l": "lone", "n": "0.25", "t": "Null"}', '{"b": null, "l": null, "n": "x", "t": "text"}', '{"l": "", "t": ""}', "{}",
        ])
    ]),
    "captions": ("chunk_id long, chunk_type string, source_file string, structured_text string", [
        (0, "text", "d", "As Figure 2a and table 3 show"), (1, "figure", "d", "Figure 2A: layout"), (2, "table", "d", "Table 3. Data, see figure 9"), (3, "figure", "e", "Figure 2a elsewhere"),
        (4, "text", "d", "vegetable 3"), (5, "text", "e", "fig. 2a and Figure  2a"), (6, "text", None, None),
    ]),
}


def _folder(spark) -> str:
    """A folder of this query's own, which goes when the session's JVM ends."""
    path = f"{shared_folder(spark)}/query-{uuid.uuid4().hex}"
    at, files = file_system(spark, path)
    files.deleteOnExit(at)
    return path


def _raw(spark, name):
    rows = fixture(spark, name).withColumns({
        "ordinal": F.lit(0), "raw_image": F.lit(None).cast("binary"), "bbox": F.lit(None).cast("array<double>"),
        "source_file": F.lit("f"), "parse_error": F.lit(None).cast("string"),
    })
    return rows.select(*RAW_CHUNKS.fieldNames())


def _told(kind, content, retry, *image):
    parts = [*content.split("→"), ""]
    reply = parts[2] if retry and len(parts) > 3 else parts[1]
    if reply == "boom":
        raise ValueError("boom")
    return reply


def _as_told(claim, original, *image):
    if original.endswith("boom"):
        raise ValueError("boom")
    return original


def _json(reply: str) -> str:
    body = rf"regexp_extract(regexp_replace(coalesce({reply}, ''), '<think>.*?</think>', '', 'gis'), '\{{.*\}}', 0, 's')"
    return f"CASE WHEN {body} <> '' AND json_valid({body}) THEN {body} ELSE '{{}}' END"


def _string(j: str, name: str, default: str = "NULL") -> str:
    return f"coalesce(json_extract_string({j}, '$.{name}'), {default})"


def _number(j: str, name: str, default: str) -> str:
    return f"coalesce(TRY_CAST(json_extract_string({j}, '$.{name}') AS DOUBLE), {default})"


def _list(j: str, name: str) -> str:
    """A list; of a lone text that isn't empty, a list of it."""
    at = f"json_extract({j}, '$.{name}')"
    one = f"json_extract_string({j}, '$.{name}')"
    return f"CASE json_type({at}) WHEN 'ARRAY' THEN json_extract_string({j}, '$.{name}[*]') WHEN 'VARCHAR' THEN CASE WHEN {one} = '' THEN [] ELSE [{one}] END ELSE [] END"


def _truth(j: str, name: str) -> str:
    return f"CASE lower(json_extract_string({j}, '$.{name}')) WHEN 'true' THEN true WHEN 'false' THEN false END"


def _fields(source: str, reply: str) -> str:
    """Fields of extracted chunks, by the defaults of their type."""
    failed_figure = "(failed AND chunk_type = 'figure')"
    schema = "CASE WHEN json_type(json_extract(j, '$.schema')) IS NULL THEN '{}' ELSE CAST(json_extract(j, '$.schema') AS VARCHAR) END"
    plain = "CASE chunk_type WHEN 'table' THEN raw_text WHEN 'figure' THEN substr(coalesce(reply, ''), 1, 1000) ELSE substr(raw_text, 1, 2000) END"
    return f"""SELECT page_num, chunk_type, raw_text,
  CASE WHEN {failed_figure} THEN CASE WHEN raw_text = '' THEN '[OCR unavailable]' ELSE raw_text END
       WHEN chunk_type = 'table' THEN {_string('j', 'structured_text', plain)} || chr(10) || '<!-- schema: ' || {schema} || ' -->' ELSE {_string('j', 'structured_text', plain)} END AS structured_text,
  CASE WHEN {failed_figure} THEN 'OCR fallback.' ELSE {_string('j', 'intuition_summary', "''")} END AS intuition_summary,
  array_to_string({_list('j', 'key_concepts')}, '|') AS concepts,
  CASE WHEN {failed_figure} THEN 0.3::DOUBLE ELSE {_number('j', 'confidence', "CASE chunk_type WHEN 'figure' THEN 0.6 ELSE 0.7 END")} END AS confidence,
  CASE WHEN {failed_figure} THEN 'Vision model not loaded.' WHEN chunk_type = 'figure'
       THEN 'figure_type=' || CASE WHEN {_string('j', 'figure_type', "''")} = '' THEN '?' ELSE {_string('j', 'figure_type')} END || ' | ' || {_string('j', 'agent_notes', "''")}
       ELSE {_string('j', 'agent_notes', "''")} END AS agent_notes,
  CASE WHEN failed THEN 'error: ValueError: boom' WHEN j = '{{}}' THEN 'no JSON' ELSE 'ok' END AS extract_status
  FROM (SELECT *, {_json('reply')} AS j FROM (SELECT *, r = 'boom' AS failed, nullif(r, 'boom') AS reply FROM (SELECT *, {reply} AS r FROM {source})))"""


_FIRST = _fields(values("asked_chunks"), "split_part(raw_text, '→', 2)")
_AGAIN = _fields(f"(SELECT page_num, chunk_type, raw_text FROM ({_FIRST}) WHERE confidence < 0.5)", "CASE WHEN len(string_split(raw_text, '→')) > 2 THEN split_part(raw_text, '→', 3) ELSE split_part(raw_text, '→', 2) END")


@query(f"SELECT * EXCLUDE (raw_text) FROM (SELECT * FROM ({_FIRST}) WHERE confidence >= 0.5 UNION ALL SELECT * FROM ({_AGAIN}))")
def extract_chunks(spark, d):
    """Extraction by type, its defaults and fallbacks, and one retry of what is below 0.5."""
    done = ingest.extract(_raw(spark, "asked_chunks"), _told)
    return done.select("page_num", "chunk_type", "structured_text", "intuition_summary", F.array_join("key_concepts", "|").alias("concepts"), "confidence", "agent_notes", "extract_status")


@query(f"SELECT iid || '.png' AS source_file FROM {values('images')} WHERE width >= 80 AND height >= 80")
def image_files(spark, d):
    """Figure chunks of image files that are large enough."""
    rows = fixture(spark, "images").select(F.concat(F.lit("/x/"), F.col("iid").cast("string"), F.lit(".png")).alias("path"), "width", "height", F.lit(b"i").alias("content"))
    return binary.from_images(rows).select("source_file")


def _pages(path, content):
    """A page a line: a table, two images and the line's text; a line ``bad`` is a broken document."""
    for line in content.decode().splitlines():
        if line == "bad":
            raise ValueError("bad")
        yield {"tables": [[["h", None], [line, "1"]], [["one row"]]], "images": [(80, 80, b"i"), (79, 80, b"j"), "odd"], "text": line * 40}


@query("""SELECT * FROM (VALUES (1, 'table', 0, '| h |  |' || chr(10) || '| --- | --- |' || chr(10) || '| a | 1 |', NULL), (1, 'figure', 1, NULL, NULL),
  (1, 'figure', 2, NULL, 'ValueError: not enough values to unpack (expected 3, got 1)'), (1, 'text', 3, repeat('a', 40), NULL), (0, 'text', 4, NULL, 'ValueError: bad')) v(page_num, chunk_type, ordinal, raw_text, parse_error)""")
def binary_scan(spark, d):
    """A file's pages: tables, then images, then text; what can't be read is a row with its error."""
    folder = _folder(spark)
    spark.createDataFrame([("a",), ("bad",)], "line string").coalesce(1).write.text(folder)

    def parser(path, content):
        for page in _pages(path, content):
            yield {**page, "images": [x if isinstance(x, tuple) else ("odd",) for x in page["images"]]}

    rows = binary.read(spark, folder, parser, "*.txt")
    return rows.select("page_num", "chunk_type", "ordinal", "raw_text", "parse_error")


_VERDICT = f"""SELECT *, {_json("CASE WHEN raw_text = 'boom' THEN NULL ELSE raw_text END")} AS j FROM {values('judged_chunks')}"""
_VALID = f"coalesce({_truth('j', 'is_valid')}, true)"


@query(f"""SELECT page_num, {_VALID} AS is_valid, array_to_string({_list('j', 'issues')}, '; ') AS issues, {_number('j', 'verdict_score', '1.0')} AS verdict_score,
  CASE WHEN raw_text = 'boom' THEN 'error: ValueError: boom' WHEN {_truth('j', 'is_valid')} IS NULL THEN 'malformed' ELSE 'ok' END AS judge_status,
  CASE WHEN NOT {_VALID} THEN 'corrected' WHEN confidence >= 0.25 THEN 'accepted' ELSE 'discarded' END AS disposition,
  CASE WHEN NOT {_VALID} AND {_string('j', 'corrected_structured_text', "''")} <> '' THEN {_string('j', 'corrected_structured_text')} ELSE 'text ' || page_num END AS structured_text,
  CASE WHEN NOT {_VALID} AND len({_list('j', 'corrected_key_concepts')}) > 0 THEN array_to_string({_list('j', 'corrected_key_concepts')}, '|') ELSE 'own' END AS concepts,
  CASE WHEN NOT {_VALID} THEN {_number('j', 'verdict_score', '1.0')} ELSE confidence END AS confidence,
  CASE WHEN NOT {_VALID} THEN '[CHECKPOINT-A CORRECTED] ' || {_string('j', 'validator_notes', "''")} ELSE 'notes' END AS agent_notes FROM ({_VERDICT})""")
def checkpoint_a(spark, d):
    """Validation of chunks, corrections in place, and what a failed or malformed judge leaves."""
    chunks = fixture(spark, "judged_chunks").withColumns({
        "raw_image": F.lit(None).cast("binary"), "structured_text": F.concat(F.lit("text "), F.col("page_num").cast("string")), "intuition_summary": F.lit("s"),
        "key_concepts": F.array(F.lit("own")), "agent_notes": F.lit("notes"),
    })
    done = ingest.accept(ingest.validate_chunks(chunks, _as_told))
    return done.select(
        "page_num", "validation.is_valid", text.join_issues(F.col("validation.issues")).alias("issues"), "validation.verdict_score", "judge_status", "disposition",
        "structured_text", F.array_join("key_concepts", "|").alias("concepts"), "confidence", "agent_notes",
    )


@query(f"""SELECT chunk_id, md5(CAST(to_json({{'chunk_type': chunk_type, 'structured_text': substr(structured_text, 1, 1500), 'intuition_summary': intuition_summary, 'key_concepts': ['k'],
  'confidence': confidence, 'agent_notes': ''}}) AS VARCHAR)) AS view_md5 FROM {PLAIN}""")
def judge_view(spark, d):
    """What a judge is shown of each document's chunk."""
    rows = _plain(spark, d).withColumn("key_concepts", F.array(F.lit("k"))).withColumn("agent_notes", F.lit(None).cast("string"))
    return rows.select("chunk_id", F.md5(ingest.judge_view(F.col("structured_text")).cast("binary")).alias("view_md5"))


def _b(mode: str) -> str:
    j = _json("CASE WHEN reply = 'boom' THEN NULL ELSE reply END")
    revised = _string("j", "revised_answer")
    if mode == "structured":
        revised, score = f"CASE WHEN lower({revised}) = 'null' THEN NULL ELSE {revised} END", f"CASE WHEN reply = 'boom' THEN 0.5 ELSE {_number('j', 'verdict_score', '1.0')} END"
        notes = f"CASE WHEN reply = 'boom' THEN 'Validation error: boom' ELSE {_string('j', 'validator_notes', chr(39) * 2)} END"
    else:
        score, notes = _number("j", "verdict_score", "1.0"), _string("j", "validator_notes", "''")
    return f"""SELECT aid, '{mode}' AS mode, coalesce({_truth('j', 'is_grounded')}, true) AS is_grounded, array_to_string({_list('j', 'hallucinations')}, '|') AS hallucinations,
  nullif({revised}, '') AS revised_answer, CAST({score} AS DOUBLE) AS verdict_score, {notes} AS validator_notes,
  CASE WHEN reply = 'boom' THEN 'error: ValueError' WHEN {_truth('j', 'is_grounded')} IS NULL THEN 'malformed' ELSE 'ok' END AS judge_status
  FROM (SELECT *, {j} AS j FROM {values('judged_answers')})"""


@query(f"{_b('structured')} UNION ALL {_b('json')}")
def checkpoint_b(spark, d):
    """Validation of answers in both modes."""
    rows = fixture(spark, "judged_answers").select("aid", F.lit("q").alias("question"), F.lit("a").alias("answer"), F.col("reply").alias("sources"))

    def judge(claim, shown):
        return _as_told(claim, shown.split("[SOURCES]\n", 1)[1])

    out = None
    for mode in ("structured", "json"):
        v = answer.validate_answers(rows, judge, mode).select(
            "aid", F.lit(mode).alias("mode"), "verdict.is_grounded", F.array_join("verdict.hallucinations", "|").alias("hallucinations"), "verdict.revised_answer",
            "verdict.verdict_score", "verdict.validator_notes", "judge_status",
        )
        out = v if out is None else out.unionByName(v)
    return out


@query(f"""SELECT lid, coalesce({_truth('reply', 'b')}, true) AS truth, array_to_string({_list('reply', 'l')}, '|') AS list, {_number('reply', 'n', '1.0')} AS number,
  CASE WHEN lower({_string('reply', 't')}) IN ('null', '') THEN NULL ELSE {_string('reply', 't')} END AS text FROM {values('loose')}""")
def loose_fields(spark, d):
    """Fields that models type loosely."""
    doc = m.json_variant(F.col("reply"))
    return fixture(spark, "loose").select(
        "lid", m.boolean_field(doc, "b", True).alias("truth"), F.array_join(m.array_field(doc, "l"), "|").alias("list"),
        m.score_or(F.try_variant_get(doc, "$.n", "string")).alias("number"), m.nullable_text(F.try_variant_get(doc, "$.t", "string")).alias("text"),
    )


_CLEAN = _stripped("regexp_replace(text, '[ \\t]+', ' ', 'g')")
_ID = "sha256(concat_ws(chr(31), concat_ws('/', source, CAST(doc_id AS VARCHAR)), '1', 'text', '0', text))"
_GATED = f"(SELECT * FROM documents WHERE length({STRIP}) >= 40)"


@query(f"""SELECT {_ID} AS chunk_id, 'text' AS chunk_type, concat_ws('/', source, CAST(doc_id AS VARCHAR)) AS source_file, md5(CASE WHEN length({_CLEAN}) < 20 THEN substr(text, 1, 2000) ELSE {_CLEAN} END) AS text_md5,
  CASE WHEN length({_CLEAN}) < 20 THEN 0.7 WHEN length({_CLEAN}) >= 100 THEN 0.9 ELSE 0.6 END::DOUBLE AS confidence, CASE WHEN length({_CLEAN}) < 20 THEN 'no JSON' ELSE 'ok' END AS extract_status,
  'accepted' AS disposition FROM {_GATED}""")
def ingest_documents(spark, d):
    """Gates, extraction by rules, ids and the confidence floor over all documents, without a judge."""
    done = ingest.ingest(documents.raw_from_documents(_t(spark, d, "documents")), judge=None)
    return done.select("chunk_id", "chunk_type", "source_file", F.md5(F.col("structured_text").cast("binary")).alias("text_md5"), "confidence", "extract_status", "disposition")


@query(f"""SELECT CAST(count(*) AS BIGINT) AS raw, CAST(count(*) AS BIGINT) AS accepted, CAST(0 AS BIGINT) AS corrected, CAST(0 AS BIGINT) AS discarded, CAST(count(*) AS BIGINT) AS upserted FROM {_GATED}""")
def ingest_totals(spark, d):
    """Counters of an ingest of all documents without models."""
    return ingest.counters(ingest.ingest_linked(documents.raw_from_documents(_t(spark, d, "documents"))))


@query(f"SELECT {_ID} AS chunk_id, md5(substr(text, 1, 2000)) AS text_md5, 0.8::DOUBLE AS confidence, 'accepted' AS disposition FROM {_GATED}")
def linked_ingest(spark, d):
    """The mode without models, through its fallback, over all documents."""
    done, status = ingest.ingest_or_standard(documents.raw_from_documents(_t(spark, d, "documents")))
    if status != "ok":
        raise RuntimeError(status)
    return done.select("chunk_id", F.md5(F.col("structured_text").cast("binary")).alias("text_md5"), "confidence", "disposition")


_REFERENCE = r"lower(regexp_replace(regexp_replace(x, '(?i)fig\.?\s', 'figure '), '\s+', ' ', 'g'))"


@query(rf"""WITH t AS (SELECT source_file, chunk_id, regexp_replace(lower(regexp_extract(structured_text, '(?i)^\s*((?:figure|table|section)\s+[0-9]+[a-z]?)\b', 1)), '\s+', ' ', 'g') AS name FROM {values('captions')}),
m AS (SELECT DISTINCT source_file, chunk_id, chunk_type, {_REFERENCE} AS name
      FROM (SELECT source_file, chunk_id, chunk_type, unnest(regexp_extract_all(structured_text, '(?i)\b((?:figure|fig\.?|table|section)\s+[0-9]+[a-z]?)\b', 1)) AS x FROM {values('captions')})),
e AS (SELECT m.chunk_id AS source, t.chunk_id AS target, m.chunk_type || '_references_' || split_part(m.name, ' ', 1) AS kind FROM m JOIN t USING (source_file, name) WHERE t.name <> '' AND m.chunk_id <> t.chunk_id)
SELECT c.chunk_id, coalesce(string_agg(e.target || ':' || e.kind, ',' ORDER BY e.target), '') AS links FROM {values('captions')} c LEFT JOIN e ON e.source = c.chunk_id GROUP BY c.chunk_id""")
def link_chunks(spark, d):
    """References by name, found and attached."""
    chunks = fixture(spark, "captions")
    rows = linking.attach(chunks, linking.link(chunks))
    return rows.select("chunk_id", F.array_join(F.transform("cross_links", lambda x: F.concat(x["target_chunk_id"].cast("string"), F.lit(":"), x["link_type"])), ",").alias("links"))


def _stored(docs, version: str):
    """Rows of the store: doc_id and text."""
    return docs.select(
        F.col("doc_id").cast("string").alias("chunk_id"), F.lit(1).alias("page_num"), F.lit("f").alias("source_file"), F.col("text").alias("structured_text"), F.lit(version).alias("intuition_summary"),
        F.array().cast("array<string>").alias("key_concepts"), F.lit(1.0).alias("confidence"), F.lit("").alias("agent_notes"), F.lit(None).cast("double").alias("validation_score"),
        F.lit(None).cast("string").alias("validation_issues"), F.array().cast("array<double>").alias("embedding"), F.when(F.col("doc_id") % 3 == 2, "figure").otherwise("text").alias("chunk_type"),
    )


def _upserted(spark, d) -> ChunkStore:
    store = ChunkStore(spark, _folder(spark))
    store.upsert(_stored(_t(spark, d, "documents"), "old"))
    labels = _t(spark, d, "labels")
    store.upsert(_stored(labels.select("doc_id", F.concat(F.lit("label "), F.col("quality").cast("string")).alias("text")), "new"))
    return store


_UPSERTED = """(SELECT doc_id, text, 'old' AS version FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id) UNION ALL SELECT doc_id, 'label ' || quality, 'new' FROM labels)"""


@query(f"SELECT doc_id, md5(text) AS text_md5, version FROM {_UPSERTED}")
def store_upsert(spark, d):
    """All documents into a chunk store, then a row for each label in place of its document."""
    rows = _upserted(spark, d).read()
    return rows.select(F.col("chunk_id").cast("long").alias("doc_id"), F.md5(F.col("structured_text").cast("binary")).alias("text_md5"), F.col("intuition_summary").alias("version"))


@query(f"SELECT doc_id, version FROM {_UPSERTED} WHERE doc_id % 3 = 2")
def store_read_type(spark, d):
    """One chunk type of a store of two tables."""
    return _upserted(spark, d).read("figure").select(F.col("chunk_id").cast("long").alias("doc_id"), F.col("intuition_summary").alias("version"))


@query(f"""SELECT page_num, CASE WHEN {_VALID} THEN confidence ELSE {_number('j', 'verdict_score', '1.0')} END AS confidence, {_number('j', 'verdict_score', '1.0')} AS validation_score,
  array_to_string({_list('j', 'issues')}, '; ') AS validation_issues, CASE WHEN NOT {_VALID} AND len({_list('j', 'corrected_key_concepts')}) > 0 THEN {_list('j', 'corrected_key_concepts')}[1] ELSE 'own' END AS concept, 1.0::DOUBLE AS norm
  FROM ({_VERDICT}) WHERE NOT {_VALID} OR confidence >= 0.25""")
def chunk_metadata(spark, d):
    """Judged chunks in the store's columns, with unit embeddings."""
    chunks = fixture(spark, "judged_chunks").withColumns({
        "raw_image": F.lit(None).cast("binary"), "structured_text": F.concat(F.lit("text "), F.col("page_num").cast("string")), "intuition_summary": F.lit("s"),
        "key_concepts": F.array(F.lit("own")), "agent_notes": F.lit("notes"), "chunk_id": F.col("page_num").cast("string"), "source_file": F.lit("f"),
    })
    rows = storable(ingest.accept(ingest.validate_chunks(chunks, _as_told)))
    norm = F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)), 6)
    return rows.select("page_num", "confidence", "validation_score", "validation_issues", F.element_at("key_concepts", 1).alias("concept"), norm.alias("norm"))


@query(f"""WITH {HITS}, one AS (SELECT * FROM hits WHERE position = 1),
told AS (SELECT qid, {_stripped("substr(substr(structured_text, 1, 800), 1, 300)")} || ' [' || upper(chunk_type) || ' | ' || source_file || ' p.' || page_num || ']' AS answer,
      'best source: [1] (' || upper(chunk_type) || ' | ' || source_file || ' p.' || page_num || ' | score=' || printf('%.2f', score) || ')' AS trace FROM one)
SELECT told.qid, 'unvalidated' AS phase, md5({_stripped('answer')}) AS answer_md5, CAST(length({_stripped('answer')}) AS INTEGER) AS answer_length, trace AS reasoning_trace, n.n AS n_hits, 'skipped' AS judge_status
FROM told JOIN (SELECT qid, count(*) AS n FROM hits GROUP BY qid) n ON n.qid = told.qid""")
def answer_questions(spark, d):
    """The query path over all chunks, with a generator that quotes and no judge."""
    done = answer.answer(_chunks(spark, d), _questions(spark, d), validates=False)
    return done.select("qid", "phase", F.md5(F.col("answer").cast("binary")).alias("answer_md5"), "answer_length", "reasoning_trace", "n_hits", "judge_status")


@query(f"""WITH {HITS} SELECT qid, CASE qid % 300 WHEN 0 THEN 'revised' WHEN 100 THEN 'warned' ELSE 'validated' END AS phase, qid % 300 = 200 AS answer_is_grounded, qid % 300 = 0 AS answer_was_revised,
  CASE qid % 300 WHEN 200 THEN 0 ELSE 2 END AS hallucination_count, CASE qid % 300 WHEN 200 THEN 1.0 ELSE 0.2 END::DOUBLE AS answer_verdict_score,
  CASE qid % 300 WHEN 0 THEN 'better' WHEN 100 THEN '[VALIDATION WARNING: claims may not be grounded]' || chr(10) || chr(10) || 'answer' ELSE 'answer' END AS answer, count(*) AS n_hits FROM hits GROUP BY qid""")
def answer_validated(spark, d):
    """The query path with a judge that finds every third answer grounded and revises another third."""
    def judge(claim, shown):
        n = int(shown.split("\n")[1].rsplit(" ", 1)[1]) % 300
        return '{"is_grounded": true}' if n == 200 else '{"is_grounded": false, "verdict_score": 0.2, "hallucinations": ["a", "b"], "revised_answer": "%s"}' % ("better" if n == 0 else "null")

    questions = _questions(spark, d).withColumn("question", F.concat_ws(" ", "question", F.col("qid").cast("string")))
    done = answer.answer(_chunks(spark, d), questions, generator=lambda q, c: "answer", judge=judge)
    v = F.col("validation_summary")
    return done.select("qid", "phase", v["answer_is_grounded"].alias("answer_is_grounded"), v["answer_was_revised"].alias("answer_was_revised"), "hallucination_count", v["answer_verdict_score"].alias("answer_verdict_score"), "answer", "n_hits")


@query("SELECT doc_id, md5(CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END) AS text_md5 FROM documents")
def chunks_export(spark, d):
    """All documents' chunks saved as JSON and read back."""
    rows = _t(spark, d, "documents").select("doc_id", F.col("text").alias("structured_text"), F.array(F.lit(1.0)).alias("embedding"), F.array(F.lit("l")).alias("cross_links"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("structured_text", T.StringType())])
    back = spark.read.schema(schema).json(sinks.save_chunks(rows, _folder(spark), "documents"))
    return back.select("doc_id", F.md5(F.col("structured_text").cast("binary")).alias("text_md5"))


@query("SELECT doc_id AS qid, md5(CASE WHEN length(text) > 1000 THEN substr(text, 1, 1000) || '...' ELSE text END) AS trace_md5 FROM documents WHERE doc_id % 100 = 0")
def answers_export(spark, d):
    """Answers saved by question and read back, their traces cut."""
    rows = _t(spark, d, "documents").filter("doc_id % 100 = 0").select(F.col("doc_id").alias("qid"), F.col("text").alias("reasoning_trace"))
    schema = T.StructType([T.StructField("reasoning_trace", T.StringType()), rows.schema["qid"]])
    back = spark.read.schema(schema).json(sinks.save_answers(rows, _folder(spark), "documents"))
    return back.select("qid", F.md5(F.col("reasoning_trace").cast("binary")).alias("trace_md5"))


@query(f"SELECT 't' || sid AS trace_id, 'score' AS name, CAST(sid AS DOUBLE) AS value, CASE WHEN upper({_stripped('data_type')}) IN ('NUMERIC', 'BOOLEAN', 'CATEGORICAL', 'CORRECTION') THEN upper({_stripped('data_type')}) ELSE 'NUMERIC' END AS data_type, 'c' AS comment FROM {values('score_types')}")
def score_rows(spark, d):
    """Scores appended and read back."""
    path = _folder(spark)
    rows = fixture(spark, "score_types").select(F.concat(F.lit("t"), F.col("sid").cast("string")).alias("trace_id"), F.lit("score").alias("name"), F.col("sid").cast("double").alias("value"), "data_type", F.lit("c").alias("comment"))
    sinks.append_scores(rows, path)
    return spark.read.schema(SCORES).parquet(path)


@query("SELECT * FROM (VALUES ('s', 'inner', 'ERROR', 'KeyError: ''x'''), ('s', 'outer', 'DEFAULT', '')) v(trace_id, span, level, message)")
def trace_rows(spark, d):
    """Spans appended and read back: one that failed inside one that didn't."""
    trace = Trace(spark, _folder(spark), "s")
    with trace.span("outer"):
        try:
            with trace.span("inner"):
                raise KeyError("x")
        except KeyError:
            pass
    path = trace.path
    trace.flush()
    return spark.read.parquet(f"{path}/events").filter("elapsed_ms >= 0").drop("elapsed_ms")


@query("""SELECT * FROM (VALUES ('pipeline.extra_figures', '5'), ('pipeline.max_context_chunks', '8'), ('validation.confidence_floor', '0.25'), ('models.server.url', 'u'), ('none.such', 'default')) v(key, value)""")
def settings_values(spark, d):
    """Settings merged key by key, and values by dotted names."""
    settings = Settings()
    settings.put("pipeline.extra_figures", 5)
    settings.put("models.server.url", "u")
    keys = ("pipeline.extra_figures", "pipeline.max_context_chunks", "validation.confidence_floor", "models.server.url", "none.such")
    return spark.createDataFrame([(k, str(settings.get(k, "default"))) for k in keys], "key string, value string")
