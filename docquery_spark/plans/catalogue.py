"""One query for each operator, over whole tables or small stated fixtures, with SQL for each.

Chunks are derived from ``documents`` and ``embeddings`` (see :func:`..sources.documents.embedded_chunks`).
Questions are all vectors whose number is divisible by 100. Behaviour that the tables don't show, as
model replies, uses the rows of :data:`FIXTURES` in both engines; queries of whole stages are in ``stages``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import model_output as m
from ..functions import routing, text, vectors
from ..operators import answer, ingest, linking, retrieve, sinks
from ..sources import documents

FIXTURES: dict[str, tuple[str, list[tuple]]] = {
    "questions": ("qid long, question string", [
        (0, "What does figure 2 show?"), (1, "図2は何を示していますか？"), (2, "What is the mapping?"), (3, "Summarise the method"), (4, "CHART"), (5, None),
    ]),
    "replies": ("rid long, reply string", [
        (0, '{"structured_text": "a", "confidence": 0.9}'), (1, 'Sure: {"structured_text": "b"} done'), (2, '{"a": 1} and {"b": 2}'),
        (3, '<think>plan {x}</think>{"confidence": 0.4}'), (4, '<THINK>one</THINK> mid <think>two</think> end'), (5, "{broken"), (6, ""),
        (7, '{"structured_text": null, "key_concepts": ["p", "q"]}'), (8, "plain answer"), (9, None),
        (10, "<think>\nplan\n</think>\n\nParis.\n"), (11, '\t{\n"structured_text": "c"\n}\n'), (12, '{"a": 1}, {"b": 2}'), (13, '{"a": 1}} {"b": {}'), (14, "\u3000 wide\t"),
    ]),
    "images": ("iid long, width int, height int", [(0, 79, 80), (1, 80, 79), (2, 80, 80), (3, 611, 278), (4, None, 100)]),
    "tables": ("tid long, cells array<array<string>>", [
        (0, []), (1, [["h"]]), (2, [["h1", "h2"], ["1", None]]), (3, [["a|b", "c"], ["0", ""], ["x"]]),
    ]),
    "validations": ("vid long, valid boolean, corrected boolean, confidence double", [
        (i, v, c, f) for i, (v, c, f) in enumerate([
            (v, c, f) for v in (True, False) for c in (True, False) for f in (0.24, 0.25, 0.49, 0.5, None)
        ])
    ]),
    "corrections": ("cid long, corrected string, original string", [(0, "", "o"), (1, None, "o"), (2, "c", "o"), (3, "c", None), (4, "", None)]),
    "links": ("chunk_id long, structured_text string", [
        (0, "See Figure 2a for the layout"), (1, "vegetable soup"), (2, "Refer to section 2"), (3, "nothing here"), (4, "Figure showing results"), (5, None),
    ]),
    "edges": ("source_chunk_id long, target_chunk_id long, link_type string, confidence double", [
        (0, 3, "text_references_figure", 0.9), (0, 1, "text_references_table", 0.8), (2, 0, "text_references_section", 0.8), (99, 1, "lost", 0.1),
    ]),
    "workflow": ("wid long, n_hits long, validates boolean, answer string, grounded boolean, revised string", [
        (i, *x) for i, x in enumerate([
            (n, v, a, g, r) for n in (0, 2) for v in (True, False) for a in ("answer", None) for g in (True, False) for r in ("better", None)
        ])
    ]),
    "issues": ("iid long, issues array<string>", [(0, []), (1, ["a"]), (2, ["a", "b; c"]), (3, None)]),
    "score_types": ("sid long, data_type string", [(0, "numeric"), (1, " Boolean "), (2, "CATEGORICAL"), (3, "correction"), (4, "other"), (5, None), (6, "categorical\n"), (7, "\tboolean\u3000")]),
    "paths": ("pid long, path string", [(0, "/data/a/report.v2.pdf"), (1, "plain"), (2, "s3://b/x.pdf"), (3, ".hidden")]),
}


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, list):
        return "[" + ", ".join(map(_literal, v)) + "]"
    return "'" + v.replace("'", "''") + "'"


_SQL_TYPES = {"long": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE", "array<string>": "VARCHAR[]", "array<array<string>>": "VARCHAR[][]"}


def values(name: str) -> str:
    """A fixture as a SQL relation."""
    schema, rows = FIXTURES[name]
    columns = [c.split(" ") for c in schema.split(", ")]
    cast = ", ".join(f"CAST({c} AS {_SQL_TYPES[t]}) AS {c}" for c, t in columns)
    body = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    return f"(SELECT {cast} FROM (VALUES {body}) AS v({', '.join(c for c, _ in columns)}))"


def fixture(spark: SparkSession, name: str) -> DataFrame:
    schema, rows = FIXTURES[name]
    return spark.createDataFrame(rows, schema)


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _chunks(spark, d):
    return documents.embedded_chunks(_t(spark, d, "documents"), _t(spark, d, "embeddings"))


def _plain(spark, d):
    return documents.document_chunks(_t(spark, d, "documents"))


def _questions(spark, d):
    """Every vector whose number is divisible by 100 as a question; every other one asks for a figure."""
    vec = _t(spark, d, "embeddings").filter(F.col("vec_id") % 100 == 0)
    return vec.select(F.col("vec_id").alias("qid"), F.when(F.col("vec_id") % 200 == 0, "What does the figure show?").otherwise("What is the method?").alias("question"), "embedding")


PLAIN = """(SELECT doc_id AS chunk_id, ['text', 'table', 'figure'][CAST(doc_id % 3 + 1 AS INTEGER)] AS chunk_type, CAST(doc_id % 10 + 1 AS INTEGER) AS page_num,
  source AS source_file, text AS structured_text, substr(text, 1, 60) AS intuition_summary, (doc_id * 37 % 101) / 100.0::DOUBLE AS confidence FROM documents)"""
CHUNKS = f"(SELECT p.*, embedding FROM {PLAIN} p JOIN embeddings ON chunk_id % (SELECT count(*) FROM embeddings) = vec_id)"
SCORED = f"""(SELECT q.vec_id AS qid, c.* EXCLUDE (embedding), list_dot_product(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score
  FROM {CHUNKS} c CROSS JOIN (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q)"""
HITS = f"""s AS {SCORED},
f AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY rank <= 8),
g AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM s WHERE chunk_type = 'figure' AND qid % 200 = 0 QUALIFY rank <= 3),
u AS (SELECT *, 'primary' AS source FROM f UNION ALL SELECT *, 'figure' AS source FROM g WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.qid = g.qid AND f.structured_text = g.structured_text)),
hits AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY source DESC, rank) AS position FROM u)"""
STRIP = r"regexp_replace(text, '^[\s\x0B\x1C-\x1F\x{85}\p{Z}]+|[\s\x0B\x1C-\x1F\x{85}\p{Z}]+$', '', 'g')"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"SELECT doc_id, length(text) AS n FROM documents WHERE length({STRIP}) >= 40")
def scan_text_gate(spark, d):
    return _t(spark, d, "documents").filter(text.is_text_chunk(F.col("text"))).select("doc_id", F.length("text").cast("long").alias("n"))


@query(f"SELECT tid, len(cells) AS n FROM {values('tables')} WHERE len(cells) >= 2")
def table_row_gate(spark, d):
    return fixture(spark, "tables").filter(text.is_table_chunk(F.col("cells"))).select("tid", F.size("cells").cast("long").alias("n"))


@query(f"SELECT iid FROM {values('images')} WHERE width >= 80 AND height >= 80")
def image_size_gate(spark, d):
    return fixture(spark, "images").filter(text.is_image_chunk(F.col("width"), F.col("height"))).select("iid")


@query(f"""SELECT tid, CASE WHEN len(cells) = 0 THEN '' ELSE array_to_string(list_concat(
  ['| ' || array_to_string(list_transform(cells[1], lambda x: coalesce(x, '')), ' | ') || ' |', '| ' || array_to_string(list_transform(cells[1], lambda x: '---'), ' | ') || ' |'],
  list_transform(cells[2:], lambda r: '| ' || array_to_string(list_transform(r, lambda x: coalesce(x, '')), ' | ') || ' |')), chr(10)) END AS markdown FROM {values('tables')}""")
def table_to_markdown(spark, d):
    return fixture(spark, "tables").select("tid", text.table_to_markdown(F.col("cells")).alias("markdown"))


@query(f"SELECT k.t AS chunk_type, count(c.chunk_id) AS n FROM (VALUES ('text'), ('table'), ('figure')) k(t) LEFT JOIN {PLAIN} c ON c.chunk_type = k.t GROUP BY k.t")
def chunk_type_counts(spark, d):
    return ingest.type_counts(_plain(spark, d))


@query(f"SELECT chunk_id, confidence FROM {PLAIN} WHERE confidence >= 0.25")
def confidence_floor(spark, d):
    return _plain(spark, d).filter(F.col("confidence") >= routing.CONFIDENCE_FLOOR).select("chunk_id", "confidence")


@query(f"SELECT chunk_id, confidence FROM {PLAIN} WHERE confidence < 0.5")
def retry_candidates(spark, d):
    return _plain(spark, d).filter(routing.needs_retry(F.col("confidence"))).select("chunk_id", "confidence")


@query(f"""SELECT vid, CASE WHEN NOT valid AND corrected THEN 'corrected' WHEN valid AND coalesce(confidence, 0) >= 0.25 THEN 'accepted' ELSE 'discarded' END AS disposition
  FROM {values('validations')}""")
def acceptance_disposition(spark, d):
    return fixture(spark, "validations").select("vid", routing.disposition(F.col("valid"), F.col("corrected"), F.col("confidence")).alias("disposition"))


@query("""SELECT coalesce(l.quality, -1) AS quality, count(*) AS raw, CAST(count_if(q = 'corrected') AS BIGINT) AS corrected, CAST(count_if(q = 'accepted') AS BIGINT) AS accepted, CAST(count_if(q = 'discarded') AS BIGINT) AS discarded, CAST(count_if(q <> 'discarded') AS BIGINT) AS upserted FROM (
  SELECT l.quality, CASE WHEN coalesce(l.quality, 0) = 0 AND coalesce(l.toxic, 0) = 1 THEN 'corrected' WHEN coalesce(l.quality, 0) = 1 AND (doc_id * 37 % 101) / 100.0 >= 0.25 THEN 'accepted' ELSE 'discarded' END AS q
  FROM documents LEFT JOIN labels l USING (doc_id)) l GROUP BY ALL""")
def acceptance_counters(spark, d):
    rows = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left")
    q, t = F.coalesce("quality", F.lit(0)), F.coalesce("toxic", F.lit(0))
    placed = rows.withColumn("disposition", routing.disposition(q == 1, t == 1, F.col("doc_id") * 37 % 101 / 100.0))
    return ingest.counters(placed.withColumn("quality", F.coalesce("quality", F.lit(-1))), "quality")


_BODY = r"regexp_extract(regexp_replace(reply, '<think>.*?</think>', '', 'gis'), '\{.*\}', 0, 's')"


@query(f"SELECT rid, CASE WHEN {_BODY} <> '' AND json_valid({_BODY}) THEN {_BODY} ELSE '{{}}' END AS doc FROM {values('replies')}")
def safe_json_extract(spark, d):
    return fixture(spark, "replies").select("rid", m.json_text(F.col("reply"), reasoning=True).alias("doc"))


def _stripped(sql: str) -> str:
    return STRIP.replace("(text,", f"({sql},", 1)


@query(f"""SELECT rid, {_stripped("regexp_replace(reply, '<think>.*?</think>', '', 'gis')")} AS answer, {_stripped("regexp_extract(reply, '<think>(.*?)</think>', 1, 'is')")} AS reasoning
  FROM {values('replies')}""")
def strip_reasoning(spark, d):
    return fixture(spark, "replies").select("rid", m.answer_text(F.col("reply")).alias("answer"), m.reasoning(F.col("reply")).alias("reasoning"))


@query(f"""SELECT rid, coalesce(json_extract_string(j, '$.structured_text'), 'content') AS structured_text, coalesce(CAST(json_extract_string(j, '$.confidence') AS DOUBLE), 0.7) AS confidence,
  coalesce(len(json_extract_string(j, '$.key_concepts[*]')), 0) AS n_concepts
  FROM (SELECT rid, CASE WHEN {_BODY} <> '' AND json_valid({_BODY}) THEN {_BODY} ELSE '{{}}' END AS j FROM {values('replies')})""")
def extract_defaults(spark, d):
    doc = m.json_variant(F.col("reply"), reasoning=True)
    return fixture(spark, "replies").select(
        "rid", m.field(doc, "structured_text", "string", "content").alias("structured_text"), m.field(doc, "confidence", "double", 0.7).alias("confidence"),
        F.size(m.array_field(doc, "key_concepts")).cast("long").alias("n_concepts"),
    )


@query(f"SELECT cid, CASE WHEN corrected IS NULL OR corrected = '' THEN original ELSE corrected END AS value FROM {values('corrections')}")
def correction_fallback(spark, d):
    return fixture(spark, "corrections").select("cid", text.or_original(F.col("corrected"), F.col("original")).alias("value"))


@query(r"SELECT doc_id, md5(text || chr(10) || chr(10) || substr(text, 1, 60)) AS body_md5 FROM documents")
def embed_text(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(text.embed_text(F.col("text"), F.substring("text", 1, 60)).cast("binary")).alias("body_md5"))


@query("""SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm FROM embeddings""")
def vector_norms(spark, d):
    return _t(spark, d, "embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"))


@query(f"SELECT qid, chunk_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM {SCORED}) WHERE rank <= 6")
def cosine_topk(spark, d):
    """The six nearest, which is what a search gives when it names no number."""
    hits = retrieve.top_k(_chunks(spark, d), _questions(spark, d), 6)
    return hits.select("qid", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(f"SELECT qid, chunk_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM {SCORED}) WHERE rank <= 8")
def cosine_topk_batch(spark, d):
    hits = retrieve.top_k(_chunks(spark, d), _questions(spark, d))
    return hits.select("qid", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 0 ELSE 1 END::DOUBLE AS unit_norm, CASE WHEN vec_id % 5 = 0 THEN 0 ELSE 1 END::DOUBLE AS cosine FROM embeddings")
def unit_vectors(spark, d):
    """Vectors times the rest of their number by 5, zero vectors among them: made unit again, and held against the original."""
    scaled = F.transform("embedding", lambda x: x * (F.col("vec_id") % 5))
    rows = _t(spark, d, "embeddings").select("vec_id", "embedding", scaled.alias("scaled"))
    unit, near = vectors.norm(vectors.normalise(F.col("scaled"))), vectors.cosine(F.col("embedding"), F.col("scaled"))
    return rows.select("vec_id", F.round(unit, 6).alias("unit_norm"), F.round(near, 6).alias("cosine"))


@query(f"""SELECT qid, chunk_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank
  FROM {SCORED} WHERE chunk_type = 'figure') WHERE rank <= 3""")
def type_filtered_topk(spark, d):
    hits = retrieve.top_k(_chunks(spark, d), _questions(spark, d), 3, "figure")
    return hits.select("qid", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


_KEYWORDS = "[" + ", ".join(_literal(k) for k in routing.VISUAL_KEYWORDS) + "]"


@query(f"SELECT qid, len(list_filter({_KEYWORDS}, lambda k: contains(lower(coalesce(question, '')), k))) > 0 AS visual FROM {values('questions')}")
def visual_keyword_route(spark, d):
    return fixture(spark, "questions").select("qid", routing.asks_for_visuals(F.col("question")).alias("visual"))


@query(f"WITH {HITS} SELECT qid, position, source, chunk_id, round(score, 6) AS score FROM hits")
def retrieve_merged(spark, d):
    hits = retrieve.retrieve(_chunks(spark, d), _questions(spark, d))
    return hits.select("qid", F.col("position").cast("long").alias("position"), "source", "chunk_id", F.round("score", 6).alias("score"))


@query(f"""WITH {HITS} SELECT qid, string_agg('[' || position || '] (' || upper(chunk_type) || ' | ' || source_file || ' p.' || page_num || ' | score=' || printf('%.2f', score) || ')' || chr(10)
  || 'Summary: ' || intuition_summary || chr(10) || 'Content: ' || substr(structured_text, 1, 800), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY position) AS context FROM hits GROUP BY qid""")
def context_string(spark, d):
    return retrieve.context(retrieve.retrieve(_chunks(spark, d), _questions(spark, d))).select("qid", "context")


@query(f"WITH {HITS} SELECT qid, string_agg('[Source ' || position || '] ' || substr(structured_text, 1, 600), chr(10) || chr(10) ORDER BY position) AS sources FROM hits GROUP BY qid")
def judge_sources(spark, d):
    return retrieve.context(retrieve.retrieve(_chunks(spark, d), _questions(spark, d))).select("qid", "sources")


@query(f"WITH {HITS} SELECT qid, position, chunk_id, chunk_type AS type, source_file AS file, page_num AS page, round(score, 3) AS score, intuition_summary AS summary, structured_text AS text FROM hits")
def source_chunks(spark, d):
    rows = retrieve.source_chunks(retrieve.retrieve(_chunks(spark, d), _questions(spark, d)))
    out = rows.select("qid", F.posexplode("source_chunks").alias("p", "c"))
    return out.select("qid", (F.col("p") + 1).cast("long").alias("position"), "c.*")


_PHRASES = "[" + ", ".join(_literal(k) for k in routing.REFERENCE_PHRASES) + "]"


@query(f"SELECT chunk_id, len(list_filter({_PHRASES}, lambda k: contains(lower(coalesce(structured_text, '')), k))) > 0 AS has_links FROM {values('links')}")
def cross_ref_detect(spark, d):
    return fixture(spark, "links").select("chunk_id", routing.has_reference(F.col("structured_text")).alias("has_links"))


@query(f"""SELECT bool_or(hit) AS has_links, CAST(count_if(hit) AS BIGINT) AS n_links, 0.85::DOUBLE AS confidence
  FROM (SELECT len(list_filter({_PHRASES}, lambda k: contains(lower(coalesce(structured_text, '')), k))) > 0 AS hit FROM {values('links')})""")
def cross_ref_summary(spark, d):
    return linking.detection_summary(fixture(spark, "links"))


@query(f"""SELECT c.chunk_id, coalesce(string_agg(e.target_chunk_id || ':' || e.link_type, ',' ORDER BY e.target_chunk_id), '') AS links
  FROM {values('links')} c LEFT JOIN {values('edges')} e ON c.chunk_id = e.source_chunk_id GROUP BY c.chunk_id""")
def attach_links(spark, d):
    rows = linking.attach(fixture(spark, "links"), fixture(spark, "edges"))
    return rows.select("chunk_id", F.array_join(F.transform("cross_links", lambda x: F.concat(x["target_chunk_id"].cast("string"), F.lit(":"), x["link_type"])), ",").alias("links"))


@query(f"""WITH {HITS} SELECT q.qid, coalesce(n, 0) AS n_hits, coalesce(n, 0) = 0 AS insufficient_context
  FROM (SELECT vec_id AS qid FROM embeddings WHERE vec_id % 100 = 0 UNION ALL SELECT -1 - qid FROM {values('questions')}) q LEFT JOIN (SELECT qid, count(*) AS n FROM hits GROUP BY qid) h USING (qid)""")
def quality_gate(spark, d):
    """Questions with a vector, and some without, which meet no chunk."""
    none = fixture(spark, "questions").select((-1 - F.col("qid")).alias("qid"), "question", F.lit(None).alias("embedding"))
    questions = _questions(spark, d)
    questions = questions.unionByName(none.withColumn("embedding", F.col("embedding").cast(questions.schema["embedding"].dataType)))
    hits = retrieve.retrieve(_chunks(spark, d), questions)
    return retrieve.with_hit_counts(questions, hits).select("qid", "n_hits", (F.col("n_hits") == 0).alias("insufficient_context"))


@query(f"""SELECT wid, CASE WHEN n_hits = 0 THEN '{answer.NO_CONTEXT_ANSWER.replace("'", "''")}' WHEN answer IS NULL THEN '{answer.ERROR_ANSWER}' WHEN NOT validates THEN answer
    WHEN NOT grounded AND revised IS NOT NULL THEN revised WHEN NOT grounded THEN '[VALIDATION WARNING: claims may not be grounded]' || chr(10) || chr(10) || answer ELSE answer END AS final_answer,
  CASE WHEN n_hits = 0 THEN 'insufficient_context' WHEN answer IS NULL THEN 'error' WHEN NOT validates THEN 'unvalidated' WHEN NOT grounded AND revised IS NOT NULL THEN 'revised'
    WHEN NOT grounded THEN 'warned' ELSE 'validated' END AS phase FROM {values('workflow')}""")
def workflow_outcome(spark, d):
    final, phase = answer.outcome(*[F.col(c) for c in ("n_hits", "validates", "answer", "grounded", "revised")])
    return fixture(spark, "workflow").select("wid", final.alias("final_answer"), phase.alias("phase"))


@query(f"""SELECT wid, CASE WHEN NOT grounded AND revised IS NOT NULL THEN revised WHEN NOT grounded THEN '[VALIDATION WARNING: claims may not be grounded]' || chr(10) || chr(10) || coalesce(answer, '')
    ELSE answer END AS final_answer, NOT grounded AND revised IS NOT NULL AS was_revised FROM {values('workflow')}""")
def answer_resolution(spark, d):
    final, replaced = answer.resolve(F.col("answer"), F.col("grounded"), F.col("revised"))
    return fixture(spark, "workflow").select("wid", final.alias("final_answer"), replaced.alias("was_revised"))


@query(f"SELECT iid, coalesce(array_to_string(issues, '; '), '') AS joined FROM {values('issues')}")
def validation_issue_join(spark, d):
    return fixture(spark, "issues").select("iid", text.join_issues(F.col("issues")).alias("joined"))


@query("SELECT doc_id, md5(CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END) AS cut_md5, md5(CASE WHEN length(text) > 1000 THEN substr(text, 1, 1000) || '...' ELSE text END) AS trace_md5 FROM documents")
def serialize_truncate(spark, d):
    rows = sinks.exported_chunks(_t(spark, d, "documents").withColumn("structured_text", F.col("text")))
    cut = text.truncate(F.col("text"), text.TRACE_CHARS)
    return rows.select("doc_id", F.md5(F.col("structured_text").cast("binary")).alias("cut_md5"), F.md5(cut.cast("binary")).alias("trace_md5"))


@query("""SELECT u.conv_id, u.turn, md5(u.text) AS question_md5, md5(a.text) AS answer_md5 FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'""")
def qa_pairs(spark, d):
    turns = _t(spark, d, "conversations")
    u = turns.filter("role = 'user'").select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("question_md5"))
    a = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.md5(F.col("text").cast("binary")).alias("answer_md5"))
    return u.join(a, ["conv_id", "turn"])


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[^\s\x0B\x1C-\x1F\x{85}\p{Z}]+')) AS INTEGER) AS n_words FROM documents")
def word_token_count(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.word_count(F.col("text")).alias("n_words"))


_TYPE = f"upper({_stripped('data_type')})"


@query(f"SELECT sid, CASE WHEN {_TYPE} IN ('NUMERIC', 'BOOLEAN', 'CATEGORICAL', 'CORRECTION') THEN {_TYPE} ELSE 'NUMERIC' END AS data_type FROM {values('score_types')}")
def score_type_normalize(spark, d):
    return fixture(spark, "score_types").select("sid", routing.score_type(F.col("data_type")).alias("data_type"))


@query(rf"SELECT pid, regexp_extract(path, '([^/]*)$', 1) AS name, CASE WHEN regexp_extract(path, '([^/]*)$', 1) LIKE '_%.%' THEN regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^.]*$', '') ELSE regexp_extract(path, '([^/]*)$', 1) END AS stem FROM {values('paths')}")
def file_names(spark, d):
    return fixture(spark, "paths").select("pid", text.file_name(F.col("path")).alias("name"), text.file_stem(F.col("path")).alias("stem"))


_BARE = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script\b.*?</script>', ' ', 'gis'), '<style\b.*?</style>', ' ', 'gis'), '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'gs'), '\s+', ' ', 'g'))"""


@query(f"SELECT url, md5({_BARE}) AS text_md5 FROM pages WHERE length({_BARE}) >= 40")
def page_chunks(spark, d):
    raw = ingest.gate(documents.raw_from_pages(_t(spark, d, "pages")))
    return raw.select(F.col("source_file").alias("url"), F.md5(F.col("raw_text").cast("binary")).alias("text_md5"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval, context, generation, checkpoint B and the outcome of the questions."""
    return answer.answer(_chunks(spark, sf_dir), _questions(spark, sf_dir))


from . import stages  # noqa: E402, F401 - adds the queries of whole stages
