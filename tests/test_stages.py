"""Ingest, store, retrieval, answering, linking, sinks, sources, streaming and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from docquery_spark.cli import main
from docquery_spark.config import Settings, merge
from docquery_spark.operators import answer, ingest, linking, retrieve, sinks
from docquery_spark.operators.models import Held, hashed_words, lexical_judge, rule_extractor
from docquery_spark.operators.store import ChunkStore, storable
from docquery_spark.operators.tracing import Trace
from docquery_spark.schemas import PROCESSED_CHUNKS, RAW_CHUNKS
from docquery_spark.sources import binary, documents
from docquery_spark.streaming.ingest import ingest_stream

BODY = "The study of Paris reached 95 percent accuracy on the test set of 2024. It used 12 layers and a careful split of the data."


def raw(spark, *rows):
    full = [(k, p, i, t, None, None, "f.pdf", e) for i, (k, p, t, e) in enumerate(rows)]
    return spark.createDataFrame(full, RAW_CHUNKS)


def test_gate(spark):
    rows = raw(spark, ("text", 1, "short", None), ("text", 1, BODY, None), ("table", 1, "| a |", None), ("text", 2, BODY, "broken"), ("audio", 1, BODY, None), ("figure", 1, None, None))
    assert sorted(r["chunk_type"] for r in ingest.gate(rows).collect()) == ["figure", "table", "text"]


def test_extraction_defaults_and_retry(spark):
    def extractor(kind, content, retry):
        if "boom" in content:
            raise ValueError("no model")
        if kind == "figure":
            return '{"figure_type": "bar", "agent_notes": "n"}'
        if kind == "table":
            return '{"schema": {"columns": ["a"]}}'
        return '{"confidence": 0.2, "structured_text": "second"}' if retry else '{"confidence": 0.4, "structured_text": "first"}' if "again" in content else "plain"

    got = {r["page_num"]: r for r in ingest.extract(raw(spark, ("text", 1, "again", None), ("text", 2, "x" * 3000, None), ("table", 3, "| t |", None), ("figure", 4, None, None), ("figure", 5, "boom", None), ("text", 6, "boom", None)), extractor).collect()}
    assert got[1]["structured_text"] == "second" and got[1]["confidence"] == 0.2
    assert got[2]["structured_text"] == "x" * 2000 and got[2]["confidence"] == 0.7 and got[2]["extract_status"] == "no JSON"
    assert got[3]["structured_text"] == '| t |\n<!-- schema: {"columns":["a"]} -->'
    assert got[4]["confidence"] == 0.6 and got[4]["agent_notes"] == "figure_type=bar | n"
    assert got[5]["confidence"] == 0.3 and got[5]["intuition_summary"] == "OCR fallback." and got[5]["structured_text"] == "boom"
    assert got[6]["extract_status"].startswith("error: ValueError") and got[6]["structured_text"] == "boom"
    assert all(set(PROCESSED_CHUNKS.fieldNames()) <= set(r.asDict()) for r in got.values())


def judged(spark, reply, fail_open=True):
    def judge(mine, original):
        if reply is None:
            raise RuntimeError("down")
        return reply

    return ingest.ingest(raw(spark, ("text", 1, BODY, None)), judge=judge, fail_open=fail_open).first()


def test_checkpoint_a(spark):
    fixed = judged(spark, '{"is_valid": false, "verdict_score": 0.1, "corrected_structured_text": "fixed", "corrected_key_concepts": [], "issues": ["i"], "validator_notes": "v"}')
    assert (fixed["disposition"], fixed["structured_text"], fixed["confidence"], fixed["agent_notes"]) == ("corrected", "fixed", 0.1, "[CHECKPOINT-A CORRECTED] v")
    assert fixed["key_concepts"]
    assert judged(spark, '{"is_valid": true}')["disposition"] == "accepted"
    assert (judged(spark, "what?")["judge_status"], judged(spark, "what?")["disposition"]) == ("malformed", "accepted")
    assert judged(spark, "what?", fail_open=False)["disposition"] == "discarded"
    assert judged(spark, None)["judge_status"].startswith("error: RuntimeError")


def test_counters_and_types(spark):
    done = ingest.ingest(raw(spark, ("text", 1, BODY, None), ("table", 2, "| t | 99 |", None))).persist()
    assert {r["chunk_type"]: r["n"] for r in ingest.type_counts(done).collect()} == {"text": 1, "table": 1, "figure": 0}
    c = ingest.counters(done).first()
    assert c["raw"] == 2 and c["raw"] == c["accepted"] + c["corrected"] + c["discarded"] and c["upserted"] == c["raw"] - c["discarded"]


def test_store_is_versioned_and_idempotent(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"))
    assert store.read().count() == 0
    chunks = storable(ingest.ingest(raw(spark, ("text", 1, BODY, None), ("table", 2, "| t | 99 |", None)), judge=None))
    store.upsert(chunks)
    store.upsert(chunks)
    assert store.read().count() == 2 and len(store.versions()) == 2
    store.upsert(chunks.filter("chunk_type = 'text'").withColumn("structured_text", F.lit("new")))
    assert {r["structured_text"] for r in store.read("text").collect()} == {"new"}
    assert store.read(version=store.versions()[0]).filter("structured_text = 'new'").count() == 0
    plan = store.read("table")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(chunk_type" in plan
    assert all(abs(sum(x * x for x in r["embedding"]) - 1) < 1e-9 for r in store.read().collect())


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [
        (f"c{i}", "figure" if i % 3 == 0 else "text", i, "f", f"text {i % 10}", "s", [float(i == j) + 0.01 * j for j in range(12)])
        for i in range(12)
    ]
    return spark.createDataFrame(rows, "chunk_id string, chunk_type string, page_num int, source_file string, structured_text string, intuition_summary string, embedding array<double>")


def asked(spark, *questions):
    return spark.createDataFrame([(i, q, [1.0 if j == i else 0.0 for j in range(12)]) for i, q in enumerate(questions)], "qid long, question string, embedding array<double>")


def test_retrieve_merges_figures_once(spark, chunks, monkeypatch):
    questions = asked(spark, "show the chart", "method", None)
    hits = retrieve.retrieve(chunks, questions)
    n = {r["qid"]: r["count"] for r in hits.groupBy("qid").count().collect()}
    assert n[1] == n[2] == 8 and 8 <= n[0] <= 11
    first = [r for r in hits.filter("qid = 0").orderBy("position").collect()]
    assert [r["position"] for r in first] == list(range(1, n[0] + 1)) and first[0]["chunk_id"] == "c0"
    primary = {r["structured_text"] for r in first if r["source"] == "primary"}
    assert not primary & {r["structured_text"] for r in first if r["source"] == "figure"}
    monkeypatch.setattr(retrieve, "BLOCK", 1)
    again = retrieve.retrieve(chunks, questions)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, hits.collect()))


def test_context_order_and_shape(spark, chunks):
    got = retrieve.context(retrieve.retrieve(chunks, asked(spark, "method"))).first()["context"]
    parts = got.split("\n\n---\n\n")
    assert len(parts) == 8 and parts[0].startswith("[1] (FIGURE | f p.0 | score=1.00)\nSummary: s\nContent: text 0")


@pytest.mark.parametrize("n_hits", [0, 2])
@pytest.mark.parametrize("validates", [True, False])
@pytest.mark.parametrize("grounded", [True, False])
@pytest.mark.parametrize("revised", [None, "better"])
def test_outcome_of_every_path(spark, n_hits, validates, grounded, revised):
    df = spark.createDataFrame([(n_hits, validates, "answer", grounded, revised)], "n int, v boolean, a string, g boolean, r string")
    final, phase = answer.outcome(*[F.col(c) for c in "nvagr"])
    got = df.select(final.alias("f"), phase.alias("p")).first()
    if n_hits == 0:
        assert got["p"] == "insufficient_context" and got["f"].startswith("[No relevant context found]")
    elif not validates:
        assert tuple(got) == ("answer", "unvalidated")
    elif grounded:
        assert tuple(got) == ("answer", "validated")
    elif revised:
        assert tuple(got) == ("better", "revised")
    else:
        assert got["p"] == "warned" and got["f"].startswith("[VALIDATION WARNING") and got["f"].endswith("answer")


def test_answer_end_to_end(spark, chunks):
    questions = asked(spark, "show the chart", "method")
    got = {r["qid"]: r for r in answer.answer(chunks, questions).collect()}
    assert got[0]["phase"] == "validated" and got[0]["validation_summary"]["answer_is_grounded"] and got[0]["source_chunks"][0]["chunk_id"] == "c0"
    assert got[1]["n_hits"] == 8 and "f p." in got[1]["answer"]
    plain = answer.answer(chunks, questions, validates=False).first()
    assert plain["phase"] == "unvalidated" and plain["validation_summary"] is None
    none = answer.answer(chunks.limit(0), questions).collect()
    assert {r["phase"] for r in none} == {"insufficient_context"} and all(r["source_chunks"] == [] for r in none)

    def broken(q, c):
        raise ValueError("x")

    assert {r["phase"] for r in answer.answer(chunks, questions, generator=broken).collect()} == {"error"}
    down = answer.answer(chunks, questions, judge=lambda a, s: 1 / 0).first()
    assert down["judge_status"] == "error: ZeroDivisionError" and down["validation_summary"]["answer_verdict_score"] == 0.5


def test_judge_sees_numbers_and_names():
    bad = json.loads(lexical_judge("Paris has 10 million people", "Paris is the capital of France"))
    assert not bad["is_grounded"] and bad["hallucinations"] == ["10"]
    assert json.loads(lexical_judge("Paris is the capital", "Paris is the capital of France"))["is_grounded"]


def test_links(spark):
    rows = [("a", "text", "d", "As Figure 2a and table 3 show"), ("b", "figure", "d", "Figure 2A: layout"), ("c", "table", "d", "Table 3. Data, see figure 9"), ("x", "figure", "e", "Figure 2a elsewhere"), ("v", "text", "d", "vegetable")]
    df = spark.createDataFrame(rows, "chunk_id string, chunk_type string, source_file string, structured_text string")
    edges = linking.link(df)
    assert {(r[0], r[1], r[2]) for r in edges.collect()} == {("a", "b", "text_references_figure"), ("a", "c", "text_references_table")}
    attached = {r["chunk_id"]: r["cross_links"] for r in linking.attach(df, edges).collect()}
    assert [x["target_chunk_id"] for x in attached["a"]] == ["b", "c"] and attached["v"] == []
    assert {r["source_chunk_id"] for r in linking.detect(df).collect()} == {"a", "c", "v"}
    none = linking.detection_summary(df.limit(0)).first()
    assert not none["has_links"] and none["n_links"] == 0


def test_sinks(spark, chunks, tmp_path):
    done = answer.answer(chunks, asked(spark, "show the chart", "method"))
    path = sinks.save_answers(done, str(tmp_path), "q")
    assert spark.read.json(path).count() == 2
    path = sinks.save_chunks(chunks.withColumn("structured_text", F.expr("repeat('x', 501)")), str(tmp_path), "c")
    assert spark.read.json(path).first()["structured_text"] == "x" * 500 + "..." and "embedding" not in spark.read.json(path).columns
    sinks.append_scores(sinks.answer_scores(done).withColumn("data_type", F.lit("odd")), str(tmp_path / "scores"))
    assert {r["data_type"] for r in spark.read.parquet(str(tmp_path / "scores")).collect()} == {"NUMERIC"}
    assert "図" in sinks.pretty(spark.createDataFrame([("図",)], "a string"))


def test_trace_records_errors(spark, tmp_path):
    trace = Trace(spark, str(tmp_path / "t"))
    with pytest.raises(KeyError), trace.span("outer"), trace.span("inner"):
        raise KeyError("x")
    trace.flush()
    rows = spark.read.parquet(str(tmp_path / "t" / "events")).collect()
    assert {(r["span"], r["level"]) for r in rows} == {("inner", "ERROR"), ("outer", "ERROR")} and all(r["elapsed_ms"] >= 0 for r in rows)


def parser(path, content):
    if content == b"bad":
        raise ValueError("not a document")
    yield {"tables": [[["a", 0], [None, "1"]], [["one row"]]], "images": [(80, 80, b"i"), (79, 80, b"j"), "odd"], "text": "x" * 40}
    yield {"text": " " * 50}


def test_binary_scan(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"ok")
    (tmp_path / "b.pdf").write_bytes(b"bad")
    (tmp_path / "c.txt").write_bytes(b"ok")
    rows = binary.read(spark, str(tmp_path), parser).orderBy("source_file", "ordinal").collect()
    good = [r for r in rows if r["source_file"] == "a.pdf"]
    assert [(r["chunk_type"], r["parse_error"] is None) for r in good] == [("table", True), ("figure", True), ("figure", False), ("text", True)]
    assert good[0]["raw_text"] == "| a |  |\n| --- | --- |\n|  | 1 |"
    assert [r["parse_error"] for r in rows if r["source_file"] == "b.pdf"] == ["ValueError: not a document"]
    images = spark.createDataFrame([("/x/i.png", 80, 80, b"x"), ("/x/j.png", 79, 80, b"x")], "path string, width int, height int, content binary")
    assert [r["source_file"] for r in binary.from_images(images).collect()] == ["i.png"]


def test_pages(spark):
    html = "<html><script>var x = '<p>';</script><style>p{}</style><!-- <b> --><p>Hello&nbsp;<b>there</b>\n world</p></html>"
    got = documents.raw_from_pages(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")).first()
    assert got["raw_text"] == "Hello&nbsp; there world" and got["source_file"] == "u"


def test_stream_equals_batch(spark, tmp_path):
    source, store = str(tmp_path / "in"), ChunkStore(spark, str(tmp_path / "store"))
    raw(spark, ("text", 1, BODY, None)).write.parquet(source)
    stream = lambda: spark.readStream.schema(RAW_CHUNKS).parquet(source)
    ingest_stream(stream(), store, str(tmp_path / "cp")).awaitTermination(120)
    raw(spark, ("text", 1, BODY, None), ("text", 2, BODY + " More.", None)).write.mode("append").parquet(source)
    ingest_stream(stream(), store, str(tmp_path / "cp")).awaitTermination(120)
    assert store.read().count() == 2


def test_settings(tmp_path):
    assert Settings().get("pipeline.max_context_chunks") == 8 and Settings().get("a.b", 3) == 3
    path = tmp_path / "s.json"
    path.write_text('{"pipeline": {"max_context_chunks": 5, "extra": null}}')
    s = Settings(str(path))
    assert s.get("pipeline.max_context_chunks") == 5 and s.get("pipeline.extra", "d") == "d" and s.get("pipeline.extra_figures") == 3
    path.write_text("{")
    assert Settings(str(path)).problem and Settings(str(tmp_path / "none")).get("models.judge", "x") == "x"
    base = {"a": {"b": 1}}
    assert merge(base, {"a": {"c": 2}}) == {"a": {"b": 1, "c": 2}} and base == {"a": {"b": 1}}


def test_models_load_late():
    loads = []
    held = Held(lambda: loads.append(1) or "model")
    with pytest.raises(RuntimeError):
        _ = held.model
    with held, held:
        assert held.model == "model" and loads == [1]
    assert len(hashed_words("a b", 8)) == 8 and hashed_words("").sum() == 0
    assert json.loads(rule_extractor("text", BODY, False))["confidence"] == 0.9


def test_command_line(spark, tmp_path, capsys):
    assert main([]) == 1
    spark.createDataFrame([(1, BODY, "s")], "doc_id long, text string, source string").write.parquet(str(tmp_path / "d"))
    storage, out = str(tmp_path / "st"), str(tmp_path / "out")
    assert main(["--storage-dir", storage, "--output", out, "pipeline", str(tmp_path / "d"), "What accuracy was reached in Paris?"]) == 0
    printed = capsys.readouterr().out
    assert "text: 1" in printed and "95 percent" in printed and "1 sources" in printed
    assert "total: 1 of 1 (1 accepted, 0 corrected, 0 discarded)" in printed and "grounded: True" in printed
    (tmp_path / ".env").write_text(f"# keys\nexport DOCQUERY_TRACE_DIR='{tmp_path}/trace'\n")
    assert main(["--storage-dir", storage, "--env-file", str(tmp_path / ".env"), "query", "method?", "--session-id", "s1", "--answer-mode", "json"]) == 0
    events = spark.read.parquet(f"{tmp_path}/trace/events").collect()
    assert {(r["trace_id"], r["span"]) for r in events} == {("s1", "query")} and spark.read.parquet(f"{tmp_path}/trace/scores").count() == 1
    assert main(["--storage-dir", storage, "ingest", str(tmp_path / "d"), "--mode", "linked"]) == 0
    assert main(["--storage-dir", storage, "query", "x", "--generator", "nobody"]) == 1
    assert main(["--storage-dir", storage, "query", "method?", "--no-validate"]) == 0
    assert main(["--storage-dir", storage, "ingest", str(tmp_path / "missing")]) == 1


def test_store_merges_tables_and_purges(spark, tmp_path, monkeypatch):
    from docquery_spark.operators import store as st

    monkeypatch.setattr(st, "MAX_TABLES", 3)
    monkeypatch.setattr(st, "KEPT", 2)
    store = ChunkStore(spark, str(tmp_path / "s"))
    base = storable(ingest.ingest(raw(spark, ("text", 1, BODY, None)), judge=None))
    for i in range(7):
        store.upsert(base.unionByName(base.withColumn("chunk_id", F.lit(f"c{i}"))).withColumn("structured_text", F.lit(f"t{i}")))
        rows = {r["chunk_id"]: r["structured_text"] for r in store.read().collect()}
        assert len(rows) == i + 2 == store.read().count() and sum(t == f"t{i}" for t in rows.values()) == 2
        assert len(store.tables(store.versions()[-1])) <= 3
    assert len(store.versions()) == 2
    held = {t for v in store.versions() for t in store.tables(v)}
    assert {p.name for p in (tmp_path / "s" / "data").iterdir()} >= held and len(list((tmp_path / "s" / "data").iterdir())) <= len(held) + 3


def test_store_keeps_both_of_two_writers(spark, tmp_path, monkeypatch):
    one, two = ChunkStore(spark, str(tmp_path / "s")), ChunkStore(spark, str(tmp_path / "s"))
    base = storable(ingest.ingest(raw(spark, ("text", 1, BODY, None)), judge=None))
    commit, first = one._commit, []

    def late(name, tables):
        if not first:  # the other writer commits between this one's look and its commit
            first.append(two.upsert(base.withColumn("chunk_id", F.lit("two"))))
        return commit(name, tables)

    monkeypatch.setattr(one, "_commit", late)
    one.upsert(base.withColumn("chunk_id", F.lit("one")))
    assert {r["chunk_id"] for r in one.read().collect()} == {"one", "two"}


def test_images_reach_models_and_fall_back(spark):
    def extractor(kind, content, retry, image=None):
        if image == b"bad":
            raise RuntimeError("no picture")
        return json.dumps({"structured_text": f"{kind} of {len(image or b'')} bytes", "confidence": 0.9})

    def judge(claim, original, image=None):
        if image == b"seen":
            return json.dumps({"is_valid": True, "verdict_score": 0.7, "validator_notes": json.loads(claim)["structured_text"]})
        if image is not None:
            raise RuntimeError("no picture")
        return json.dumps({"is_valid": original.startswith("[Figure: {"), "verdict_score": 0.6})

    rows = [("figure", i, i, None, b, None, "f.pdf", None) for i, b in enumerate([b"seen", b"other", b"bad"])]
    done = {r["page_num"]: r for r in ingest.ingest(spark.createDataFrame(rows, RAW_CHUNKS), extractor, judge, ocr=lambda image: "read by ocr").collect()}
    assert done[0]["validation"]["validator_notes"] == "figure of 4 bytes" and done[0]["validation"]["verdict_score"] == 0.7
    assert done[1]["judge_status"] == "ok" and done[1]["disposition"] == "accepted" and done[1]["validation"]["verdict_score"] == 0.6
    assert (done[2]["structured_text"], done[2]["confidence"], done[2]["agent_notes"]) == ("read by ocr", 0.3, "Vision model not loaded.")
    assert "raw_image" not in done[0].asDict()


def test_retry_note_is_no_content(spark):
    seen = ingest.extract(raw(spark, ("text", 1, BODY, None)), lambda kind, content, retry: json.dumps({"structured_text": content, "confidence": 0.1})).first()
    assert seen["structured_text"] == BODY


def test_routed_extractors(spark):
    from docquery_spark.operators.models import identity_extractor, routed

    rows = raw(spark, ("text", 1, BODY, None), ("table", 2, "| t |", None), ("figure", 3, None, None))
    got = {r["chunk_type"]: r for r in ingest.extract(rows, routed(text=identity_extractor, table=rule_extractor)).collect()}
    assert got["text"]["confidence"] == 0.8 and got["text"]["structured_text"] == BODY and got["table"]["extract_status"] == "no JSON"
    assert got["figure"]["extract_status"].startswith("error: KeyError") and got["figure"]["confidence"] == 0.3


def test_linked_ingest_and_its_fallback(spark):
    rows = raw(spark, ("text", 1, "As Figure 2 shows, the results of all runs are stable over time.", None), ("text", 2, "Figure 2. Results of all runs over the whole of the time.", None))
    done = {r["page_num"]: r for r in ingest.ingest_linked(rows).collect()}
    assert [x["target_chunk_id"] for x in done[1]["cross_links"]] == [done[2]["chunk_id"]] and done[2]["cross_links"] == []
    assert {r["disposition"] for r in done.values()} == {"accepted"} and done[1]["confidence"] == 0.8

    def broken(raw):
        raise ValueError("no linker")

    chunks, status = ingest.ingest_or_standard(rows, broken)
    assert status == "ValueError: no linker" and chunks.count() == 2
    assert ingest.ingest_or_standard(rows)[1] == "ok"


@pytest.mark.parametrize(("mode", "reply", "want"), [
    ("structured", '{"is_grounded": false, "revised_answer": "NULL", "verdict_score": "0.3", "hallucinations": "x"}', (False, None, 0.3, ["x"])),
    ("json", '{"is_grounded": false, "revised_answer": "NULL", "verdict_score": 0.3, "hallucinations": ["x"]}', (False, "NULL", 0.3, ["x"])),
    ("structured", '{"verdict_score": "high"}', (True, None, 1.0, [])),
    ("structured", None, (True, None, 0.5, [])),
    ("json", None, (True, None, 1.0, [])),
])
def test_checkpoint_b_modes(spark, mode, reply, want):
    def judge(claim, sources):
        assert ("[ANSWER]" in sources) == (mode == "json")
        if reply is None:
            raise RuntimeError("down")
        return reply

    rows = spark.createDataFrame([("q", "a", "s")], "question string, answer string, sources string")
    v = answer.validate_answers(rows, judge, mode).first()["verdict"]
    assert (v["is_grounded"], v["revised_answer"], v["verdict_score"], v["hallucinations"]) == want
    with pytest.raises(ValueError, match="mode"):
        answer.validate_answers(rows, judge, "other")


def test_registry_and_live_settings():
    from docquery_spark.operators import registry

    settings = Settings()
    assert registry.role("extractor") is rule_extractor and registry.role("chunk_judge", "none") is None
    assert registry.role("generator", "json:dumps") is json.dumps
    with pytest.raises(KeyError, match="nobody"):
        registry.role("generator", "nobody")
    for key, value in (("validation.confidence_floor", 0.4), ("validation.enable_checkpoint_a", False), ("pipeline.max_context_chunks", 2), ("validation.answer_mode", "json"), ("models.extractor", "served:m"), ("models.server.url", "http://h/v1")):
        settings.put(key, value)
    into, out = registry.ingest_options(settings), registry.answer_options(settings)
    assert into["floor"] == 0.4 and into["judge"] is None and into["extractor"].__self__.url == "http://h/v1"
    assert out["k"] == 2 and out["mode"] == "json" and out["validates"]


def test_served_model(spark):
    """Against a server of our own."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from docquery_spark.operators.served import ServedModel

    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, self.headers.get("Authorization"), body))
            user = body["messages"][1]["content"]
            user = user if isinstance(user, str) else user[0]["text"] + " with image"
            reply = json.dumps({"structured_text": user, "confidence": 0.2 if "one JSON" not in user else 0.9, "is_valid": True})
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": reply}}]}).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    model = ServedModel(f"http://127.0.0.1:{server.server_port}/v1", "m", "secret")
    got = ingest.ingest(raw(spark, ("text", 1, BODY, None)), model.extractor, model.chunk_judge).first()
    assert got["confidence"] == 0.9 and got["structured_text"].startswith(BODY) and got["disposition"] == "accepted"
    assert "with image" in model.extractor("figure", "f", False, b"x") and model.generator("q", "c") and model.answer_judge("a", "[SOURCES]")
    assert {x[0] for x in seen} == {"/v1/chat/completions"} and {x[1] for x in seen} == {"Bearer secret"} and len(seen) == 6
    server.shutdown()
    down = ingest.ingest(raw(spark, ("text", 1, BODY, None)), ServedModel("http://127.0.0.1:9/v1", "m").extractor, judge=None).first()
    assert down["extract_status"].startswith("error: ")
