"""Command line: ingest, query, pipeline."""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import functions as F

from .config import Settings, environment
from .operators import answer, ingest, registry, sinks
from .operators.store import ChunkStore, storable
from .operators.tracing import Trace
from .session import session
from .sources import binary, documents

#: Names the folder that trace events and scores are appended to; without it nothing is traced.
TRACE_KEY = "DOCQUERY_TRACE_DIR"
#: Flags that name models, and the settings that they set.
MODELS = ("extractor", "embedder", "generator", "chunk_judge", "answer_judge")


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="docquery")
    top.add_argument("--storage-dir", default="storage")
    top.add_argument("--output", default=None, help="folder for JSON results; none are written without it")
    top.add_argument("--settings", default=None)
    top.add_argument("--env-file", default=".env")
    top.add_argument("--parser", default=None, help="module:function for binary documents")
    commands = top.add_subparsers(dest="command")
    for name in ("ingest", "query", "pipeline"):
        c = commands.add_parser(name)
        if name != "query":
            c.add_argument("path", help="Parquet table of documents, or with --parser a folder of files")
            c.add_argument("--mode", choices=("standard", "linked"), default="standard", help="linked: no models, references attached; standard where that fails")
            c.add_argument("--links", action="store_true", default=None, help="attach references in the standard mode")
            c.add_argument("--strict", action="store_true", help="discard chunks whose judge failed")
        if name != "ingest":
            c.add_argument("question")
            c.add_argument("--answer-mode", choices=("structured", "json"), default=None)
        c.add_argument("--session-id", default=None, help="parts the traces of one session from others")
        for model in MODELS:
            c.add_argument(f"--{model.replace('_', '-')}", default=None, help="a built-in name, module:function, or served:model")
        c.add_argument("--validate", dest="validate", action="store_true", default=None)
        c.add_argument("--no-validate", dest="validate", action="store_false")
    return top


def _settings(args) -> Settings:
    settings = Settings(args.settings)
    if settings.problem:
        print(f"settings: {settings.problem}", file=sys.stderr)
    for model in MODELS:
        settings.put(f"models.{model}", getattr(args, model, None))
    settings.put("pipeline.links", getattr(args, "links", None))
    settings.put("validation.answer_mode", getattr(args, "answer_mode", None))
    for point in ("a", "b"):
        settings.put(f"validation.enable_checkpoint_{point}", args.validate)
    if getattr(args, "strict", False):
        settings.put("validation.fail_open", False)
    return settings


def _ingest(spark, args, settings: Settings, store: ChunkStore, trace: Trace) -> None:
    with trace.span("ingest"):
        if args.parser:
            module, _, name = args.parser.partition(":")
            raw = binary.read(spark, args.path, getattr(importlib.import_module(module), name), "*")
        else:
            raw = documents.raw_from_documents(spark.read.parquet(args.path))
        options, status = registry.ingest_options(settings), "ok"
        if args.mode == "linked":
            done, status = ingest.ingest_or_standard(raw, **options)
        else:
            done = ingest.ingest(raw, **options)
        done = done.persist()
        kept = done.filter("disposition <> 'discarded'")
        with trace.span("store"):
            store.upsert(storable(done, **registry.store_options(settings)))
        for r in ingest.type_counts(kept).orderBy("chunk_type").collect():
            print(f"{r['chunk_type']}: {r['n']}")
        n = ingest.counters(done).first()
        print(f"total: {n['upserted']} of {n['raw']} ({n['accepted']} accepted, {n['corrected']} corrected, {n['discarded']} discarded)")
        if status != "ok":
            print(f"linked mode failed, standard mode used: {status}")
        if args.output:
            sinks.save_chunks(kept, args.output, args.path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0])
        done.unpersist()


def _query(spark, args, settings: Settings, store: ChunkStore, trace: Trace) -> None:
    with trace.span("query"):
        embedding = registry.store_options(settings)
        vector = [float(x) for x in embedding["embedder"](args.question, embedding["dimensions"])]
        asked = spark.createDataFrame([(0, args.question, vector)], "qid long, question string, embedding array<double>")
        done = answer.answer(store.read(), asked, session=args.session_id, **registry.answer_options(settings)).persist()
        first = done.first()
        print(first["answer"])
        print(f"[{first['phase']}] {first['n_hits']} sources")
        if first["validation_summary"]:
            v = first["validation_summary"]
            print(f"grounded: {v['answer_is_grounded']}, score {v['answer_verdict_score']:.2f}, revised: {v['answer_was_revised']}, unsupported: {'; '.join(v['hallucinations']) or '-'}")
        if trace.path:
            sinks.append_scores(sinks.answer_scores(done), f"{trace.path}/scores")
        if args.output:
            sinks.save_answers(done.withColumn("qid", F.xxhash64("question")), args.output, "query")
        done.unpersist()


def main(argv: list[str] | None = None) -> int:
    parser = _parser()
    args = parser.parse_args(argv)
    if not args.command:
        parser.print_help()
        return 1
    spark = session()
    trace = Trace(spark, environment(args.env_file).get(TRACE_KEY) or None, args.session_id)
    try:
        settings, store = _settings(args), ChunkStore(spark, args.storage_dir)
        if args.command in ("ingest", "pipeline"):
            _ingest(spark, args, settings, store, trace)
        if args.command in ("query", "pipeline"):
            _query(spark, args, settings, store, trace)
    except KeyboardInterrupt:
        return 130
    except Exception as e:
        print(f"{type(e).__name__}: {str(e)[:500]}", file=sys.stderr)
        return 1
    finally:
        trace.flush()
    return 0


if __name__ == "__main__":
    sys.exit(main())
