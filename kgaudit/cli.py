"""Command line: python -m kgaudit.cli COMMAND ... Exit code 1 if a check fails or an input is missing."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kgaudit.functions import fuzzy
from kgaudit.operators import entities as en
from kgaudit.operators import gate, graph, ledger, planning, vectors, verify
from kgaudit.session import exists, get_spark, materialize
from kgaudit.sources import files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kgaudit", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    v = sub.add_parser("verify", help="score a graph against a reference registry")
    v.add_argument("--graph", required=True, help="GraphML file")
    v.add_argument("--ground-truth", required=True)
    v.add_argument("--docs-dir")
    v.add_argument("--json", help="write the whole report here")
    v.add_argument("--fuzzy-threshold", type=float, default=fuzzy.THRESHOLD)
    v.add_argument("--verbose", action="store_true")
    s = sub.add_parser("split", help="split a registry into known and withheld entities")
    s.add_argument("--ground-truth", required=True)
    s.add_argument("--registry", required=True)
    s.add_argument("--holdout", required=True)
    s.add_argument("--fraction", type=float, default=0.2)
    s.add_argument("--seed", type=int, default=20260806)
    i = sub.add_parser("pending", help="documents that a ledger doesn't have")
    i.add_argument("--input-dir", required=True)
    i.add_argument("--ledger")
    i.add_argument("--limit", type=int)
    i.add_argument("--batch-size", type=int, default=10)
    i.add_argument("--force", action="store_true")
    q = sub.add_parser("query", help="context rows of questions, given as vectors")
    q.add_argument("--vectors", required=True, help="parquet: id, kind, embedding")
    q.add_argument("--edges", required=True, help="parquet: rel_id, src, dst")
    q.add_argument("--questions", required=True, help="parquet: query_id, query")
    q.add_argument("--mode", choices=vectors.MODES, default="hybrid")
    q.add_argument("--all-modes", action="store_true")
    q.add_argument("--top-k", type=int, default=40)
    q.add_argument("--repl", action="store_true", help="read query ids, one a line, until exit, quit or the end")
    n = sub.add_parser("generate", help="plan a corpus: which documents are to be written")
    n.add_argument("--ground-truth", required=True)
    n.add_argument("--out-dir", required=True)
    n.add_argument("--count", type=int, default=24)
    n.add_argument("--seed", type=int, default=42)
    n.add_argument("--overwrite", action="store_true")
    d = sub.add_parser("disambiguate", help="split homonyms and merge aliases of a graph; a dry run unless told where to write")
    d.add_argument("--graph", required=True, help="GraphML file")
    d.add_argument("--ground-truth", required=True)
    d.add_argument("--specs", help="JSON lines: norm, target, target_ord, keywords")
    d.add_argument("--in-place", action="store_true")
    d.add_argument("--output-graph")
    d.add_argument("--verbose", action="store_true")
    g = sub.add_parser("gate", help="literals that mustn't occur in texts")
    g.add_argument("texts", help="folder of .md files")
    g.add_argument("--terms", required=True, help="one term a line")
    return p


def _verify(spark: SparkSession, a: argparse.Namespace) -> int:
    registry = files.read_registry(spark, a.ground_truth)
    nodes, edges = files.read_graph(spark, a.graph)
    none = spark.createDataFrame([], "file string, narrator string")
    narrators = files.corpus_narrators(files.read_corpus(spark, a.docs_dir)) if a.docs_dir else none
    report = verify.run(files.registry_entities(registry), files.hierarchy_links(registry), files.participants(registry), nodes, edges, narrators, a.fuzzy_threshold)
    print(report.text(a.verbose))
    if a.json:
        files.write_text(report.to_json(), a.json)
    return 0 if report.summary.first()["passed"] else 1


def _split(spark: SparkSession, a: argparse.Namespace) -> int:
    registry = files.read_registry(spark, a.ground_truth)
    doc = registry.first().asDict(recursive=True)
    every = files.registry_entities(registry)
    held = {r["id"] for r in en.choose_holdout(every, a.fraction, a.seed).collect()}
    sections = {s: [{k: v for k, v in e.items() if v is not None} for e in doc[s] or []] for s in en.SECTIONS}
    pick = lambda inside: {s: [e for e in rows if (e["id"] in held) == inside] for s, rows in sections.items()}
    links = [h for h in doc["hierarchy"] or [] if h["parent_id"] not in held and h["child_id"] not in held]
    files.write_json({"sector_name": doc["sector_name"], **pick(False), "hierarchy": links}, a.registry)
    files.write_json({"sector_name": doc["sector_name"], "withheld_entity_ids": sorted(held), **pick(True)}, a.holdout)
    n = lambda part: sum(map(len, part.values()))
    complete = n(pick(True)) + n(pick(False)) == n(sections)
    print(f"kept {n(pick(False))}, held {n(pick(True))}, total {n(sections)}")
    return 0 if complete else 1


def _pending(spark: SparkSession, a: argparse.Namespace) -> int:
    done = files.read_ledger(spark, a.ledger) if a.ledger else spark.createDataFrame([], "path string, sha string")
    todo = ledger.batches(ledger.pending(files.read_corpus(spark, a.input_dir), done, a.limit, a.force), a.batch_size)
    for r in todo.select("batch", "path").orderBy("path").collect():
        print(r["batch"], r["path"])
    return 0


def _query(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.repl:
        return _repl(spark, a, sys.stdin)
    v, e, q = (spark.read.parquet(x) for x in (a.vectors, a.edges, a.questions))
    if not v.limit(1).count():
        raise ValueError("there are no vectors")
    modes = ("local", "global", "hybrid") if a.all_modes else (a.mode,)
    vectors.retrieve_all(v, e, q, modes, k=a.top_k).orderBy("query_id", "mode", F.desc("score"), "id").show(1000, truncate=False)
    return 0


def _repl(spark: SparkSession, a: argparse.Namespace, lines) -> int:
    """Answers for one query id a line, until exit, quit or the end of the input."""
    v, e, q = (spark.read.parquet(x) for x in (a.vectors, a.edges, a.questions))
    for line in lines:
        if (line := line.strip()).lower() in ("exit", "quit"):
            break
        if line:
            asked = q.filter(F.col("query_id").cast("string") == line)
            vectors.retrieve(v, e, asked, a.mode, k=a.top_k).orderBy(F.desc("score"), "id").show(1000, truncate=False)
    return 0


def _generate(spark: SparkSession, a: argparse.Namespace) -> int:
    registry = files.read_registry(spark, a.ground_truth)
    named = [(r["id"], r["name"]) for r in files.registry_entities(registry).orderBy("entity_ord").collect()]
    events = [(r["event_id"], list(r["participant_ids"] or [])) for r in files.section(registry, "timeline").collect()]
    made = planning.plan(spark, named, events, a.count, a.seed)
    there = files.read_corpus(spark, a.out_dir).select(F.col("file").alias("filename")) if exists(spark, a.out_dir) else spark.createDataFrame([], "filename string")
    todo = planning.missing_targets(made, there, a.overwrite)
    outcome = made.join(todo.select("doc_num", F.lit("planned").alias("outcome")), "doc_num", "left").select(F.coalesce("outcome", F.lit("skipped")).alias("outcome"))
    for r in todo.orderBy("doc_num").collect():
        print(r["filename"], ",".join(r["subject_entity_ids"]), ",".join(r["source_event_ids"]))
    for r in planning.outcomes(outcome).orderBy("outcome").collect():
        print(f"{r['outcome']}: {r['n']}")
    return 0


def _disambiguate(spark: SparkSession, a: argparse.Namespace) -> int:
    nodes, edges = files.read_graph(spark, a.graph)
    spec = "norm string, target string, target_ord int, keywords array<string>"
    specs = spark.read.schema(spec).json(a.specs) if a.specs else spark.createDataFrame([], spec)
    aliases = en.alias_map(files.registry_entities(files.read_registry(spark, a.ground_truth)))
    drop = [c for c in ("entity_id", "truncate", "created_at") if c in nodes.columns]
    numbered = lambda df: df.drop(*drop).withColumn("ord", F.monotonically_increasing_id())
    out_nodes, out_edges, totals = graph.disambiguate(numbered(nodes), numbered(edges), specs, aliases)
    out_nodes, out_edges = materialize(out_nodes, "nodes"), materialize(out_edges, "edges")
    print(", ".join(f"{k}: {v}" for k, v in totals.first().asDict().items()))
    if a.verbose:
        for r in out_nodes.orderBy("node_id").collect():
            print(r["node_id"])
    path = a.graph if a.in_place else a.output_graph
    files.write_graphml(out_nodes, out_edges, path or a.graph, dry_run=path is None)
    return 0


def _gate(spark: SparkSession, a: argparse.Namespace) -> int:
    terms = files.read_questions(spark, a.terms).select(F.col("question").alias("term_id"), F.col("question").alias("term"))
    found = gate.leaks(files.read_corpus(spark, a.texts).select(F.col("file").alias("text_id"), "text"), terms).collect()
    for r in sorted(found):
        print(f"{r['text_id']}: {r['term_id']}")
    return 1 if found else 0


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = get_spark("kgaudit")
    try:
        return {"verify": _verify, "split": _split, "pending": _pending, "query": _query, "gate": _gate, "generate": _generate, "disambiguate": _disambiguate}[a.command](spark, a)
    except Exception as e:
        print(f"error: {str(e).splitlines()[0]}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
