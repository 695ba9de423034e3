"""Readers and writers: registry documents, graphs, corpora, key-value stores, line files."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from urllib.parse import unquote
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgaudit.functions import text as tx
from kgaudit.operators.entities import SECTIONS, unify
from kgaudit.session import put

_S, _LIST = T.StringType(), T.ArrayType(T.StringType())


def _struct(*fields: tuple[str, T.DataType]) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(n, t) for n, t in fields]))


#: The fields of a registry document.
REGISTRY = T.StructType(
    [
        T.StructField("sector_name", _S),
        T.StructField("houses", _struct(("id", _S), ("name", _S), ("aliases", _LIST), ("description", _S), ("motto", _S))),
        T.StructField("megacorporations", _struct(("id", _S), ("name", _S), ("aliases", _LIST), ("description", _S), ("specialization", _S))),
        T.StructField("persons", _struct(("id", _S), ("name", _S), ("aliases", _LIST), ("titles", _LIST), ("callsigns", _LIST), ("affiliation_id", _S), ("role", _S))),
        T.StructField("stations_and_ships", _struct(("id", _S), ("name", _S), ("aliases", _LIST), ("type", _S), ("is_homonym_risk", T.BooleanType()), ("owner_id", _S), ("description", _S))),
        T.StructField("hierarchy", _struct(("parent_id", _S), ("child_id", _S), ("relation_type", _S), ("level", T.IntegerType()))),
        T.StructField("timeline", _struct(("event_id", _S), ("year", T.IntegerType()), ("title", _S), ("description", _S), ("participant_ids", _LIST))),
        T.StructField("withheld_entity_ids", _LIST),
    ]
)


def read_registry(spark: SparkSession, path: str, tolerant: bool = False) -> DataFrame:
    """The registry document, one row. A tolerant read of a missing or broken file gives a row of nulls."""
    try:
        df = spark.read.schema(REGISTRY).option("multiLine", True).option("mode", "PERMISSIVE" if tolerant else "FAILFAST").json(path)
        if tolerant:
            df.limit(1).collect()
        return df
    except Exception:
        if tolerant:
            return spark.createDataFrame([(None,) * len(REGISTRY)], REGISTRY)
        raise


def section(registry: DataFrame, name: str) -> DataFrame:
    return registry.select(F.inline(name))


def registry_entities(registry: DataFrame) -> DataFrame:
    """All entities with category, and entity_ord: their order in the document."""
    out = unify({category: registry.select(F.posexplode(name).alias("at", "x")).select("at", "x.*") for name, category in SECTIONS.items()})
    rank = {c: i for i, c in enumerate(SECTIONS.values())}
    ord_ = F.element_at(F.create_map(*[F.lit(x) for c, i in rank.items() for x in (c, i * 1_000_000)]), F.col("category")) + F.col("at")
    return out.withColumn("entity_ord", ord_.cast("long")).drop("at")


def hierarchy_links(registry: DataFrame) -> DataFrame:
    return section(registry, "hierarchy").select("parent_id", "child_id", F.coalesce("relation_type", F.lit("")).alias("relation_type"), F.coalesce("level", F.lit(1)).alias("level"))


def participants(registry: DataFrame) -> DataFrame:
    return section(registry, "timeline").select("event_id", F.explode("participant_ids").alias("entity_id"))


def timeline(registry: DataFrame) -> DataFrame:
    """event_id, year (as text, empty if missing), title, description."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return section(registry, "timeline").select("event_id", *[text(c).alias(c) for c in ("year", "title", "description")])


def write_json(rows: list[dict] | dict, path: str) -> None:
    """A small document as indented JSON that keeps its letters, by the file system that the path names."""
    write_text(json.dumps(rows, ensure_ascii=False, indent=2), path)


def write_text(text: str, path: str) -> None:
    if (spark := SparkSession.getActiveSession()) is None:
        raise RuntimeError("there is no session")
    put(spark, path, [text.encode()])


def settings(spark: SparkSession, path: str) -> dict[str, str]:
    """NAME=value lines of a settings file; names that the environment has win. Quotes around values are taken off."""
    lines = [r["question"] for r in read_questions(spark, path).collect()]
    named = dict(x.removeprefix("export ").split("=", 1) for x in lines if "=" in x)
    return {k.strip(): os.environ.get(k.strip(), v.strip().strip("'\"")) for k, v in named.items()}


_NODE = "_id string, data array<struct<_key:string,_VALUE:string>>"
_EDGE = "_source string, _target string, data array<struct<_key:string,_VALUE:string>>"
_KEY = "_id string, `_attr.name` string, _for string"


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes (node_id, ...) and edges (src, dst, weight, ...) of a GraphML file; attribute names come from its key
    elements, edges are undirected and given once."""
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    names = {r["_id"]: r["_attr.name"] for r in read("key", _KEY).collect()}
    label = F.create_map(*[F.lit(x) for kv in (names or {"": ""}).items() for x in kv])

    def pivot(df: DataFrame, ids: dict[str, str], attrs: list[str]) -> DataFrame:
        m = F.map_from_entries(F.transform(F.coalesce("data", F.array().cast("array<struct<_key:string,_VALUE:string>>")), lambda d: F.struct(F.coalesce(label[d["_key"]], d["_key"]).alias("k"), d["_VALUE"].alias("v"))))
        return df.withColumn("m", m).select(*[F.col(a).alias(b) for a, b in ids.items()], *[F.col("m")[a].alias(a) for a in attrs])

    nodes = pivot(read("node", _NODE), {"_id": "node_id"}, ["entity_id", "entity_type", "description", "source_id", "file_path", "created_at", "truncate"])
    edges = pivot(read("edge", _EDGE), {"_source": "src", "_target": "dst"}, ["weight", "description", "keywords", "source_id", "file_path", "created_at", "truncate"])
    edges = edges.withColumns({"weight": F.col("weight").cast("double"), "s": F.least("src", "dst"), "d": F.greatest("src", "dst")}).drop("src", "dst").withColumnsRenamed({"s": "src", "d": "dst"})
    return nodes, edges


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """nodes and edges as XML elements below a folder; parquet tables of both are the form to work with."""
    data = lambda df, skip: F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("_key"), F.col(c).cast("string").alias("_VALUE"))) for c in df.columns if c not in skip])).alias("data")
    nodes.select(F.col("node_id").alias("_id"), data(nodes, ("node_id",))).write.format("xml").option("rootTag", "graph").option("rowTag", "node").save(f"{path}/nodes")
    edges.select(F.col("src").alias("_source"), F.col("dst").alias("_target"), data(edges, ("src", "dst"))).write.format("xml").option("rootTag", "graph").option("rowTag", "edge").save(f"{path}/edges")


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str, dry_run: bool = False) -> dict[str, int]:
    """nodes (node_id, ...) and edges (src, dst, ...) as one GraphML file, sorted, for readers of that form; the path may
    be that of the file which they were read from, once they are tables of their own. Rows go through the driver in
    order, a partition at a time. A dry run only counts. Returns the numbers of nodes and edges."""
    spark = nodes.sparkSession
    attributes = [("node", c, f"n{i}", nodes) for i, c in enumerate(x for x in nodes.columns if x != "node_id")]
    attributes += [("edge", c, f"e{i}", edges) for i, c in enumerate(x for x in edges.columns if x not in ("src", "dst"))]
    if dry_run:
        return {"nodes": nodes.count(), "edges": edges.count()}
    kinds = {"double": "double", "float": "double", "int": "long", "bigint": "long", "boolean": "boolean"}
    told = {"nodes": 0, "edges": 0}

    def element(tag: str, row, key: str, own: str) -> str:
        data = "".join(f"<data key={quoteattr(i)}>{escape(str(row[c]).lower() if isinstance(row[c], bool) else str(row[c]))}</data>" for kind, c, i, _ in attributes if kind == key and row[c] is not None)
        return f"<{tag} {own}>{data}</{tag}>\n"

    def chunks() -> Iterator[bytes]:
        yield b"<?xml version='1.0' encoding='utf-8'?>\n<graphml xmlns=\"http://graphml.graphdrawing.org/xmlns\">\n"
        for kind, c, i, df in attributes:
            yield f'<key id="{i}" for="{kind}" attr.name={quoteattr(c)} attr.type="{kinds.get(df.schema[c].dataType.simpleString(), "string")}"/>\n'.encode()
        yield b'<graph edgedefault="undirected">\n'
        for r in nodes.orderBy("node_id").toLocalIterator():
            told["nodes"] += 1
            yield element("node", r, "node", f"id={quoteattr(r['node_id'])}").encode()
        for r in edges.orderBy("src", "dst").toLocalIterator():
            told["edges"] += 1
            yield element("edge", r, "edge", f"source={quoteattr(r['src'])} target={quoteattr(r['dst'])}").encode()
        yield b"</graph>\n</graphml>\n"

    aside = f"{path}.{uuid.uuid4().hex}"  # whole or not at all, also where the path is the one read from
    put(spark, aside, chunks())
    p = spark._jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(p(path), False)
    fs.rename(p(aside), p(path))
    return told


def read_corpus(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """path, file, text of the .md files of a folder; files that can't be read are passed over."""
    df = spark.read.option("pathGlobFilter", "*.md").option("ignoreCorruptFiles", True).text(folder, wholetext=True)
    df = df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
    return df.orderBy("path").limit(limit) if limit is not None else df


def corpus_narrators(corpus: DataFrame) -> DataFrame:
    return corpus.select("file", tx.narrator("text").alias("narrator"))


def write_corpus(docs: DataFrame, folder: str) -> None:
    """One file for each row (filename, frontmatter, body), by the file system that the folder names: Spark's writer
    makes a folder for each name, and the driver gives the file in it its name."""
    spark = docs.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path
    fs = p(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    aside = f"{folder.rstrip('/')}/_writing-{uuid.uuid4().hex}"
    whole = F.concat_ws("", F.coalesce("frontmatter", F.lit("")), F.lit("\n\n"), F.coalesce("body", F.lit("")))
    docs.select(whole.alias("value"), "filename").write.partitionBy("filename").text(aside)
    for made in fs.listStatus(p(aside)):
        if (name := made.getPath().getName()).startswith("filename="):
            to = p(f"{folder}/{unquote(name.removeprefix('filename='))}")
            fs.delete(to, False)
            fs.rename(next(x.getPath() for x in fs.listStatus(made.getPath()) if x.getPath().getName().startswith("part-")), to)
    fs.delete(p(aside), True)


def read_statuses(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, status of a status store: one JSON object of objects."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "map<string, struct<status: string>>")).alias("doc_id", "s")).select("doc_id", F.col("s.status").alias("status"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "map<string, string>")).alias("path", "sha"))


def read_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """length of all files below a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """One question a line; blank lines and comments are dropped."""
    return spark.read.text(path).select(F.trim("value").alias("question")).filter("question <> '' and not startswith(question, '#')")


def provider(rows: DataFrame, answer, schema: str, at_once: int | None = None) -> DataFrame:
    """Rows through a pluggable provider (a function from pandas to pandas), batch by batch: where a language model
    would be called, by at most `at_once` tasks at a time. Put filters before it."""
    rows = rows if at_once is None else rows.coalesce(at_once)
    return rows.mapInPandas(lambda pdfs: (answer(p) for p in pdfs), schema)
