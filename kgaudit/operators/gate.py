"""Rules on texts: patterns that must or mustn't occur, leaked literals, accepted blocks."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kgaudit.functions import text as tx


FEW_RULES = 10_000


def scan(files: DataFrame, rules: DataFrame) -> DataFrame:
    """file, rule, ok from files (file, text) and rules (rule, pattern, required): a required pattern must occur in
    some line, another one must not. Every file is held against every rule; up to FEW_RULES they are broadcast."""
    hit = F.expr("regexp_like(text, concat('(?m)', pattern))")
    each = files.crossJoin(F.broadcast(rules) if rules.limit(FEW_RULES + 1).count() <= FEW_RULES else rules)
    return each.select("file", "rule", F.when(F.col("required"), hit).otherwise(~hit).alias("ok"))


def verdict(scanned: DataFrame) -> DataFrame:
    return scanned.groupBy("file").agg(F.bool_and("ok").alias("passed"), F.count_if(~F.col("ok")).alias("broken"))


#: Terms and bytes of them up to which they are looked for by one automaton, and signs of a term that it holds.
FEW_TERMS, FEW_BYTES, ANCHOR = 50_000, 32 << 20, 24


def leaks(texts: DataFrame, terms: DataFrame, least: int = 5) -> DataFrame:
    """text_id, term_id of terms (term_id, term) of so many signs that occur in a text as they are.

    Up to FEW_TERMS terms are broadcast and found where texts are read, by an automaton on their first ANCHOR signs: one
    pass, no shuffle of texts. More of them meet the texts by keys: see leaks_by_key."""
    t = terms.filter(F.length("term") >= least).select("term_id", "term").distinct()
    n, size = t.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    if n > FEW_TERMS or size > FEW_BYTES:
        return leaks_by_key(texts, t, least)
    by_term: dict[str, list] = {}
    for r in t.collect():  # within the bound
        by_term.setdefault(r["term"], []).append(r["term_id"])
    shared = texts.sparkSession.sparkContext.broadcast(by_term)
    kind = lambda c, df: df.schema[c].dataType
    to_arrow = pa.schema([pa.field("text_id", to_arrow_type(kind("text_id", texts))), pa.field("term_id", to_arrow_type(kind("term_id", terms)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[str]] = {}
        for term in shared.value:
            held.setdefault(term[:ANCHOR], []).append(term)
        automaton = ahocorasick.Automaton()
        for anchor in held:
            automaton.add_word(anchor, anchor)
        if held:
            automaton.make_automaton()
        for b in batches:
            ids, found = [], []
            for text_id, text in zip(b.column(0), b.column(1), strict=True):
                if (text := text.as_py()) is None or not held:
                    continue
                hit: set[str] = set()
                for end, anchor in automaton.iter(text):
                    start = end - len(anchor) + 1
                    hit.update(x for x in held[anchor] if x not in hit and text.startswith(x, start))
                for i in sorted({i for x in hit for i in shared.value[x]}):
                    ids.append(text_id.as_py()), found.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((ids, found), to_arrow, strict=True)], schema=to_arrow)

    return texts.select("text_id", "text").mapInArrow(run, f"text_id {kind('text_id', texts).simpleString()}, term_id {kind('term_id', terms).simpleString()}").distinct()


def leaks_by_key(texts: DataFrame, terms: DataFrame, least: int = 5) -> DataFrame:
    """The same for any number of terms. Texts and terms meet by keys, not by pairs: a term's longest inner word, which is
    a whole word of any text that holds the term; for terms of one word or two its first `least` signs, which such a text
    holds somewhere. Only ids and hashed keys are joined; texts are fetched for the pairs that are left, and tested."""
    word = r"[\p{L}\p{N}]+"
    t = terms.filter(F.length("term") >= least).select("term_id", "term").distinct()
    inner = F.expr(f"regexp_extract_all(term, '(?<=[^\\\\p{{L}}\\\\p{{N}}]){word.replace(chr(92), chr(92) * 2)}(?=[^\\\\p{{L}}\\\\p{{N}}])', 0)")
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    keyed = t.withColumn("word", longest).withColumn("key", F.xxhash64(F.coalesce("word", F.substring("term", 1, least)), F.col("word").isNull()))
    words = texts.select("text_id", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(word), F.lit(0)), lambda w: F.xxhash64(w, F.lit(False))))).alias("key"))
    if keyed.filter("word is null").limit(1).count():
        parts = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("text") - least + 1)), lambda i: F.xxhash64(F.substring(F.col("text"), i, F.lit(least)), F.lit(True)))
        words = words.union(texts.select("text_id", F.explode(F.array_distinct(parts)).alias("key")))
    pairs = words.join(keyed.select("key", "term_id", "term"), "key").select("text_id", "term_id", "term").distinct()
    return texts.select("text_id", "text").join(pairs, "text_id").filter(F.contains("text", F.col("term"))).select("text_id", "term_id").distinct()


def missing_modules(files: DataFrame, known: list[str]) -> DataFrame:
    """file, module that a file imports and that is neither one of the known ones nor a file beside it (file, text; a
    file's name without its end is its module)."""
    line = r"(?m)^\s*(?:from|import)\s+([A-Za-z_][A-Za-z0-9_]*)"
    used = files.select("file", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(line), F.lit(1)))).alias("module"))
    beside = files.select(F.regexp_replace(tx.basename(F.col("file").cast("string")), r"\.[^.]*$", "").alias("module")).distinct()
    return used.filter(~F.col("module").isin(known)).join(beside, "module", "left_anti").select("file", "module")


def accepted_block(responses: DataFrame) -> DataFrame:
    """run, status, block: the longest fenced block of responses that went well."""
    ok = (F.lower("status") == "success") & (F.coalesce("error", F.lit("")) == "")
    return responses.select("run", "status", F.when(ok, tx.longest_block("response")).alias("block"))
