"""Resolves raw mentions to registry entities and rewrites extraction records in line order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgaudit.functions import text as tx
from kgaudit.operators.gate import leaks


def registry_index(entities: DataFrame) -> DataFrame:
    """norm, entity_id, entity_ord, target, alias_target, evidence: names and aliases (not titles or callsigns) of the
    registry; `target` is the first alias for entities at risk of homonymy, else the name."""
    risk = F.coalesce("is_homonym_risk", F.lit(False)) if "is_homonym_risk" in entities.columns else F.lit(False)
    first = F.get(F.coalesce("aliases", F.array().cast("array<string>")), F.lit(0))
    described = F.concat_ws(" ", *[F.col(c) for c in ("type", "category", "description") if c in entities.columns])
    each = F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    out = entities.select("id", "entity_ord", F.when(risk, F.coalesce(first, "name")).otherwise(F.col("name")).alias("target"), F.coalesce(first, "name").alias("alias_target"), tx.keywords(described).alias("evidence"), F.explode(each).alias("n"))
    return out.select(tx.normalize("n").alias("norm"), F.col("id").alias("entity_id"), "entity_ord", "target", "alias_target", "evidence").filter("norm <> ''").distinct()


def _answers(asked: DataFrame, index: DataFrame, compat: bool) -> DataFrame:
    """norm, info, known, how, shared: what names with their texts stand for, each pair of them once, where the index has
    the name. Entities of a name with equal evidence count as one with a number, and the hits of a pair are summed up
    where they are found, so no step writes or sends the mentions of a name times its entities."""
    hits = F.size(F.filter("evidence", lambda k: F.contains(F.col("info"), k)))
    groups = index.groupBy("norm", F.array_sort("evidence").alias("evidence")).agg(F.count("*").alias("size"), F.min("entity_ord").alias("ord"))
    # merged, since the registry may be far larger than its files tell; the key of the sums isn't that of the join, so a
    # name with many texts may be split over tasks
    found = asked.join(groups.hint("merge"), "norm").select(F.struct("norm", "info").alias("pair"), hits.alias("hits"), "size", "ord")
    by_hits = found.groupBy("pair", "hits").agg(F.sum("size").alias("size"), F.min("ord").alias("ord"))
    top = F.max(F.struct("hits", "size", "ord"))
    each = by_hits.groupBy("pair").agg(F.sum("size").alias("n"), top.alias("top"), F.min(F.when(F.col("hits") > 0, F.col("ord"))).alias("first_hit"))
    each = each.select("pair.norm", "pair.info", "n", F.col("top.hits").alias("best"), F.col("top.size").alias("ties"), F.col("top.ord").alias("ord"), "first_hit")
    one = F.col("n") == 1
    fits = one | (F.col("best") > 0) & (F.lit(True) if compat else F.col("ties") == 1)
    at = F.when(one, F.col("ord")).otherwise(F.col("first_hit") if compat else F.col("ord"))
    chosen = each.filter(fits).select("norm", "info", "n", "best", at.alias("entity_ord"))
    # entities may share a place in the order
    right = one | ((hits > 0) if compat else hits == F.col("best"))
    named = F.when(one, F.col("target")).otherwise(F.col("alias_target"))
    known = chosen.join(index.hint("merge"), ["norm", "entity_ord"]).filter(right).groupBy("norm", "info").agg(F.min(named).alias("known"), F.min(F.when(one, "registry").otherwise("evidence")).alias("how"))
    return each.select("norm", "info", (F.col("n") > 1).alias("shared")).join(known, ["norm", "info"], "left")


def resolve(mentions: DataFrame, index: DataFrame, compat: bool = False, qualify: bool = False) -> DataFrame:
    """mention_id, resolved, method, from mentions (mention_id, raw_name, description, context; to qualify also owner,
    entity_type).

    registry    one entity has this name
    evidence    several have it; with compat the first whose keywords occur in the text, else the one of which most
                occur, if it is alone at that
    designation a designation in the text that overlaps with the name (with compat: or is long enough)
    qualified   with qualify: a name that several entities have and that nothing else settles, with the mention's owner
                or else its type, so that no ambiguous name is given bare
    raw         the name as it is
    """
    m = mentions.withColumns({"norm": tx.normalize("raw_name"), "info": F.lower(F.concat_ws(" ", "description", "context"))})
    out = m.join(_answers(m.select("norm", "info").distinct(), index, compat), ["norm", "info"], "left")
    info = F.concat_ws("\n", "description", "context")

    def fits_name(d):
        norm = tx.normalize(d)
        overlap = F.contains(norm, F.col("norm")) | F.contains(F.col("norm"), norm)
        return (norm != "") & ((overlap | (F.length(d) >= 5)) if compat else overlap)

    named = F.get(F.filter(tx.designations(info), fits_name), F.lit(0))
    blank = F.col("norm") == ""
    last, how_last = F.trim("raw_name"), F.lit("raw")
    if qualify:
        by = F.coalesce(F.nullif(F.trim("owner"), F.lit("")), F.nullif(F.trim("entity_type"), F.lit("")))
        told = F.when(F.col("shared") & by.isNotNull(), tx.structural_name(last, by))
        last, how_last = F.coalesce(told, last), F.when(told.isNotNull(), "qualified").otherwise("raw")
    resolved = F.when(blank, F.col("raw_name")).otherwise(F.coalesce("known", named, last))
    method = F.when(blank, "raw").otherwise(F.coalesce("how", F.when(named.isNotNull(), "designation"), how_last))
    return out.select("mention_id", resolved.alias("resolved"), method.alias("method"))


def records(responses: DataFrame) -> DataFrame:
    """doc_id, line_no, line, fields, kind of the lines of responses (doc_id, text). kind: entity, relation, other."""
    out = responses.select("doc_id", F.posexplode(tx.lines("text")).alias("line_no", "line")).withColumn("fields", tx.fields("line"))
    head, n = F.lower(F.col("fields")[0]), F.size("fields")
    kind = F.when((head == "entity") & (n >= 4), "entity").when(head.isin("relation", "relationship") & (n >= 5), "relation").otherwise("other")
    return out.withColumn("kind", kind)


def canonicalize(lines: DataFrame, renames: DataFrame, two_pass: bool = False) -> DataFrame:
    """doc_id, line_no, line: entity lines get their resolved name (renames: doc_id, line_no, resolved); ends of
    relation lines the latest rename of that name in an earlier line of the document, by the exact name or else by the
    normalised one. With two_pass later lines count as well."""
    e = lines.filter("kind = 'entity'").join(renames, ["doc_id", "line_no"], "left").withColumn("to", F.coalesce("resolved", F.col("fields")[1]))
    r = lines.filter("kind = 'relation'")
    named = e.select("doc_id", "line_no", F.col("fields")[1].alias("name"), "to")
    asked = r.select("doc_id", "line_no", F.explode(F.array(F.struct(F.lit(1).alias("end"), F.col("fields")[1].alias("name")), F.struct(F.lit(2).alias("end"), F.col("fields")[2].alias("name")))).alias("x")).select("doc_id", "line_no", "x.end", "x.name")

    def as_of(key) -> DataFrame:
        both = named.select("doc_id", "line_no", key.alias("key"), F.lit(0).alias("end"), "to").unionByName(asked.select("doc_id", "line_no", key.alias("key"), "end", F.lit(None).cast("string").alias("to")))
        w = Window.partitionBy("doc_id", "key").orderBy("line_no", "end")
        w = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing if two_pass else Window.currentRow)
        return both.withColumn("last", F.last("to", ignorenulls=True).over(w)).filter("end > 0").select("doc_id", "line_no", "end", "last")

    exact, loose = as_of(F.col("name")), as_of(tx.normalize("name")).withColumnRenamed("last", "loose")
    ends = asked.join(exact, ["doc_id", "line_no", "end"]).join(loose, ["doc_id", "line_no", "end"]).withColumn("to", F.coalesce("last", "loose", "name"))
    pair = ends.groupBy("doc_id", "line_no").agg(F.max(F.when(F.col("end") == 1, F.col("to"))).alias("src"), F.max(F.when(F.col("end") == 2, F.col("to"))).alias("dst"))
    rest = lambda k: F.slice("fields", k, F.size("fields"))
    out_e = e.select("doc_id", "line_no", F.array_join(F.concat(F.array(F.col("fields")[0], F.col("to")), rest(3)), tx.FIELD).alias("line"))
    out_r = r.join(pair, ["doc_id", "line_no"]).select("doc_id", "line_no", F.array_join(F.concat(F.array(F.col("fields")[0], F.col("src"), F.col("dst")), rest(4)), tx.FIELD).alias("line"))
    return out_e.unionByName(out_r).unionByName(lines.filter("kind = 'other'").select("doc_id", "line_no", "line"))


def last_before(rows: DataFrame, key: list[str], order: str, value, name: str = "last") -> DataFrame:
    """The latest value of a key up to and with each row, nulls passed over."""
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def evidence(texts: DataFrame, candidates: DataFrame, substrings: bool = True) -> DataFrame:
    """text_id, candidate_ord, keyword: the first candidate of which a keyword occurs in the text, in lower case;
    without `substrings`, as a word of it. candidates: candidate_ord, keyword. Keywords are found by the leak scan, or
    meet words by an equi-join, so no text is tried against all candidates."""
    if substrings:
        lower = texts.select("text_id", F.lower("text").alias("text"))
        hit = leaks(lower, candidates.select(F.col("keyword").alias("term_id"), F.col("keyword").alias("term")).distinct(), 1)
        found = hit.withColumnRenamed("term_id", "keyword").join(candidates, "keyword")
    else:
        found = texts.select("text_id", F.explode(tx.keywords("text")).alias("keyword")).join(candidates, "keyword")
    return found.groupBy("text_id").agg(F.min(F.struct("candidate_ord", "keyword")).alias("x")).select("text_id", "x.candidate_ord", "x.keyword")
