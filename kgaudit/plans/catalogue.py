"""The registered queries on the engine's own operators, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgaudit.functions import fuzzy as fz
from kgaudit.functions import text as tx
from kgaudit.operators import entities as en
from kgaudit.operators import gate as gt
from kgaudit.operators import graph as gr
from kgaudit.operators import ledger as lg
from kgaudit.operators import limiter as lm
from kgaudit.operators import order as od
from kgaudit.operators import planning as pl
from kgaudit.operators import resolve as rs
from kgaudit.operators import vectors as vc
from kgaudit.operators import verify as vf
from kgaudit.session import table
from kgaudit.streaming import ingest as st

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def put(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


#: The SQL twin of functions.text.normalize.
NORM = r"trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT {NORM.format('p_name')} AS norm_name, count(*) AS group_size, count(DISTINCT p_brand) AS n_brands FROM part GROUP BY 1 HAVING count(*) > 1")
def homonym_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that share a normalised name."""
    part = table(spark, sf_dir, "part").select(tx.normalize("p_name").alias("norm_name"), "p_brand")
    return part.groupBy("norm_name").agg(F.count("*").alias("group_size"), F.count_distinct("p_brand").alias("n_brands")).filter("group_size > 1")


# --- text, hashes, ledger ---------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, sha256({NORM.format('text')}) AS norm_sha FROM documents")
def normalize_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(tx.normalize("text"), 256).alias("norm_sha"))


@query("SELECT doc_id, sha256(text) AS sha FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))


@query("WITH l AS (SELECT doc_id, sha256(text) AS sha FROM documents WHERE doc_id % 2 = 0) SELECT d.doc_id, sha256(d.text) AS sha FROM documents d WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.doc_id = d.doc_id AND l.sha = sha256(d.text))")
def ledger_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that a ledger of the even ids doesn't have."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    done = docs.filter("path % 2 = 0").select("path", F.sha2("text", 256).alias("sha"))
    return lg.pending(docs, done).select(F.col("path").alias("doc_id"), "sha")


@query("WITH d AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 10 AS batch FROM documents) SELECT batch::BIGINT AS batch, count(*) AS n, min(doc_id) AS first_id FROM d GROUP BY batch")
def ingest_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"))
    return lg.batches(docs).groupBy("batch").agg(F.count("*").alias("n"), F.min("path").alias("first_id"))


@query("SELECT sha256(text) AS sha, min(doc_id) AS survivor, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("survivor"), F.count("*").alias("copies")).filter("copies > 1")


SLUG = "regexp_replace(substr(CASE WHEN {0} = '' THEN 'entity' ELSE {0} END, 1, 30), '^-+|-+$', '', 'g')".format("regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')")


@query(f"SELECT doc_id, {SLUG.format('text')} AS slug, printf('%04d_%s_%s.md', doc_id, source, {SLUG.format('text')}) AS filename FROM documents")
def slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.slug("text").alias("slug"), tx.document_name("doc_id", "source", "text").alias("filename"))


@query("SELECT d AS designation, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '\\b([A-Z0-9]{2,}-[A-Za-z0-9-]+)\\b', 1)) AS d FROM pages UNION ALL SELECT unnest(regexp_extract_all(html, '(?i)\\b(?:alias|callsign|code)\\s*[:—-]\\s*([A-Za-z0-9_-]+)', 1)) FROM pages UNION ALL SELECT 'unit_' || page_id % 50 FROM pages) GROUP BY d")
def designations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Designations in pages to which an announced one is added."""
    announced = F.concat("html", F.lit("\n callsign: `unit_"), (F.col("page_id") % 50).cast("string"), F.lit("`"))
    pages = table(spark, sf_dir, "pages").select(F.explode(tx.designations(announced)).alias("designation"))
    return pages.groupBy("designation").agg(F.count("*").alias("n"))


@query("SELECT page_id, len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1))::BIGINT AS links FROM pages")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_count("html", F.lit('<a href="[^"]*"')).cast("long").alias("links"))


@query("SELECT conv_id, turn, length(trim(regexp_replace(regexp_replace('```' || chr(10) || text || chr(10) || '```', '^```[^\\n]*\\n', ''), '\\n?```\\s*$', ''), ' ' || chr(9) || chr(10) || chr(13)))::BIGINT AS clean_chars, length(text)::BIGINT AS chars FROM conversations")
def fence_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns in a fence, cleaned of it."""
    c = table(spark, sf_dir, "conversations")
    fenced = F.concat(F.lit("```\n"), "text", F.lit("\n```"))
    return c.select("conv_id", "turn", F.length(tx.clean_markdown(fenced)).cast("long").alias("clean_chars"), F.length("text").cast("long").alias("chars"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'unknown' ELSE source END AS narrator FROM documents")
def frontmatter_narrator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with frontmatter (two of three), parsed again."""
    docs = table(spark, sf_dir, "documents")
    block = tx.frontmatter(F.col("doc_id").cast("string"), F.col("source"), F.array(F.col("lang")), F.array().cast("array<string>"), F.lit("2026-01-01T00:00:00Z"))
    whole = F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise(F.concat(block, F.lit("\n\nbody\n")))
    return docs.select("doc_id", tx.narrator(whole).alias("narrator"))


@query("SELECT doc_id, lang || '<SEP>' || source || '<SEP>x' AS merged FROM documents")
def packed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    a, b = F.concat_ws(tx.SEP, "lang", "source"), F.concat(F.col("source"), F.lit("<SEP> x <SEP>"))
    return docs.select("doc_id", tx.merge_packed(a, b).alias("merged"))


@query("SELECT a::BIGINT AS attempt, least(2.0 * 2.0 ** a, 60.0)::DOUBLE AS delay, 8.5::DOUBLE AS named FROM range(6) t(a)")
def backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.range(6).select(F.col("id").alias("attempt"))
    return t.select("attempt", tx.retry_delay(F.lit(None).cast("string"), F.col("attempt")).alias("delay"), tx.retry_delay(F.lit("'retryDelay': '7.5s'"), F.col("attempt")).alias("named"))


@query("SELECT event_type, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS k_sum, count(*) AS n FROM events GROUP BY event_type")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.groupBy("event_type").agg(F.sum("k").alias("k_sum"), F.count("*").alias("n"))


@query("SELECT lower(event_type) AS status, count(*) AS n, lower(event_type) = 'processed' AS final FROM events GROUP BY 1")
def status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lg.status_counts(table(spark, sf_dir, "events").select(F.upper("event_type").alias("status")))


@query("SELECT count(*) AS files, coalesce(sum(strlen(text)), 0)::BIGINT AS bytes FROM documents WHERE strlen(text) > 0")
def storage_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lg.inventory(table(spark, sf_dir, "documents").select(F.octet_length("text").cast("long").alias("length")))


# --- leaks and gates --------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT d.doc_id AS text_id, b.item_id AS term_id FROM documents d JOIN benchmark b ON length(b.text) >= 5 AND contains(d.text, b.text)")
def leak_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark text word for word."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return gt.leaks(docs.select(F.col("doc_id").alias("text_id"), "text"), items.select(F.col("item_id").alias("term_id"), F.col("text").alias("term")))


@query("WITH l AS (SELECT DISTINCT d.doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)) SELECT source, count(*) AS docs, count(l.doc_id) AS leaked, round_even(100.0 * count(l.doc_id) / count(*), 2)::DOUBLE AS pct FROM documents d LEFT JOIN l USING (doc_id) GROUP BY source")
def leak_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = leak_scan(spark, sf_dir).select(F.col("text_id").alias("doc_id"), F.lit(1).alias("hit")).distinct()
    one = table(spark, sf_dir, "documents").select("doc_id", "source").join(hit, "doc_id", "left").groupBy("source").agg(F.count("*").alias("docs"), F.count("hit").alias("leaked"))
    return one.withColumn("pct", tx.percent(F.col("leaked"), F.col("docs")))


@query("SELECT doc_id AS file, NOT (regexp_matches(text, '@') OR regexp_matches(text, 'AKIA[A-Z0-9]+')) AND regexp_matches(text, '[a-z]') AS passed, (regexp_matches(text, '@')::INT + regexp_matches(text, 'AKIA[A-Z0-9]+')::INT + (NOT regexp_matches(text, '[a-z]'))::INT)::BIGINT AS broken FROM documents")
def gate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([("no address", "@", False), ("no key", "AKIA[A-Z0-9]+", False), ("has words", "[a-z]", True)], "rule string, pattern string, required boolean")
    return gt.verdict(gt.scan(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), "text"), rules))


@query("SELECT conv_id AS run, turn, text AS block FROM conversations WHERE role = 'assistant'")
def accepted_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest fenced block of each answer (the whole answer is fenced, and a shorter block goes before it)."""
    c = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    rows = c.select(F.concat_ws("/", "conv_id", "turn").alias("run"), F.lit("success").alias("status"), F.lit("").alias("error"), F.concat(F.lit("```\n```\nand\n```python\n"), "text", F.lit("```")).alias("response"))
    out = gt.accepted_block(rows)
    return out.select(F.split("run", "/")[0].cast("long").alias("run"), F.split("run", "/")[1].cast("long").alias("turn"), "block")


# --- entities ---------------------------------------------------------------------------------------------------------


def _part_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_brand").alias("owner"))


@query("SELECT 'nation' AS category, count(*) AS n, count(DISTINCT n_name) AS names FROM nation UNION ALL SELECT 'supplier', count(*), count(DISTINCT s_name) FROM supplier UNION ALL SELECT 'customer', count(*), count(DISTINCT c_name) FROM customer UNION ALL SELECT 'part', count(*), count(DISTINCT p_name) FROM part")
def entity_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entities in one table, counted by category."""
    t = lambda name, p: table(spark, sf_dir, name).select(F.col(f"{p}_{name}key" if name != "supplier" and name != "customer" else {"supplier": "s_suppkey", "customer": "c_custkey"}[name]).cast("long").alias("id"), F.col(f"{p}_name").alias("name"))
    every = en.unify({"nation": t("nation", "n"), "supplier": t("supplier", "s"), "customer": t("customer", "c"), "part": _part_entities(spark, sf_dir)})
    return every.groupBy("category").agg(F.count("*").alias("n"), F.count_distinct("name").alias("names"))


@query("WITH k AS (SELECT p_name || ' (' || p_type || ', ' || p_brand || ')' AS structural_name, count(*) AS n FROM part GROUP BY 1) SELECT structural_name, n FROM k")
def structural_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _part_entities(spark, sf_dir)
    return e.groupBy(tx.structural_name(F.col("name"), F.col("type"), F.col("owner")).alias("structural_name")).agg(F.count("*").alias("n"))


@query(
    f"""WITH e AS (SELECT p_partkey AS id, {NORM.format('p_name')} AS k FROM part),
last AS (SELECT id FROM e WHERE k = (SELECT max(k) FROM (SELECT k FROM e GROUP BY k HAVING count(*) > 1))),
rest AS (SELECT id, row_number() OVER (ORDER BY sha256('20260806|' || id), id) AS r, round_even(count(*) OVER () * 0.2, 0) AS n FROM e WHERE id NOT IN (SELECT id FROM last))
SELECT id FROM last UNION ALL SELECT id FROM rest WHERE r <= n"""
)
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Withheld parts: the homonym group that sorts last, and a fifth of the others by hash order."""
    return en.choose_holdout_by_hash(_part_entities(spark, sf_dir).select("id", "name"))


@query("SELECT count(*) AS total, count(*) - 25 AS kept, 25::BIGINT AS held, true AS complete FROM customer")
def split_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split that withholds the 25 least customers, accounted for."""
    e = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("owner"))
    held = e.orderBy("id").limit(25).select("id")
    links = e.select(F.col("owner").cast("long").alias("parent_id"), F.col("id").alias("child_id"))
    kept, out, _ = en.split(e, held, links)
    return en.accounted(e, kept, out)


@query(f"WITH e AS (SELECT p_partkey AS id, p_name AS name FROM part UNION ALL SELECT 1000000 + s_suppkey, s_name FROM supplier), n AS (SELECT {NORM.format('name')} AS norm, min(id) AS entity_id, min(name) AS canonical, count(*) AS c FROM e GROUP BY 1) SELECT norm, entity_id, canonical FROM n WHERE c = 1")
def alias_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts and suppliers that stand for one of them only."""
    suppliers = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1_000_000).alias("id"), F.col("s_name").alias("name"))
    return en.alias_map(_part_entities(spark, sf_dir).select("id", "name").union(suppliers))


@query("WITH t AS (SELECT item_id, lower(text) AS text FROM benchmark), w AS (SELECT DISTINCT keyword FROM (SELECT unnest(string_split_regex(text, '\\s+')) AS keyword FROM t) WHERE length(keyword) >= 4), k AS (SELECT (length(keyword) * 100 + ascii(keyword))::INT AS candidate_ord, keyword FROM w) SELECT item_id AS text_id, min(candidate_ord) AS candidate_ord FROM t JOIN k ON contains(text, keyword) GROUP BY item_id")
def evidence_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first candidate of which a keyword occurs in a benchmark text; candidates are numbered by length and first
    sign of their keyword."""
    texts = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("text_id"), "text")
    words = texts.select(F.explode(tx.keywords("text")).alias("keyword")).distinct()
    candidates = words.select((F.length("keyword") * 100 + F.ascii("keyword")).alias("candidate_ord"), "keyword")
    return rs.evidence(texts, candidates).select("text_id", "candidate_ord")


@query(
    """WITH e AS (SELECT p_partkey AS id, p_name AS name, [p_name || ' ' || p_partkey] AS aliases, lower(p_type || ' ' || p_brand) AS d FROM part
  UNION ALL SELECT 1000000 + s_suppkey, s_name, ['agent ' || s_suppkey], 'supplier' FROM supplier),
x AS (SELECT DISTINCT id, name, aliases[1] AS alias, list_filter(list_distinct(string_split(d, ' ')), lambda k: length(k) >= 4) AS evidence, {n} AS norm FROM (SELECT *, unnest(list_distinct([name] || aliases)) AS v FROM e)),
m AS (SELECT p_partkey AS mention_id, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN 'Supplier#' || lpad((p_partkey % 10)::VARCHAR, 9, '0') WHEN 2 THEN 'unit ' || p_partkey ELSE p_name END AS raw,
  CASE WHEN p_partkey % 4 = 3 THEN '' ELSE p_type END AS description, CASE WHEN p_partkey % 8 = 2 THEN 'callsign: unit_x' ELSE CASE WHEN p_partkey % 4 = 3 THEN 'nothing' ELSE lower(p_brand) END END AS context, p_brand AS owner FROM part),
f AS (SELECT m.*, x.*, len(list_filter(evidence, lambda k: contains(lower(description || ' ' || context), k))) AS hits FROM m JOIN x ON x.norm = {r}),
b AS (SELECT mention_id, count(*) AS n, max(hits) AS best FROM f GROUP BY mention_id),
g AS (SELECT mention_id, n, best, count(*) FILTER (WHERE hits = best) AS ties, min(name) AS only_name, min(alias) FILTER (WHERE hits = best) AS alias FROM f JOIN b USING (mention_id) GROUP BY ALL)
SELECT m.mention_id,
  CASE WHEN n = 1 THEN only_name WHEN n > 1 AND best > 0 AND ties = 1 THEN alias WHEN n IS NULL AND m.mention_id % 8 = 2 AND contains('unit_x', {r}) THEN 'unit_x' WHEN n > 1 THEN trim(raw) || ' (' || owner || ')' ELSE trim(raw) END AS resolved,
  CASE WHEN n = 1 THEN 'registry' WHEN n > 1 AND best > 0 AND ties = 1 THEN 'evidence' WHEN n IS NULL AND m.mention_id % 8 = 2 AND contains('unit_x', {r}) THEN 'designation' WHEN n > 1 THEN 'qualified' ELSE 'raw' END AS method
FROM m LEFT JOIN g USING (mention_id)""".replace("{n}", NORM.format("v")).replace("{r}", NORM.format("raw"))
)
def resolver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mention for each part, resolved against a registry of parts and suppliers: by name, by evidence, by a
    designation, by its owner where the name is ambiguous, or left as it is."""
    part, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    p = part.select(key.alias("id"), F.col("p_name").alias("name"), F.array(F.concat_ws(" ", "p_name", key.cast("string"))).alias("aliases"), F.col("p_type").alias("type"), F.col("p_brand").alias("description"), F.lit(False).alias("is_homonym_risk"))
    agents = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1_000_000).alias("id"), F.col("s_name").alias("name"), F.array(F.concat(F.lit("agent "), F.col("s_suppkey").cast("string"))).alias("aliases"), F.lit("supplier").alias("type"), F.lit(None).cast("string").alias("description"), F.lit(False).alias("is_homonym_risk"))
    registry = p.unionByName(agents).withColumn("entity_ord", F.col("id"))
    agent = F.concat(F.lit("Supplier#"), F.lpad((key % 10).cast("string"), 9, "0"))
    raw = F.when(key % 4 == 0, F.upper("p_name")).when(key % 4 == 1, agent).when(key % 4 == 2, F.concat(F.lit("unit "), key.cast("string"))).otherwise(F.col("p_name"))
    context = F.when(key % 8 == 2, "callsign: unit_x").when(key % 4 == 3, "nothing").otherwise(F.lower("p_brand"))
    mentions = part.select(key.alias("mention_id"), raw.alias("raw_name"), F.when(key % 4 == 3, "").otherwise(F.col("p_type")).alias("description"), context.alias("context"), F.col("p_brand").alias("owner"), F.col("p_type").alias("entity_type"))
    return rs.resolve(mentions, rs.registry_index(registry), qualify=True)


@query(f"SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN sha256(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS last_user FROM conversations")
def asof_last_user_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return rs.last_before(c, ["conv_id"], "turn", F.when(F.col("role") == "user", F.sha2("text", 256)), "last_user").select("conv_id", "turn", "last_user")


@query(
    """WITH l AS (SELECT conv_id AS doc_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS line_no, role, 'n' || (turn % 3) AS name, 'R' || turn AS resolved FROM conversations),
e AS (SELECT * FROM l WHERE role = 'user'), r AS (SELECT * FROM l WHERE role <> 'user'),
a AS (SELECT r.*, coalesce((SELECT arg_max(e.resolved, e.line_no) FROM e WHERE e.doc_id = r.doc_id AND e.name = r.name AND e.line_no <= r.line_no), r.name) AS src FROM r)
SELECT doc_id, line_no, 'entity<|#|>' || resolved || '<|#|>person<|#|>text' AS line FROM e UNION ALL SELECT doc_id, line_no, 'relation<|#|>' || src || '<|#|>other<|#|>knows<|#|>text' FROM a"""
)
def canonicalize_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as extraction lines: user turns name entities, the other turns relate to the latest renames."""
    c = table(spark, sf_dir, "conversations")
    name = F.concat(F.lit("n"), (F.col("turn") % 3).cast("string"))
    line = F.when(F.col("role") == "user", F.concat_ws(tx.FIELD, F.lit("entity"), name, F.lit("person"), F.lit("text"))).otherwise(F.concat_ws(tx.FIELD, F.lit("relation"), name, F.lit("other"), F.lit("knows"), F.lit("text")))
    turns = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("t"))
    responses = turns.select(F.col("conv_id").alias("doc_id"), F.array_join(F.transform("t", lambda x: x["line"]), "\n").alias("text"))
    renames = turns.select(F.col("conv_id").alias("doc_id"), F.posexplode("t").alias("line_no", "x")).select("doc_id", "line_no", F.concat(F.lit("R"), F.col("x.turn").cast("string")).alias("resolved"))
    return rs.canonicalize(rs.records(responses), renames)


@query("SELECT lang AS split, count(*) FILTER (WHERE e AND a) AS tp, count(*) FILTER (WHERE NOT e AND a) AS fp, count(*) FILTER (WHERE e AND NOT a) AS fn, CASE WHEN count(*) FILTER (WHERE a) > 0 THEN round_even(100.0 * count(*) FILTER (WHERE e AND a) / count(*) FILTER (WHERE a), 2) ELSE 0 END::DOUBLE AS precision, CASE WHEN count(*) FILTER (WHERE e) > 0 THEN round_even(100.0 * count(*) FILTER (WHERE e AND a) / count(*) FILTER (WHERE e), 2) ELSE 0 END::DOUBLE AS recall FROM (SELECT lang, quality = 1 AS e, n_chars >= 500 AS a FROM documents JOIN labels USING (doc_id)) GROUP BY lang")
def mention_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return vf.mention_scores(d.select(F.col("lang").alias("split"), (F.col("quality") == 1).alias("expected"), (F.col("n_chars") >= 500).alias("actual")))


# --- hierarchy and graph ----------------------------------------------------------------------------------------------


def _hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region - nation - customer as one table of links."""
    r = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.concat(F.lit("n"), "n_nationkey").alias("child_id"), F.lit(2).alias("level"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("parent_id"), F.concat(F.lit("c"), "c_custkey").alias("child_id"), F.lit(3).alias("level"))
    return r.unionByName(c)


@query("SELECT 'r' || n_regionkey AS grandparent_id, 'n' || n_nationkey AS parent_id, 'c' || c_custkey AS child_id FROM nation JOIN customer ON c_nationkey = n_nationkey")
def hierarchy_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.two_hops(_hierarchy(spark, sf_dir))


@query("WITH RECURSIVE t(node, depth) AS (SELECT 'r' || r_regionkey, 1 FROM region UNION ALL SELECT h.child, t.depth + 1 FROM t JOIN (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation) h ON h.parent = t.node WHERE t.depth < 10) SELECT node, depth::INT AS depth FROM t")
def hierarchy_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth of each node below the regions, by a recursive query with a depth limit."""
    table(spark, sf_dir, "region").createOrReplaceTempView("kg_region")
    table(spark, sf_dir, "nation").createOrReplaceTempView("kg_nation")
    return spark.sql("WITH RECURSIVE t(node, depth) AS (SELECT concat('r', r_regionkey), 1 FROM kg_region UNION ALL SELECT concat('n', n.n_nationkey), t.depth + 1 FROM t JOIN kg_nation n ON concat('r', n.n_regionkey) = t.node WHERE t.depth < 10) SELECT node, depth FROM t")


def _supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and the parts that they delivered, as edges."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.col("l_quantity").alias("weight"), F.concat(F.lit("o"), "l_orderkey").alias("source_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))


_SUPPLY = "(SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, l_quantity AS weight, 'o' || l_orderkey AS source_id, l_orderkey * 10 + l_linenumber AS ord FROM lineitem)"


@query(f"WITH e AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM {_SUPPLY}), d AS (SELECT a AS n, b AS m FROM e UNION ALL SELECT b, a FROM e), v AS (SELECT 's' || s_suppkey AS node_id FROM supplier UNION ALL SELECT 'p' || p_partkey FROM part) SELECT node_id, count(m) AS degree, min(m) AS neighbour FROM v LEFT JOIN d ON n = node_id GROUP BY node_id")
def graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node_id")).union(table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey")))
    return gr.degrees(nodes, _supply(spark, sf_dir))


_ORDER_EDGES = "(SELECT DISTINCT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders)"


@query(f"WITH RECURSIVE d AS (SELECT src AS a, dst AS b FROM {_ORDER_EDGES} UNION SELECT dst, src FROM {_ORDER_EDGES}), t(node, other) AS (SELECT DISTINCT a, a FROM d UNION SELECT t.node, d.b FROM t JOIN d ON d.a = t.other) SELECT node, min(other) AS component FROM t GROUP BY node")
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return gr.components(o.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("o"), "o_orderkey").alias("dst")))


@query(f"WITH RECURSIVE d AS MATERIALIZED (SELECT DISTINCT src AS a, dst AS b FROM {_SUPPLY} UNION SELECT dst, src FROM {_SUPPLY}), t(node, hops) USING KEY (node) AS (SELECT (SELECT min(a) FROM d), 0 UNION SELECT d.b, min(t.hops) + 1 FROM t JOIN d ON d.a = t.node WHERE d.b NOT IN (SELECT node FROM recurring.t) GROUP BY d.b) SELECT (SELECT min(a) FROM d) AS source, node, hops::INT AS hops FROM t")
def graph_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances from one node of the supply graph to all that it is connected with."""
    e = _supply(spark, sf_dir)
    return gr.distances(e, gr.both_ways(e).agg(F.min("src").alias("source")))


@query(f"WITH e AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, * FROM {_SUPPLY}), u AS (SELECT a, b, source_id, min(ord) AS o FROM e GROUP BY a, b, source_id) SELECT e.a AS src, e.b AS dst, sum(weight)::DOUBLE AS weight, (SELECT string_agg(source_id, '<SEP>' ORDER BY o) FROM u WHERE u.a = e.a AND u.b = e.b) AS source_id FROM e GROUP BY e.a, e.b")
def edge_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.merge_edges(_supply(spark, sf_dir))


@query(
    f"""WITH c AS (SELECT {NORM.format('p_name')} AS norm, min(p_partkey) AS canon FROM part GROUP BY 1),
m AS (SELECT p_partkey, 'p' || canon AS canonical FROM part JOIN c ON c.norm = {NORM.format('p_name')}),
e AS (SELECT 's' || l_suppkey AS a, canonical AS b, l_quantity AS w FROM lineitem JOIN m ON l_partkey = p_partkey)
SELECT least(a, b) AS src, greatest(a, b) AS dst, sum(w)::DOUBLE AS weight FROM e GROUP BY 1, 2"""
)
def alias_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supply edges after parts were merged into the least part of their name."""
    part = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("node_id"), "p_partkey", tx.normalize("p_name").alias("name"))
    first = part.groupBy("name").agg(F.min("p_partkey").alias("k"))
    aliases = part.join(first, "name").select(F.col("node_id").alias("norm"), F.concat(F.lit("p"), "k").alias("canonical"))
    nodes = part.select("node_id", F.lit("part").alias("entity_type"), F.col("p_partkey").alias("ord"))
    return gr.merge_aliases(nodes, _supply(spark, sf_dir).drop("source_id"), aliases)[1]


@query(
    """WITH l AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity, l_returnflag FROM lineitem),
e AS (SELECT 's' || l_suppkey AS a, CASE WHEN l_returnflag = 'R' THEN 'returned' ELSE 'kept' END AS b, l_quantity AS w FROM l)
SELECT least(a, b) AS src, greatest(a, b) AS dst, sum(w)::DOUBLE AS weight FROM e GROUP BY 1, 2 UNION ALL SELECT 'kept', 'returned', 1.0"""
)
def node_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node `goods` split by the return flag that its edges speak of."""
    li = table(spark, sf_dir, "lineitem")
    edges = li.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.lit("goods").alias("dst"), F.col("l_quantity").alias("weight"), F.concat(F.lit("flag "), "l_returnflag").alias("description"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    nodes = edges.select(F.col("src").alias("node_id")).distinct().union(edges.select("dst").distinct())
    specs = spark.createDataFrame([("goods", "kept", 0, ["flag a", "flag n"]), ("goods", "returned", 1, ["flag r"])], "norm string, target string, target_ord int, keywords array<string>")
    return gr.split_nodes(nodes, edges, specs)[1].select("src", "dst", "weight")


_NAMED = f"(SELECT p_partkey, 'p' || canon AS canonical FROM part JOIN (SELECT {NORM.format('p_name')} AS norm, min(p_partkey) AS canon FROM part GROUP BY 1) c ON c.norm = {NORM.format('p_name')})"


def _confused(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Nodes, edges, splits and aliases of a graph of suppliers, parts of several names, and a node `goods` that stands
    for two things."""
    part = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("node_id"), F.col("p_type").alias("description"), F.col("p_partkey").alias("ord"), tx.normalize("p_name").alias("name"))
    first = part.groupBy("name").agg(F.min("ord").alias("k"))
    aliases = part.join(first, "name").select(F.col("node_id").alias("norm"), F.concat(F.lit("p"), "k").alias("canonical"))
    li = table(spark, sf_dir, "lineitem")
    at = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord")
    supply = li.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.col("l_quantity").alias("weight"), F.lit("").alias("description"), at)
    goods = li.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.lit("goods").alias("dst"), F.col("l_quantity").alias("weight"), F.concat(F.lit("flag "), "l_returnflag").alias("description"), at)
    others = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node_id"), F.lit("").alias("description"), (-1 - F.col("s_suppkey")).alias("ord"))
    nodes = part.drop("name").unionByName(others).union(spark.createDataFrame([("goods", "", -1_000_000_000)], "node_id string, description string, ord long")).withColumn("entity_type", F.when(F.col("ord") < 0, "").otherwise("part"))
    specs = spark.createDataFrame([("goods", "kept", 0, ["flag a", "flag n"]), ("goods", "returned", 1, ["flag r"])], "norm string, target string, target_ord int, keywords array<string>")
    return nodes, supply.unionByName(goods), specs, aliases


@query(f"WITH m AS {_NAMED}, e AS (SELECT 's' || l_suppkey AS a, canonical AS b, l_quantity AS w FROM lineitem JOIN m ON l_partkey = p_partkey UNION ALL SELECT 's' || l_suppkey, CASE WHEN l_returnflag = 'R' THEN 'returned' ELSE 'kept' END, l_quantity FROM lineitem) SELECT least(a, b) AS src, greatest(a, b) AS dst, sum(w)::DOUBLE AS weight FROM e GROUP BY 1, 2 UNION ALL SELECT 'kept', 'returned', 1.0")
def disambiguated_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.disambiguate(*_confused(spark, sf_dir))[1].select("src", "dst", "weight")


@query(f"WITH m AS {_NAMED}, t AS (SELECT canonical, p_type, min(p_partkey) AS o FROM part JOIN m USING (p_partkey) GROUP BY ALL) SELECT canonical AS node_id, 'part' AS entity_type, string_agg(p_type, '<SEP>' ORDER BY o) AS description FROM t GROUP BY canonical UNION ALL SELECT 's' || s_suppkey, NULL, '' FROM supplier UNION ALL SELECT unnest(['kept', 'returned']), NULL, ''")
def disambiguated_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.disambiguate(*_confused(spark, sf_dir))[0].select("node_id", "entity_type", "description")


@query(f"WITH m AS {_NAMED}, e AS (SELECT DISTINCT l_suppkey, canonical FROM lineitem JOIN m ON l_partkey = p_partkey UNION SELECT DISTINCT l_suppkey, CASE WHEN l_returnflag = 'R' THEN 'returned' ELSE 'kept' END FROM lineitem) SELECT 1::BIGINT AS homonyms, (SELECT count(*) FROM m WHERE canonical <> 'p' || p_partkey) AS renamed, (SELECT count(DISTINCT canonical) FROM m) + (SELECT count(*) FROM supplier) + 2 AS nodes, (SELECT count(*) FROM e) + 1 AS edges")
def disambiguated_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.disambiguate(*_confused(spark, sf_dir))[2]


@query("WITH d AS (SELECT 'c' || c_custkey AS n, 'n' || c_nationkey AS m FROM customer UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer), v AS (SELECT 'c' || c_custkey AS node_id FROM customer UNION ALL SELECT 'n' || n_nationkey FROM nation UNION ALL SELECT 's' || s_suppkey FROM supplier), g AS (SELECT node_id, count(m) AS k, min(m) AS neighbour FROM v LEFT JOIN d ON n = node_id GROUP BY node_id) SELECT node_id, neighbour, CASE WHEN k = 0 THEN 'isolated' ELSE 'dead end' END AS kind FROM g WHERE k < 2")
def sparse_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isolated nodes and dead ends of customers and their nations; suppliers are nodes without edges."""
    c = table(spark, sf_dir, "customer")
    edges = c.select(F.concat(F.lit("n"), "c_nationkey").alias("src"), F.concat(F.lit("c"), "c_custkey").alias("dst"))
    nodes = edges.select(F.col("dst").alias("node_id")).union(table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey"))).union(table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey")))
    alone = gr.isolated(nodes, edges).select("node_id", F.lit(None).cast("string").alias("neighbour"), F.lit("isolated").alias("kind"))
    return alone.unionByName(gr.dead_ends(nodes, edges).withColumn("kind", F.lit("dead end")))


# --- checks of a graph ------------------------------------------------------------------------------------------------


@query("WITH f AS (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_quantity >= 50 AND l_discount >= 0.1) SELECT count(*) AS total, count(l_suppkey) AS found, count(*) - count(l_suppkey) AS missing, round_even(100.0 * count(l_suppkey) / count(*), 2)::DOUBLE AS pct FROM supplier LEFT JOIN f ON l_suppkey = s_suppkey")
def entity_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many suppliers delivered some item in large number at the full discount."""
    e = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    found = table(spark, sf_dir, "lineitem").filter("l_quantity >= 50 and l_discount >= 0.1").select(F.col("l_suppkey").alias("entity_id"))
    return vf.coverage(e, found)


@query(
    f"""WITH e AS (SELECT p_partkey AS id, {NORM.format('p_name')} AS norm_name FROM part), g AS (SELECT norm_name, count(*) AS group_size FROM e GROUP BY 1 HAVING count(*) > 1),
f AS (SELECT DISTINCT l_partkey AS id, 's' || (l_suppkey % 7) AS node_id FROM lineitem),
n AS (SELECT norm_name, group_size, node_id, count(*) AS c FROM g JOIN e USING (norm_name) LEFT JOIN f USING (id) GROUP BY ALL)
SELECT norm_name, group_size, count(*) FILTER (WHERE node_id IS NOT NULL AND c = group_size) AS shared, count(node_id) AS nodes, (count(*) FILTER (WHERE node_id IS NOT NULL AND c = group_size) > 0 OR count(node_id) = 1) AS collapsed FROM n GROUP BY 1, 2"""
)
def homonym_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("entity_id"), F.concat(F.lit("s"), F.col("l_suppkey") % 7).alias("node_id"))
    return vf.homonym_collapse(_part_entities(spark, sf_dir).select("id", "name"), found)


@query("SELECT l_partkey AS entity_id, count(DISTINCT l_suppkey) AS nodes FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def alias_splitting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vf.alias_splits(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("entity_id"), F.col("l_suppkey").alias("node_id")))


@query("SELECT 'n' || n_nationkey AS child_id, 'r' || n_regionkey AS parent_id, 2 AS level, n_nationkey % 5 <> 0 AS covered, n_nationkey % 5 <> 0 AS direct, 0::BIGINT AS collapsed_pairs, CASE WHEN n_nationkey % 5 <> 0 THEN 1 ELSE -1 END AS hops FROM nation")
def hierarchy_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links from region to nation, in a graph that lacks each fifth nation's edge."""
    links = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.concat(F.lit("n"), "n_nationkey").alias("child_id"), F.lit(2).alias("level"), F.col("n_nationkey").alias("k"))
    edges = links.filter("k % 5 <> 0").select(F.col("parent_id").alias("src"), F.col("child_id").alias("dst"))
    ids = links.select(F.col("parent_id").alias("entity_id")).union(links.select("child_id")).distinct()
    found = ids.select("entity_id", F.col("entity_id").alias("node_id"))
    parts = gr.components(edges, ids.select(F.col("entity_id").alias("node")))
    return vf.hierarchy(links.drop("k"), found, edges, parts).withColumn("hops", F.coalesce("hops", F.lit(-1)))


@query("SELECT 'r' || n_regionkey AS grandparent_id, 'n' || n_nationkey AS parent_id, 'c' || c_custkey AS child_id, n_nationkey % 5 <> 0 AS reachable, n_nationkey % 5 <> 0 AS strict, CASE WHEN n_nationkey % 5 <> 0 THEN 2 ELSE -1 END AS hops FROM nation JOIN customer ON c_nationkey = n_nationkey")
def multi_hop_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region to customer by way of the nation, in a graph that lacks each fifth nation's edge to its region."""
    links = _hierarchy(spark, sf_dir)
    edges = links.filter("level = 3 or cast(substr(child_id, 2) as int) % 5 <> 0").select(F.col("parent_id").alias("src"), F.col("child_id").alias("dst"))
    ids = links.select(F.col("parent_id").alias("entity_id")).union(links.select("child_id")).distinct()
    found = ids.select("entity_id", F.col("entity_id").alias("node_id"))
    parts = gr.components(edges, ids.select(F.col("entity_id").alias("node")))
    out = vf.multi_hop(links, found, edges, parts).withColumn("hops", F.coalesce("hops", F.lit(-1)))
    return out.select("grandparent_id", "parent_id", "child_id", "reachable", "strict", "hops")


@query("SELECT round_even(100.0 * (5 + count(*) FILTER (WHERE n_nationkey % 6 <> 0)) / (5 + count(*)), 2)::DOUBLE AS entity_pct, 0::BIGINT AS collapsed, 0::BIGINT AS separated, round_even(100.0 * count(*) FILTER (WHERE n_nationkey % 6 <> 0) / count(*), 2)::DOUBLE AS hierarchy_pct, 2 AS max_level, 100.0::DOUBLE AS multi_hop_pct, (SELECT round_even(100.0 * count(*) FILTER (WHERE k > 0) / count(*), 2) FROM (SELECT count(*) FILTER (WHERE n_nationkey % 6 <> 0) AS k FROM nation GROUP BY n_regionkey))::DOUBLE AS timeline_pct, (100.0 * (5 + count(*) FILTER (WHERE n_nationkey % 6 <> 0)) / (5 + count(*)) >= 70 AND 100.0 * count(*) FILTER (WHERE n_nationkey % 6 <> 0) / count(*) >= 50) AS passed FROM nation")
def gate_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole verification and its gate: regions and nations as the reference, a graph without each sixth nation."""
    named = lambda df, p: df.select(F.concat(F.lit(p), f"{p}_key").alias("id"), F.substring(F.sha2(F.concat(F.lit(p), F.col(f"{p}_key").cast("string")), 256), 1, 16).alias("name"))
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n_key"), F.col("n_regionkey").alias("r_key"))
    e = named(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("r_key")), "r").union(named(nation, "n"))
    links = nation.select(F.concat(F.lit("r"), "r_key").alias("parent_id"), F.concat(F.lit("n"), "n_key").alias("child_id"), F.lit(2).alias("level"), "n_key")
    name = lambda df, id_, out: df.join(e.select(F.col("id").alias(id_), F.col("name").alias(out)), id_)
    there = name(name(links.filter("n_key % 6 <> 0"), "parent_id", "src"), "child_id", "dst")
    edges = there.select("src", "dst", F.lit("a.md").alias("file_path"))
    nodes = e.join(links.filter("n_key % 6 = 0").select(F.col("child_id").alias("id")), "id", "left_anti").select(F.col("name").alias("node_id"), F.lit("a.md").alias("file_path"))
    who = links.select(F.col("parent_id").alias("event_id"), F.col("child_id").alias("entity_id"))
    narrators = spark.createDataFrame([("a.md", "log")], "file string, narrator string")
    return vf.run(e, links.drop("n_key"), who, nodes, edges, narrators).summary


@query("SELECT l_orderkey AS event_id, 1 + count(DISTINCT l_suppkey) AS nodes, true AS is_covered, true AS counted FROM lineitem GROUP BY 1")
def timeline_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as events, the order itself and its suppliers as participants, edges between them."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("o"), "l_orderkey").alias("o"), F.concat(F.lit("s"), "l_suppkey").alias("s"))
    who = li.select(F.col("l_orderkey").alias("event_id"), F.col("o").alias("entity_id")).union(li.select("l_orderkey", "s")).distinct()
    found = who.select("entity_id", F.col("entity_id").alias("node_id")).distinct()
    return vf.timeline(who, found, gr.components(li.select(F.col("o").alias("src"), F.col("s").alias("dst"))))


@query("SELECT source AS narrator, count(DISTINCT doc_id) AS nodes, count(DISTINCT lang) AS edges FROM documents GROUP BY source")
def source_contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as nodes and languages as edges, each with the file that gave it."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.concat(F.lit("/in/"), "source", F.lit(".md")).alias("file_path"))
    nodes = d.select(F.col("doc_id").cast("string").alias("node_id"), "file_path")
    edges = d.select(F.col("lang").alias("src"), F.lit("zz").alias("dst"), "file_path").distinct()
    files = d.select(tx.basename("file_path").alias("file")).distinct().select("file", F.regexp_replace("file", "\\.md$", "").alias("narrator"))
    return vf.contributions(nodes, edges, files)


@query("SELECT source AS narrator, count(*) AS n, round_even(100.0 * count(*) / sum(count(*)) OVER (), 2)::DOUBLE AS pct FROM documents GROUP BY source")
def narrator_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.distribution(table(spark, sf_dir, "documents").select(F.col("source").alias("narrator")))


@query("WITH s(key, share, ord) AS (VALUES ('encyclopedia', 0.3, 0), ('dossier', 0.25, 1), ('propaganda', 0.25, 2), ('log', 0.2, 3)), n AS (SELECT count(*) AS n FROM documents), p AS (SELECT key, ord, round_even(n * share::DOUBLE, 0)::BIGINT AS k, n FROM s, n) SELECT key, CASE WHEN ord = 3 THEN n - (SELECT sum(k) FROM p WHERE ord < 3) ELSE k END::BIGINT AS planned FROM p")
def proportional_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").agg(F.count("*").alias("n"))
    shares = spark.createDataFrame([(k, s, i) for i, (k, s) in enumerate(pl.SHARES)], "key string, share double, ord int")
    return pl.allocate(shares.crossJoin(n), F.col("n"))  # four shares and one count


@query("SELECT p_partkey AS id, row_number() OVER (ORDER BY sha256('42|' || p_partkey), p_partkey)::INT AS doc_num FROM part QUALIFY doc_num <= 24")
def document_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.plan_by_hash(_part_entities(spark, sf_dir), 24)


# --- fuzzy matching ---------------------------------------------------------------------------------------------------


def _block(a: str, b: str, alo: str, ahi: str, blo: str, bhi: str) -> str:
    """SQL: the longest common block of two parts of texts (k signs from i and j), the first of equals."""
    lcp = f"len(list_filter(range(1, least({ahi} - i, {bhi} - j) + 1), lambda l: substr({a}, i + 1, l) = substr({b}, j + 1, l)))"
    each = f"flatten(list_transform(range({alo}, {ahi}), lambda i: list_transform(range({blo}, {bhi}), lambda j: {{'k': {lcp}, 'i': -i, 'j': -j}})))"
    return f"coalesce(list_max({each}), {{'k': 0, 'i': 0, 'j': 0}})"


@query(
    f"""WITH RECURSIVE e AS (SELECT DISTINCT p_name AS id, {NORM.format('p_name')} AS b FROM part),
v AS (SELECT p_name || 's' AS node_id FROM (SELECT DISTINCT p_name FROM part) UNION ALL SELECT reverse(p_name) FROM (SELECT DISTINCT p_name FROM part)),
n AS (SELECT node_id, {NORM.format('node_id')} AS a FROM v),
p AS MATERIALIZED (SELECT DISTINCT a, b FROM n, e WHERE a <> b AND 2.0 * least(length(a), length(b)) / (length(a) + length(b)) >= 0.82),
s AS (SELECT a, b, 0::BIGINT AS alo, length(a) AS ahi, 0::BIGINT AS blo, length(b) AS bhi, {_block('a', 'b', '0', 'length(a)', '0', 'length(b)')} AS m FROM p
  UNION ALL SELECT a, b, c.alo, c.ahi, c.blo, c.bhi, {_block('a', 'b', 'c.alo', 'c.ahi', 'c.blo', 'c.bhi')} FROM (SELECT a, b, unnest([{{'alo': alo, 'ahi': -m.i, 'blo': blo, 'bhi': -m.j}}, {{'alo': m.k - m.i, 'ahi': ahi, 'blo': m.k - m.j, 'bhi': bhi}}]) AS c FROM s WHERE m.k > 0)),
r AS (SELECT a, b, 2.0 * sum(m.k) / (length(a) + length(b)) AS ratio FROM s GROUP BY a, b),
q AS (SELECT e.id, n.node_id, CASE WHEN n.a = e.b THEN 1.0 WHEN ((length(e.b) >= 6 AND contains(n.a, e.b)) OR (length(n.a) >= 6 AND contains(e.b, n.a))) AND least(length(n.a), length(e.b)) / greatest(length(n.a), length(e.b)) >= 0.7 THEN 0.9 WHEN r.ratio >= 0.82 THEN r.ratio END::DOUBLE AS score FROM n, e LEFT JOIN r ON r.a = n.a AND r.b = e.b)
SELECT id AS entity_id, node_id, 'canonical' AS matched_by, id AS matched_name, score FROM q WHERE score IS NOT NULL"""
)
def fuzzy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of the part names with their plurals and with themselves backwards."""
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    e = names.select(F.col("p_name").alias("id"), F.col("p_name").alias("name"))
    nodes = names.select(F.concat("p_name", F.lit("s")).alias("node_id")).union(names.select(F.reverse("p_name")))
    return fz.match(en.names(e), nodes)


@query("WITH n AS (SELECT DISTINCT p_name AS a, length(p_name) AS n FROM part) SELECT x.a AS name, count(*) AS candidates FROM n x JOIN n y ON y.n >= ceil(x.n * (0.82 / 1.18) - 1e-9) AND y.n <= floor(x.n / (0.82 / 1.18) + 1e-9) GROUP BY x.a")
def fuzzy_blocking_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many names the length bound lets through for each name."""
    n = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.length("p_name").alias("n")).distinct()
    low = fz.length_bound()
    a = n.select("name", F.explode(F.sequence(F.ceil(F.col("n") * low - 1e-9).cast("int"), F.floor(F.col("n") / low + 1e-9).cast("int"))).alias("n"))
    return a.join(n.select(F.col("name").alias("other"), "n"), "n").groupBy("name").agg(F.count("*").alias("candidates"))


# --- vectors ----------------------------------------------------------------------------------------------------------

_COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: each hundredth vector, held against all."""
    return _vectors(spark, sf_dir).filter("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))


_RANKED = f"(SELECT a.vec_id AS query_id, b.vec_id AS id, round({_COS}, 6) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0)"


@query(f"SELECT query_id, id, score FROM {_RANKED} WHERE rank <= 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vc.top_k(_vectors(spark, sf_dir), _asked(spark, sf_dir), 10).select("query_id", "id", F.round("score", 6).alias("score"))


@query(f"SELECT query_id, id, score, rank::INT AS rank FROM {_RANKED} WHERE rank <= 40")
def vector_topk_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the default number of neighbours, in blocks of queries."""
    return vc.top_k(_vectors(spark, sf_dir), _asked(spark, sf_dir), block_bytes=16_384).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


_KINDS = "CASE WHEN label < 4 THEN 'entity' WHEN label < 7 THEN 'relation' ELSE 'chunk' END"


@query(
    f"""WITH v AS (SELECT vec_id AS id, {_KINDS} AS kind, embedding FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.id, b.kind, {_COS} AS score FROM embeddings a, v b WHERE a.vec_id % 100 = 0),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY score DESC, id) AS r FROM s) WHERE r <= CASE kind WHEN 'chunk' THEN 20 ELSE 40 END),
g AS (SELECT r.id AS rel_id, (SELECT max(e.id) FROM v e WHERE e.kind = 'entity' AND e.id <= r.id) AS src, (SELECT min(e.id) FROM v e WHERE e.kind = 'entity' AND e.id >= r.id) AS dst FROM v r WHERE r.kind = 'relation'),
l AS (SELECT query_id, kind, id, score FROM t WHERE kind = 'entity' UNION ALL SELECT query_id, 'relation', rel_id, score FROM t JOIN g ON t.id = g.src OR t.id = g.dst WHERE kind = 'entity'),
o AS (SELECT query_id, kind, id, score FROM t WHERE kind = 'relation' UNION ALL SELECT query_id, 'entity', unnest([src, dst]), score FROM t JOIN g ON t.id = g.rel_id WHERE kind = 'relation'),
m AS (SELECT 'local' AS mode, * FROM l UNION ALL SELECT 'global', * FROM o UNION ALL SELECT 'hybrid', * FROM l UNION ALL SELECT 'hybrid', * FROM o UNION ALL SELECT 'naive', query_id, kind, id, score FROM t WHERE kind = 'chunk' UNION ALL SELECT 'mix', * FROM l UNION ALL SELECT 'mix', * FROM o UNION ALL SELECT 'mix', query_id, kind, id, score FROM t WHERE kind = 'chunk')
SELECT query_id, mode, kind, id, round(max(score), 6) AS score FROM m WHERE id IS NOT NULL GROUP BY ALL"""
)
def retrieval_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All modes; a relation's ends are the entities with the nearest ids on either side."""
    label = F.col("label")
    v = _vectors(spark, sf_dir).withColumn("kind", F.when(label < 4, "entity").when(label < 7, "relation").otherwise("chunk")).drop("label")
    g = od.nearest(v.select("id", "kind"), "id", F.when(F.col("kind") == "entity", F.col("id")), "src", "dst")
    g = g.filter("kind = 'relation'").select(F.col("id").alias("rel_id"), "src", "dst")
    out = vc.retrieve_all(v, g, _asked(spark, sf_dir), ("local", "global", "hybrid", "naive", "mix", "bypass"))
    return out.filter("id is not null").withColumn("score", F.round("score", 6))


@query("SELECT count(vec_id) AS vectors, count(*) FILTER (WHERE len(embedding) <> 64) AS wrong_dim, count(*) FILTER (WHERE vec_id IS NULL) AS texts_without, count(*) FILTER (WHERE doc_id IS NULL) AS vectors_without FROM embeddings FULL JOIN documents ON vec_id = doc_id")
def embedding_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vc.integrity(_vectors(spark, sf_dir).drop("label"), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), 64)


# --- limits and streams -----------------------------------------------------------------------------------------------


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("request_id"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))


@query("SELECT user_id AS key, event_id AS request_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS in_window FROM (SELECT user_id, event_id, date_trunc('second', ts) AS ts FROM events)")
def sliding_admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.trailing_counts(_requests(spark, sf_dir), 3600).select("key", "request_id", "in_window")


@query(
    """WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_id, epoch(date_trunc('second', ts))::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts)), event_id) AS n FROM events),
a(user_id, n, held) AS (SELECT user_id, n, [t] FROM e WHERE n = 1
  UNION ALL SELECT user_id, n, list_slice(held || [CASE WHEN len(held) >= 3 AND now - held[-3] < 3600.0::DOUBLE THEN held[-3] + 3600.0::DOUBLE + 0.05::DOUBLE ELSE now END], -3, -1) FROM (SELECT a.user_id, e.n, held, greatest(held[-1], e.t) AS now FROM a JOIN e ON e.user_id = a.user_id AND e.n = a.n + 1))
SELECT user_id AS key, event_id AS request_id, t AS at, held[-1] AS admitted, held[-1] - t AS waited FROM a JOIN e USING (user_id, n)"""
)
def rate_limiter_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three requests an hour for each user."""
    return lm.admissions(_requests(spark, sf_dir), 3, 3600.0)


@query("SELECT c AS code, a::BIGINT AS attempt, CASE WHEN (c = 429 OR c >= 500) AND a < 4 THEN 2.0 ** (a + 1) END::DOUBLE AS wait FROM (SELECT unnest([400, 404, 429, 500, 503])) t(c), range(6) r(a)")
def retry_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.range(6).select(F.col("id").alias("attempt"), F.explode(F.array(*[F.lit(c) for c in (400, 404, 429, 500, 503)])).alias("code"))
    return t.select("code", "attempt", tx.retry_wait(F.col("code"), F.col("attempt")).alias("wait"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at, props LIKE '%1%' OR event_type = 'error' AS extraction FROM events")
def call_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls of a provider: when, and whether they extract records (asked for, or by the prompt's heading)."""
    e = table(spark, sf_dir, "events")
    prompt = F.when(F.col("event_type") == "error", F.concat(F.lit("x ---Input Text--- "), "props")).otherwise(F.col("props"))
    return e.select("event_id", tx.utc_iso(F.col("ts").cast("timestamp")).alias("at"), tx.is_extraction(prompt, F.contains("props", F.lit("1"))).alias("extraction"))


@query("SELECT event_id, 'v' || value AS temperature, 2::BIGINT AS options FROM events")
def provider_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options of calls, cut down to those that a provider takes."""
    e = table(spark, sf_dir, "events").select("event_id", F.create_map(F.lit("temperature"), F.concat(F.lit("v"), F.col("value").cast("string")), F.lit("model"), F.col("event_type"), F.lit("secret"), F.col("props")).alias("o"))
    return e.withColumn("o", tx.allowed("o", ["temperature", "model"])).select("event_id", F.col("o")["temperature"].alias("temperature"), F.size("o").cast("long").alias("options"))


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS answer FROM conversations GROUP BY conv_id")
def streamed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as chunks of a streamed answer, put together."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(tx.joined_chunks(F.col("text"), F.col("turn")).alias("answer"))


@query("SELECT vec_id AS id, len(embedding)::BIGINT AS dim, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings")
def stacked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir).select("id", F.array("embedding").alias("matrix"))
    v = vc.stacked(rows, 64)
    return v.select("id", F.size("embedding").cast("long").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("total"))


@query("SELECT DISTINCT 'src/m' || doc_id || '.py' AS file, 'm' || (doc_id % 7 * 1000003) AS module FROM documents WHERE 'm' || (doc_id % 7 * 1000003) NOT IN (SELECT 'm' || doc_id FROM documents)")
def missing_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that import a known module, one beside them, and one that may be missing."""
    d = table(spark, sf_dir, "documents")
    text = F.concat(F.lit("import os\nfrom m"), (F.col("doc_id") % 7 * 1_000_003).cast("string"), F.lit(" import x\n"))
    return gt.missing_modules(d.select(F.concat(F.lit("src/m"), F.col("doc_id").cast("string"), F.lit(".py")).alias("file"), text.alias("text")), ["os"])


@query()
def holdout_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The holdout by the seeded generator, bit by bit; tested against a plain version."""
    return en.choose_holdout(_part_entities(spark, sf_dir).select(F.col("id").cast("string").alias("id"), "name"))


@query()
def document_plan_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus plan by the seeded generator over nations and the events of their regions; tested against a plain
    version."""
    nation = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # a few rows by nature
    events = sorted({r["n_regionkey"] for r in nation})
    return pl.plan(spark, [(f"n{r['n_nationkey']}", r["n_name"]) for r in nation], [(f"v{k}", [f"n{r['n_nationkey']}" for r in nation if r["n_regionkey"] == k]) for k in events])


@query("SELECT 'n' || c_nationkey AS parent_id, 'c' || c_custkey AS child_id FROM customer WHERE c_custkey % 10 <> 0 AND c_nationkey % 4 <> 1")
def split_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of a split that withholds each tenth customer and some nations: those that touch no withheld end."""
    c = table(spark, sf_dir, "customer")
    links = c.select(F.concat(F.lit("n"), "c_nationkey").alias("parent_id"), F.concat(F.lit("c"), "c_custkey").alias("child_id"))
    e = links.select(F.col("child_id").alias("id")).union(table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey")))
    number = F.substring("id", 2, 20).cast("int")
    held = e.filter(F.when(F.col("id").startswith("c"), number % 10 == 0).otherwise(number % 4 == 1))
    return en.split(e, held, links)[2]


@query("SELECT strftime(ts, '%Y-%m-%d') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = st.windowed_counts(table(spark, sf_dir, "events"))
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT doc_id, sha256(text) AS sha FROM documents")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents read as a stream of files; the ledger that the stream leaves."""
    import uuid

    from kgaudit.session import shared_dir

    base = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    one = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    one.write.parquet(f"{base}/in")
    st.ingest(spark, f"{base}/in", one.schema, f"{base}/ledger", f"{base}/state", lambda df, n: df.write.mode("overwrite").format("noop").save()).awaitTermination()
    return spark.read.schema("id long, sha string").parquet(f"{base}/ledger/*").select(F.col("id").alias("doc_id"), "sha")
