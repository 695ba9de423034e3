import re
import zlib

import numpy as np
import pytest

from kgaudit.llm import bpe, line_dedup, mixing, ngram_join, toxicity


def plain_targets(sizes):
    names = sorted(k for k in sizes if k is not None) + [None] * (None in sizes)
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    out, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        share = {k: left * weight[k] / sum(weight[x] for x in free) for k in free}
        over = [k for k in free if share[k] > 3 * sizes[k] + 1e-9]
        if not over:
            return out | share
        for k in over:
            out[k] = 3.0 * sizes[k]
            left -= out[k]
            free.discard(k)
    return out


CASES = [
    {"a": [100] * 30, "b": [7] * 50, "c": [1000], "d": [3, 500], None: [10] * 40, "é": [1]},
    {"a": [5], "b": [1] * 1000},
    {"only": [10, 20, 30]},
    {f"s{k}": [k + 1] * 5 for k in range(17)},
]


@pytest.mark.parametrize("case", CASES)
def test_mix(spark, case):
    rows, i = [], 0
    for source, sizes in case.items():
        for n in sizes:
            rows.append((i, "w " * n, source))
            i += 1
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.taken(df).collect()
    where = {r[0]: r[2] for r in rows}
    want = plain_targets({k: sum(v) for k, v in case.items()})
    for s in case:
        own = [r for r in got if where[r["doc_id"]] == s]
        assert all(abs(r["target"] - want[s]) < 1e-6 and r["source_size"] == sum(case[s]) for r in own)
        assert want[s] - 1 <= sum(r["taken"] for r in own) <= want[s] + 1e-6
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    again = {(r["doc_id"], r["taken"]) for r in mixing.taken(df.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in got}
    copies = mixing.copies(df).collect()
    assert sum(r["words"] for r in copies) == sum(r["taken"] for r in got)
    assert [r["finish"] for r in copies] == sorted(r["finish"] for r in copies)
    assert mixing.mixed(df).columns == df.columns


def test_mix_edge_cases(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, "y"), (3, "", None), (None, "w " * 50, None), (4, "q\x0b\xa0r", "z")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, source string, cut int")
    got = mixing.taken(df).collect()
    assert len(got) == 6 and {(r["doc_id"], r["size"]) for r in got} == {(1, 3), (2, 0), (3, 0), (None, 50), (4, 2)}
    assert mixing.taken(df.limit(0)).count() == 0 and mixing.mixed(df.limit(0)).count() == 0
    assert not any(r["size"] and r["taken"] > 3 * r["size"] for r in got)


def test_mix_of_null_and_repeated_ids(spark):
    rows = [(None, f"w{k} " * (1 + k % 7), "hot") for k in range(300)] + [(7, "same text here", "hot")] * 200 + [(8 + k, "a b", "cold") for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.taken(df).collect()
    want = plain_targets({s: sum(len(t.split()) for _, t, x in rows if x == s) for s in ("hot", "cold")})
    for s, size in (("hot", None), ("cold", 2)):
        own = [r for r in got if (r["source_size"] == 40) == (s == "cold")]
        assert want[s] - 1 <= sum(r["taken"] for r in own) <= want[s] + 1e-6 and all(r["taken"] <= 3 * r["size"] for r in own)
    assert len({r["finish"] for r in got if r["doc_id"] is None}) == 300  # no two share a place
    again = mixing.mixed(df.repartition(9))
    words = sum(len(r["text"].split()) for r in again.collect())
    assert abs(words - sum(r["taken"] for r in got)) <= 2 * 7


def test_the_budget_cuts_the_queue(spark):
    """Before the cut lie all copies that end by virtual time one, and the running total ends at the budget."""
    rows = [(i, "w " * (1 + i % 9), "abc"[i % 3]) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    q, end = mixing._queued(df, 3, 7, "doc_id", "text", "source")
    q = q.collect()
    all_copies = sorted(((r["before"] + k * r["source_size"] + r["size"]) / r["target"], r["row"], k, r["size"]) for r in q for k in range(3))
    budget, total, want = sum({r["source"]: int(r["target"]) for r in q}.values()), 0, 0.0
    for finish, _, _, size in all_copies:
        if total >= budget:
            break
        total, want = total + size, finish
    assert end == want >= 1.0


def test_mix_of_very_long_texts(spark):
    rows = [(1, "w " * 400_000, "a"), (2, "x y z", "a"), (3, "q " * 300_000, "b"), (4, None, "b")]
    got = {r["doc_id"]: r for r in mixing.taken(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert [got[k]["size"] for k in (1, 2, 3, 4)] == [400_000, 3, 300_000, 0]
    for source in ((1, 2), (3, 4)):
        own = [got[k] for k in source]
        assert own[0]["target"] - 1 <= sum(r["taken"] for r in own) <= own[0]["target"] + 1e-6


def labelled(n=900, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words = [f"w{k}" for k in rng.integers(0, 300, 30)]
        insult, group = rng.random() < 0.4, rng.random() < 0.4
        if insult:
            words[3] = "dolt"
        if group:
            words[20] = "martians"
        rows.append((i, " ".join(words), int(insult and group)))
    return rows


def test_pairs_of_terms_are_learnt(spark):
    """Toxic is the insult together with the group; neither is alone."""
    rows = labelled()
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t, _ in rows], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in rows)
    assert np.mean([got[i]["predicted"] == y for i, y in held]) > 0.93
    lone = toxicity.FactorizationMachine(model.bias, model.weights, np.zeros_like(model.vectors), model.bits)
    cache = toxicity._Terms(model.bits)
    margin = lambda m, t: m.margin(toxicity.terms(t, cache))
    both = lambda m: margin(m, "dolt martians") - margin(m, "dolt") - margin(m, "martians") + margin(m, "x")
    assert both(model) > both(lone) + 0.1


def test_the_margin_is_the_sum_over_all_pairs():
    rng = np.random.default_rng(5)
    m = toxicity.FactorizationMachine(0.3, rng.normal(size=64), rng.normal(size=(64, 4)), 6)
    for size in (0, 1, 2, 40):
        x = np.sort(rng.choice(64, size, replace=False))
        pairs = sum(float(m.vectors[a] @ m.vectors[b]) for i, a in enumerate(x) for b in x[i + 1 :])
        assert abs(m.margin(x) - (0.3 + m.weights[x].sum() + pairs)) < 1e-9


@pytest.mark.parametrize("op", [lambda a, b: a != b, lambda a, b: a and b, lambda a, b: not (a or b)])
def test_interactions_of_terms_that_say_nothing_alone(op):
    cache = toxicity._Terms(18)

    def rows(n, seed):
        rng, x, y = np.random.default_rng(seed), [], []
        for _ in range(n):
            words = [f"w{k}" for k in rng.integers(0, 300, 30)]
            a, b = rng.random() < 0.5, rng.random() < 0.5
            words += ["dolt"] * a + ["martians"] * b
            x.append(toxicity.terms(" ".join(words), cache))
            y.append(float(op(a, b)))
        return x, np.array(y)

    model = toxicity.fit(*rows(3000, 1))
    held = rows(600, 2)
    assert np.mean([(model.score(x) >= 0.5) == y for x, y in zip(*held, strict=True)]) > 0.9


def test_repeated_ids_are_learnt_once(spark):
    rows = labelled(300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(rows[1][0], "z y x")] * 500 + [(rows[1][0], rows[1][1])] * 500, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(rows[1][0], None), (None, 1)], "doc_id long, toxic int")
    a, b = toxicity.train(docs, labels), toxicity.train(docs.repartition(5), labels)
    assert a.bias == b.bias and (a.weights == b.weights).all()


def test_very_long_texts_are_scored_whole(spark):
    rows = labelled(600)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    long = " ".join(f"q{k}" for k in range(300_000))
    some = spark.createDataFrame([(1, long), (2, "dolt " + long + " martians")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(some, model).collect()}
    assert got[2] > got[1] + 0.1


def test_held_out_accuracy_on_the_test_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    some = docs.join(labels.select("doc_id"), "doc_id")
    got = {r["doc_id"]: r for r in toxicity.score(some, toxicity.train(docs, labels)).collect()}
    held = [(got[r["doc_id"]], r["toxic"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    hits = sum(r["predicted"] for r, y in held if y)
    assert hits / sum(y for _, y in held) > 0.8 and sum(r["predicted"] for r, y in held if not y) <= 0.01 * len(held)


def test_toxicity_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 0), (None, "dolt", 0), (2, "", 0), (2, "", 0)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, none)
    got = toxicity.score(docs, model).collect()
    assert len(got) == 4 and all(0 <= r["score"] < 0.5 and r["predicted"] == 0 for r in got)
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [True]
    assert toxicity.keep_clean(docs, model).count() == 4 and toxicity.score(docs.limit(0), model).count() == 0


def test_pipeline_stage_by_stage(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in p.STAGES]
    assert names == ["toxicity", "line_dedup", "ngram_join", "mixing", "bpe"]
    from kgaudit.session import materialize

    kept = materialize(p.drop_toxic(spark, docs, sf))
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert kept.exceptAll(docs).count() == 0
    lines = materialize(p.drop_lines(spark, kept, sf))
    assert lines.columns == docs.columns and lines.count() == kept.count()
    assert lines.filter("n_chars <> length(text)").count() == 0
    want = line_dedup.dedup(kept).select("doc_id", "text")
    assert want.exceptAll(lines.select("doc_id", "text")).count() == 0
    one = materialize(p.drop_near_copies(spark, lines, sf))
    classes = ngram_join.join(lines).select("class_id").distinct()
    assert {r[0] for r in one.select("doc_id").collect()} == {r[0] for r in classes.collect()} and one.count() == classes.count()
    mix = materialize(p.mix_sources(spark, one, sf))
    taken = {r["doc_id"]: r for r in mixing.taken(one).collect()}
    times = {r["doc_id"]: r["count"] for r in mix.groupBy("doc_id").count().collect()}
    assert all(abs(times.get(i, 0) * r["size"] - r["taken"]) <= r["size"] / 2 for i, r in taken.items() if r["size"])
    last = p.tokenise(spark, mix, sf)
    assert last.count() == mix.count()
    assert last.exceptAll(bpe.round_trip(mix)).count() == 0
    text = {r["doc_id"]: r["text"] for r in mix.collect()}
    assert sum(len(re.findall(r"\S+", t)) for t in text.values()) > 0


def test_pipeline_runs_whole(spark, sf):
    import corpus_pipeline as p

    assert p.run(spark, sf).count() > 0 and p.ORACLE_SQL is None


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls in any column, empty texts, repeated rows and ties: each stage keeps all columns, clean documents stay."""
    import corpus_pipeline as p

    rows = [(i, f"plain document number {i} about w{i} and v{i}\na line that many share, word for word", "en", "ab"[i % 2], 60) for i in range(12)]
    rows += [(None, "no id here at all", None, None, None), (None, None, "en", "a", 0), (20, "", None, "b", 0), (21, None, "fr", None, None)]
    rows += [(22, "twice the same row", "en", "a", 18)] * 3 + [(23, "twice the same row", "en", "b", 18), (24, "z" * 300_000, "en", "a", 300_000)]
    spark.createDataFrame(rows, DOCUMENTS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0), (1, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    more = docs.selectExpr("*", "1 row", "2 part", "'x' key", "3 size", "4 n_lines", "5 label", "6 line", "7 component")
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, more, str(tmp_path))
        assert out.columns == more.columns, name
        assert out.select("row", "n_lines", "key").distinct().collect() == [(1, 4, "x")], name
    kept = {r["text"] for r in p.drop_near_copies(spark, p.drop_toxic(spark, docs, str(tmp_path)), str(tmp_path)).collect()}
    assert {r[1] for r in rows[:12]} <= kept and "twice the same row" in kept
    got = p.run(spark, str(tmp_path)).collect()
    assert got and {r["doc_id"] for r in got} <= {r[0] for r in rows} and all(r["n_tokens"] > 0 for r in got)  # the mix takes some more often, others not at all
    empty = docs.limit(0)
    for name, stage in p.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name


def test_registered():
    import __spark_entry__ as e

    ops = {re.match(r"op\d+", n)[0] for n in e.queries() if n.startswith("op")}
    assert ops == {f"op{k}" for k in range(1, 11)} and "pipeline" in e.queries()
