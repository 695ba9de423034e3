import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgaudit.llm import line_dedup, ngram_join, shingles


def plain_lines(rows, t=0.8):
    """(doc_id, line) to remove, by all earlier lines that share a word of the prefix."""
    lines = sorted((i if i is not None else math.inf, k, frozenset(w)) for i, text in rows for k, line in enumerate((text or "").split("\n")) if (w := line_dedup._words(line)))
    df = collections.Counter(w for *_, s in lines for w in s)
    held, gone = collections.defaultdict(list), set()
    for at, (i, k, s) in enumerate(lines):
        prefix = sorted(s, key=lambda w: (df[w], w))[: len(s) - math.ceil(t * len(s) - 1e-9) + 1]
        if any(len(s & lines[b][2]) >= t * len(s | lines[b][2]) - 1e-9 for w in prefix for b in held[w]):
            gone.add((None if i == math.inf else i, k))
        for w in prefix:
            held[w].append(at)
    return gone


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["é", "a,", "(b)"]
    bank = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 25))] for _ in range(25)]
    rows = []
    for i in range(n):
        lines = []
        for _ in range(rng.randint(0, 8)):
            line = list(rng.choice(bank))
            for _ in range(rng.randint(0, 3)):
                line[rng.randrange(len(line))] = rng.choice(vocabulary)
            lines.append((" " if rng.random() < 0.8 else " \t").join(line).upper() if rng.random() < 0.1 else " ".join(line))
        rows.append((rng.randrange(10**6) * n + i, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("seed,how", [(1, {}), (2, {"listed": 1}), (3, {"listed": 1, "few_lines": 0}), (2, {"listed": 1, "few_lines": 3}), (4, {"bits": 1}), (5, {"bits": 4, "listed": 1}), (6, {"bits": 0})])
def test_lines_against_plain_search(spark, seed, how):
    rows = corpus(seed)
    gone = plain_lines(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in line_dedup.dedup(df, **how).collect()}
    for i, text in rows:
        want = "\n".join(x for k, x in enumerate(text.split("\n")) if (i, k) not in gone)
        assert (got[i]["text"], got[i]["n_removed"]) == (want, sum(g[0] == i for g in gone))


def test_a_line_with_many_false_candidates_still_finds_its_match(spark):
    """Twenty earlier lines pass the filters for one word or another; the match is the last of them."""
    base = [f"x{k}" for k in range(20)]
    rows = [(k, " ".join(base[:16] + [f"y{k}{j}" for j in range(4)])) for k in range(20)]
    rows += [(50, " ".join([*base[:18], "z1", "z2"])), (60, " ".join([*base[:18], "z1", "z3"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"] for r in line_dedup.dedup(df, listed=1).filter("n_removed > 0").collect()}
    assert got == {i for i, _ in plain_lines(rows)}


def test_hashed_words_are_those_of_the_line():
    import numpy as np
    import pyarrow as pa

    texts = ["A b\nc  a\tB\n\n x", None, "", "é ÉÉ\n", "\x1fq\x0bq"]
    h, line, owner, number = line_dedup._hashed(pa.array(texts))
    want = [(d, k, line_dedup._words(x)) for d, t in enumerate(texts) for k, x in enumerate((t or "").split("\n")) if line_dedup._words(x)]
    assert [(int(o), int(n)) for o, n in zip(owner, number, strict=True)] == [(d, k) for d, k, _ in want]
    assert [len(np.unique(h[line == i])) for i in range(len(want))] == [len(w) for *_, w in want]
    assert len(np.unique(h)) == len(set().union(*(w for *_, w in want)))


def test_line_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "a b c d e\nx"), (3, "a b c d e\nx"), (None, "a b c d e"), (4, "A  b c d e\nq"), (5, "a b c d\na b c"), (6, "\n\n"), (7, "k l m n o\nk l m n o"), (8, "Q"), (9, "b c d")]
    df = spark.createDataFrame([(*r, "keep") for r in rows], "doc_id long, text string, pos string")
    got = collections.Counter((r["doc_id"], r["text"], r["n_lines"], r["n_removed"], r["pos"]) for r in line_dedup.dedup(df).collect())
    want = [(1, None, 0, 0), (2, "", 0, 0), (3, "a b c d e\nx", 2, 0), (3, "a b c d e\nx", 2, 0), (None, "", 1, 1), (4, "q", 2, 1), (5, "a b c", 2, 1), (6, "\n\n", 3, 0), (7, "k l m n o", 2, 1), (8, "", 1, 1), (9, "b c d", 1, 0)]
    assert got == collections.Counter((*w, "keep") for w in want)
    assert line_dedup.dedup(df.limit(0)).count() == 0


def test_repeated_rows_in_many_partitions_are_one_document(spark):
    rows = [(3, "a b c d e f\nx y z")] * 40 + [(4, "x y z\nnew words here")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = collections.Counter((r["doc_id"], r["text"], r["n_removed"]) for r in line_dedup.dedup(df).collect())
    assert got == {(3, "a b c d e f\nx y z", 0): 40, (4, "new words here", 1): 40}


def test_zero_characters_are_white_space(spark):
    rows = [(1, "a\0b c d e"), (2, "\0\0"), (3, "first\0\nb a\0c  e d"), (4, "q\0\nr\ns"), (5, "r")]
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("a\0b c d e", 0), 2: ("\0\0", 0), 3: ("first\0", 1), 4: ("q\0\nr\ns", 0), 5: ("", 1)}


def test_columns_of_the_same_names(spark):
    df = spark.createDataFrame([(1, "a b", 7, 8, 9), (2, "a b\nc", 7, 8, 9)], "doc_id long, text string, n_lines int, doc int, line int")
    out = line_dedup.dedup(df)
    assert out.columns == ["doc_id", "text", "doc", "line", "n_lines", "n_removed"]
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a b", 8, 9, 1, 0), (2, "c", 8, 9, 2, 1)]


def test_very_long_line(spark):
    rng = random.Random(3)
    a = [f"word{rng.randrange(150_000)}" for _ in range(2_000_000)]
    b = a[:-1000] + [f"new{k}" for k in range(1000)]
    assert len(" ".join(a)) > 20_000_000
    rows = [(1, "short\n" + " ".join(a)), (2, " ".join(b) + "\nshort\ntail")]
    got = {r["doc_id"]: (r["text"][-4:], r["n_removed"], len(r["text"])) for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1][1:] == (0, len(rows[0][1])) and got[2] == ("tail", 2, 4)


def test_word_hashes_do_not_depend_on_chunks(monkeypatch):
    import numpy as np
    import pyarrow as pa

    texts = pa.array(["one two  three\nfour " + "x" * 50, "two three"])
    whole = line_dedup._hashed(texts)[0]
    monkeypatch.setattr(line_dedup, "_HASHED", 4)
    assert (line_dedup._hashed(texts)[0] == whole).all() and len(np.unique(whole)) == 5


def grams(text):
    w = re.findall(r"\w+", (text or "").lower())
    k = min(5, len(w))
    return frozenset(tuple(w[a : a + k]) for a in range(len(w) - k + 1)) if w else frozenset()


def plain_join(rows, t=0.8):
    sets = [grams(x) for _, x in rows]
    near = [[a != b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9 and len(sets[a] | sets[b]) > 0) for b in range(len(rows))] for a in range(len(rows))]
    label = list(range(len(rows)))
    for _ in rows:
        label = [min([label[a], *(label[b] for b in range(len(rows)) if near[a][b])]) for a in range(len(rows))]
    ids = lambda c: [rows[k][0] for k in range(len(rows)) if label[k] == c and rows[k][0] is not None]
    return collections.Counter((rows[k][0], min(ids(label[k]), default=None), sum(near[k])) for k in range(len(rows)))


def near_copies(seed):
    rng = random.Random(seed)
    bank = [[f"v{rng.randrange(400)}" for _ in range(rng.randint(1, 160))] for _ in range(12)]
    rows = []
    for i in range(150):
        text = list(rng.choice(bank))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            text[rng.randrange(len(text))] = f"n{rng.randrange(10**6)}"
        rows.append((i * 3, " ".join(text)))
    return rows


@pytest.mark.parametrize("block", [4, 1024])
def test_join_against_all_pairs(spark, block):
    rows = near_copies(7)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = collections.Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.join(df, block=block).collect())
    assert got == plain_join(rows)


def test_join_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "A, b"), (None, "a b"), (4, "q w e r t y"), (5, "q w e r t y u"), (None, "zz"), (6, " ".join(map(str, range(30)))), (7, " ".join(map(str, range(31))))]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, sid int")
    got = collections.Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.join(df).collect())
    assert got == plain_join(rows)
    kept = ngram_join.survivors(df)
    assert kept.columns == df.columns and sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 3, 4, 5, 6]
    assert ngram_join.join(df.limit(0)).count() == 0


def test_unrelated_documents_of_one_id_or_none_survive(spark):
    rows = [(None, "one two three"), (None, "four five six"), (None, "Four, five six"), (8, "a b c d"), (8, "e f g h"), (None, "a b c d"), (9, "k l m n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [(r["doc_id"], r["text"]) for r in ngram_join.survivors(df).collect()]
    assert len(kept) == 5 and {(None, "one two three"), (8, "a b c d"), (8, "e f g h"), (9, "k l m n")} < set(kept)


def test_signs_rule_out_no_match():
    """Pairs around the threshold: the signs let all pairs at or above it through, and few of those far below."""
    import numpy as np

    rng, made = np.random.default_rng(1), ngram_join.MinHash(23, 6)
    seen = {0.8: [], 0.85: [], 0.45: []}
    for j in seen:
        for _ in range(150):
            union = rng.integers(0, 1 << 63, 400, np.uint64)
            both = round(400 * j)
            rest = rng.permutation(400)
            a, b = union[rest[: both + (400 - both) // 2]], np.r_[union[rest[:both]], union[rest[both + (400 - both) // 2 :]]]
            x, y = (np.frombuffer(made.band_hashes(np.unique(s))[1], np.uint8) for s in (a, b))
            p = 0.8 + 0.2 / 256
            seen[j].append((x == y).sum() >= 138 * p - 6 * np.sqrt(138 * p * (1 - p)))
    assert all(seen[0.8]) and all(seen[0.85]) and sum(seen[0.45]) < 10


def test_recall_at_the_threshold(spark):
    """Links of pairs at or a little above the threshold: nearly all are found."""
    rng, rows = random.Random(4), []
    for k in range(150):
        base = [f"b{k}x{i}" for i in range(100)]
        other = list(base)
        for at in rng.sample(range(2, 98, 8), 2):
            other[at] = f"n{rng.randrange(10**9)}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    want = plain_join(rows)
    got = {r["doc_id"]: r["n_links"] for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = [i for i, _, n in want if n]
    assert len(linked) > 200 and sum(got[i] == 1 for i in linked) >= 0.98 * len(linked)
    assert all(got[i] <= n for i, _, n in want)


def test_join_of_very_long_and_hot_texts(spark):
    rng = random.Random(6)
    long = [f"w{rng.randrange(10**6)}" for _ in range(200_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:-100])), (3, " ".join(long[:100_000]))]
    rows += [(10 + k, " ".join([f"hot{i}" for i in range(60)] + [f"t{k}"])) for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = collections.Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.join(df, block=16).collect())
    assert got == collections.Counter([(1, 1, 1), (2, 1, 1), (3, 3, 0), *((10 + k, 10, 79) for k in range(80))])


def test_bands_reach_the_recall():
    bands, rows = ngram_join.bands_for(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands * rows <= 144 and rows > 1


def test_bitmap_sends_a_part_once_a_task(spark):
    """Ids that come in many batches are gathered before they are dealt out."""
    ids = np.arange(40_000, dtype=np.int64) * 7919 * 65_521
    rows = spark.range(0, 40_000, 1, 1).select((F.col("id") * 7919 * 65_521).alias("x"))
    bits = shingles.bitmap(rows, lambda b: b.column(0).to_numpy())
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    run = max(store.executionsList().apply(i).executionId() for i in range(store.executionsList().size()))
    values, sent = store.executionMetrics(run), []
    nodes = store.planGraph(run).allNodes()
    for metrics in (nodes.apply(i).metrics() for i in range(nodes.size())):
        sent += [int(values.get(m.accumulatorId()).get().replace(",", "")) for m in (metrics.apply(i) for i in range(metrics.size())) if m.name() == "shuffle records written" and values.get(m.accumulatorId()).isDefined()]
    assert 0 < max(sent) <= shingles.BITS >> 16  # 20 times that with a row for each batch and part
    assert shingles.hits(bits.value, ids).all() and int(np.unpackbits(bits.value).sum()) == len(np.unique(ids & (shingles.BITS - 1)))
    bits.destroy()
