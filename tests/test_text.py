import pytest
from pyspark.sql import functions as F

from kgaudit.functions import text as tx


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("text,want", [("Ab-Ç Привет, мир_1!", "ab ç привет мир_1"), (None, ""), ("  ", "")])
def test_normalize(spark, text, want):
    assert one(spark, text, tx.normalize) == want


@pytest.mark.parametrize("text,want", [("Iron Forge Citadel", "iron-forge-citadel"), ("Дом", "entity"), (None, "entity"), ("--a--", "a"), ("x" * 29 + " yz", "x" * 29)])
def test_slug(spark, text, want):
    assert one(spark, text, tx.slug) == want


@pytest.mark.parametrize("a,b,want", [("a<SEP>b", "b<SEP> c <SEP>", "a<SEP>b<SEP>c"), (None, "x", "x"), ("", "", "")])
def test_merge_packed(spark, a, b, want):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(tx.merge_packed("a", "b").alias("y")).first()["y"] == want


def test_longest_block_is_the_first_of_equals(spark):
    assert one(spark, "```python\nab\n```\n```\ncd\n```", tx.longest_block) == "ab\n"
    assert one(spark, "```\na\n```x```py\nabc\n```", tx.longest_block) == "abc\n"
    assert one(spark, "none", tx.longest_block) is None


def test_clean_markdown(spark):
    assert one(spark, "```markdown\n---\nk: v\n---\nBody\n```", tx.clean_markdown) == "Body"
    assert one(spark, "  Body  ", tx.clean_markdown) == "Body"


def test_narrator(spark):
    doc = "---\ndoc_id: 1\nnarrator: 'log'\n---\nnarrator: other"
    assert one(spark, doc, tx.narrator) == "log"
    assert one(spark, "no block\nnarrator: log", tx.narrator) == "unknown"
    assert one(spark, "---\nnarrator: dossier\n---", tx.narrator_in_head) == "dossier"


def test_frontmatter_round_trip(spark):
    block = spark.range(1).select(tx.frontmatter(F.lit("1"), F.lit("log"), F.array(F.lit("e1"), F.lit("e2")), F.array().cast("array<string>"), F.lit("2026-01-01T00:00:00Z")).alias("b"))
    text = block.first()["b"]
    assert text == "---\ndoc_id: 1\nnarrator: log\nsubject_entity_ids:\n  - e1\n  - e2\nsource_event_ids: []\ngenerated_at: '2026-01-01T00:00:00Z'\n---"
    assert one(spark, text, tx.narrator) == "log"


def test_designations_need_whole_words(spark):
    assert one(spark, "encoded and well-known; callsign: X-1 of AB-Zed", tx.designations) == ["X-1", "AB-Zed"]


def test_lines(spark):
    assert one(spark, "a\r\nb\x85c d\n", tx.lines) == ["a", "b", "c", "d"]


def test_input_section(spark):
    assert one(spark, "---Input Text---\n```\nhello\n```", tx.input_section) == "hello\n"


@pytest.mark.parametrize("message,attempt,want", [("'retryDelay': '7.5s'", 0, 8.5), (None, 0, 2.0), (None, 4, 32.0), ("x", 5, 60.0)])
def test_retry_delay(spark, message, attempt, want):
    df = spark.createDataFrame([(message, attempt)], "m string, a int")
    assert df.select(tx.retry_delay(F.col("m"), F.col("a")).alias("y")).first()["y"] == want


def test_percent_rounds_halves_to_even(spark):
    rows = spark.createDataFrame([(1, 800), (0, 0), (3, 800)], "a int, b int").select(tx.percent(F.col("a"), F.col("b")).alias("y")).collect()
    assert [r["y"] for r in rows] == [0.12, 0.0, 0.38]


def test_structural_name(spark):
    df = spark.createDataFrame([("n", "t", None), ("n", None, None)], "n string, t string, o string")
    assert [r[0] for r in df.select(tx.structural_name(F.col("n"), F.col("t"), F.col("o"))).collect()] == ["n (t)", "n"]
