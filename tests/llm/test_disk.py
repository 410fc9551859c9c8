"""What operators leave on disk while they run, and what crowds of lines cost."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from floodsift import session
from floodsift.llm import jaccard, lines


def shuffle_files(spark):
    """Files of shuffles in the folders of the session's block managers."""
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    names = [n for at in folders for _, _, found in os.walk(at.getPath()) for n in found]
    return {n for n in names if n.startswith("shuffle_") and n.endswith(".data")}


@pytest.mark.parametrize("keep", [session.stage, session.settle])
def test_shuffles_go_when_a_table_is_written(spark, keep):
    before, was = shuffle_files(spark), spark.conf.get(session.CLEANUP)
    table = keep(spark.range(5000).groupBy((F.col("id") % 700).alias("k")).count())
    for _ in range(50):  # files are removed by messages to the executors
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffle_files(spark) <= before
    assert table.count() == 700 and spark.conf.get(session.CLEANUP) == was


def test_released_tables_are_gone(spark):
    a, b = session.stage(spark.range(5)), session.stage(spark.range(7))
    session.release(a)
    assert not os.path.exists(a._staged_at) and os.path.exists(b._staged_at) and b.count() == 7


@pytest.fixture
def staged_now(monkeypatch):
    """The staged tables that were not released yet, and the columns of all."""
    left, columns = [], []

    def stage(df):
        left.append(session.stage(df))
        columns.append(df.columns)
        return left[-1]

    def release(*tables):
        session.release(*tables)
        left[:] = [t for t in left if not any(t is x for x in tables)]

    for module in (lines, jaccard):
        monkeypatch.setattr(module, "stage", stage)
        monkeypatch.setattr(module, "release", release)
    return left, columns


def test_sets_and_their_shingles_do_not_stay(spark, staged_now):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(90)) for _ in range(40)) for _ in range(30)]
    texts += [t + " end" for t in texts[:10]]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = {r["id"]: r["component_id"] for r in jaccard.near_duplicates(docs, "id", 5).collect()}
    assert found == {k: k - 30 if k >= 30 else k for k in range(40)}
    assert not any({"head", "set", "bits"} & set(t.columns) for t in staged_now[0])


def crowd(count):
    """Long lines with one beginning, each with a few words of its own; every fourth is near the one before it."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rest, found = [word() for _ in range(24)], []
    for k in range(count):
        own = list(rest)
        for at in rng.sample(range(24), 5):
            own[at] = "".join(sorted(own[at], key=lambda _: rng.random()))
        found.append("the same beginning of every line of it " + " ".join(own))
        if k % 4 == 3:
            found[-1] = found[-2][:-9] + found[-2][-8:]
    return found


@pytest.mark.parametrize("most", [0, lines.CROWDED_PAIRS])
def test_crowds_that_are_partitioned_or_met_as_they_are(spark, monkeypatch, staged_now, most):
    monkeypatch.setattr(lines, "CROWD", 8)
    monkeypatch.setattr(lines, "CROWDED_PAIRS", most)
    monkeypatch.setattr(lines, "PAIRS_A_TASK", 10)
    docs = spark.createDataFrame(list(enumerate(crowd(120))), "doc_id long, text string")
    got = {r["key"] for r in lines.removed_lines(docs).collect()}
    near = F.levenshtein(F.col("x.text"), F.col("y.text")) <= 2
    pairs = docs.alias("x").join(docs.alias("y"), (F.col("x.doc_id") < F.col("y.doc_id")) & near)
    assert got == {r["doc_id"] for r in pairs.select("y.doc_id").distinct().collect()} and len(got) >= 30
    # Few pairs are worth no level of partitioning, which would stage the crowd's rows with their heads.
    assert any("head" in c for c in staged_now[1]) == (most == 0)


def test_lines_that_differ_in_many_places_are_not_verified(spark, monkeypatch):
    texts = sorted(set(crowd(100)))
    table = spark.createDataFrame([(x,) for x in texts], "line string").withColumn("h", F.xxhash64("line"))
    near = F.levenshtein(F.col("x.line"), F.col("y.line")) <= 2
    wanted = table.alias("x").join(table.alias("y"), (F.col("x.h") < F.col("y.h")) & near).count()
    seen = []
    monkeypatch.setattr(lines, "stage", lambda df: seen.append(session.stage(df)) or seen[-1])
    assert lines.near_pairs(table).count() == wanted
    assert sum(t.count() for t in seen if "line_b" in t.columns) <= 2 * wanted


@pytest.mark.parametrize("letters", ["abcd ", "abcdé "])
def test_segments_of_near_lines_are_met(spark, letters):
    rng, rows = random.Random(5), []
    for k in range(1500):
        y = x = "".join(rng.choice(letters) for _ in range(rng.randint(3, 60)))
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(y))
            y = y[:at] + rng.choice(["", rng.choice(letters)]) + y[at + rng.randint(0, 1) :]
        rows.append((x, y, 1 + k % 2))
    table = spark.createDataFrame(rows, "a string, b string, edits int")
    met = lines.segments_met(F.col("a"), F.col("b"), F.col("edits"), 2)
    near = F.levenshtein("a", "b") <= F.col("edits")
    assert table.where(near & ~met).isEmpty() and not table.where(~met).isEmpty()
