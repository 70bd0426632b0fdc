"""Buckets that are cut into tiles give the same near-duplicates as the sequential scan."""

import random

import pytest
from pyspark.sql import functions as F

from pactlens.operators import dedup
from test_operators import brute_keep_first


def boilerplate_texts(count, own, seed=5):
    """Texts that share a long passage and little else, some of them near copies of others."""
    rng = random.Random(seed)
    passage = " ".join(f"shared{i}" for i in range(44))
    texts = []
    for i in range(count):
        if texts and rng.random() < 0.15:
            texts.append(rng.choice(texts) + rng.choice(["", " more"]))
        else:
            texts.append(passage + " " + " ".join(f"own{i}x{j}" for j in range(own + i % 3)))
    return texts


@pytest.mark.parametrize("tile", [2, 7, 4096])
def test_tiles_equal_the_scan(spark, monkeypatch, tile):
    monkeypatch.setattr(dedup, "TILE_ROWS", tile)
    monkeypatch.setattr(dedup, "LEADER_ROUNDS", 1)
    texts = boilerplate_texts(120, 5)
    kept, gone = brute_keep_first(texts)
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    assert {r["id"]: r["keeper_id"] for r in dedup.near_duplicates(rows).collect()} == gone
    assert sorted(r["id"] for r in dedup.keep_first(rows).collect()) == kept


def members_of(spark, count, size):
    bits = F.struct(*[F.xxhash64(F.lit(k), "id").alias(f"w{k}") for k in range(dedup.BITMAP_WORDS)])
    return spark.range(count).select(F.lit(7).cast("long").alias("token"), "id", size(F.col("id")).cast("int").alias("n"),
                                     F.lit(0).alias("place"), F.lit(True).alias("indexes"), bits.alias("bits"))


def test_tiles_are_bounded_and_ordered_by_size(spark):
    for size in (lambda i: F.lit(50), lambda i: i % 200 + 1, lambda i: F.when(i % 3 == 0, 50).otherwise(i % 900 + 20)):
        tiled = dedup.tiles_of(members_of(spark, 20_000, size), 500).groupBy("tile").agg(
            F.count("*").alias("c"), F.min("n").alias("low"), F.max("n").alias("high")).orderBy("tile").collect()
        assert sum(r["c"] for r in tiled) == 20_000 and max(r["c"] for r in tiled) <= 3 * 500
        assert all(a["high"] <= b["low"] for a, b in zip(tiled, tiled[1:]))


def test_a_bucket_of_unlike_rows_meets_in_bounded_tasks(spark):
    """Each pair of tiles is a key of its own, and tiles of too unlike sizes never meet."""
    members = members_of(spark, 6_000, lambda i: i % 400 + 20)
    assert dedup._meet_in_tiles(members, 0.85, 500).count() == 0
    plan = dedup._meet_in_tiles(members, 0.85, 500)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "Cross" not in plan
    same = members.withColumn("bits", F.struct(*[F.lit(0).cast("long").alias(f"w{k}") for k in range(dedup.BITMAP_WORDS)]))
    got = dedup._meet_in_tiles(same, 0.85, 500).count()
    sizes = [i % 400 + 20 for i in range(6_000)]
    counts = [sizes.count(n) for n in range(20, 420)]
    near = sum(counts[a] * counts[b] for a in range(400) for b in range(a) if b + 20 >= (a + 20) * 0.85 - 1e-9)
    assert got == near + sum(c * (c - 1) // 2 for c in counts)
