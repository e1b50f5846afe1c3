"""Bit functions: property tests over all leaf patterns and random words."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import bits


def test_all_leaf_patterns_rank_and_back(spark):
    rows = spark.range(65536).select("id", bits.combinadic_rank(F.col("id")).alias("rank"))
    back = rows.withColumn("back", bits.combinadic_unrank(F.col("rank"), F.bit_count("id")))
    assert back.filter("back <> id").count() == 0
    sizes = rows.groupBy(F.bit_count("id").alias("k")).agg(F.count("*").alias("n"), F.countDistinct("rank").alias("d"), F.max("rank").alias("m")).collect()
    assert all(r.n == r.d == math.comb(16, r.k) and r.m == r.n - 1 for r in sizes)


WORD = st.integers(-(1 << 63), (1 << 63) - 1)


@settings(max_examples=4, deadline=None)
@given(st.lists(WORD, min_size=30, max_size=60))
def test_random_words(spark, words):
    v = F.col("v")
    frame = spark.createDataFrame([(w,) for w in [*words, 0, -1, 1, -(1 << 63)]], "v long")
    got = frame.select(
        "v", bits.zigzag(v).alias("zigzag"), bits.varint_length(v).alias("length"), bits.byte_swap(bits.byte_swap(v)).alias("swapped"), bits.mirror(bits.mirror(v)).alias("mirrored"),
        bits.transpose(bits.transpose(v)).alias("transposed"), bits.byte_swap(v).alias("once"), bits.unsigned_order(v).alias("order"),
        bits.bit_concat([(bits.bit_slice(v, 36, 28), 28), (bits.bit_slice(v, 16, 20), 20), (bits.bit_slice(v, 0, 16), 16)]).alias("joined"),
    ).collect()
    for r in got:
        u = r.v & (1 << 64) - 1
        assert r.zigzag & (1 << 64) - 1 == ((r.v << 1) ^ (r.v >> 63)) & (1 << 64) - 1
        assert r.length == max(1, math.ceil(u.bit_length() / 7))
        assert r.swapped == r.mirrored == r.transposed == r.joined == r.v
        assert r.once & (1 << 64) - 1 == int.from_bytes(u.to_bytes(8, "little"), "big")
    by_order = [r.v & (1 << 64) - 1 for r in sorted(got, key=lambda r: r.order)]
    assert by_order == sorted(by_order)


def test_color_flip_and_nibbles(spark):
    r = spark.range(1).select(bits.color_flip(F.lit(0b1111), F.lit(0b0101)).alias("f"), bits.nibble_pack(F.lit(3), F.lit(14)).alias("n"), bits.binomial(16, F.lit(8), 16).alias("b")).first()
    assert (r.f, r.n, r.b) == (0b1010, 3 | 14 << 4, 12_870)


def test_sums_that_overflow_are_errors(spark):
    with pytest.raises(Exception, match="OVERFLOW|overflow"):
        spark.range(2).select(F.sum(F.lit(2**62).cast("long") + F.lit(2**62 - 1)).alias("s")).collect()
