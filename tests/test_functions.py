import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import u64
from tessera.functions.kmers import SEEDS, kmer_hashes, run_hashes

M = (1 << 64) - 1
# x, fmix64, xorshift_star, hash_family(x, 3)
MIXED = [
    (0x0, 0x0, 0x0, 0x0),
    (0x1, 0xB456BCFC34C2CB2C, 0x47E4CE4B896CDD1D, 0x8C0527DED1096283),
    (0x2, 0x3ABF2A20650683E7, 0x8FC99C9712D9BA3A, 0xEA1BFFE59D93B295),
    (0xFFFFFFFF, 0xCC71ECDA2AA8BCC6, 0x94365C88BB8AC683, 0x891502745D49104F),
    (0x0123456789ABCDEF, 0x87CBFBFE89022CEA, 0x7C9482472CB6708C, 0xFD8982D40F257E8E),
    (0xFFFFFFFFFFFFFFFF, 0x64B5720B4B825F21, 0xF92CC9E5C6000000, 0x503BCFBC9D825F21),
]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_mixers_as_columns(spark):
    df = spark.createDataFrame([(signed(r[0]),) for r in MIXED], "x long")
    got = df.select(u64.fmix64(F.col("x")), u64.xorshift_star(F.col("x")), u64.hash_family(F.col("x"), 3), u64.bucket_of(F.col("x"), 10)).collect()
    assert [tuple(r)[:3] for r in got] == [tuple(map(signed, r[1:])) for r in MIXED]
    assert [r[3] for r in got] == [0, 721, 234, 817, 543, 402]


def test_unsigned_min(spark):
    df = spark.createDataFrame([(-1,), (5,), (signed(1 << 63),)], "x long")
    assert df.agg(u64.unsigned_min(F.col("x"))).first()[0] == 5


def rol(x, n):
    n %= 64
    return ((x << n) | (x >> (64 - n))) & M if n else x


def naive(kmer):
    comp = dict(zip("ACGT", "TGCA", strict=True))
    f = r = 0
    for j, c in enumerate(kmer):
        f ^= rol(SEEDS[c], len(kmer) - 1 - j)
        r ^= rol(SEEDS[comp[c]], j)
    return min(f, r)


@pytest.mark.parametrize(("kmer", "h"), [("A", 0x295549F54BE24456), ("ACG", 0xAF7E3241C5CCAF2E), ("ACGTA", 0xAAC82409423F1D6A), ("TACGT", 0xAAC82409423F1D6A), ("GATTACAGATTACAGATTACAGATTACAGAT", 0x1E29C43BD1173D27)])
def test_known_hashes(kmer, h):
    assert run_hashes(kmer, len(kmer)).tolist() == [h]


@given(st.text("ACGT", min_size=0, max_size=150), st.integers(1, 70))
def test_rolling_equals_naive_and_strands_agree(run, k):
    expected = [naive(run[i : i + k]) for i in range(len(run) - k + 1)]
    assert run_hashes(run, k).tolist() == expected
    other = run[::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert run_hashes(other, k).tolist() == expected[::-1]


def test_runs_are_not_spanned():
    assert len(kmer_hashes("ACGTNacgtnnAC", 3)) == 4
    assert len(kmer_hashes(None, 3)) == len(kmer_hashes("", 3)) == 0
    assert np.array_equal(kmer_hashes("acgt", 3), kmer_hashes("ACGT", 3))
