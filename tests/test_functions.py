import random

import pytest
from pyspark.sql import functions as F

from foldmill.functions import hashing, packing, scalars, sequences, tokens


def one(spark, column, *values, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r[0] for r in df.select(column(F.col("x"))).collect()]


def test_tokens(spark):
    assert one(spark, lambda c: tokens.tokens(c, " ,"), "a,,b  a", "", " ,, ", None) == [["a", "b", "a"], [], [], None]
    assert one(spark, lambda c: tokens.tokens(c), "it's-a (test): *yes*!\tno_w") == [["it", "s", "a", "test", "yes", "no", "w"]]
    assert one(spark, lambda c: tokens.records(c, "\n", " "), "k1 x\nk2 y\n \nk1 z") == [[["k1", "x"], ["k2", "y"], ["k1", "z"]]]
    with pytest.raises(ValueError):
        tokens.char_class("")


@pytest.mark.parametrize(("n", "want"), [(1, ["a", "b", "a", "b"]), (2, ["a-b", "b-a", "a-b"]), (3, ["a-b-a", "b-a-b"]), (4, ["a-b-a-b"]), (5, [])])
def test_ngrams(spark, n, want):
    assert one(spark, lambda c: tokens.ngrams(tokens.tokens(c), n), "a b a b", "a") == [want, ["a"] if n == 1 else []]


def test_rotations(spark):
    halves = lambda c: F.transform(scalars.rotations(c), scalars.half)
    assert one(spark, halves, "abcdefgh", "abcdefghi") == [["cdef", "efgh", "ghab", "abcd"], ["cdef", "efgh", "ghia", "iabc"]]
    assert one(spark, lambda c: scalars.rotate(c, F.lit(3)), "", "ab", None) == ["", "ba", None]


def test_unsigned(spark):
    got = one(spark, scalars.unsigned, "0xFFFFFFFFFFFFFFFF", "017", "0", "42", "x1", "", None)
    assert [None if v is None else int(v) for v in got] == [2**64 - 1, 15, 0, 42, None, None, None]


def test_partition_sum(spark):
    assert one(spark, scalars.byte_sum, "abc", "é", "zz", "") == [294, -148, 244, 0]
    assert one(spark, lambda c: scalars.partition_of(c, 4), "abc", "é", "zz") == [2, 0, 0]
    assert one(spark, lambda c: scalars.partition_of(c, 4, 1), "abc") == [3]


def test_published_hash_vectors():
    assert hashing.lookup3_many([b"", b"Four score and seven years ago"]).tolist() == [0xDEADBEEF, 0x17770551]
    assert hashing.lookup3_many([b""], 0xDEADBEEF).tolist() == [0xBD5B7DDE]
    assert hashing.lookup3_many([b"Four score and seven years ago"], 1).tolist() == [0xCD628161]
    four = b"Four score and seven years ago"
    cases = {(b"", 0, 0): (0xDEADBEEF, 0xDEADBEEF), (b"", 0, 0xDEADBEEF): (0xBD5B7DDE, 0xDEADBEEF), (b"", 0xDEADBEEF, 0xDEADBEEF): (0x9C093CCD, 0xBD5B7DDE)}
    cases |= {(four, 0, 0): (0x17770551, 0xCE7226E6), (four, 0, 1): (0xE3607CAE, 0xBD371DE4), (four, 1, 0): (0xCD628161, 0x6CBEA4B3)}
    for (value, seed, second), want in cases.items():
        c, b = hashing.lookup3_pairs([value], seed, second)
        assert (int(c[0]), int(b[0])) == want


def murmur2(v, seed):
    h, m = (seed ^ len(v)) & 0xFFFFFFFF, 0x5BD1E995
    while len(v) >= 4:
        k = int.from_bytes(v[:4], "little") * m & 0xFFFFFFFF
        h = (h * m ^ (k ^ k >> 24) * m) & 0xFFFFFFFF
        v = v[4:]
    if v:
        h = (h ^ int.from_bytes(v, "little")) * m & 0xFFFFFFFF
    h = (h ^ h >> 13) * m & 0xFFFFFFFF
    return h ^ h >> 15


def test_block_hashes_do_not_depend_on_the_batch():
    rng = random.Random(1)
    values = [rng.randbytes(rng.randrange(40)) for _ in range(300)] + [b"", b"\x80", b"\xff\xfe", b"abc"]
    for many in (hashing.lookup3_many, hashing.murmur2_many, hashing.superfast_many):
        assert many(values).tolist() == [int(many([v])[0]) for v in values]
        assert len(set(many(values).tolist())) > 290
    assert hashing.murmur2_many(values, 7).tolist() == [murmur2(v, 7) for v in values]


def test_hash_columns(spark):
    assert one(spark, hashing.fnv1, "", "a", "foobar") == [0x811C9DC5, 0x050C5D7E, 0x31F0B262]
    assert one(spark, lambda c: hashing.null_hash(c, 0), "abcd", "xabcd", "abc") == [0x61626364, 0x61626364, 0]
    assert one(spark, lambda c: hashing.null_hash(c, 2), "abcdXY", "abcdX") == [0x61626364, 0]
    assert one(spark, hashing.lookup3, "Four score and seven years ago", None, "") == [0x17770551, None, 0xDEADBEEF]
    assert len(set(one(spark, hashing.avalanche_2, *range(500), kind="long"))) == 500


def test_runs_and_deltas(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([7, 7, 9, 9, 9, 7])] + [(2, 0, None), (2, 1, None), (2, 2, 3)], "g int, i int, v int")
    runs = sequences.run_lengths(df, ["g"], ["i"], "v")
    assert sorted((r.g, r.run, r.v, r.length) for r in runs.collect()) == [(1, 0, 7, 2), (1, 1, 9, 3), (1, 2, 7, 1), (2, 0, None, 2), (2, 1, 3, 1)]
    back = sequences.expand_runs(runs, ["g"], "v")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.selectExpr("g", "cast(i as long) as place", "v").collect()))
    coded = sequences.deltas(spark.createDataFrame([(1, v) for v in (3, 5, 9)], "g int, v int"), ["g"], ["v"], "v")
    assert [r.delta for r in coded.orderBy("v").collect()] == [3, 2, 4]
    assert all(r.value == r.v for r in sequences.undeltas(coded, ["g"], ["v"]).collect())
    assert one(spark, sequences.bit_width, 0, 1, 5, kind="long") == [1, 1, 3]


def test_vector_hashes(spark):
    assert one(spark, sequences.threshold_bits, [1.0, 3.0, 2.0, 4.0], [], kind="array<double>") == ["0101", ""]
    rng = random.Random(2)
    image = [rng.random() for _ in range(1024)]
    got = one(spark, sequences.perceptual_hash, image, [2 * v + 1 for v in image], None, [1.0], kind="array<double>")
    assert got[0] == got[1] and (got[0] % 2**64).bit_count() == 32 and got[2:] == [None, None]
    m = sequences.dct_matrix(32)
    assert abs(m @ m.T - [[float(i == j) for j in range(32)] for i in range(32)]).max() < 1e-12


def test_packing(spark):
    rng = random.Random(4)
    for values in ([], [0], [3, 5, 9], [7, 7, 7], sorted(rng.randrange(1 << 40) for _ in range(500)), list(range(1000))):
        assert packing.unpack_sorted(packing.pack_sorted(values)) == values
    assert len(packing.pack_sorted(list(range(1000)))) < 300
    with pytest.raises(ValueError):
        packing.pack_sorted([2, 1])
    assert one(spark, lambda c: packing.unpacked(packing.packed(c)), [1, 4], None, kind="array<long>") == [[1, 4], None]
    assert one(spark, lambda c: F.decode(packing.uncompressed(packing.compressed(F.encode(c, "UTF-8"))), "UTF-8"), "é" * 50, "", None) == ["é" * 50, "", None]
