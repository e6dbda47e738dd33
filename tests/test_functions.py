import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspan.functions import bands as B, decisions as D, text as X, vectors as V
from tests.conftest import rows


def one(spark, values, expr, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(expr).collect()]


def test_round_half_is_binary16(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=500), rng.normal(size=500) * 1e-6, [0.0, -0.0, 2.0**-24, 2.0**-25, 1.0, 1.0 + 2.0**-11]])
    got = spark.createDataFrame([(x.tolist(),)], "v array<double>").select(V.round_half(F.col("v"))).first()[0]
    assert got == x.astype(np.float16).astype(np.float64).tolist()


def test_normalise_keeps_the_zero_vector(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>")
    assert [r[0] for r in df.select(V.normalise(F.col("v"))).collect()] == [[0.0, 0.0], [0.6, 0.8]]


def test_truncate_checks_its_width():
    with pytest.raises(ValueError):
        V.truncate(F.lit(None), 0)


def test_prepare_query_follows_the_metadata(spark):
    df = spark.createDataFrame([([3.0, 4.0, 12.0], 2, "float32"), ([0.1, 0.2, 0.3], 3, "float16")], "v array<double>, dim int, p string")
    got = [r[0] for r in df.select(V.prepare_query(F.col("v"), F.col("dim"), F.col("p"))).collect()]
    assert got[0] == [0.6, 0.8]
    half = np.array([0.1, 0.2, 0.3]).astype(np.float16).astype(float)
    assert np.allclose(got[1], half / np.linalg.norm(half), atol=1e-15)


def test_bands(spark):
    z = [5.0, 4.0, 3.0, 2.0, 1.99, None, float("nan")]
    assert one(spark, z, B.band(F.col("x")), "x double") == ["very_common", "common", "mid", "uncommon", "rare", "rare", "rare"]
    assert one(spark, [None, 1.0], B.band_label(F.col("x")), "x double") == ["unknown", "rare (<2)"]


def test_content_tokens_and_echo(spark):
    q = "The smell of RAIN hitting don't dry-ground"
    assert one(spark, [q], X.content_tokens(F.col("x"))) == [["smell", "rain", "hitting", "don", "dry", "ground"]]
    words = ["raininess", "raindrop", "train", "ran", "a rainy day", ""]
    df = spark.createDataFrame([(w, q) for w in words], "w string, q string")
    assert [r[0] for r in df.select(X.echoes(F.col("w"), F.col("q"))).collect()] == [True, True, False, False, True, False]


def test_stopwords_are_complete():
    assert len(X.STOPWORDS) == len(set(X.STOPWORDS)) == 106


def test_lexical_overlap(spark):
    pairs = [("a stiff black hat with a curled brim", "bowler hat", "head_noun"), ("open metal cans in the kitchen", "can opener", "stem_shared"),
             ("a small thing", "aglet", "none"), ("hat", "hat", "none")]
    df = spark.createDataFrame(pairs, "q string, t string, want string")
    assert all(r[0] == r[1] for r in df.select(X.lexical_overlap(F.col("q"), F.col("t")), "want").collect())


def test_phrase_and_mentions(spark):
    df = spark.createDataFrame([("It's a Red-Herring!", "red herring"), ("redherring", "red herring")], "q string, t string")
    assert [r[0] for r in df.select(X.contains_phrase(F.col("q"), F.col("t"))).collect()] == [True, False]
    df = spark.createDataFrame([("an axb here", "a.b"), ("an A.B here", "a.b"), ("xa.b", "a.b"), ("a\\E b", "a\\E")], "q string, t string")
    assert [r[0] for r in df.select(X.mentions_word(F.col("q"), F.col("t"))).collect()] == [False, True, False, True]


def test_strip_knows_unicode_spaces(spark):
    assert one(spark, [" \t a b \n　"], X.strip(F.col("x"))) == ["a b"]
    assert one(spark, ["a b  c\n"], X.word_count(F.col("x"))) == [3]


def test_lengths(spark):
    texts = ["w " * n for n in (8, 9, 12, 13, 16, 17)]
    assert one(spark, texts, X.length_bucket(F.col("x"))) == ["<=8 words", "9-12 words", "9-12 words", "13-16 words", "13-16 words", "17+ words"]


def test_flags_and_lists(spark):
    assert one(spark, ["FALSE", " no ", "0", "yes", "", None], X.reachable_flag(F.col("x"))) == [False, False, False, True, True, True]
    assert one(spark, [" a,, b ,", None], X.split_csv(F.col("x"))) == [["a", "b"], []]


def test_url_component(spark):
    assert one(spark, ["a b/~!'()*-_.é&"], X.url_component(F.col("x"))) == ["a%20b%2F~!'()*-_.%C3%A9%26"]


def test_request_check(spark):
    got = one(spark, ["", None, "x" * 500, "x" * 501], X.request_rejection(F.col("x")))
    assert got == ["query is required and must be a string"] * 2 + [None, "query too long (max 500 characters)"]


def test_row_id(spark):
    assert one(spark, [7, 12345], X.row_id("authored", F.col("x")), "x int") == ["authored-0007", "authored-12345"]


@pytest.mark.parametrize("b,c,p", [(9, 22, 0.02945), (2, 1, 1.0), (0, 0, 1.0), (1, 8, 0.03906), (1, 3, 0.625), (11, 6, 0.33231), (0, 5, 0.0625)])
def test_mcnemar(spark, b, c, p):
    got = spark.createDataFrame([(b, c)], "b long, c long").select(D.mcnemar_p(F.col("b"), F.col("c"))).first()[0]
    assert math.isclose(got, p, abs_tol=5e-6)


def test_mcnemar_of_a_million_pairs(spark):
    from statistics import NormalDist

    n, low = 1_000_000, 498_600
    got = spark.createDataFrame([(low, n - low), (0, 2000), (500_000, 500_000)], "b long, c long").select(D.mcnemar_p(F.col("b"), F.col("c")).alias("p")).collect()
    near = 2 * NormalDist().cdf((low + 0.5 - n / 2) / math.sqrt(n / 4))
    assert math.isclose(got[0]["p"], near, rel_tol=1e-3) and got[1]["p"] == 0.0 and got[2]["p"] == 1.0


def test_normalise_is_linear_in_width_and_keeps_zero(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<double>")
    assert [r[0] for r in df.select(V.normalise(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0], None]


def test_verdicts(spark):
    df = spark.createDataFrame([(0.129, 0.001), (0.07, 0.2), (0.045, 0.029), (0.0, 1.0), (-0.1, 0.01)], "d double, p double")
    assert [r[0] for r in df.select(D.verdict(F.col("d"), F.col("p"))).collect()] == [
        "WIN", "above threshold, not significant", "null result", "no difference", "significant regression"]
