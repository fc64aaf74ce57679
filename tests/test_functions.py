from pyspark.sql import functions as F

from kinmatch.functions import hashes, numbers, titles


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(expr.alias("o")).first()["o"]


def test_three_title_forms_differ(spark):
    t = "  CÀ-PHÊ 500g / 0.5 KG "
    assert one(spark, t, titles.feature_title("t")) == "cà phê 500g 0 5 kg"
    assert one(spark, t, titles.audit_title("t")) == "cà-phê 500g / 0.5 kg"
    assert one(spark, t, titles.folded_title("t")) == "  cà-phê 500g / 0.5 kg "
    assert one(spark, t, titles.plain_title("t")) == "cà phê 500g 0 5 kg"
    assert one(spark, None, titles.feature_title("t")) is None


def test_word_ngrams_pad_words_and_keep_repeats(spark):
    assert one(spark, "ab ab", titles.word_ngrams("t", 2, 3)) == [" a", "ab", "b ", " ab", "ab "] * 2
    assert one(spark, "a", titles.word_ngrams("t", 4, 4)) == []
    assert one(spark, "", titles.word_ngrams("t", 2, 3)) == []


def test_identity_tokens_have_no_word_bounds(spark):
    assert one(spark, "title 500g x", titles.identity_tokens("t")) == ["500", "g", "l", "x"]
    assert one(spark, "title 500g x", titles.bounded_identity_tokens("t")) == ["500", "g", "x"]
    pair = spark.createDataFrame([(["1"], ["1"]), (["1"], ["2"]), ([], []), ([], ["g"])], "a array<string>, b array<string>")
    assert [r[0] for r in pair.select(titles.variant_conflict(F.col("a"), F.col("b"))).collect()] == [False, True, False, True]


def test_escaped_bytes_are_shown_unless_invalid(spark):
    assert one(spark, r"[\xe2\x9c\x85COD] A6S TWS", titles.shown_title("t")) == "[✅COD] A6S TWS"
    assert one(spark, r"a\xff", titles.shown_title("t")) == r"a\xff"


def test_encoded_titles_are_cut_padded_and_never_empty(spark):
    v = F.create_map(F.lit("a"), F.lit(2), F.lit("b"), F.lit(3))
    assert one(spark, "abz", titles.encoded_title("t", v, 5)) == [2, 3, 1, 0, 0]
    assert one(spark, "abab", titles.encoded_title("t", v, 2)) == [2, 3]
    assert one(spark, "", titles.encoded_title("t", v, 2)) == [1, 0]


def test_hash_bits_and_distance(spark):
    df = spark.createDataFrame([("ffffffffffffffff", "FFFFFFFFFFFFFFF0"), ("xyz", None)], "a string, b string")
    got = df.select(hashes.phash_bits("a").alias("a"), hashes.phash_bits("b").alias("b")).select("a", "b", hashes.hamming("a", "b").alias("d")).collect()
    assert tuple(got[0]) == (-1, -16, 4)
    assert tuple(got[1]) == (None, None, None)


def test_numbers(spark):
    assert one(spark, 0.0, numbers.safe_divide(F.lit(3.0), F.col("t")), "double") == 0.0
    assert [one(spark, x, numbers.balanced_round(F.col("t")), "double") for x in (0.5, 1.5, 2.5, 2.6)] == [0, 2, 2, 3]
    assert one(spark, [3.0, 4.0], numbers.unit_vector("t"), "array<double>") == [0.6, 0.8]
    for bad in ([0.0, 0.0], [], [float("nan"), 1.0], [float("inf"), 1.0]):
        assert one(spark, bad, numbers.unit_vector("t"), "array<double>") is None
    assert [one(spark, n, numbers.group_size_band(F.col("t")), "int") for n in (1, 2, 3, 6, 10)] == ["2", "2", "3_to_5", "6_to_9", "10_plus"]
    assert one(spark, 1, numbers.strict_size_band(F.col("t")), "int") == "3_to_5"


def test_scripts(spark):
    assert one(spark, "Kopi 5 кофе", titles.title_scripts("t")) == ["cyrillic", "digits", "latin"]
    assert one(spark, "!!", titles.title_scripts("t")) == ["other"]
