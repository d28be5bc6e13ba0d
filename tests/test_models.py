"""Text features against Spark's own stages."""

from pyspark.ml import PipelineModel
from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer

from cellweave.learn import models as M


def test_character_counts_equal_those_of_the_stages_they_stand_for(spark):
    texts = ["", "a", "ab", "Abab  ab\tA\n", "Straße ẞ İi ΑΣ Σ", "漢字, 漢字", "x\U0001f600y\U0001f600", "é\u0301\u2028z\x00q", "ab" * 3000]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for n, dims in ((2, 1 << 14), (3, 1000), (1, 64)):
        plain = PipelineModel([RegexTokenizer(inputCol="t", outputCol="c", pattern="", minTokenLength=1), NGram(n=n, inputCol="c", outputCol="g"), HashingTF(inputCol="g", outputCol="v", numFeatures=dims)])
        want = {r.id: r.v for r in plain.transform(d).collect()}
        assert {r.id: r.v for r in M.CharCounts("t", "v", n, dims).transform(d).collect()} == want


def test_no_string_is_made_of_each_character():
    assert not [s for s in M.char_features("t") if isinstance(s, RegexTokenizer | NGram)]
