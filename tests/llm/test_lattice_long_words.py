"""Long unseen words keep the model's own log probability."""

import math
import random

import public_tokenizers
from pyspark.sql import functions as F

from braidline.llm import lattice_lm

PATH = public_tokenizers.path("piece_bpe_32k.model")


def unseen(n):
    rnd = random.Random(n)
    return "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None) for i, t in rows], "doc_id long, text string, lang string")


def test_long_word_against_log_probability(spark):
    word, model = unseen(5000), lattice_lm.lattice(PATH)
    got = lattice_lm.score_documents(frame(spark, [(1, word)]), F.lit(True), PATH).first()
    # nothing trains, so the lattice alone scores the word and the end
    want = (float(model.log_probabilities([word])[0]) + 2 * math.log(0.5)) / math.log(10)
    assert want < -1000 and math.isclose(got.score, want, rel_tol=1e-9)


def test_long_words_after_training(spark):
    words = [unseen(n) for n in (40, 1000, 5000, 20000)]
    rows = [(i, f"the cat sat on the mat {i}") for i in range(1, 40)] + [(100 + i, w) for i, w in enumerate(words)]
    got = {r.doc_id: r.score for r in lattice_lm.score_documents(frame(spark, rows), F.col("doc_id") >= 100, PATH).collect()}
    scores = [got[100 + i] for i in range(4)]
    assert all(map(math.isfinite, scores)) and scores == sorted(scores, reverse=True)
    # in proportion to the letters
    assert 3.5 < scores[3] / scores[2] < 4.5 and 4 < scores[2] / scores[1] < 6
