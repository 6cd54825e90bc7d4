"""Reading levels: overlap of neighbouring sentences, folds whose labels play no part."""

from __future__ import annotations

import numpy as np

from strandline.llm import p10_reading_level as p10


def test_shared_buckets_of_neighbours():
    sentence = np.array([0, 0, 1, 1, 1, 2, 3])
    ids = np.array([5, 6, 6, 6, 7, 5, 5])
    assert p10._shared(sentence, ids, 5).tolist() == [0.0, 0.5, 0.0, 1.0, 0.0]


def test_cohesion_tells_linked_from_unlinked_sentences():
    vocabulary = p10.Vocabulary.of(np.ones((1 << p10.BITS, 3)))
    linked = "The northern harbor was closed. The northern harbor was quiet. The northern harbor was open."
    apart = "The northern harbor was closed. Many crews slept in tents. Snow fell upon distant peaks."
    x = p10.features([linked, apart, ""], vocabulary)
    assert x[0, -2] > 2 * x[1, -2] and x[2, -2] == 0


def test_labels_of_noise_are_not_predicted(spark):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(300)]
    rows = [(i, "en", int(rng.integers(1, 4)), " ".join(rng.choice(words, 40)) + ".") for i in range(90)]
    grader = p10.train(spark.createDataFrame(rows, "item_id bigint, lang string, reading_level int, text string"))
    assert grader.accuracy < 0.6  # held-out folds tell nothing of their labels
