"""What a Python worker holds, and keeps from stage to stage."""

import pickle
import random

import numpy as np

from veriseam.llm import sentencepiece_bpe, toxicity
from veriseam.llm.queries import piece_model


def test_a_task_leaves_no_remembered_words():
    """Workers kept the words of a stage through the next ones (pipeline, memory in toxicity)."""
    kept = sentencepiece_bpe.encoder(piece_model())
    own = kept.renewed()
    text = "Words that are met again, and again: words."
    assert own.decode(own.encode(text)) == text and own.encode(text) == sentencepiece_bpe.Encoder(piece_model()).encode(text)
    assert own.words and not (kept.words or kept.pieces or kept.fits)


def test_a_pickled_model_is_smaller_and_the_same():
    """A worker holds the pickled model beside the model (pipeline, memory in toxicity)."""
    rnd = random.Random(9)
    vocabulary = ["".join(rnd.choices("abcdefghij", k=8)) for _ in range(4_000)]
    sample = [(i % 3 == 0, " ".join(rnd.choices(vocabulary, k=60) + rnd.sample(vocabulary[:60], 20)), i) for i in range(400)]
    model = toxicity.Model(sample, {0: 900, 1: 100})
    packed = pickle.dumps(model)
    again = pickle.loads(packed)
    arrays = {k: v for k, v in vars(model).items() if isinstance(v, np.ndarray)}
    assert all(np.array_equal(v, getattr(again, k)) for k, v in arrays.items())
    assert len(packed) < sum(v.nbytes for v in arrays.values()) * 3 / 4
    one, two = model.scorer(), again.scorer()
    assert all(one(t) == two(t) for _, t, _ in sample[:50])
