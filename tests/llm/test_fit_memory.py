"""What a fit holds at a time."""

import tracemalloc

import numpy as np

from fathomry.llm import toxic_spans


def test_rounds_of_the_chain_fit_go_block_by_block():
    rng = np.random.default_rng(1)
    labels = (np.arange(600) % 4 == 0).astype(float)
    texts = [b" ".join([b"vileword" if y and i % 40 == 0 else b"vile%d" % w for i, w in enumerate(rng.integers(0, 3000, 960))]) for y in labels]
    tracemalloc.start()
    model = toxic_spans.fit(texts, labels, rounds=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    places = 600 * 960
    assert model is not None and peak < 100 * places
