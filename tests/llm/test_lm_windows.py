"""Every place of every training text teaches the attention model, once."""

import pickle
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from citeweave.llm import lm
from citeweave.llm.attention import HALF, Attention


def test_every_place_teaches():
    rng = np.random.default_rng(3)
    size, classes = 12, lm.STARTS + lm.INNER
    alphabet = lm.Alphabet(size, np.ones(size, bool))
    texts = [rng.integers(0, size, n).astype(np.uint16) for n in (1, 5, 24, 25, 700, 3000, 49)]
    batch = pa.RecordBatch.from_arrays([pa.array([t.tobytes() for t in texts], pa.binary()), pa.array([0, 0, 0, 0, 1, 1, 1], pa.int64())], names=["ids", "group"])
    model = Attention(np.zeros((size + 2, 4)), np.zeros((size + 1, classes)), 6)
    own = np.zeros(len(model.vector()) + 1)
    work = lm._trained(alphabet, SimpleNamespace(value=(model, 0.01)), SimpleNamespace(value=np.arange(size)))
    work(iter([batch]), own)
    assert own[-1] == sum(len(t) for t in texts)


def test_step_of_a_sent_model():
    """A model learns alike before and after it is sent to a task, also where logits are held under the limit."""
    rng = np.random.default_rng(4)
    for height in (1, 80):
        m = Attention(np.concatenate([rng.standard_normal((31, 5)), np.zeros((1, 5))]), height * rng.standard_normal((31, 7)), 6)
        sent = pickle.loads(pickle.dumps(m))
        ids = rng.integers(0, 30, 200).astype(np.int32)
        x, at = m.windows(ids, np.array([0, 30, 200]))
        y = np.full(len(x) * HALF, -1)
        y[at] = rng.integers(0, 7, 200)
        before = m.vector()
        losses = [[a.train(x, y, 0.01) for _ in range(5)] for a in (m, sent)]
        assert losses[0] == losses[1] and np.isfinite(losses[0]).all()
        assert (m.vector() == sent.vector()).all() and (m.vector() != before).any()
