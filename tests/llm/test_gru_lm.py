"""Tokens and blocks of the language model."""

from collections import Counter

import numpy as np
import pyarrow as pa

from tidelog.llm import gru_lm

TEXTS = [None, "", " \t\n\x0b\f\r", "A b\ta", "\x1cÀ É x  a\n", "zz yy zz", " a\x85b", "a\x00b a", "b"]


def test_tokens_of_odd_texts():
    v = gru_lm.Vocabulary([("a", 5), ("b", 3), ("À", 2), ("", 9)], 30, 8)
    tokens = gru_lm.Tokens(pa.array(TEXTS, pa.string()), v)
    hot = v.words.to_pylist()
    for i, (text, ids, rest) in enumerate(zip(TEXTS, tokens.docs(), tokens.rest().to_pylist())):
        want = [w.decode() for w in [*(text or "").encode().lower().split(), b""]]
        place = [hot.index(w) if w in hot else -1 for w in want]
        assert tokens.n[i] == len(want) and ids.tolist() == [v.net[p] if p >= 0 else v.tail for p in place]
        assert {r["word"]: r["n"] for r in rest} == Counter(w for w in want if w not in hot)
        assert tokens.sums(v.count)[i] == sum(v.count[p] for p in place if p >= 0)
    none = gru_lm.Tokens(pa.array([], pa.string()), v)
    assert none.docs() == [] and len(none.rest()) == len(none.sums(v.count)) == 0


def test_scoring_works_in_blocks(monkeypatch):
    v = gru_lm.Vocabulary([(f"w{i}", 1000 - i) for i in range(900)] + [("", 50)], 500_000, 950)
    draw = np.random.default_rng(2)
    w = gru_lm.start_weights(v)
    docs = [np.append(draw.integers(1, v.n_in, draw.integers(0, 70)), 0) for _ in range(300)]
    alone = [gru_lm.score_docs(w, [d])[0] for d in docs]
    step, widths = gru_lm._step, []
    monkeypatch.setattr(gru_lm, "LANES", 64)
    monkeypatch.setattr(gru_lm, "_step", lambda w, x, h: widths.append(len(h)) or step(w, x, h))
    assert np.allclose(gru_lm.score_docs(w, docs), alone, rtol=1e-5)
    assert max(widths) == 64
