"""Units of a worker's documents are learned once, and the pieces tried at an end are those that can end there."""

import numpy as np
import public_tokenizers

from caseloom.llm.sentencepiece import PieceModel


def test_many_distinct_words_are_learned_once():
    model, learned = PieceModel(public_tokenizers.path("piece_bpe_32k.model")), []
    learn = model.learn
    model.learn = lambda units: learned.extend(units) or learn(units)
    texts = [" ".join(f"q{i:x}" for i in range(a, a + 20_000)) for a in range(0, 200_000, 20_000)]
    first, again = model.encode(texts), [model.encode([t])[0] for t in texts]
    assert all(np.array_equal(a, b) for a, b in zip(first, again)) and len(learned) == len(set(learned))


def test_lengths_at_an_end_hold_every_piece():
    model = PieceModel(public_tokenizers.path("piece_bpe_32k.model"))
    for piece in model.rank:
        for before in ("", "x", "▁", piece):
            tail = (before + piece)[-3:]
            known = model.lengths.get(tail) or ((2, 1) if tail[-2:] in model.rank else (1,))
            assert len(piece) in known
