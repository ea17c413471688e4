"""Texts that are read in pieces give what they give as a whole."""

import random

import numpy as np
import pytest
from cases import prose

from ternion.llm import bytewords, quality, simhash

LONG = " ".join([prose(1, 3000), "BAD bad x1 $$$ \n\t ü" * 50, "y" * 5000, prose(2, 3000), "end end"])


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(bytewords, "SLICE_BYTES", 64)
    monkeypatch.setattr(bytewords.pieces, "__defaults__", (256,))


def test_pieces_join_and_keep_words(small):
    data = np.frombuffer(LONG.encode(), np.uint8)
    cuts = list(bytewords.pieces(data, ~bytewords.SPACE))
    assert len(cuts) > 20 and b"".join(data[a:b].tobytes() for a, b in cuts) == LONG.encode()
    assert [w for a, b in cuts for w in data[a:b].tobytes().split()] == LONG.encode().split()


@pytest.mark.parametrize("text", [LONG, "z" * 9000, " " * 9000, "one two " * 2000, "\n".join(str(random.Random(i).random()) for i in range(500))])
def test_simhash(small, monkeypatch, text):
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "LONG", 300)
    assert simhash.fingerprint(text) == whole


@pytest.mark.parametrize("text", [LONG, "z" * 9000, " " * 9000, "one two " * 2000])
def test_quality(small, monkeypatch, text):
    data = np.frombuffer(text.encode(), np.uint8)
    at, lexicon = np.array([0, len(data)]), np.sort(np.array([quality._lexicon_hash(w) for w in (b"bad", b"alpha")], np.uint64))
    whole = quality.features(data, at, lexicon)
    monkeypatch.setattr(quality, "LONG", 300)
    assert np.allclose(quality.features(data, at, lexicon), whole)
