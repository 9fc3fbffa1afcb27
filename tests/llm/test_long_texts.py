"""A text too long for anchors is an error, not a missed repeat."""

import numpy as np
import pytest

import __spark_entry__  # noqa: F401
from quizlens.llm import codes


def test_a_piece_beyond_anchor_bits_raises(monkeypatch):
    monkeypatch.setattr(codes, "ANCHOR_BITS", np.uint64(6))
    units = np.arange(64, dtype=np.uint64)
    assert len(codes.Runs(units[:63], np.array([0, 63]), 10, 4).first)
    with pytest.raises(ValueError, match="too long"):
        codes.Runs(units, np.array([0, 64]), 10, 4)
