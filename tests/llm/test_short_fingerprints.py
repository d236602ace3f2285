from __future__ import annotations

import random
from statistics import mean

from tests.llm.fixtures import prose
from txnrisk.llm import fingerprints as FP


def test_likeness_of_short_texts():
    """Texts of 16 to 100 code points have anchors, are unlike each other and like their near copies."""
    rng = random.Random(31)
    texts = [prose(rng, 40)[:n] for n in range(16, 101) for _ in range(4)]
    found = [FP.anchors(t) for t in texts]
    assert all(len(f) for f in found)
    assert mean(FP.likeness(a, b) for a, b in zip(found, found[1:])) < 0.05
    assert max(FP.likeness(a, b) for a, b in zip(found, found[1:])) < 0.7
    longer = [(t, f) for t, f in zip(texts, found) if len(t) >= 32]
    assert mean(FP.likeness(f, FP.anchors(t[:-1] + "#")) for t, f in longer) > 0.7
    halves = [FP.likeness(f, FP.anchors(FP.edited(t, prose(rng, 40)))) for t, f in longer]
    assert max(halves) < 1 and 0.15 < mean(halves) < 0.6
