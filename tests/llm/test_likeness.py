import numpy as np

from weftgraph.llm import fingerprint


def test_likeness_does_not_sink_with_length():
    """The last quarter of P paragraphs replaced: 0.75 / 1.25 of either's paragraphs are shared."""
    for p in (10, 100, 400, 1000, 5000):
        old, new = [], []
        for i in range(24):
            own = [f"{p} {i} {j}" for j in range(p)]
            old.append(own)
            new.append(own[: p - p // 4] + [f"new {p} {i} {j}" for j in range(p // 4)])
        got = fingerprint.likeness(fingerprint.sums(old), fingerprint.sums(new))
        assert abs(got.mean() - (p - p // 4) / (p + p // 4)) < 0.06, (p, got.mean())
        unlike = fingerprint.likeness(fingerprint.sums(old), fingerprint.sums([[x + "!" for x in ps] for ps in old]))
        assert unlike.mean() < 0.06, (p, unlike.mean())


def test_levels_are_homomorphic():
    texts = [str(i) for i in range(300)]
    whole = fingerprint.sums([texts])[0]
    assert (whole == fingerprint.reduced(sum((fingerprint.vector(t) for t in texts), np.zeros(fingerprint.LANES, np.uint32)))).all()
    assert (fingerprint.delete(whole, "7") == fingerprint.sums([[t for t in texts if t != "7"]])[0]).all()
