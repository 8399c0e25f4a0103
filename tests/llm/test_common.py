import random

import numpy as np
import pyarrow as pa

from concord.llm.common import ALNUM, PLAIN, ByteWords, ascending, grouped


def test_byte_words(monkeypatch):
    """As many words as split gives, equal words alike, however texts are cut into stretches."""
    rng = random.Random(1)
    long = ["x" * 1000 + " y" * 10, None, "", "ab" * 400]
    whole = {}
    for part in (1 << 18, 64, 7, 1):
        monkeypatch.setattr(ByteWords, "PART", part)
        for table in (PLAIN, ALNUM):
            read = ByteWords(table)
            for k in range(60):
                texts = long if k == 0 else [None if rng.random() < 0.1 else "".join(rng.choice("ab Éc\t\n-Z\x1c") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 8))]
                h, n = read(pa.array(["cut", *texts], pa.string()).slice(1))
                want = [(t or "").encode().translate(table).split() for t in texts]
                assert n.tolist() == [len(w) for w in want], texts
                for x, w in zip(h.tolist(), [w for y in want for w in y], strict=True):
                    assert whole.setdefault(w, x) == x, w
    assert len(set(whole.values())) == len(whole) > 500
    h, n = read(pa.array([], pa.string()))
    assert not len(h) and not len(n)


def test_orders():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 1000):
        for top in (3, 2**40, 2**63 - 1):
            k = rng.integers(0, top, n)
            assert (k[ascending(k)] == np.sort(k)).all()
            order, new = grouped(k.astype(np.uint64))
            assert sorted(order.tolist()) == list(range(n)) and len(new) == n
            v = k[order]
            assert all(new[i] or v[i] == v[i - 1] for i in range(n)) and (top == 3 or new.sum() <= len(np.unique(k)) + 2)
