import re

import pytest

from vecloom.llm import substring as S


def brute(rows, width=13):
    texts = [(i, re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in rows]
    place = lambda i: float("inf") if i is None else i
    first = {}
    for i, w in texts:
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            first[key] = min(place(i), first.get(key, place(i)))
    out = []
    for i, w in texts:
        gone = {j for k in range(len(w) - width + 1) if first[tuple(w[k : k + width])] < place(i) for j in range(k, k + width)}
        out.append((str(i), len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


@pytest.mark.parametrize("bits", [S.CELL_BITS, 17])
def test_against_brute_force(odd, none, monkeypatch, bits):
    monkeypatch.setattr(S, "CELL_BITS", bits)
    df, rows = odd
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in S.deduplicate(df.withColumnRenamed("x", "y")).collect())
    assert got == brute(rows)
    assert S.deduplicate(none).count() == 0


def test_anchors_are_equal_where_windows_are():
    import numpy as np

    h = np.random.default_rng(1).integers(0, 2**63, 100, dtype=np.uint64)
    a = S.anchors(h, 13)
    b = S.anchors(np.concatenate((h[50:80], h[:9])), 13)
    assert len(a) == 88 and a[50:68].tolist() == b[:18].tolist()
