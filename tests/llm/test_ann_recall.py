"""Recall at the registered parameters and full shard size."""

import numpy as np
import pytest

from slotledger.llm import ann


@pytest.mark.parametrize("share", [0.0, 1 / 3])
def test_recall_in_a_full_shard(share):
    """A share of the rows are near but unequal copies of one vector."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(ann.SHARD, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = rng.permutation(ann.SHARD)[: int(share * ann.SHARD)]
    x[near] = x[0] + rng.normal(size=(len(near), 64)) * 1e-4
    ids = np.arange(ann.SHARD)
    books = ann.fit(x)
    codes = ann.encode(x, books)[0]
    q = np.unique(np.concatenate([near[:30], ids[:30]]))
    got = ann._search(q, x[q], ids, x, codes, books, ann.TOP, ann.STEP)
    assert len(got) == len(q) * ann.TOP
    got = got.groupby("query_id").vec_id.agg(set)
    hit = 0
    for i in set(q.tolist()):
        s = x @ x[i]
        s[i] = -np.inf
        hit += len(got[i] & set(np.argsort(-s, kind="stable")[: ann.TOP].tolist()))
    assert hit >= 0.95 * len(got) * ann.TOP
    # the codes choose what is scored exactly: with others, many more rows are and neighbours are lost all the same
    wrong = codes[rng.permutation(len(codes))]
    met = {}
    for name, c in (("own", codes), ("wrong", wrong)):
        lookups = [(books @ x[i])[np.arange(len(books)), c].sum(1) for i in q]
        met[name] = np.mean([len(ann.reranked(s, lambda n, i=i: (x[n] * x[i]).sum(1), ann.TOP + 1, ann.SHARD // 16)[0]) for i, s in zip(q, lookups)]) / ann.SHARD
    assert met["own"] < (0.6 if share else 0.25) and met["wrong"] > met["own"] + 0.2
    lost = ann._search(q, x[q], ids, x, wrong, books, ann.TOP, ann.STEP).groupby("query_id").vec_id.agg(set)
    assert sum(len(got[i] & lost[i]) for i in got.index) < 0.85 * len(got) * ann.TOP
