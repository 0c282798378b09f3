import tracemalloc

import numpy as np
import pandas as pd
import pytest

from scriptorium.operators import search


@pytest.mark.parametrize("clip", [None, 0.35, np.full(16, 0.3)])
def test_products_of_a_task_are_tiles(clip):
    r = np.random.default_rng(1)
    x = r.normal(size=(10_000, 16)) * 0.2
    x[5000:5010] = x[0]  # equal vectors: the smaller keys
    batches = [pd.DataFrame({"vec_id": np.arange(i, i + 5000), "embedding": list(x[i : i + 5000])}) for i in (5000, 0)]
    ids = np.arange(0, 10_000, 5)
    tracemalloc.start()
    got = pd.concat(search._rows_of(iter(batches), (ids, x[ids]), 3, "vec_id", clip, True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6 and len(got) == 3 * len(ids)
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    for q in (0, 5, 5000, 9995):
        near = np.round((unit * unit[q]).sum(axis=1), 6)
        near[q] = -2
        want = sorted(range(len(x)), key=lambda v: (-near[v], v))[:3]
        mine = got[got["query_id"] == q].sort_values(["similarity", "vec_id"], ascending=[False, True])
        assert mine["vec_id"].tolist() == want and mine["similarity"].tolist() == [near[v] for v in want]
