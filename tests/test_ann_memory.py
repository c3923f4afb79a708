import tracemalloc

import numpy as np
import pandas as pd

from graphloom.operators import ann


def test_a_block_keeps_its_finds_in_columns():
    """Memory of a block of rows and queries: less than a hundred bytes a row found, beside the distances of 512 queries."""
    r = np.random.default_rng(0)
    x, q = r.normal(size=(2048, 16)), r.normal(size=(3072, 16))
    model = ann.fit(x, "l2", 9.0, len(x))
    cell = np.zeros(len(x), int)
    rows = pd.DataFrame({"kind": "Vector", "id": [str(i) for i in range(len(x))], "code": [c.tobytes() for c in model.codes(x, cell)], "cell": cell})
    asked = pd.DataFrame({"query": [str(i) for i in range(len(q))], "vector": list(q)})
    tracemalloc.start()
    found = ann.roughly_nearest(model, rows, asked, 200)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 200 * len(q) and peak < 100 * len(found) + 3 * 512 * len(x) * 8
    of = found[found["query"] == "7"]
    d = ((model.decoded(model.codes(x, cell), cell) - q[7]) ** 2).sum(1)
    assert sorted(of["id"].astype(int)) == sorted(np.argsort(d)[:200]) and np.allclose(of["rough"], d[of["id"].astype(int)])
