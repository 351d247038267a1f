"""What the searches of many origins give is handed on in few frames."""

import numpy as np
import pandas as pd

from wayfare.operators import routing
from wayfare.operators.graph import Graph, Grid


def test_profiles_of_many_origins_share_frames():
    n = 500
    ring = Graph(((k, k, (k + 1) % n, np.array([60.0 + k % 7, 70.0, 80.0])) for k in range(n)), Grid(0.0, 3600.0, 3))
    batches = [pd.DataFrame({"origin": range(a, a + 250), "targets": [[k, (k + 1) % n, n + 1] for k in range(a, a + 250)]}) for a in (0, 250)]
    frames = list(routing._profile_frames(iter(batches), ring.grid, ring.profile, rows_of_a_frame=600))
    assert [len(f) for f in frames] == [600, 600, 300]
    rows = {(r.origin, r.destination): r for r in pd.concat(frames).itertuples()}
    assert len(rows) == 3 * n
    for k in range(n):
        assert rows[k, k].cst == 0 and rows[k, (k + 1) % n].points == [60.0 + k % 7, 70.0, 80.0]
        assert rows[k, n + 1].points is None and pd.isna(rows[k, n + 1].cst)
