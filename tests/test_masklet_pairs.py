"""Every pair of tracks, against a walk over frames."""

from collections import defaultdict

import pytest

from tesserae.plans import registry
from tesserae.plans.boxes import det
from tests.conftest import SF


def test_all_pairs_equal_a_walk_over_frames(spark):
    tracks = defaultdict(dict)
    for r in det(spark, SF).collect():
        tracks[r.category, r.kind, r.n][r.image_id] = (r.x, r.y, r.w, r.h)
    expected = {}
    for (c, kind, g), a in tracks.items():
        for (c2, kind2, p), b in tracks.items():
            if (kind, kind2) != ("F", "O") or c != c2:
                continue
            inter = union = 0
            for f in a.keys() | b.keys():
                x, y = a.get(f), b.get(f)
                i = max(min(x[0] + x[2], y[0] + y[2]) - max(x[0], y[0]), 0) * max(min(x[1] + x[3], y[1] + y[3]) - max(x[1], y[1]), 0) if x and y else 0
                inter, union = inter + i, union + sum(z[2] * z[3] for z in (x, y) if z) - i
            expected[c, g, p] = pytest.approx(inter / union, abs=1e-6)
    got = {(r.category, r.gn, r.pn): r.iou for r in registry.queries()["masklet_iou"](spark, SF).collect()}
    assert got == expected and len(got) > 3
