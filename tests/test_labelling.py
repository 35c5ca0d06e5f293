import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from emberline.operators import labelling


def flood(cells, diagonal):
    left, out = set(cells), {}
    for start in sorted(cells):
        if start not in left:
            continue
        todo, group = [start], []
        left.discard(start)
        while todo:
            r, c = todo.pop()
            group.append((r, c))
            for dr in (-1, 0, 1):
                for dc in (-1, 0, 1):
                    if (dr or dc) and (diagonal or not (dr and dc)) and (r + dr, c + dc) in left:
                        left.discard((r + dr, c + dc))
                        todo.append((r + dr, c + dc))
        out.update(dict.fromkeys(group, min(group)))
    return out


@settings(max_examples=150, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=60), st.booleans(), st.randoms())
def test_labels_match_a_flood_fill(cells, diagonal, rng):
    cells = sorted(cells)
    rng.shuffle(cells)
    row, col = (np.array([c[k] for c in cells], np.int64) for k in (0, 1))
    label = labelling.labels(row, col, diagonal)
    want = flood(cells, diagonal)
    assert {c: (int(row[k]), int(col[k])) for c, k in zip(cells, label, strict=True)} == want


def test_core_hangs_together_with_the_peak():
    row, col = np.array([0, 0, 0, 0, 1]), np.array([0, 1, 2, 4, 4])
    value = np.array([0.9, 0.6, 0.4, 0.8, 0.8])
    assert labelling.core(row, col, value, 0, 0.5).tolist() == [0, 1]
    assert labelling.core(row, col, value, 2, 0.5).tolist() == [0, 1, 2]
