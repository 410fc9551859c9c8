import sys

import numpy as np

from floodsift.llm.neighbours import search_block


def test_windows_are_looked_up_for_all_queries_of_a_block_at_once():
    rng = np.random.default_rng(5)
    vectors, ids = rng.standard_normal((600, 8)), np.arange(600)
    top = float(np.sqrt((vectors**2).sum(axis=1)).max())

    def lookups(queries):
        seen = []
        sys.setprofile(lambda frame, event, of: seen.append(1) if event == "c_call" and of.__name__ == "searchsorted" else None)
        try:
            found = list(search_block(ids, vectors, queries, top, 5))
        finally:
            sys.setprofile(None)
        assert all((np.diff(scores) <= 0).all() and len(rows) == 6 for _, rows, scores in found)
        return len(seen)

    assert lookups(vectors[:200]) < 2 * lookups(vectors[:50])
