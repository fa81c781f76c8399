"""Terms of a stored index are counted row by row, and a segment's postings move once."""

import pyarrow as pa

from sparkmem.operators import stored


def test_counted():
    rows = [[{"term": "a", "w": 1.0}, {"term": "b", "w": 0.5}, {"term": "a", "w": 2.0}], [], None, [{"term": "c", "w": 1.0}]]
    got = [sorted((x["term"], x["tf"]) for x in r) for r in stored.counted(pa.array(rows)).to_pylist()]
    assert got == [[("a", 3.0), ("b", 0.5)], [], [], [("c", 1.0)]]
    assert stored.counted(pa.array(rows)[2:]).to_pylist()[1] == [{"term": "c", "tf": 1.0}]
    assert stored.counted(pa.array([[], []], pa.list_(pa.struct([("term", pa.string()), ("w", pa.float64())])))).to_pylist() == [[], []]
