"""What a task of the anchored passages holds of its texts."""

import tracemalloc

import pyarrow as pa

from quillspark.operators import segment


def test_texts_are_not_all_python_strings(spark):
    find = segment.anchored("ANCHOR", "START", "END", least=10).func
    body = "é" * 20_000
    texts = pa.array([f"START one START {i} ANCHOR {body} END" for i in range(2000)] + [None, "none"])
    tracemalloc.start()
    found = []
    for part in find(iter([texts])):
        assert len(part) <= segment.PASSAGE_ROWS
        found.append(part)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25_000_000  # all texts and passages together are 80 MB as Python strings
    assert [t for part in found for t in part.to_pylist()] == [f"START {i} ANCHOR {body}".strip() for i in range(2000)] + [None, None]
