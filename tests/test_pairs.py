"""What a task of the vector search holds at once."""

import tracemalloc

import numpy as np
import pyarrow as pa

from quillspark.operators import retrieval


def test_pairs_of_a_task_stay_small():
    draw = np.random.default_rng(1)
    plan = type("Sent", (), {"value": retrieval._Asked([(i, [], v) for i, v in enumerate(draw.normal(size=(200, 8)).tolist())])})
    schema = pa.schema([("query_id", pa.int64()), ("uid", pa.string()), ("similarity", pa.float64())])
    vectors = pa.FixedSizeListArray.from_arrays(pa.array(draw.normal(size=80_000)), 8).cast(pa.list_(pa.float64()))
    batch = pa.record_batch([pa.array([f"u{i:05d}" for i in range(10_000)]), pa.array([[]] * 10_000, pa.list_(pa.string())), vectors], names=["uid", "_by", "_v"])
    tracemalloc.start()
    rows = sum(b.num_rows for b in retrieval._nearest(plan, 10, schema)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 2000 and peak < 50_000_000
