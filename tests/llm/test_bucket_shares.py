"""Windows are dealt evenly to buckets."""

import json

import numpy as np
import pyarrow as pa
import pytest

from convoke.llm import substring
from convoke.plans.tables import put_once, shared


def test_no_bucket_gets_much_more_than_its_share() -> None:
    words = np.random.default_rng(3).integers(0, 1 << 40, (200, 300))
    texts = [" ".join(map(str, x)) for x in words.tolist()]
    part = pa.RecordBatch.from_pydict({"d": pa.array(range(200), pa.int64()), "t": pa.array([0] * 200, pa.int32()), "text": pa.array(texts)})
    sizes = np.zeros(16)
    for rows in substring._dealt(part, 20, 10, 16):
        for bucket, h in zip(rows.column("bucket").to_pylist(), rows.column("h").to_pylist(), strict=True):
            sizes[bucket] += len(h) / 8
    assert sizes.sum() == 200 * 281
    assert sizes.max() < 1.5 * sizes.mean()


def test_an_index_dealt_in_another_way_is_refused(spark) -> None:
    path = shared(spark)
    put_once(spark, f"{path}/RUNS.0", json.dumps({"window": 20, "anchor": 10, "tasks": 4, "buckets": 16, "runs": []}))
    with pytest.raises(ValueError, match="anew"):
        substring.FingerprintIndex(spark, path)
