import numpy as np
import pyarrow as pa

from quarrystone.llm import toxicity


def test_a_batch_is_scored_in_slices(monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "scores_of", lambda texts, *_: seen.append(len(texts)) or np.array([len(t) / 1000 for t in texts]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(700)), pa.array([None if k == 3 else "x" * k for k in range(700)])], ["id", "text"])
    found = toxicity.batch_scores(batch, 1)
    assert max(seen) <= 256 and found.tolist() == [0 if k == 3 else k / 1000 for k in range(700)]
    assert len(toxicity.batch_scores(batch.slice(0, 0), 1)) == 0
