from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import common, pii, quality_classifier

ROWS = 2_500


def body_of(stage):
    """What a stage gives to ``mapInArrow``."""
    return stage(SimpleNamespace(mapInArrow=lambda run, _: run, schema=None))


@pytest.mark.parametrize("stage", [pii.redact_documents, lambda docs: quality_classifier.keep_good(docs, SimpleNamespace(score=lambda x: np.ones(len(x))))])
def test_a_stage_works_on_few_rows_at_a_time_and_gives_memory_back(stage, monkeypatch):
    freed = []
    monkeypatch.setattr(common, "release", lambda: freed.append(1))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(ROWS)), "text": [None, "", "call me"] + ["a line of words"] * (ROWS - 3)})
    out = list(body_of(stage)(iter([batch, batch.slice(0, 0), batch])))
    assert max(b.num_rows for b in out) <= 1_000
    assert pa.Table.from_batches(out).to_pydict() == pa.Table.from_batches([batch, batch]).to_pydict()
    assert len(freed) >= 3  # after each batch, and at the end


def test_release_gives_arrow_memory_back():
    def held():
        return sum(int(line.split()[1]) for line in open("/proc/self/smaps_rollup") if line.startswith("Pss_Anon"))

    common.release()
    before = held()
    parts = [pa.array(np.arange(8_192)) for _ in range(2_000)]
    copies = [pa.concat_arrays([p, p]) for p in parts]
    most = held()
    del parts, copies
    common.release()
    assert most - before > 150_000 and held() - before < 30_000  # kB
