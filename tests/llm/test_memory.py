"""What tasks leave behind in Python workers, which Spark keeps for later stages."""

import pyarrow as pa
import public_tokenizers

from folioscope.llm import bpe, common, decontaminate, quality, simhash
from folioscope.llm.bpe import VOCABULARY


def test_encoders_keep_no_pieces_after_a_task():
    path = public_tokenizers.path(VOCABULARY)
    batch = pa.record_batch({"doc_id": [1, 2], "text": ["several words that are new", "and others"]})
    for make in (bpe._coded, bpe._round_trips):
        out = make(path)(iter([batch]))
        next(out)
        assert len(bpe.bpe(path).known) > len(bpe.bpe(path).special)
        assert list(out) == []
        assert bpe.bpe(path).known == bpe.bpe(path).special_ids
        next(out := make(path)(iter([batch, batch])))
        out.close()  # as when a limit ends a task
        assert bpe.bpe(path).known == bpe.bpe(path).special_ids


def test_tasks_of_the_pipeline_give_memory_back(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    batch = pa.record_batch({"doc_id": [1], "_th": [1], "_id": [1], "node": [1], "text": ["one two three four five six"]})
    model = quality.Model(quality.np.zeros(2 * quality.BUCKETS, "float32"), 0.0)
    runs = [quality._scored(model, "s"), simhash._wide(5), simhash._sets(5), simhash._hashes_of(5), bpe._coded(public_tokenizers.path(VOCABULARY)), bpe._round_trips(public_tokenizers.path(VOCABULARY))]
    for n, run in enumerate(runs, 1):
        assert list(run(iter([batch])))
        assert len(calls) == n
    assert all("lean" in x.__qualname__ for x in (decontaminate._verified(None), simhash._similar(0.8), simhash._crossing(0.8), simhash._tally(1, 5, 3)))
