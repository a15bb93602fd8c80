"""A worker holds what one operator remembers, and gives it up to the next one."""

import pyarrow as pa

from tracewarden.llm import encoding, worker
from tracewarden.llm.queries import vocabulary


def test_the_next_owner_frees_the_encoder():
    path = vocabulary("byte_bpe_50k.json")
    own = encoding.encoder(path, True)
    before = own.encode(pa.array(["one two three", None]), 1)
    assert encoding._ENCODERS
    worker.claim("something else")
    assert not encoding._ENCODERS
    worker.claim("".join(["something", " else"]))  # an equal name is the same owner
    again = encoding.encoder(path, True)
    assert again is not own
    assert [x.tolist() for x in again.encode(pa.array(["one two three", None]), 1)] == [x.tolist() for x in before]


def test_short_slices_give_the_same_ids(monkeypatch):
    path = vocabulary("byte_bpe_50k.json")
    batch = pa.RecordBatch.from_arrays([pa.array([f"text number {i} " * 40 for i in range(50)])], ["text"])

    def ids():
        return [x for _, _, found in encoding.encoded(iter([batch]), path, True, 1, "text") for x in found.tolist()]

    whole = ids()
    monkeypatch.setattr(encoding, "SLICE_CHARS", 1000)
    assert ids() == whole
