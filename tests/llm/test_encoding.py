"""Batch encoding against the tokenizer itself."""

import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tracewarden.llm import encoding
from tracewarden.llm.queries import vocabulary

ODD = [
    "", " ", "word", "word.", "Word., ", "WORD word Word wOrD.!? x9. 9. 9.. a.b. .", "don't can't. it's, we'll!", "a  b", " lead", "trail ", "tab\tand\nline\r\n",
    "É È ÀÉ. naïve, İstanbul ΣΑΣ. ΑΣ, ß.", "é. É, ö", "日本語 テスト。 中文.", " x  y", "<|endoftext|> a <|ENDOFTEXT|>. b<|endoftext|>.", "x" * 400 + ". y", "1,2,3. 10.", "...", "?! word:;", "\U0001f600. ok\U0001f600.",
    "a</w> b</w>. </w>", "Ġword Ġ. Ċ",
]


@pytest.mark.parametrize("name,spaced", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
@pytest.mark.parametrize("room", [1_000_000, 300])
def test_ids_are_those_of_the_tokenizer(name, spaced, room, monkeypatch):
    monkeypatch.setattr(encoding, "CACHE_PIECES", room)
    rng = random.Random(5)
    own, plain = encoding.Encoder(vocabulary(name), spaced), Tokenizer.from_file(vocabulary(name))
    bits = [w for t in ODD for w in t.split(" ")] + [f"w{i}" for i in range(300)]
    for _ in range(6):
        texts = [*ODD, None, *(" ".join(rng.choice(bits) + rng.choice(["", "", ".", ",", "?!"]) for _ in range(rng.randrange(60))) for _ in range(40))]
        starts, ids = own.encode(pa.array(texts), 7)
        for i, text in enumerate(texts):
            assert ids[starts[i]:starts[i + 1]].tolist() == [*plain.encode(text or "", add_special_tokens=False).ids, 7], text
    assert np.all(np.diff(starts) > 0)
