"""Added tokens, which the library finds in the raw text."""

import numpy as np
import pytest

pytest.importorskip("dayloom.llm.registry")

from dayloom.llm import token_files


def test_added_tokens_are_looked_for_in_the_raw_text(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = ["a <|ENDOFTEXT|> b", "a <|endoftext|> b", "x<|StartOfText|>y, z", "<|startoftext|>é", "<|endoftext|", "A B"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: (r.start, list(np.frombuffer(r.ids, "<u4"))) for r in token_files.read_files(spark, token_files.encode_documents(df, path)).collect()}
    start = 0
    for i, t in enumerate(rows):
        want = [*tok.encode(t, add_special_tokens=False).ids, 1]
        assert got[i] == (start, want)
        start += len(want)


def test_another_tokenizer_is_asked_for_every_text(tmp_path):
    import json

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    assert token_files._Words(path, "I").short
    with open(path) as f:
        other = json.load(f)
    other["normalizer"] = None  # keeps capitals
    changed = str(tmp_path / "other.json")
    with open(changed, "w") as f:
        json.dump(other, f)
    texts = ["Some Words, in CAPITALS.", "plain words"]
    tok = Tokenizer.from_file(changed)
    got = [np.frombuffer(x, "<u4").tolist() for x in token_files._ids_of(changed, 1)(texts)]
    assert got == [[*tok.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert not token_files._Words(changed, "I").short
