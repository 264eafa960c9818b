"""Tokenizer plug-ins, artifacts and rendering."""

import json

import pytest

from tessera.functions.tokenizer import BPETokenizer, ByteTokenizer, rendered
from tessera.operators import bpe

TEXTS = ["the cat, the hat", "Ünïcode 🚀\n\n x", "", "aaaaaa"]


def test_artifacts(tmp_path):
    t = BPETokenizer(bpe.train({tuple(b"the cat"): 5, tuple(b"aaaa"): 2}, 6))
    t.save(str(tmp_path))
    again = BPETokenizer.load(str(tmp_path))
    assert again.identity == t.identity and all(again.decode(again.encode(x)) == x for x in TEXTS)
    bad = json.loads((tmp_path / "vocab.json").read_text())
    (tmp_path / "vocab.json").write_text(json.dumps(bad | {"256": "00"}))
    with pytest.raises(ValueError, match="agree"):
        BPETokenizer.load(str(tmp_path))


def test_columns(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    t = BPETokenizer(bpe.train({tuple(b"the cat"): 5, tuple(b"aaaa"): 2}, 6))
    for own in (t, ByteTokenizer()):
        assert {r.doc_id: r.ids for r in own.encoded(docs).collect()} == {i: own.encode(x) for i, x in enumerate(TEXTS)}
    assert ByteTokenizer().decode([256, 65, 255]) == "<|bos|>A�"


def test_rendering():
    text = lambda role, *parts: {"role": role, "parts": [{"type": k, "text": v} for k, v in parts]}
    ids, mask = rendered([text("system", ("text", "s")), text("user", ("text", "u")), text("assistant", ("text", "a"), ("python", "1"), ("python_output", "2"))], ByteTokenizer())
    assert ids == [256, 257, 115, 10, 10, 117, 258, 259, 97, 261, 49, 262, 263, 50, 264, 260]
    assert [i for i, m in zip(ids, mask) if m] == [97, 261, 49, 262, 260]
