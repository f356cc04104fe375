import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.sentencepieces import Pieces, batches_of, encode_decode, pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


SAMPLES = ["", " ", "  ", "   a", "a  b   c ", "▁", "a▁b", "▁ ▁a", "\n\t\r\n", "\x00", "<s>", "<0x41>", "<unk>", "aaaaaaa", "a" * 5000, "ab" * 3001, "the the", "émoji 😀😀 ①", " " * 77 + "x" + " " * 40,
           "lowerlowerlower", "========", "é" * 501, "1234567890" * 50, "Hello world　x"]


def same(lib, text):
    p = pieces(PATH)
    ids = p.encode([text])[0]
    want = lib.encode(text, add_bos=True, add_eos=True)
    assert ids.tolist() == want
    assert p.decode(ids) == lib.decode(want)


@pytest.mark.parametrize("text", SAMPLES)
def test_samples(lib, text):
    same(lib, text)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="abtheionrs ▁\n", max_size=200), st.text(alphabet="ab ", max_size=60)))
def test_any_text(text):
    same(sentencepiece.SentencePieceProcessor(model_file=PATH), text.encode("utf-8", "replace").decode())


def test_any_ids(lib):
    rng = random.Random(1)
    p = pieces(PATH)
    for _ in range(300):
        ids = [rng.choice([1, 2, rng.randrange(3, 259), rng.randrange(3, 32000)]) for _ in range(rng.randrange(12))]
        assert p.decode(np.array(ids, np.int64)) == lib.decode(ids)


def test_operator(spark, lib):
    rows = [(k, t) for k, t in enumerate(SAMPLES) if "\x00" not in t] + [(None, "x"), (7, "x"), (8, None)]
    out = encode_decode(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as id"), PATH).collect()
    want = sorted((str(i), hashlib.sha256(np.array(lib.encode(t or "", add_bos=True, add_eos=True), "<u4").tobytes()).hexdigest()) for i, t in rows)
    assert sorted((str(r.doc_id), r.ids_sha256) for r in out) == want
    assert all(r.n_tokens == len(r.ids) and hashlib.sha256(r.decoded.encode()).hexdigest() == r.decoded_sha256 for r in out)


def test_workers_keep_no_words_of_ended_tasks(spark):
    def kept(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(pieces(PATH).words)])], ["n"])

    docs = spark.range(4000, numPartitions=8).selectExpr("id as doc_id", "concat('word', id, ' other', id * 7) as text")
    assert encode_decode(docs, PATH, whole=False).count() == 4000
    probes = [r.n for r in spark.range(8, numPartitions=8).mapInArrow(kept, "n long").collect()]
    # a worker that is new has loaded the model, and with it encoded the probes
    assert max(probes) < 100


def test_batches_are_cut_as_texts_come():
    it = iter(["x" * 200_000] * 5)
    assert len(next(batches_of(it))) == 1
    assert len(list(it)) == 3


def test_another_kind_of_model_is_refused(monkeypatch):
    """A library that normalises otherwise, as another model would make it do."""

    class Other(sentencepiece.SentencePieceProcessor):
        def encode(self, texts, **k):
            return super().encode([t.lower() for t in texts], **k)

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Other)
    with pytest.raises(ValueError, match="another way"):
        Pieces(PATH)
