"""Encoding and decoding against the sentencepiece library, id by id and character by character."""

import hashlib

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import sentence_pieces as P
from quarry.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
MODEL = P.model_of(open(PATH, "rb").read())

TEXTS = [
    "", " ", "  ", "a", " a", "a ", "▁x", "▁▁ ▁y", "\0a\0", "<s>hi</s>", "<unk> <0x41>", "日本語😀 ẞ​", "a\tb\r\nc\n\n\n d", "ab" * 700, "a" * 5000, "x" + " " * 1000 + "the", " " * 33, " " * 32 + "the",
    *[" " * n + "in" for n in range(14, 36)], *["." * n + " " + "=" * n for n in range(1, 70, 3)], "deadbeef0123456789ABCDEF" * 40, "ининин" * 50, "퟿\U0010ffff", "word " * 3000, "the　the   x", "aaaaabaaaab" * 30,
]


def check(texts):
    ids = P.encode_texts(MODEL, pa.array(texts, pa.string()))
    theirs = LIBRARY.encode([t or "" for t in texts], add_eos=True)
    assert ids.to_pylist() == theirs
    assert P.decode_ids(MODEL, ids).to_pylist() == [LIBRARY.decode(i) for i in theirs]


def test_odd_texts():
    check([*TEXTS, None])
    for text in TEXTS:
        check([text])
    check([])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" ▁aeinorst\n.-=0日é😀"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=6))
def test_any_texts(texts):
    check(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31999)), max_size=20), max_size=5))
def test_any_ids(ids):
    assert P.decode_ids(MODEL, pa.array(ids, pa.list_(pa.int32()))).to_pylist() == [LIBRARY.decode(i) for i in ids]


def test_pieces_in_sequence():
    """Texts made of pieces of the vocabulary, joined without spaces: long chains of competing merges."""
    pieces = [p.replace(P.SPACE, " ") for p in MODEL.pieces[259:]]
    check(["".join(pieces[k : k + 40]) for k in range(0, len(pieces), 40)])
    check(["".join(pieces[k :: 997]) for k in range(300)])


def test_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    ids = LIBRARY.encode([r["text"] or "" for r in rows], add_eos=True, num_threads=1)
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    want = {(r["doc_id"], len(i), sha(" ".join(map(str, i))), sha(LIBRARY.decode(i))) for r, i in zip(rows, ids, strict=True)}
    found = QUERIES["op11_sentence_pieces"](spark, SF)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(rows)


def test_odd_rows(spark, odd, empty):
    model = P.read_model(spark, PATH)
    with pytest.raises(ValueError, match="such a column"):
        P.encode(odd, model)
    found = P.decode(P.encode(odd, model, to="pieces"), model, "pieces")
    assert found.columns == [*odd.columns, "pieces", "decoded"]
    for r in found.collect():
        assert r["pieces"] == LIBRARY.encode(r["text"] or "", add_eos=True) and r["decoded"] == (r["text"] or "") and r["tag"] == "clash"
    assert found.count() == odd.count()
    assert P.decode(P.encode(empty, model), model).count() == 0
    assert P.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id int, ids array<int>"), model).select("decoded").collect() == [("",), ("",)]


def test_slabs_of_a_batch(spark, monkeypatch):
    monkeypatch.setattr(P, "SLAB_BYTES", 64)
    docs = spark.createDataFrame([(k, text) for k, text in enumerate(TEXTS)], "doc_id int, text string").coalesce(1)
    model = P.read_model(spark, f"file://{PATH}")
    for r in P.decode(P.encode(docs, model, end=False), model).collect():
        assert r["ids"] == LIBRARY.encode(r["text"]) and r["decoded"] == LIBRARY.decode(r["ids"])


def test_refused_models():
    with pytest.raises(ValueError, match="not BPE"):
        P.model_of(b"")
