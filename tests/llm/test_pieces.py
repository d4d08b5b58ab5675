"""SentencePiece ids and decoding against the library on whole texts."""

import hashlib
import random

import numpy as np
import pytest

from nestgrain.llm import pieces, pieces_query

ODD = ["", " ", "  ", "a", " a", "a ", "  a  b ", "\n", " \n \n", "a▁b", "▁", "▁▁x ", "<s>a</s>", "\x00a", "café ﬁ \U0001f600\U0001f600 中文",
       "tab\tstop\r\nline", "1234 5,6", "x" * 5000, "é ​ z", "   "]


def library(texts):
    model = pieces.load_model(pieces_query.model_path())
    for text in texts:
        ids = model.encode(text or "", add_bos=True, add_eos=True)
        yield ids, model.decode(ids)


def fuzz(n):
    rng = random.Random(5)
    letters = "abcdeé ,.▁  \n\t0<中\U0001f600"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


def test_ids_and_texts_equal_the_library(spark, docs_of, monkeypatch):
    monkeypatch.setattr(pieces, "BLOCK_BYTES", 700)
    texts = ODD + fuzz(400) + [None, "a b", "a b"]
    got = {r["doc_id"]: r for r in pieces.encoded(docs_of(list(enumerate(texts))), pieces_query.model_path(), keep=True).collect()}
    assert len(got) == len(texts)
    for i, (ids, decoded) in enumerate(library(texts)):
        row = got[i]
        assert np.frombuffer(row["ids"], "<u4").tolist() == ids and row["decoded"] == decoded and row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_whole_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {(r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
            for r, (ids, text) in zip(rows, library([r["text"] for r in rows]))}
    assert {tuple(r) for r in pieces_query.op13_pieces(spark, sf_dir).collect()} == want


def test_empty_table_and_equal_ids(spark, docs_of):
    assert pieces.encoded(docs_of([]), pieces_query.model_path()).collect() == []
    assert pieces.encoded(docs_of([(1, "a"), (1, "a"), (None, None)]), pieces_query.model_path()).count() == 3


def test_stored_blocks_are_not_shuffled(spark, docs_of):
    out = pieces.encoded(docs_of([(1, "a b"), (2, "b c")]), pieces_query.model_path())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(block") == 1  # the ids; the numbered texts stay in their buckets
    assert {r["doc_id"] for r in out.collect()} == {1, 2}
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("nestgrain_")]


def test_chunks_cover_the_text():
    for text in ODD + fuzz(200):
        assert "".join(pieces.MARKER + k for k in pieces.chunk_keys(text)) == ((pieces.MARKER + text).replace(" ", pieces.MARKER) if text else "")


def test_models_with_crossing_pieces_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(pieces_query.model_path(), "rb") as file:
        proto.ParseFromString(file.read())
    proto.pieces[300].piece = f"of{pieces.MARKER}the"
    path = tmp_path / "crossing.model"
    path.write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError, match="crosses words"):
        pieces.load_model(str(path))
