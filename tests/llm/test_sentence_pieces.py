import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from parley.llm import sentence_pieces as sp
from tests.llm.helpers import driver, frame, odd_documents

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PARTS = [*" ▁\t\n\r\x00aeiouABst<>/.,'019x", "é", "é", "ﬁ", "①", "梦", "ع", "​", "﻿", " ", "　", "😀", "̀", "<s>", "</s>",
         "<0x0A>", "the ", "ing", "  ", "    ", "▁▁"]


def encoded(enc, texts):
    raw = [t.encode() for t in texts]
    ids, n = enc.ids(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("keep", [sp.KEEP_BYTES, 200])
def test_agenda_equals_the_library(monkeypatch, keep):
    monkeypatch.setattr(sp, "KEEP_BYTES", keep)
    enc, library = sp.PieceEncoder(MODEL), SentencePieceProcessor(model_file=MODEL)
    texts = odd_texts(3000) + [d["text"] or "" for d in driver("documents")] + ["x" * 20_000, "ab" * 5000, "梦" * 3000, " " * 999]
    for lo in range(0, len(texts), 300):
        part = texts[lo:lo + 300]
        own = encoded(enc, part)
        assert own == library.encode(part)
        assert [enc.words.decode(np.array(x, np.int64)) for x in own] == library.decode(own)


def test_whole_texts_without_cuts_give_the_same_ids():
    enc = sp.PieceEncoder(MODEL)
    texts = odd_texts(500, 2)
    units = encoded(enc, texts)
    enc.cut = sp.one_unit
    enc._forget()
    assert encoded(enc, texts) == units


def test_any_ids_decode_as_in_the_library():
    words, rng = sp.Vocabulary(MODEL), random.Random(4)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(32_000), rng.randrange(3, 259), rng.randrange(3), 28705, 259]) for _ in range(rng.randint(0, 12))]
        assert words.decode(np.array(ids, np.int64)) == words.library.decode(ids), ids


def test_the_best_score_is_merged_first_and_the_leftmost_among_equals():
    words = sp.Vocabulary(MODEL)
    words.score = {"ab": -2.0, "bc": -1.0, "aa": -3.0, "aaa": -4.0}
    assert words.merged("abc") == ["a", "bc"]
    assert words.merged("aaaa") == ["aa", "aa"]
    assert words.merged("aaa") == ["aaa"]
    assert words.merged("") == []


@pytest.mark.parametrize("row,rows", [(sp.ROW, sp.ROWS), (5, 2), (0, 7)])
def test_tables_of_parts_equal_the_heap(monkeypatch, row, rows):
    monkeypatch.setattr(sp, "ROW", row)
    monkeypatch.setattr(sp, "ROWS", rows)
    words = sp.Vocabulary(MODEL)
    texts = [t.replace(" ", sp.SPACE) for t in odd_texts(300, 5) if t] + ["internationalisation", "x", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"]
    for text, ids in zip(texts, words.encode_words(texts)):
        want = []
        for piece in words.merged(text):
            want += [words.ids[piece]] if piece in words.ids else [words.byte_ids[b] for b in piece.encode()]
        assert ids.tolist() == want, text


def test_query_columns_over_odd_documents(spark):
    rows, library = odd_documents() + [(200 + i, t) for i, t in enumerate(odd_texts(50, 3))], SentencePieceProcessor(model_file=MODEL)
    got = sp.piece_digests(sp.sentence_pieces(frame(spark, rows).repartition(3), MODEL))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agrees"]

    def digests(i, t):
        ids = library.encode(t or "")
        return (i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                hashlib.sha256(library.decode(ids).encode()).hexdigest(), True)

    assert sorted(map(tuple, got.collect()), key=repr) == sorted((digests(*r) for r in rows), key=repr)


def test_empty_table_and_text_ids(spark):
    assert sp.sentence_pieces(frame(spark, []), MODEL).collect() == []
    docs = spark.createDataFrame([("a", "x y"), (None, None)], "doc_id string, text string")
    got = {r.doc_id: (r.ids, r.decoded, r.agrees) for r in sp.sentence_pieces(docs, MODEL).collect()}
    assert got[None] == ([], "", True) and got["a"][1:] == ("x y", True)


def test_other_kinds_of_models_are_refused(tmp_path):
    from sentencepiece.sentencepiece_model_pb2 import ModelProto
    for change in (lambda m: setattr(m.trainer_spec, "model_type", m.trainer_spec.UNIGRAM),
                   lambda m: setattr(m.normalizer_spec, "add_dummy_prefix", False),
                   lambda m: setattr(m.pieces[300], "type", 4)):
        model = ModelProto()
        with open(MODEL, "rb") as f:
            model.ParseFromString(f.read())
        change(model)
        path = tmp_path / "other.model"
        path.write_bytes(model.SerializeToString())
        with pytest.raises(ValueError):
            sp.Vocabulary(str(path))
