import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from parley.llm import encoding
from parley.llm.encoding import Encoder
from parley.llm.packing import pack
from parley.llm.token_files import mapped, read_token_files, write_token_files
from tests.llm.helpers import driver, frame, odd_documents

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD_SPACES = ["", " ", "  ", " a", "a ", "a  b", "a\n b", "a \nb", "a\n\nb", "a\t b", "a \t b", "a  b", "a  b", "a b",
              "x\x1c y", "a '", "it's  's", "a <|endoftext|> b", "a<|endoftext|>b", "<|endoftext|>", "e ́e", "ΟΔΟΣ ΣΑ", "İ I",
              "a " * 50, "1 23  4", "…— “q” ", "\r\n x", "a\x0b b", "a\x85 b"]


@pytest.mark.parametrize("path,cut", [(WORD, "word"), (BYTE, "spaced")])
def test_pieces_give_the_ids_of_the_whole_text(path, cut):
    whole = Tokenizer.from_file(path)
    texts = ODD_SPACES + [t or "" for _, t in odd_documents()] + [d["text"] or "" for d in driver("documents")]
    enc = Encoder(path, cut)
    for t, got in zip(texts, enc.encode(texts)):
        assert np.frombuffer(got, enc.dtype).tolist() == whole.encode(t, add_special_tokens=False).ids, t[:50]


@pytest.mark.parametrize("path,cut", [(WORD, "word"), (BYTE, "spaced")])
def test_words_of_equal_hash_get_their_own_ids(path, cut):
    word = "a"
    while len(word) < 1024:  # Thue-Morse: the polynomial hash of the complement is the same
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    whole, enc = Tokenizer.from_file(path), Encoder(path, cut)
    for texts in ([f"x {word} {other} y"], [f"{other} z", f" {word}", "end"], [f"{other}\n {other} {word}"]):
        for t, got in zip(texts, enc.encode(texts)):
            assert np.frombuffer(got, enc.dtype).tolist() == whole.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("length", [2048, 7])
def test_pack_covers_every_id_once(spark, length):
    rows = odd_documents()
    enc = Tokenizer.from_file(WORD)
    got = pack(frame(spark, rows).repartition(5), WORD, length=length).collect()
    want = sorted([*enc.encode(t or "", add_special_tokens=False).ids, 1] for _, t in rows)
    at = sorted((r.sequence_id * length + r.offset, r) for r in got)
    assert at[0][0] == 0 and all(a + r.length == b for (a, r), (b, _) in zip(at, at[1:]))  # gapless
    assert all(r.offset + r.length <= length for r in got)
    docs, now = [], []
    for _, r in at:
        ids = np.frombuffer(r.ids, "<u2").astype("<u4")
        assert r.start == len(now) and r.ids_crc32 == zlib.crc32(ids.tobytes()) and r.length == len(ids)
        now += ids.tolist()
        if len(now) == r.doc_tokens:
            docs.append(now)
            now = []
    assert not now and sorted(docs) == want


def test_pack_empty(spark):
    assert pack(frame(spark, []), WORD).count() == 0


def test_token_files_round_trip(spark):
    rows = odd_documents()
    enc = Tokenizer.from_file(BYTE)
    manifest = write_token_files(frame(spark, rows).repartition(4), BYTE)
    got = read_token_files(manifest).orderBy("start").collect()
    pos = 0
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append([*enc.encode(t or "", add_special_tokens=False).ids, 0])
    for r in got:
        mine = [x for x in ids[r.doc_id] if zlib.crc32(np.array(x, "<u4").tobytes()) == r.ids_crc32]
        assert mine and r.start == pos and r.n_tokens == len(mine[0])
        pos += r.n_tokens
    assert len(got) == len(rows)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    part = manifest.orderBy("part").first()
    assert mapped(f"{part['name']}.bin", f"<u{part['width']}", part["n_tokens"]).dtype == np.dtype("<u2")


def test_token_files_empty(spark):
    assert read_token_files(write_token_files(frame(spark, []), BYTE)).count() == 0


def test_token_files_are_read_by_many_tasks(spark):
    """The manifest is a few kB, and still each file has a task of its own."""
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    manifest = write_token_files(docs, BYTE)
    read = read_token_files(manifest)
    tasks = {r.at for r in read.selectExpr("spark_partition_id() AS at").collect()}
    assert manifest.count() == len(tasks) > 1


@pytest.mark.parametrize("keep,longest", [(0, 64), (20_000, 3), (64 << 20, 0)])
def test_the_kept_pieces_are_bounded(monkeypatch, keep, longest):
    monkeypatch.setattr(encoding, "KEEP_BYTES", keep)
    monkeypatch.setattr(encoding, "LONGEST", longest)
    whole, enc = Tokenizer.from_file(BYTE), Encoder(BYTE, "spaced")
    for lo in range(0, 3000, 100):
        texts = [f"word{lo + i} {'x' * (i * 7)} the the {'long' * 40}" for i in range(100)]
        for t, got in zip(texts, enc.encode(texts)):
            assert np.frombuffer(got, enc.dtype).tolist() == whole.encode(t, add_special_tokens=False).ids
        assert enc.kept_bytes() <= keep + 30_000 and np.diff(enc.text_at).max(initial=0) <= longest
