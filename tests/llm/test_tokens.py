import re

import numpy as np

from parley.llm import tokens as tk
from tests.llm.helpers import odd_documents


def test_words_and_hashes_equal_regular_expressions():
    texts = [t or "" for _, t in odd_documents()]
    data = tk.LOWER[np.frombuffer("".join(texts).encode(), np.uint8)]
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    for kind, pattern in ((tk.NOT_SPACE, rb"[^\x20\x09-\x0D]+"), (tk.ALNUM, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        s, e, row = tk.spans(data, offsets, kind)
        raw = data.tobytes()
        got = [(r, raw[a:b]) for a, b, r in zip(s, e, row)]
        want = [(i, w) for i, t in enumerate(texts) for w in re.findall(pattern, t.encode().lower())]
        assert got == want
        h = tk.hashes(data, s, e)
        by = {}
        for (_, w), x in zip(got, h.tolist()):
            assert by.setdefault(w, x) == x
        assert len(set(by.values())) == len(by)
        some = next(iter(by))
        assert tk.hash_word(some) == by[some]


def test_block_borders_do_not_change_hashes(monkeypatch):
    data = np.frombuffer(b"aa bb " * 1000, np.uint8)
    s, e, _ = tk.spans(data, np.array([0, len(data)]), tk.NOT_SPACE)
    whole = tk.hashes(data, s, e)
    monkeypatch.setattr(tk, "_BLOCK", 64)
    assert (tk.hashes(data, s, e) == whole).all()
    assert len(set(whole.tolist())) == 2
