import re

from parley.llm.licences import Licences, SuffixAutomaton, licence_scan, split_words
from parley.llm.licence_texts import TEMPLATES
from tests.llm.helpers import frame, odd_documents

PHRASES = [(("mit", "license"), "mit"), (("apache", "license"), "apache"), (("general", "public", "license"), "gpl")]


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    found = [(i, label) for p, label in PHRASES for i in range(len(w) - len(p) + 1) if tuple(w[i:i + len(p)]) == p]
    at = [i for i, _ in found]
    return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def test_licence_scan_odd_rows(spark):
    mit = next(t for n, t in TEMPLATES if len(t) > 300 and n == "mit")
    rows = odd_documents() + [
        (900, "Under the MIT\nLicense, mit-license: MIT, License! apache license"), (901, mit), (902, "mit"), (903, "License"),
        (904, mit[:200] + " inserted words here " + mit[200:]), (905, "Licensed under CC BY-NC 4.0."), (906, (mit + "\n") * 40),
        (907, "general public license general public license general public")]
    got = licence_scan(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str) == \
        sorted(((i, *brute(t)) for i, t in rows), key=str)
    by = {r.doc_id: r for r in got}
    assert by[901].labels == "mit" and by[901].score == 1.0 and by[901].base_labels == ""
    assert by[904].labels == "mit" and 0.6 < by[904].score <= 1
    assert by[905].labels == "cc-by-nc" and by[905].score == 1.0
    assert by[900].labels == "apache,mit" and by[907].labels == "gpl"
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert by[4].score == 0 and by[4].labels == ""


def test_licence_scan_empty(spark):
    assert licence_scan(frame(spark, [])).count() == 0


def test_matching_statistics_equal_brute_force():
    import random
    rng = random.Random(4)
    seqs = [[rng.randint(0, 3) for _ in range(n)] for n in (12, 30, 30, 1, 7)]
    seqs.append(seqs[1][:10])
    auto = SuffixAutomaton(seqs)
    subs = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    text = [rng.randint(0, 4) for _ in range(300)]
    for i, (state, n) in enumerate(auto.statistics(text)):
        want = max((m for m in range(i + 2) if m == 0 or tuple(text[i + 1 - m:i + 1]) in subs))
        assert n == want
        if n:
            piece = text[i + 1 - n:i + 1]
            ends = sorted((k, e) for k, s in enumerate(seqs) for e in range(n, len(s) + 1) if s[e - n:e] == piece)
            assert auto.places[state] == ends


def test_chains_follow_the_template():
    model = Licences()
    w = split_words("licensed under the apache license version 2 0")
    import numpy as np
    from parley.llm import tokens as tk
    sym = model.symbols(np.array([tk.hash_word(x) for x in w], np.uint64)).tolist()
    spans = list(model.chains(model.automaton.long_matches(sym, 4), 12))
    assert any(model.labels[k] == "apache" and n == model.sizes[k] for k, _, _, n in spans)


def test_creative_commons_variants_are_told_apart(spark):
    long = "This work is licensed under a Creative Commons {} License."
    want = {
        long.format("Attribution 4.0 International"): "cc-by",
        long.format("Attribution 3.0 Unported"): "cc-by",
        long.format("Attribution (with credit to its author) 4.0 International"): "cc-by",
        long.format("Attribution-ShareAlike 4.0 International"): "cc-by-sa",
        long.format("Attribution-Share Alike 3.0 Unported"): "cc-by-sa",
        long.format("Attribution-NoDerivatives 4.0 International"): "cc-by-nd",
        long.format("Attribution-No Derivative Works 3.0 Unported"): "cc-by-nd",
        long.format("Attribution-NonCommercial 4.0 International"): "cc-by-nc",
        long.format("Attribution-NonCommercial-ShareAlike 4.0 International"): "cc-by-nc-sa",
        long.format("Attribution, NonCommercial and ShareAlike 4.0 International"): "cc-by-nc-sa",
        long.format("Attribution-NonCommercial-NoDerivs 3.0 Unported"): "cc-by-nc-nd",
        long.format("Zero"): "", "This work is licensed under a Creative Commons License.": "",
        "Licensed under CC BY 4.0.": "cc-by", "Licensed under CC BY 3.0.": "cc-by", "Licensed under CC BY-ND 4.0.": "cc-by-nd",
        "Licensed under CC BY-SA 2.0.": "cc-by-sa", "Licensed under CC BY-NC-SA 4.0.": "cc-by-nc-sa", "CC-BY-NC-ND-4.0": "cc-by-nc-nd",
        "Text is licensed under CC BY 4.0. Images are licensed under CC BY-SA 4.0.": "cc-by,cc-by-sa",
    }
    rows = list(enumerate(want))
    got = {r.doc_id: r for r in licence_scan(frame(spark, rows)).collect()}
    assert {t: got[i].labels for i, t in rows} == want
    assert {x.split(":")[0] for x in got[1].spans.split(";")} == {"cc-by"}
