"""PL-1 end to end against a plain-Python version of the rule path, on the
driver's sf0.001 data with the fixture words."""

from difflib import SequenceMatcher

from parley import fixtures as fx
from parley.operators import rules
from parley.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def py_ratio(a, b):
    if not a or not b:
        return 0
    return int(round(100 * SequenceMatcher(None, a, b).ratio()))


def test_rule_record_equals_plain_python(spark):
    words = fx.fixture_words()
    transcripts = {r.conv_id: r.text for r in fx.transcripts(spark, SF).collect()}
    corpus = fx.corpus(spark, SF).collect()
    cache = {r.name: r.text for r in corpus if r.sector == "Marketing"}
    by_sector = {}
    for r in corpus:
        by_sector.setdefault(r.sector, []).append(r.name)

    def describe(name):
        if name in cache:
            return cache[name]
        stem = name.replace(".pdf", "").lower()
        for ws, text in words.description_rules:
            if any(w in stem for w in ws):
                return text
        return words.description_default

    got = {r.conv_id: r for r in QUERIES["rule_followups"](spark, SF).collect()}
    assert set(got) == {k for k, t in transcripts.items() if t.strip()}
    for cid, text in transcripts.items():
        if not text.strip():
            continue
        low = text.lower()
        name = words.client_marker_name if any(
            words.client_marker in line and ":" in line for line in text.split("\n")) else words.client_default
        objection = next((lbl for lbl, ws in words.objection_rules if any(w in low for w in ws)), "none")
        sectors = {s for k, s in words.lexicon if k.lower() in low}
        cands = [(py_ratio(low, n.lower()), n, s) for s in sectors for n in by_sector.get(s, [])]
        cands.sort(key=lambda x: (-x[0], x[1], x[2]))
        pdf1 = cands[0][1] if cands else None
        pdf2 = cands[1][1] if len(cands) > 1 else None
        desc1 = describe(pdf1) if pdf1 else ""
        desc2 = describe(pdf2) if pdf2 else ""
        topic = rules.TOPIC_STORE if words.store_word in text else rules.TOPIC_GENERIC
        r = got[cid]
        assert (r.client_name, r.objection, r.selected_pdf_1, r.selected_pdf_2) == (name, objection, pdf1, pdf2)
        assert (r.pdf1_description, r.pdf2_description) == (desc1, desc2)
        assert r.followup_1 == rules.MESSAGE_1.format(client_name=name, topic=topic, pdf1=pdf1, desc1=desc1)
        assert r.followup_2 == rules.MESSAGE_2.format(client_name=name, topic=topic, pdf2=pdf2, desc2=desc2)
        m3 = rules.MESSAGE_3.get(objection, rules.MESSAGE_3_OTHER)
        assert r.followup_3 == m3.format(client_name=name)
        assert r.followup_4 == rules.MESSAGE_4.format(client_name=name)
