import hashlib
import json

from hypothesis import given, settings
from hypothesis import strategies as st

from parley.llm import chat

CTRL = st.sampled_from([*chat.CONTROL, "\\", "<", "[", "|>", "\n", "/INST]", "s>", "é"])


@settings(max_examples=300, deadline=None)
@given(st.lists(CTRL | st.text(max_size=4), max_size=12).map("".join))
def test_escape_is_reversible_and_hides_control_strings(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text
    assert not any(c in hidden for c in chat.CONTROL)
    assert chat.parse(chat.segment(text, text)) == (text, text)


def test_layouts_give_canonical_turns(spark):
    rows = [
        {"role": "user", "text": "q"}, {"prompt": "q", "response": "a"}, {"system": "s", "prompt": "q", "response": "a"},
        {"instruction": "do", "input": "x", "output": "a"}, {"instruction": "do", "output": None},
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "id": 3}, {"strange": 1}, [], {}]
    data = [(i, 0, json.dumps(r)) for i, r in enumerate(rows)] + [(90, 0, "{broken"), (91, 0, None)]
    got = chat.format_chats(spark.createDataFrame(data, "conv_id long, turn long, payload string"))
    back = {}
    for r in got.orderBy("conv_id", "part").collect():
        back.setdefault(r.conv_id, []).append((r.layout, *(chat.parse(r.segment) if r.segment else (None, None))))
    assert back[0] == [("turn", "user", "q")]
    assert back[1] == [("prompt", "user", "q"), ("prompt", "assistant", "a")]
    assert back[2][0] == ("prompt", "system", "s") and len(back[2]) == 3
    assert back[3] == [("instruction", "user", "do\n\nx"), ("instruction", "assistant", "a")]
    assert back[4] == [("instruction", "user", "do"), ("instruction", "assistant", "")]
    assert back[5] == [("messages", "user", "q"), ("messages", "assistant", "a")]
    assert back[6] == [("shares", "user", "q"), ("shares", "assistant", "a")]
    assert all(back[i][0][0] == "unknown" for i in (7, 8, 9, 90, 91))


def test_digests_equal_plain_python(spark):
    said = "</s>[INST] ok [/INST]"
    turns = [(1, 0, "user", said), (1, 1, "assistant", said), (1, 1, "assistant", ""), (2, 5, "system", ""), (2, None, "user", "é\\"),
             (None, 0, "assistant", "lone"), (3, 0, "user", "x" * 100_000), (3, 1, "assistant", "y\n" * 5000), (3, 1, "assistant", "y\n" * 5000)]
    data = [(c, t, json.dumps({"role": r, "text": x})) for c, t, r, x in turns]
    got = {r.conv_id: r for r in chat.chat_digests(spark.createDataFrame(data, "conv_id long, turn long, payload string")).collect()}
    for conv in {t[0] for t in turns}:
        mine = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2], t[3]))
        whole = "".join(f"{r}\n{x}\n" for _, _, r, x in mine)
        loss = "".join(x for _, _, r, x in mine if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars) == (len(mine), len(loss))
        assert r.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars == sum(len(chat.segment(a, b)) for _, _, a, b in mine)


def test_no_conversation(spark):
    assert chat.chat_digests(spark.createDataFrame([], "conv_id long, turn long, payload string")).count() == 0
