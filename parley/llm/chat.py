"""Operator 5, chat formatting by schema fingerprints.

A row's payload is one JSON value in any known layout. The nested field paths
of the value, sorted and hashed, are its fingerprint; the fingerprint selects a
declarative mapping (which paths make turns of which role), and the mapping
gives canonical turns. A registry maps every fingerprint a layout can have
(optional fields present or not), so choosing costs one dictionary lookup.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. Inside a text
backslashes are doubled and a single backslash is put behind the first
character of every control string, so no control string survives in a text and
``unescape`` restores it exactly. Roles are JSON-escaped as well, so that they
hold no newline. The loss mask covers the texts of assistant turns.

Formatting works row by row without a shuffle; a conversation is a sequence of
segments in the written output, never one huge value. Reading back parses the
segments in parallel, and only the digests walk a conversation in order, in a
stream with constant memory, so a conversation of any length is safe.

Defined results: null text and null role are empty; turns come in the order of
turn (null first), then role, then text; a null conversation id is one
conversation; a payload of an unknown layout gives a row with layout 'unknown'
and no turn; an empty table gives an empty result."""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import prepare, written

START, END = "<|im_start|>", "<|im_end|>"

#: Control strings that must not appear in formatted texts (fixed values).
CONTROL = [START, END, "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|eot_id|>", "<|start_header_id|>",
           "<|end_header_id|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<pad>", "<unk>"]
_CONTROL = re.compile("|".join(re.escape(c) for c in sorted(CONTROL, key=len, reverse=True)))
_SEGMENT = re.compile(re.escape(START) + r"([^\n]*)\n(.*)" + re.escape(END) + r"\n", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


@dataclass(frozen=True)
class Part:
    """Turns from one place of a layout. ``items``: path of an array of
    messages ('' for none); ``role``: a fixed role, or with ``role_field`` the
    field that names it; ``texts``: fields joined by an empty line."""
    texts: tuple[str, ...]
    role: str = ""
    role_field: str = ""
    items: str = ""


@dataclass(frozen=True)
class Layout:
    name: str
    needs: tuple[str, ...]
    parts: tuple[Part, ...]
    may: tuple[str, ...] = ()


LAYOUTS = [
    Layout("turn", ("role", "text"), (Part(("text",), role_field="role"),), ("turn", "conv_id")),
    Layout("message", ("role", "content"), (Part(("content",), role_field="role"),), ("name",)),
    Layout("prompt", ("prompt", "response"),
           (Part(("system",), "system"), Part(("prompt",), "user"), Part(("response",), "assistant")), ("system", "id")),
    Layout("completion", ("prompt", "completion"), (Part(("prompt",), "user"), Part(("completion",), "assistant")), ("id",)),
    Layout("question", ("question", "answer"), (Part(("question",), "user"), Part(("answer",), "assistant")), ("id",)),
    Layout("instruction", ("instruction", "output"),
           (Part(("system",), "system"), Part(("instruction", "input"), "user"), Part(("output",), "assistant")),
           ("input", "system", "id")),
    Layout("messages", ("messages[].role", "messages[].content"), (Part(("content",), role_field="role", items="messages"),),
           ("id", "messages[].name")),
    Layout("shares", ("conversations[].from", "conversations[].value"),
           (Part(("value",), role_field="from", items="conversations"),), ("id",)),
]

#: Role names of other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant"}


def paths(value, at: str = "") -> set[str]:
    """Nested field paths of the leaves; an array adds [] to its path."""
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{at}.{k}" if at else k) for k, v in value.items())) if value else {at}
    if isinstance(value, list):
        return set().union(*(paths(v, at + "[]") for v in value)) if value else {at + "[]"}
    return {at}


def fingerprint(found: set[str]) -> str:
    return hashlib.blake2b("\n".join(sorted(found)).encode(), digest_size=8).hexdigest()


def registry(layouts: list[Layout]) -> dict[str, Layout]:
    """Every fingerprint that a layout can have."""
    out = {}
    for lay in layouts:
        for n in range(len(lay.may) + 1):
            for extra in itertools.combinations(lay.may, n):
                out[fingerprint({*lay.needs, *extra})] = lay
    return out


def _text(v) -> str:
    return "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def turns_of(value, layout: Layout) -> Iterator[tuple[str, str]]:
    for part in layout.parts:
        for item in (value.get(part.items) or []) if part.items else [value]:
            texts = [_text(item.get(t)) for t in part.texts if t in item]
            if not texts:
                continue
            role = _text(item.get(part.role_field)) if part.role_field else part.role
            yield ROLES.get(role, role) if layout.name == "shares" else role, "\n\n".join(t for t in texts if t)


def segment(role: str, text: str) -> str:
    return f"{START}{json.dumps(escape(role), ensure_ascii=False)[1:-1]}\n{escape(text)}{END}\n"


def parse(seg: str) -> tuple[str, str]:
    m = _SEGMENT.fullmatch(seg)
    return unescape(json.loads(f'"{m[1]}"')), unescape(m[2])


def format_chats(rows: DataFrame, conv_col: str = "conv_id", order_col: str = "turn", payload_col: str = "payload",
                 layouts: list[Layout] | None = None) -> DataFrame:
    """Formatted segments: conv_id, turn, part, layout, fingerprint, segment,
    loss_start, loss_end (code points of the segment under the loss mask). One
    row per turn; a payload without turns gives one row with a null segment."""
    prepare(rows.sparkSession)
    table = registry(LAYOUTS if layouts is None else layouts)
    src = rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(order_col).cast("long").alias("turn"),
                      F.col(payload_col).alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out = [], []
            for i, raw in enumerate(b.column(2).to_pylist()):
                try:
                    value = json.loads(raw) if raw is not None else None
                except ValueError:
                    value = None
                print_ = fingerprint(paths(value)) if value is not None else ""
                lay = table.get(print_)
                n = 0
                for n, (role, text) in enumerate(turns_of(value, lay) if lay else (), 1):
                    seg = segment(role, text)
                    end = len(seg) - len(END) - 1
                    begin = end - len(escape(text))
                    learn = role == "assistant"
                    at.append(i)
                    out.append((n - 1, lay.name, print_, seg, begin if learn else 0, end if learn else 0))
                if not n:
                    at.append(i)
                    out.append((0, lay.name if lay else "unknown", print_, None, 0, 0))
            cols = list(zip(*out)) or [()] * 6
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(take), b.column(1).take(take), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()),
                pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.int64()),
                pa.array(cols[5], pa.int64())],
                names=["conv_id", "turn", "part", "layout", "fingerprint", "segment", "loss_start", "loss_end"])

    return src.mapInArrow(run, "conv_id long, turn long, part int, layout string, fingerprint string, segment string, "
                               "loss_start long, loss_end long")


def read_back(formatted: DataFrame) -> DataFrame:
    """Role and text of each formatted segment, with its masked text."""
    src = formatted.where("segment IS NOT NULL").select("conv_id", "turn", "part", "segment", "loss_start", "loss_end")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            segs = b.column(3).to_pylist()
            got = [parse(s) for s in segs]
            loss = [unescape(s[x:y]) if y > x else ("" if y else None)
                    for s, x, y in zip(segs, b.column(4).to_pylist(), b.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(1), b.column(2), pa.array([r for r, _ in got], pa.string()),
                pa.array([t for _, t in got], pa.string()), pa.array(loss, pa.string()),
                pa.array([len(s) for s in segs], pa.int64())],
                names=["conv_id", "turn", "part", "role", "text", "loss", "chars"])

    return src.mapInArrow(run, "conv_id long, turn long, part int, role string, text string, loss string, chars long")


def digests(turns: DataFrame) -> DataFrame:
    """One row per conversation: digests over its turns in order, streamed
    with constant memory."""
    order = ["conv_id", "turn", "role", "text", "part"]
    src = turns.select("conv_id", "role", "text", "loss", "chars", "turn", "part").repartition("conv_id").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        now, n, all_, loss_n, loss, chars = None, 0, None, 0, None, 0

        def rows(done):
            cols = list(zip(*done)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

        for b in batches:
            done = []
            for conv, role, text, masked, size in zip(*(b.column(i).to_pylist() for i in range(5))):
                if all_ is None or conv != now:
                    if all_ is not None:
                        done.append((now, n, all_.hexdigest(), loss_n, loss.hexdigest(), chars))
                    now, n, all_, loss_n, loss, chars = conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0
                n += 1
                all_.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                chars += size
                if masked is not None:
                    loss_n += len(masked)
                    loss.update(masked.encode("utf-8", "surrogatepass"))
            yield rows(done)
        if all_ is not None:
            yield rows([(now, n, all_.hexdigest(), loss_n, loss.hexdigest(), chars)])

    return src.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                               "formatted_chars long")


def chat_digests(rows: DataFrame) -> DataFrame:
    """Format, write, read back and digest conversations given as rows of
    conv_id, turn and payload."""
    return digests(read_back(written(format_chats(rows), "formatted-chats")))
