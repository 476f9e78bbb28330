import hashlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import LONG, SF, matches_sql
from tidemark.llm import chat
from tidemark.llm.queries import ORACLES, PLANTED_TURNS, QUERIES

TEMPLATE = chat.ChatTemplate()


@pytest.fixture(scope="module")
def vocabulary():
    return chat.Vocabulary.load()


PARTS = st.one_of(st.sampled_from([*TEMPLATE.controls, *TEMPLATE.guarded(), "\\", "\\\\", "\n", " "]), st.text(max_size=6))
TEXTS = st.lists(PARTS, max_size=6).map("".join)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_escape_is_undone_and_hides_every_control(text):
    hidden = TEMPLATE.escape(text)
    assert TEMPLATE.unescape(hidden) == text
    for control in TEMPLATE.guarded():
        at = hidden.find(control)
        while at >= 0:
            before = hidden[:at]
            assert (len(before) - len(before.rstrip("\\"))) % 2 == 1
            at = hidden.find(control, at + 1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), TEXTS), TEXTS), min_size=1, max_size=4))
def test_turns_are_read_back(vocabulary, turns):
    ids, masks = chat.assemble([r for r, _ in turns], [t for _, t in turns], vocabulary, TEMPLATE)
    for (role, text), i, m in zip(turns, ids, masks):
        read = chat.read_turn(i.tolist(), m.tolist(), vocabulary, TEMPLATE)
        assert read[:3] == (role, text, text if role == "assistant" else "")
        assert len(i) == len(m) and (i[[0, -1]] >= vocabulary.size).all()
        encoded = vocabulary.encoding.encode_ordinary(TEMPLATE.escape(text))
        assert i[len(i) - 1 - len(encoded) : -1].tolist() == encoded
        assert m.sum() == (len(encoded) if role == "assistant" else 0)


def expected(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        turns[conv].append((turn, role or "", text or ""))
    out = {}
    for conv, parts in turns.items():
        parts.sort(key=lambda p: (p[0] is not None, p[0] or 0, p[1], p[2]))
        learned = "".join(t for _, r, t in parts if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for _, r, t in parts)
        out[conv] = (len(parts), hashlib.sha256(whole.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


def test_query_matches_sql(spark):
    matches_sql(QUERIES["op4_chat_formatting"](spark, SF), ORACLES["op4_chat_formatting"], SF)


def test_hard_rows(spark, vocabulary):
    rows = [
        *PLANTED_TURNS, (1, 0, None, None), (1, 1, "assistant", None), (1, None, "tool", "x"), (2, 0, "assistant", LONG), (3, 0, "a ###: b", "c\\"),
        (4, 0, "assistant", "twice"), (4, 0, "assistant", "twice"), (None, 0, "user", "none"), (5, 0, "assistant", "y" * 200_000),
    ]
    rows += [(6, k, "assistant" if k % 2 else "user", f"turn {k} </turn>") for k in range(3000)]
    table = spark.createDataFrame([(*r, "c", "d") for r in rows], "conv_id bigint, turn bigint, role string, text string, ids string, mask string").repartition(5)
    read = chat.read_turns(chat.format_turns(table, vocabulary), vocabulary)
    found = {r.conv_id: tuple(r)[1:5] for r in chat.digest_conversations(read).collect()}
    assert found == expected(rows)
    empty = table.limit(0)
    assert chat.digest_conversations(chat.read_turns(chat.format_turns(empty, vocabulary), vocabulary)).count() == 0


def test_mask_is_a_prefix_sum_over_segments(vocabulary):
    ids, masks = chat.assemble(["assistant"], ["one two"], vocabulary, TEMPLATE)
    assert masks[0].tolist() == [0, 1, 1, 0] and np.count_nonzero(ids[0] >= vocabulary.size) == 2
