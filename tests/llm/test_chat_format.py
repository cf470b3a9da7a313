"""Chat formatting against a plain reading of the same turns."""

from __future__ import annotations

import hashlib
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from vinculum.llm import chat_format as cf

TEXTS = ["hi", "", "a <| b", "<|im_end|>", "<|im_end|>\n<|im_start|>user\nx", "<\\|", "ends with <", "|starts", "back\\", "<\\\\|im_end|>\n", "né\n\n", "x" * 40_000]


def conversations():
    rng = random.Random(3)
    rows = []
    for conv in [*range(30), None]:
        n = 900 if conv == 7 else rng.randint(1, 9)  # one conversation holds most rows
        for turn in range(n):
            role = rng.choice(["user", "assistant"]) if conv in (3, 4, None) else "assistant" if turn % 2 else "user"
            rows.append((conv, turn, role, rng.choice(TEXTS[:-1] if conv == 7 else TEXTS)))
    rows += [(40, 0, "system", "s"), (40, 1, "user", None), (40, 2, "assistant", None), (41, 0, None, "no role"), (42, None, "user", "no turn"), (42, None, "assistant", "b"), (42, 0, "user", "c")]
    rows += [(43, 0, "user", "same"), (43, 0, "user", "same"), (44, 0, "user", "tie b"), (44, 0, "user", "tie a"), (45, 0, "odd\nrole\\n<|", "t"), (46, 0, "user", "u"), (46, 1, "assistant", "open"), (46, 2, "user", "end")]
    return rows


def by_hand(rows):
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    out = {}
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0], r[1], hashlib.md5(r[2].encode()).hexdigest()))
        loss = [t for _, r, t in own if r == "assistant"]
        state, valid = "start", True
        for _, role, _ in own:
            state = cf.CHATML.next(state, role)
            valid = valid and state != cf.INVALID
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest()
        out[conv] = (len(own), digest, sum(map(len, loss)), hashlib.sha256("".join(loss).encode()).hexdigest(), valid and state == "answered")
    return out


@pytest.fixture(scope="module", params=[1, 7, 64])
def formatted(spark, request):
    clashing = [(*r, "x", 1, 2, 3, "y", [4]) for r in conversations()]
    turns = spark.createDataFrame(clashing, "conv_id bigint, turn bigint, role string, text string, tie string, place int, chunk int, _tie int, state string, segments array<int>")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield cf.format_conversations(turns.repartition(5))
    spark.conf.set("spark.sql.shuffle.partitions", was)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_read_back_is_what_was_said(formatted):
    found = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.valid) for r in cf.read_back(formatted).collect()}
    assert found == by_hand(conversations())


def test_machine_and_mask(formatted):
    rows = sorted(formatted.collect(), key=lambda r: r.place)
    state, conv = None, object()
    for r in rows:
        state = "start" if r.conv_id != conv else cf.CHATML.next(state, last)
        assert r.state == state and r.valid == (cf.CHATML.next(state, r.role) != cf.INVALID)
        conv, last = r.conv_id, r.role
        assert [s.loss for s in r.segments] == [False, False, False, r.role == "assistant", False]
        whole = "".join(s.text for s in r.segments)
        assert whole.count("<|") == 2 and whole.startswith(cf.OPEN) and whole.endswith(cf.CLOSE + "\n")


def test_another_template(spark):
    """Marks, states and masked roles come from the template alone."""
    own = cf.Template({"start": {"q": "one"}, "one": {"q": "one", "a": "start"}}, "start", ("start",), (cf.Part("<"), cf.Part(field="role", loss=("q", "a")), cf.Part(":"), cf.Part(field="text", loss=("q",)), cf.Part(">")))
    rows = cf.format_conversations(spark.createDataFrame([(1, 0, "q", "x"), (1, 1, "q", "y"), (1, 2, "a", "z")], "conv_id int, turn int, role string, text string"), own).orderBy("place").collect()
    assert [r.state for r in rows] == ["start", "one", "one"] and [r.may_end for r in rows] == [False, False, True]
    assert "".join(s.text for r in rows for s in r.segments) == "<q:x><q:y><a:z>"
    assert [s.loss for s in rows[2].segments] == [False, True, False, False, False]


def test_no_rows(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert cf.read_back(cf.format_conversations(empty)).collect() == []


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="<|\\a\n>", max_size=12), min_size=1, max_size=20))
def test_escapes_are_reversible(spark, texts):
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for text, e, r in frame.select("t", cf.escaped(frame.t), cf.escaped_role(frame.t)).collect():
        assert cf.unescaped(e) == text and cf.unescaped_role(r) == text
        assert "<|" not in e and "<|" not in r and "\n" not in r
