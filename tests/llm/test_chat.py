import hashlib
import itertools

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from scorefold.llm import chat

TURNS = "conv_id long, turn long, role string, parts " + chat.PART + ", formatted string, mask string"


def run(spark, rows):
    frame = spark.createDataFrame([(*r, "clash", "clash") for r in rows], TURNS)
    return {r.conv_id: r for r in chat.read_chats(chat.format_chats(frame)).collect()}


def text(value):
    return ("text", value, None, None)


def test_parts_become_ordered_placeholders(spark):
    parts = [text("see "), ("image", None, "a.png", 2.0), text(" and <image> "), ("audio", None, "b.wav", 1.5), ("document", None, "c.pdf", None), None]
    row = run(spark, [(1, 0, "user", parts), (1, 1, "assistant", [text("ok")])])[1]
    assert row.turns[0].text == "see <image> and <image> <audio><document>"
    assert "see <image> and <\\image> <audio><document>" in row.formatted
    assert [(a.seq, a.type, a.ref, a.tokens) for a in row.attachments] == [(1, "image", "a.png", 514), (1, "audio", "b.wav", 40), (1, "document", "c.pdf", 702)]
    assert row.extra_tokens == 514 + 40 + 702
    assert row.learned == "ok"


def test_nulls_ties_and_empty(spark):
    rows = [(2, None, None, None), (2, 0, "assistant", []), (2, 0, "assistant", [text("b")]), (2, 0, "assistant", [text("b")]), (None, 1, "user", [text(None)])]
    got = run(spark, rows)
    assert [(t.role, t.text) for t in got[2].turns] == [("", ""), ("assistant", ""), ("assistant", "b"), ("assistant", "b")]
    assert got[2].learned == "bb" and got[None].turns[0].text == ""
    assert run(spark, []) == {}


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<s>\\"]), st.text(st.sampled_from("\\<>[]/sINSTa\n\u00e9\U0001f600"), max_size=12)), min_size=1, max_size=4), min_size=1, max_size=6))
def test_round_trip(spark, chats):
    pieces = ["</s>", "[INST]", "[/INST]", "<\\/s>", "\\"]
    rows = [(c, t, role, [text(body + pieces[(c + t) % 5])]) for c, turns in enumerate(chats) for t, (role, body) in enumerate(turns)]
    got = run(spark, rows)
    for c, mine in itertools.groupby(rows, key=lambda r: r[0]):
        mine = list(mine)
        assert [(t.role, t.text) for t in got[c].turns] == [(r[2], r[3][0][1]) for r in mine]
        assert hashlib.sha256(got[c].learned.encode()).digest() == hashlib.sha256("".join(r[3][0][1] for r in mine if r[2] == "assistant").encode()).digest()


def test_control_strings_across_neighbouring_parts(spark):
    parts = [text("a<"), text("/s>b[IN"), text("ST]"), {"type": "image", "text": None, "ref": "r", "units": 1.0}, text("<im"), text("age>\\")]
    got = run(spark, [(1, 0, "user", parts), (1, 1, "assistant", [text("[/IN"), text(None), text("ST]")])])
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "a</s>b[INST]<image><image>\\"), ("assistant", "[/INST]")]
    assert got[1].learned == "[/INST]"
