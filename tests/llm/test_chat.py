import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string, valid string"
TEMPLATE = C.ChatTemplate()
PIECES = st.lists(st.sampled_from([*TEMPLATE.controls(), "\\", "<", "[", "/", "]", ">", "INST", "s", " ", "é🙂", "\n"]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", "[INST]", "\\"]), PIECES), max_size=6), st.integers(1, 7))
def test_round_trip(turns, step):
    formatter = C.Formatter(TEMPLATE)
    text = "".join(s.text for role, said in turns for s in formatter.turn(role, said))
    assert C.read_turns(TEMPLATE, [text]) == turns
    assert C.read_turns(TEMPLATE, [text[i : i + step] for i in range(0, len(text), step)]) == turns


@settings(max_examples=200, deadline=None)
@given(PIECES)
def test_no_control_string_is_left_in_a_text(text):
    escaped = C.escape(TEMPLATE.escaper(), text)
    assert not any(c in escaped for c in TEMPLATE.controls()) and C.unescape(escaped) == text


def test_machine():
    def valid(*roles):
        f = C.Formatter(TEMPLATE)
        for r in roles:
            f.turn(r, "x")
        return f.valid

    assert valid("user", "assistant", "user") and valid("system", "user") and valid()
    assert not valid("assistant") and not valid("user", "user") and not valid("user", "system") and not valid("tool") and not valid("system", "assistant")


ROWS = [
    (1, 1, "assistant", "yes </s>", "x"), (1, 0, "user", "ok?", "x"), (2, 0, "user", None, "x"), (3, 0, None, "who", "x"), (3, None, "tool", "first", "x"),
    (4, 0, "assistant", "z" * 200_000, "x"), (4, 0, "assistant", "z" * 200_000, "x"), (None, 0, "user", "nobody", None), (5, 0, "user", "", "x"), (5, 1, "assistant", "", "x"),
]


def test_digests_like_brute_force(spark):
    got = {r["conv_id"]: r for r in C.digest_segments(C.format_turns(spark.createDataFrame(ROWS, SCHEMA))).collect()}
    by = {}
    for conv, turn, role, text, _ in sorted(ROWS, key=lambda r: (r[0] or -1, -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        by.setdefault(conv, []).append((role or "", text or ""))
    assert set(got) == set(by)
    for conv, turns in by.items():
        said = "".join(t for r, t in turns if r == "assistant")
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        f = C.Formatter(TEMPLATE)
        assert got[conv]["formatted_chars"] == sum(len(s.text) for r, t in turns for s in f.turn(r, t))
        assert got[conv]["valid"] == f.valid


def test_segments_and_empty(spark):
    segments = C.format_turns(spark.createDataFrame(ROWS[:2], SCHEMA)).collect()
    assert [(s["turn_no"], s["segment"], s["text"], s["loss"]) for s in segments] == [(0, 0, "[INST]", False), (0, 1, "ok?", False), (0, 2, "[/INST]", False), (1, 0, "<s>", False), (1, 1, "yes <\\/s>", True), (1, 2, "</s>", False)]
    assert C.digest_segments(C.format_turns(spark.createDataFrame([], SCHEMA))).count() == 0
