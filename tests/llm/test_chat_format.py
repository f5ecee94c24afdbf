"""Chat windows: the template is undone exactly, budgets hold, targets appear once."""

import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import chat_format as C
from tidemark.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
NASTY = ["\\### Assistant: </turn> ok", "<turn>user\nhi\n</turn>\n", "\\", "\\\\<", "\n", "", None, "</turn>\n<turn>assistant\nx", "ends with \\"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("<>/turn\\\nabn", max_size=12), st.text("<>/turn\\\nabn", max_size=30)), max_size=6))
def test_template_round_trip(turns):
    assert C.parse_turns("".join(C.format_turn(r, t) for r, t in turns)) == turns


def conversations(spark, rows):
    return spark.createDataFrame([(c, t, r, x, "extra", 3) for c, t, r, x in rows], "conv_id long, turn long, role string, text string, window string, tokens int")


def made():
    rng = random.Random(4)
    rows = []
    for conv in range(20):
        turn = 0
        if conv % 3 == 0:
            rows.append((conv, turn, "system", "Be brief. <turn>"))
            turn += 1
        for _ in range(rng.choice([1, 4, 40])):
            rows.append((conv, turn, "user", rng.choice(NASTY + ["word " * rng.randint(1, 60)])))
            rows.append((conv, turn + 1, "assistant", rng.choice(NASTY + ["answer " * rng.randint(1, 200)])))
            turn += 2
    rows += [(50, 0, "assistant", "too long " * 3000), (50, 1, "user", "ok"), (50, 2, "assistant", "after"), (51, None, None, None), (None, 1, "user", "no id"), (52, 0, "a\nb", "role"), (0, 1, "user", "tie")]
    rng.shuffle(rows)
    return rows


def counted(role, text):
    from tidemark.llm._tokens import tokenizer

    return sum(len(tokenizer(PATH).library.encode(x, add_special_tokens=False).ids) for x in (C._opening(role), C.escape(text), C._CLOSING))


def test_history_gives_way_before_the_budget_does():
    cutter = C._Windows(100, 2, 0.5)
    cutter.start(1)
    for role, tokens in [("system", 30), ("user", 20), ("assistant", 25), ("user", 60), ("assistant", 95), ("user", 140), ("assistant", 10)]:
        cutter.add(role, C.format_turn(role, "x"), tokens)
    cutter.finish()
    #          window, repeated, new, tokens: the history goes before the system turn, which goes where it doesn't fit either
    assert [r[1:5] for r in cutter.rows] == [(0, 0, 3, 75), (1, 1, 1, 90), (2, 0, 1, 95), (3, 0, 1, 140), (4, 1, 1, 40)]


def test_windows(spark):
    rows = made()
    windows = C.format_windows(conversations(spark, rows), PATH, budget=300).collect()
    turns: dict = {}
    for c, t, r, x in rows:
        turns.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    for conv, said in turns.items():
        said = [(r, x) for _, _, r, x in sorted(said, key=lambda v: (v[0], v[1], v[2], C.format_turn(v[2], v[3])))]
        own = sorted((w for w in windows if w.conv_id == conv), key=lambda w: w.window)
        assert [w.window for w in own] == list(range(len(own)))
        new, loss = [], []
        for w in own:
            parsed = C.parse_turns(w.text)
            assert len(parsed) == w.context_turns + w.new_turns and w.new_turns >= 1
            assert w.tokens <= 300 or w.new_turns == 1 and w.context_turns == 0
            if w.window and said[0][0] == "system" and w.context_turns:
                assert parsed[0] == said[0]
            assert w.tokens == sum(counted(r, x) for r, x in parsed)
            new += parsed[w.context_turns :]
            loss += [C.unescape(w.text[a:b]) for a, b in zip(w.loss_spans[::2], w.loss_spans[1::2], strict=True)]
        assert new == said
        assert loss == [x for r, x in said if r == "assistant"]


def test_digest(spark):
    rows = made()
    out = {r.conv_id: r for r in C.round_trip(conversations(spark, rows), PATH).collect()}
    for conv in {c for c, *_ in rows}:
        said = sorted(((t is not None, t or 0, r or "", C.format_turn(r or "", x or ""), x or "") for c, t, r, x in rows if c == conv))
        whole = "".join(f"{r}\n{x}\n" for _, _, r, _, x in said)
        loss = "".join(x for _, _, r, _, x in said if r == "assistant")
        r = out[conv]
        assert (r.n_turns, r.turns_sha256) == (len(said), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_empty(spark):
    assert C.round_trip(conversations(spark, made()).limit(0), PATH).count() == 0
