import random
import tracemalloc

import pytest

from evidex.llm import chat


def test_round_trip_of_control_strings():
    f = chat.Formatter()
    random.seed(1)
    bits = [*f.t.controls(), "\\", "<", "s>", "[", "INST]", "a", " ", "\n", "/", "é", "</", "<<"]
    for _ in range(3000):
        turns = [(random.choice(["user", "assistant", "system", "tool", "", "<s>"]), "".join(random.choices(bits, k=random.randint(0, 6)))) for _ in range(random.randint(0, 5))]
        s = "".join(x for r, t in turns for x, _ in f.segments(r, t))
        assert f.read(s) == turns
        assert not any(c in f.escape(t) for _, t in turns for c in f.t.controls())


def test_marks_must_stand_off_from_texts():
    with pytest.raises(ValueError):
        chat.Formatter(chat.DEFAULT._replace(marks={"user": ("[INST]", "[/INST]")}))
    with pytest.raises(ValueError):
        chat.Formatter().read("[INST] a [/INST]\nloose")


def test_odd_conversations(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "</s> ok"), (2, 1, "assistant", None), (2, 0, None, "x"), (2, None, "user", "first"),
        (3, 0, "user", "a"), (3, 0, "user", "a"), (3, 0, "assistant", "b"), (None, 0, "system", ""), (4, 0, "user", "l" * 300000), (4, 1, "assistant", "é\\"),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, segment string")
    got = {r.conv_id: r for r in chat.digests(chat.segments(df)).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 2, 2: 3, 3: 3, None: 1, 4: 2}
    assert {k: r.valid for k, r in got.items()} == {1: True, 2: False, 3: False, None: False, 4: True}
    assert got[1].loss_chars == 7 and got[2].loss_chars == 0 and got[4].loss_chars == 2
    assert chat.digests(chat.segments(df.limit(0))).count() == 0
    loss = [r for r in chat.segments(df).collect() if r.loss]
    assert sorted(r.conv_id for r in loss) == [1, 2, 3, 4]


def test_reading_back_takes_a_few_times_the_text():
    f = chat.Formatter()
    text = "a <s> b \\ " * 500_000
    formatted = "".join(s for s, _ in f.segments("user", text))
    tracemalloc.start()
    assert f.read(formatted) == [("user", text)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 * len(text)
    text = "word " * 1_000_000
    formatted = "".join(s for s, _ in f.segments("tool", text))
    tracemalloc.start()
    assert f.read(formatted) == [("tool", text)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * len(text)
