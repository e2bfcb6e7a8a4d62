"""Chat windows: exact round trip, budget, history and loss mask."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from odd import PARTS, odd_texts
from taxomatch.llm import chat

ROLES = ["user", "assistant", "system", "tool", "a\nb", "a\\n", "\\\\n", "</s>", "", None]


@pytest.fixture(scope="module")
def talks(spark):
    rng = random.Random(3)
    texts = odd_texts(200, 5)[:-2]
    rows = [(c, t, rng.choice(ROLES), rng.choice(texts)) for c in range(40) for t in range(rng.randint(1, 12))]
    rows += [(100, t, rng.choice(["user", "assistant"]), "word " * rng.randint(0, 60)) for t in range(1300)] + [(100, -5, "system", "be nice <s>")]
    rows += [(101, 1, "assistant", "twice"), (101, 1, "assistant", "twice"), (101, 1, "assistant", "once"), (101, None, "user", "no number")]
    rows += [(None, 0, "user", "nobody's"), (None, 1, "assistant", "answer"), (102, 0, "user", "long " * 500), (102, 1, "assistant", "".join(PARTS))]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "conv_id long, turn long, role string, text string, rank string, window int").repartition(5)
    said = {}
    for c, t, role, text in rows:
        said.setdefault(c, []).append((t if t is not None else -10**9, (role or "").encode(), (text or "").encode()))
    return df, {c: [(r.decode(), x.decode()) for _, r, x in sorted(v)] for c, v in said.items()}


def test_digests_read_back_exactly(talks):
    df, said = talks
    got = {r.conv_id: r for r in chat.digests(chat.windows(df, 100, 30, 4)).collect()}
    assert got.keys() == said.keys()
    for c, turns in said.items():
        target = "".join(x for r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(target), hashlib.sha256(target.encode()).hexdigest())


def test_windows(talks):
    df, said = talks
    budget, history, most = 100, 30, 4
    out = {}
    for r in chat.read_back(chat.windows(df, budget, history, most)).collect():
        out.setdefault(r.conv, []).append(r)
    for c, turns in said.items():
        rows = sorted(out[c], key=lambda r: r["first"])
        assert [t for r in rows for t in r.turns] == turns  # each turn is new once, in order
        lead = turns[0][0] == "system"
        for r in rows:
            whole = r.text.split("</s>")[:-1]
            assert len(whole) == r.n_context + r.n_new
            assert r.n_context <= most + lead and (r["first"] > 0) == (r.n_context > 0 or r["first"] > 0)
            if lead and r["first"] > 0:
                assert whole[0].startswith("<s>system\n")
            assert [t for role, t in r.turns if role == "assistant"] == list(r.targets)
            assert r.n_tokens <= budget or r.n_new == 1 or lead
    assert max(r.n_context for r in out[100]) > 1


def test_no_control_string_survives(talks):
    for r in chat.windows(talks[0], 100, 30, 4).collect():
        n = r.n_context + r.n_new
        assert (r.text.count("<s>"), r.text.count("</s>")) == (n, n)
        assert not any(x in r.text for x in ("[INST]", "[/INST]", "<SYS>", "</SYS>"))


def test_plan_is_native(talks):
    plan = chat.digests(chat.windows(talks[0]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.windows(none)).count() == 0


def test_escape_is_reversible(spark):
    df = spark.createDataFrame([(t or "",) for t in odd_texts(300, 9)], "t string")
    same = df.select((chat.unescape(chat.escape(F.col("t"))) == F.col("t")) & (chat.unescape_role(chat.escape_role(F.col("t"))) == F.col("t")))
    assert {r[0] for r in same.collect()} == {True}


def test_a_system_turn_that_is_not_first_is_kept(spark):
    """A null-numbered user turn stands ahead of the system turn."""
    rows = [(1, None, "user", "hello"), (1, 0, "system", "be brief")]
    rows += [(1, k, "user" if k % 2 else "assistant", " ".join(["word"] * 30)) for k in range(1, 21)]
    rows += [(1, 30, "system", "a later one")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.windows(df, 120, 30, 2).orderBy("first").collect()
    assert len(got) > 3 and [r.text.startswith("<s>system\nbe brief</s>") for r in got] == [False] + [True] * (len(got) - 1)
    assert sum(r.text.count("be brief") for r in got) == len(got) and got[1].n_context > 0
