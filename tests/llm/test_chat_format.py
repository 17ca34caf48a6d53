"""Windows against a direct construction, round trips of the template, hot conversations, native plans."""

import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortspark.llm import chat_format as C

ROWS = "conv_id long, turn long, role string, text string"
CONTROLS = ["<|im_start|>", "<|im_end|>\n", "<|im_end|>", "[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "<|", "<\\|", "[\\/INST]", "<\\\\s>", "<<", "\\", "[", "<", "|", "\n", "s>", "ok", "ñ漢🙂"]


def conversations(seed=4):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice(CONTROLS + ["some words here ", "x "]) for _ in range(rng.randrange(n)))
    rows = []
    for c in range(40):
        turn = 0
        if c % 3 == 0:
            rows.append((c, turn, "system", "rule " * rng.randrange(1, 60)))
            turn += 1
        for _ in range(rng.randrange(0 if turn else 1, 9)):
            rows.append((c, turn, "user" if turn % 2 else "assistant", text(30)))
            turn += 1
    # a third of the rows in one conversation, one turn over the budget
    rows += [(1000, 0, "system", "be brief")] + [(1000, t, "user" if t % 2 else "assistant", f"{t} " + text(12)) for t in range(1, 120)]
    rows += [(1001, 0, "user", "q"), (1001, 1, "assistant", "long " * 1500), (1001, 2, "user", "thanks"), (1001, 3, "assistant", "")]
    # nulls, ties, repeated rows, odd roles
    rows += [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (1002, None, "assistant", "first"), (1002, 0, None, None), (1002, 1, "to\\ol\n<|x", "c")]
    rows += [(1003, 0, "assistant", "same")] * 5 + [(1003, 1, "system", "late rule")] + [(1004, 0, "system", "alone")]
    return rows


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, ROWS)
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(["row", "pos", "first", "n", "lead", "conv", "hash", "stretch"])]) if extra else df


def tokens(text):
    return len(re.findall(C.PIECE, text)) + C.MARKS


def expected(rows, budget, history):
    """(conv_id, first, last, context, n_tokens) and the new turns of every window."""
    convs = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "")):
        convs.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    out = {}
    for conv, turns in convs.items():
        n = [tokens(t) for _, t in turns]
        system = int(turns[0][0] == "system")
        ahead = n[0] if system else 0
        room = max(budget - history - ahead, C.LEAST)
        start, at = [], 0
        for i in range(len(turns)):
            start.append(at)
            at += 0 if system and i == 0 else n[i]
        cells = {}
        for i in range(len(turns)):
            cells.setdefault(start[i] // room, []).append(i)
        for members in cells.values():
            spans = [members]
            last = members[-1]
            if start[last] + n[last] - start[members[0]] > room and start[last] > start[members[0]]:
                spans = [members[:-1], members[-1:]]
            for span in spans:
                back = [i for i in range(system, span[0]) if start[i] + history >= start[span[0]]]
                lead = [0] if system and span[0] > 0 else []
                total = sum(n[i] for i in lead + back + span)
                out[conv, span[0]] = (span[-1], len(lead + back), total, [turns[i] for i in span])
    return out


def test_windows_match_a_direct_construction(spark):
    rows = conversations()
    for budget, history in ((400, 64), (500, 0), (1024, 192)):
        got = C.read_back(C.windows(frame(spark, rows), budget, history)).collect()
        want = expected(rows, budget, history)
        assert len(got) == len(want)
        for r in got:
            last, context, total, new = want[r.conv_id, r.first_turn]
            assert (r.last_turn, r.n_context, r.n_tokens, r.over_budget) == (last, context, total, total > budget)
            assert [tuple(t) for t in r.turns] == new
            assert r.learned == [text for role, text in new if role == "assistant"]
            assert r.text.count(C.START) == r.text.count(C.END) == context + len(new)
        assert any(r.over_budget for r in got) and all(r.n_tokens <= budget for r in got if r.last_turn > r.first_turn)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(CONTROLS), max_size=12).map("".join), min_size=1, max_size=20))
def test_escapes_are_reversible_and_hide_controls(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", C.escape(F.col("t")).alias("e"), C.unescape(C.escape(F.col("t"))).alias("u"), C.unescape_role(C.escape_role(F.col("t"))).alias("r"), C.escape_role(F.col("t")).alias("er")).collect()
    for r in got:
        assert r.u == r.t == r.r and "\n" not in r.er
        assert not re.search(r"<(\||/?s>|/?SYS>>)|\[/?INST\]", r.e + r.er)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_digests(spark, monkeypatch):
    rows = conversations(9)
    monkeypatch.setattr(C, "read", lambda spark, sf, table: frame(spark, rows))
    df = C.op11_chat_format(spark, "")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct", plan)
    got = {r.conv_id: r for r in df.collect()}
    tricky = "</s>[INST] ok [/INST]"
    convs = {}
    for r in sorted(rows + [(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "")):
        convs.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    assert set(got) == set(convs)
    for conv, turns in convs.items():
        r, learned = got[conv], "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), digest("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(learned), digest(learned))
        assert r.formatted_chars > sum(len(b) for _, b in turns)


def test_other_token_counts_and_stretches(spark, monkeypatch):
    """A token count of the caller's; the system turn posted to many parts."""
    monkeypatch.setattr(C, "STRETCHES", 2)
    rows = [(1, 0, "system", "s")] + [(1, t, "assistant", f"t{t}") for t in range(1, 400)]
    got = C.windows(frame(spark, rows), 300, 20, lambda text: F.length(text)).collect()
    assert len(got) > 8 and sorted(t for r in got for t in range(r.first_turn, r.last_turn + 1)) == list(range(400))
    assert all(r.n_context >= 2 and r.text.startswith("<|im_start|>system\ns<|im_end|>") for r in got if r.first_turn)


def test_empty_table(spark, monkeypatch):
    empty = frame(spark, conversations()).limit(0)
    assert C.windows(empty).count() == 0
    monkeypatch.setattr(C, "read", lambda spark, sf, table: empty)
    assert [r.conv_id for r in C.op11_chat_format(spark, "").collect()] == [-7]
