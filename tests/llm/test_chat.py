import random
from collections import defaultdict

from segcast.llm import chat

PARTS = ["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_repeat|>", "<|im_sep|>", "<|im_end|>",
         "\\", "\\\\", "<", "[", "<\\", "\n", "é", "word ", "x" * 40, "<|im_", "end|>", "$1", "\\n"]


def conversations(n, seed):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.randint(1, 9)):
            role = "system" if t == 0 and r.random() < 0.5 else r.choice(["user", "assistant", "tool", "", None, "[INST]"])
            text = None if r.random() < 0.05 else "".join(r.choice(PARTS) for _ in range(r.randint(0, 25)))
            rows.append((c, t, role, text))
    return rows


def brute(rows):
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((-1 if t is None else t, role or "", text or ""))
    return {c: (len(v), "".join(f"{r}\n{x}\n" for _, r, x in sorted(v)), "".join(x for _, r, x in sorted(v) if r == "assistant"))
            for c, v in by.items()}


def frame(spark, rows):
    from pyspark.sql import functions as F
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit(3)).withColumn("span", F.lit(4))


def test_round_trip_for_any_budget(spark):
    rows = conversations(60, 1)
    rows += [(100, 0, "user", "a" * 50_000), (100, 1, "assistant", "b" * 50_000), (101, 0, "assistant", "twice"), (101, 0, "assistant", "twice"),
             (102, None, "assistant", "first"), (102, 0, "user", "second"), (None, 0, "user", "q"), (None, 1, "assistant", "a")]
    df = frame(spark, rows)
    want = brute(rows)
    for budget, history in ((1024, 256), (40, 15), (1, 0)):
        got = chat.read_back(chat.format_conversations(df, budget, history)).collect()
        assert {r.conv_id: (r.n_turns, r.turns, r.loss) for r in got} == want


def test_windows_hold_system_turn_history_and_mask(spark):
    rows = [(1, 0, "system", "be brief")] + [(1, t, "user" if t % 2 else "assistant", f"turn {t} " + "w" * 60) for t in range(1, 13)]
    got = sorted(chat.format_conversations(frame(spark, rows), 100, 30).collect(), key=lambda r: r.window)
    assert len(got) > 2
    for k, r in enumerate(got):
        pieces = r.formatted.split(chat.END)[:-1]
        marker = chat.TURN if k == 0 else chat.REPEATED
        assert pieces[0].removeprefix(chat.BEGIN) == f"{marker}system{chat.TEXT}be brief"
        repeated = [p for p in pieces[1:] if p.startswith(chat.REPEATED)]
        assert len(repeated) <= 2 and (k == 0 or repeated), "limited history"
        assert len(r.loss_spans) == sum(p.startswith(f"{chat.TURN}assistant") for p in pieces)
        for s in r.loss_spans:
            assert r.formatted[s.start:s.start + s.length].startswith("turn ")
            assert r.formatted[s.start - len(chat.TEXT):s.start] == chat.TEXT
            assert r.formatted[s.start + s.length:].startswith(chat.END)


def test_windows_keep_the_budget_unless_one_turn_is_longer(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", "w" * 1490) for t in range(9)]  # three start within the room, two fit
    rows += [(2, t, "user", "w" * 784) for t in range(20)]
    rows += [(3, t, "assistant", ["ж" * 700, "字" * 500, "</s>" * 200][t % 3]) for t in range(20)]
    rows += [(4, 0, "system", "s" * 400)] + [(4, t, "user", "x" * (t * 37 % 900)) for t in range(1, 60)]
    rows += [(5, 0, "system", "s"), (5, 1, "user", "y" * 9000), (5, 2, "user", "z"), (5, 3, "user", "y" * 9000), (5, 4, "user", "z")]
    rows += [(c + 10, t, role, text) for c, t, role, text in conversations(40, 7)]
    for budget, history in ((1024, 256), (200, 40)):
        over = 0
        for r in chat.format_conversations(frame(spark, rows), budget, history).collect():
            pieces = r.formatted.removeprefix(chat.BEGIN).split(chat.END)[:-1]
            own = [p for p in pieces if p.startswith(chat.TURN)]
            system = [p for p in pieces if p.split(chat.TEXT)[0].endswith(">system")]
            room = budget - history - sum(len(p.encode()) / 4 for p in system)
            assert own
            if len(r.formatted.encode()) / 4 > budget:
                over += 1
                alone = [p for p in own if p not in system]
                assert room < 1 or len(alone) == 1 and len((alone[0] + chat.END).encode()) / 4 + 5 > room  # 5: markers and rounding
        assert over >= 2  # the turns of 9,000 characters


def test_escape_hides_control_strings_and_reverses(spark):
    from pyspark.sql import functions as F
    r = random.Random(2)
    texts = ["".join(r.choice(PARTS) for _ in range(12)) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escape(F.col("t")))
    for row in df.withColumn("u", chat.unescape(F.col("e"))).collect():
        assert row.u == row.t
        assert not any(p in row.e for p in PARTS[:10])


def test_empty_and_native(spark):
    df = frame(spark, [(1, 0, "user", "x")])
    out = chat.read_back(chat.format_conversations(df))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0
