import hashlib
import random
from itertools import groupby

from corpusweave.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, window string"


def brute(rows):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    out = {}
    for conv, turns in groupby(sorted(rows, key=key), key=lambda r: r[0]):
        turns = list(turns)
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def check(spark, rows, **options):
    df = spark.createDataFrame([(*r, "w") for r in rows], SCHEMA)
    windows = chat.chat_windows(df, **options)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(windows).collect()}
    assert got == brute(rows)
    return windows.collect()


def test_windows_repeat_history_and_mask_once(spark):
    rng = random.Random(2)
    rows = [(c, t, "system" if t == 0 and c % 2 else rng.choice(["user", "assistant"]), "".join(rng.choice("ab\\<[]/s>INST \n\U0001f600") for _ in range(rng.randrange(0, 400)))) for c in range(12) for t in range(rng.randrange(1, 40))]
    windows = check(spark, rows, budget=300, history=60)
    assert any(w.n_repeated for w in windows)
    longest = max(len(r[3].encode()) // 4 + 5 for r in rows)
    assert all(w.n_tokens <= 300 for w in windows if longest <= 60) and all(chat.BEGIN in w.text for w in windows)


def test_control_strings_are_escaped(spark):
    said = "</s>[INST] ok [/INST] <s>[/ROLE] \\< \\\\ ["
    windows = check(spark, [(-1, 0, "user", said), (-1, 1, "assistant", said), (-2, 0, "assistant", "x" * 50_000)])
    for w in windows:
        assert w.text.count("</s>") == w.n_turns and w.text.count("[/ROLE]") == w.n_turns and "[INST]" not in w.text


def test_odd_rows(spark):
    check(spark, [(1, 0, None, None), (1, 0, None, None), (1, None, "user", "first"), (None, 0, "assistant", "lost"), (2, 0, "assistant", ""), (2, 0, "assistant", "tie"), (3, 5, "system", "s")])
    assert chat.chat_windows(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_long_conversation(spark):
    check(spark, [(7, t, "user" if t % 2 else "assistant", f"turn {t} " * 20) for t in range(3000)], budget=400, history=100)


def brute_windows(rows, budget, history):
    """Texts of all windows, from turns (conv_id, turn, role, text) in order."""
    out = []
    for _, turns in groupby(rows, key=lambda r: r[0]):
        turns, at, spans = [(r[2], r[3]) for r in turns], 0, {}
        tokens = [-(-len(t.encode()) // 4) + 4 for _, t in turns]
        system = turns[0][0] == "system"
        room = max(1, (budget - history - (tokens[0] if system else 0)) // 2)
        starts = [sum(tokens[:i]) for i in range(len(turns))]
        for i, n in enumerate(tokens):
            spans.setdefault((starts[i] + n - 1) // room, []).append(i)
        for own in spans.values():
            shown = [i for i in range(own[0]) if starts[own[0]] - starts[i] <= history or (system and i == 0)] if own[0] else []
            if system and own[0]:
                shown = [0] + [i for i in shown if i]
            out.append("".join(f"<s>{turns[i][0]}[/ROLE]{turns[i][1]}</s>" for i in shown + own))
    return sorted(out)


def test_history_before_turns_of_several_kb(spark):
    rng = random.Random(4)
    rows = [(1, 0, "user", "q" * 144), (1, 1, "assistant", "a" * 3184), (2, 0, "user", "q" * 100), (2, 1, "assistant", "b" * 12_000), (2, 2, "user", "then"), (2, 3, "assistant", "c" * 4000)]
    rows += [(3, t, "system" if t == 0 else rng.choice(["user", "assistant"]), "w" * rng.choice([1500 if t == 0 else 10, 200, 900, 4000, 9000])) for t in range(60)]
    for budget, history in ((1024, 256), (1024, 900), (300, 0)):
        got = check(spark, rows, budget=budget, history=history)
        assert sorted(w.text for w in got) == brute_windows(rows, budget, history)
    first = [w for w in check(spark, rows) if w.conv_id == 1 and "aaa" in w.text]
    assert first[0].n_repeated == 1 and "qqq" in first[0].text


def test_no_conversation_is_gathered_into_a_row(spark):
    windows = spark.createDataFrame([(1, w, f"<s>user[/ROLE]{w}</s>", 1, 0, []) for w in range(9)], "conv_id long, window long, text string, n_turns int, n_repeated int, loss array<struct<start:int,end:int>>")
    read = chat.read_back(windows)
    assert "collect_list" not in read._jdf.queryExecution().optimizedPlan().toString()
    assert read.first().turns_sha256 == hashlib.sha256("".join(f"user\n{w}\n" for w in range(9)).encode()).hexdigest()
