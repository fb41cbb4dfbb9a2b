from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from shroudspark.llm.chat_format import Plan, windows

SCHEMA = "conv_id bigint, turn bigint, role string, text string, window int, talk string, n double"


def make(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 0.0) for r in rows], SCHEMA)


def count(text):
    return len(re.findall(r"[^\W_]+|[^\w\s]|_", text))


def brute(rows, plan):
    out = []
    for conv in sorted({r[0] for r in rows if None not in r}):
        turns = sorted({r[1:] for r in rows if r[0] == conv and None not in r})
        head = [t for t in turns if t[1] == plan.system]
        talk = [t for t in turns if t[1] != plan.system]
        cost = lambda ts: sum(count(t[2]) + plan.overhead for t in ts)
        a = number = 0
        while a < len(talk):
            h = a
            while h > 0 and a - h < plan.history_turns and cost(talk[h - 1 : a]) <= plan.history:
                h -= 1
            b = a + 1
            while b < len(talk) and cost(head) + cost(talk[h : b + 1]) <= plan.budget:
                b += 1
            text, spans = "", []
            for k, (_, role, words) in [(-1, t) for t in head] + list(enumerate(talk))[h:b]:
                text += f"<|{role}|>\n"
                if role == plan.target and k >= a:
                    spans.append((len(text), len(text) + len(words)))
                text += words + "\n<|end|>\n"
            out.append((conv, number, talk[a][0], talk[b - 1][0], a - h, cost(head) + cost(talk[h:b]), text, spans))
            a, number = b, number + 1
    return out


def test_windows_equal_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for conv in range(30):
        for turn in range(rng.randrange(1, 25)):
            role = "system" if turn == 0 and conv % 3 == 0 else ("user", "assistant")[turn % 2]
            rows.append((conv, turn, role, " ".join(rng.choice(("word", "a,b", "é!", "12")) for _ in range(rng.randrange(0, 30)))))
    rows += [(3, None, "user", "x"), (None, 1, "user", "x"), (3, 90, None, "x"), (3, 91, "user", None), rows[0], (50, 0, "system", "alone"), (51, 2, "user", "tie"), (51, 2, "assistant", "tie")]
    for plan in (Plan(budget=60, history=20), Plan(budget=5, history=0), Plan()):
        got = sorted(
            (r["conv_id"], r["window"], r["first_turn"], r["last_turn"], r["n_history"], r["n_tokens"], r["text"], [(s["start"], s["end"]) for s in r["targets"]])
            for r in windows(make(spark, rows), plan).collect()
        )
        assert got == brute(rows, plan)


def test_system_turns_may_fill_the_budget_and_other_columns_may_have_any_name(spark):
    rows = [(1, 0, "system", "rule " * 100), *((1, k, "user", "a b") for k in range(1, 4)), (1, 4, "assistant", "")]
    table = make(spark, rows).withColumn("sums", F.lit(1)).withColumn("talk", F.lit("x")).withColumn("window", F.lit(2))
    plan = Plan(budget=50)
    got = sorted((r["window"], r["first_turn"], r["last_turn"]) for r in windows(table, plan).collect())
    assert got == [(w, a, b) for _, w, a, b, *_ in brute(rows, plan)] == [(k, k + 1, k + 1) for k in range(4)]


def test_another_count_of_tokens_may_be_given(spark):
    rows = [(1, k, "user", "x" * 10) for k in range(6)]
    got = windows(make(spark, rows), Plan(budget=28, history=0), count=F.length).collect()
    assert sorted((r["first_turn"], r["n_tokens"]) for r in got) == [(0, 28), (2, 28), (4, 28)]


def test_targets_are_learnt_once_and_long_turns_stay_whole(spark):
    rows = [(1, k, ("user", "assistant")[k % 2], f"t{k} " * (1000 if k == 5 else 10)) for k in range(12)]
    got = windows(make(spark, rows), Plan(budget=64, history=30)).collect()
    learnt = [r["text"][s["start"] : s["end"]] for r in sorted(got, key=lambda r: r["window"]) for s in r["targets"]]
    assert learnt == [t for _, _, role, t in rows if role == "assistant"]
    assert windows(make(spark, [])).count() == 0
