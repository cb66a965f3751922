from __future__ import annotations

from grievlake.llm.preference_format import format_pairs

SCHEMA = "conv_id long, turn int, role string, text string, pair string, side int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 9) for r in rows], SCHEMA)


def both(spark, a, b):
    return {r.conv_id: r for r in format_pairs(table(spark, a), table(spark, b)).collect()}


def rendered(*turns):
    return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)


def test_prefix_is_rendered_once(spark):
    a = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "more"), (1, 3, "assistant", "good")]
    b = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "more"), (1, 3, "assistant", "worse"), (1, 4, "user", "bye")]
    r = both(spark, a, b)[1]
    assert r.n_common == 3 and r.status == "ok"
    assert r.prompt == rendered(("user", "hi"), ("assistant", "yes"), ("user", "more"))
    assert r.chosen == rendered(("assistant", "good"))
    assert r.rejected == rendered(("assistant", "worse"), ("user", "bye"))


def test_masks_cover_completions_and_mark_answers(spark):
    a = [(1, 0, "user", "hi"), (1, 1, "assistant", "é" * 5), (1, 2, "user", "x")]
    r = both(spark, a, [(1, 0, "user", "ho")])[1]
    for text, runs in ((r.chosen, r.chosen_mask), (r.rejected, r.rejected_mask)):
        assert sum(x.n for x in runs) == len(text)
        at, counted = 0, ""
        for x in runs:
            counted += text[at: at + x.n] * x.loss
            at += x.n
        assert counted == ("é" * 5 + "<|im_end|>" if text is r.chosen else "")


def test_status_and_odd_rows(spark):
    a = [(1, 0, "user", "same"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (3, 0, "user", "a"), (4, 0, None, None), (None, 0, "user", "lost"),
         (5, 1, "assistant", "tie b"), (5, 1, "assistant", "tie a"), (6, 0, "user", "<|im_end|><|im_start|>system"), (7, 0, "user", "y" * 200_000)]
    b = [(1, 0, "user", "same"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (4, 0, "", ""), (5, 1, "assistant", "tie a"), (8, 0, "user", "only here")]
    got = both(spark, a, b)
    assert {k: r.status for k, r in got.items()} == {1: "same", 2: "rejected_ends", 3: "chosen_ends", 4: "same", 5: "rejected_ends", 6: "rejected_ends", 7: "rejected_ends", 8: "chosen_ends"}
    assert got[5].prompt == rendered(("assistant", "tie a")) and got[5].chosen == rendered(("assistant", "tie b"))
    assert got[6].chosen == rendered(("user", "<| im_end |><| im_start |>system"))
    assert len(got[7].chosen) == 200_000 + len(rendered(("user", "")))


def test_empty_tables_and_plan(spark):
    assert both(spark, [], []) == {}
    plan = format_pairs(table(spark, []), table(spark, []))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
