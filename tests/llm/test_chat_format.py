from consensa.llm import chat_format as c

A = [("user", "hi"), ("assistant", "yes"), ("user", "sure?"), ("assistant", "very")]
B = [("user", "hi"), ("assistant", "yes"), ("user", "sure?"), ("assistant", "no"), ("user", "ok")]
PAIRS = [(1, A, B), (2, A, A), (3, A, None), (4, None, None), (5, [], B), (6, A[:2], A), (7, [(None, None)], [("", "")]),
         (8, [("user", "ü\U0001F600")], [("assistant", "")]), (1, A, B)]


def text_of(turns):
    return "".join(f"{c.OPEN}{r or ''}\n{t or ''}{c.CLOSE}" for r, t in turns)


def brute(chosen, rejected):
    x, y = ([(r or "", t or "") for r, t in s or []] for s in (chosen, rejected))
    n = 0
    while n < min(len(x), len(y)) and x[n] == y[n]:
        n += 1

    def spans(turns):
        at, out = 0, []
        for r, t in turns:
            start, at = at + len(c.OPEN + r) + 1, at + len(c.OPEN + r) + 1 + len(t) + len(c.CLOSE)
            if r == "assistant":
                out.append((start, at))
        return out
    return n, text_of(x[:n]), text_of(x[n:]), spans(x[n:]), text_of(y[n:]), spans(y[n:])


def test_against_brute_force(spark):
    df = spark.createDataFrame([(i, a, b, "clash") for i, a, b in PAIRS],
                               f"pair_id long, chosen {c.TURNS}, rejected {c.TURNS}, prompt string")
    got = sorted((r.pair_id, r.n_prompt_turns, r.prompt, r.chosen_completion, [tuple(s) for s in r.chosen_spans],
                  r.rejected_completion, [tuple(s) for s in r.rejected_spans]) for r in c.format_preferences(df).collect())
    assert got == sorted((i, *brute(a, b)) for i, a, b in PAIRS)


def test_reply_pairs(spark):
    rows = [(1, i, r, t) for i, (r, t) in enumerate(A)] + [(2, 0, "user", "q")] + [(3, 0, "user", "q"), (3, 1, "assistant", "a")]
    got = {r.conv_id: r.rejected and [tuple(t) for t in r.rejected]
           for r in c.reply_pairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {1: A[:3] + [("assistant", "yes")], 2: None, 3: [("user", "q"), ("assistant", "")]}


def test_empty_table(spark):
    assert c.format_preferences(spark.createDataFrame([], f"chosen {c.TURNS}, rejected {c.TURNS}")).collect() == []
