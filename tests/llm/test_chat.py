import random

from atomflow.llm.chat import collapse_and_render

SCHEMA = "conv_id bigint, turn bigint, role string, text string, position int"


def brute(rows):
    convs = {}
    for c, t, r, x, _ in set(rows):
        convs.setdefault(c, []).append((t, r, x))
    low = lambda v: (v is not None, v)
    convs = {c: [(r, x) for _, r, x in sorted(v, key=lambda y: tuple(low(z) for z in y))] for c, v in convs.items()}
    out = {}
    for c, v in convs.items():
        if any(len(w) > len(v) and w[: len(v)] == v for w in convs.values()):
            continue
        same = [d for d, w in convs.items() if w == v]
        if c == min(same, key=lambda d: (d is None, d or 0)):
            out[c] = (len(v), len(same), "".join(f"<|im_start|>{r or ''}\n{x or ''}<|im_end|>\n" for r, x in v))
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for c in range(60):
        base = [(("user", "assistant")[i % 2], rng.choice(["a", "b", None, ""])) for i in range(rng.randint(1, 5))]
        rows += [(c, i, r, x, 9) for i, (r, x) in enumerate(base)]
    rows += rows[:10]  # repeated log lines
    rows += [(None, 0, "user", "a", 1), (None, None, "user", "z", 1), (70, 0, None, "a", 1), (70, 0, "user", None, 1), (71, 0, "user", "x" * 100_000, 1)]
    got = {r.conv_id: (r.n_turns, r.n_copies, r.text) for r in collapse_and_render(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_empty(spark):
    assert collapse_and_render(spark.createDataFrame([], SCHEMA)).count() == 0
