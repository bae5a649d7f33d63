"""Common prefixes, prompts and masks."""

from assaykit.llm import preference as pf

SCHEMA = "id int, chosen_turns array<struct<role:string,text:string>>, rejected_turns array<struct<role:string,text:string>>, status string"


def render(turns):
    return "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)


def learned(mask, text):
    """The characters that a mask lets through."""
    out, at = "", 0
    for run in filter(None, mask.split(";")):
        skip, take = map(int, run.split(","))
        out += text[at + skip : at + skip + take]
        at += skip + take
    assert at == len(text)
    return out


def test_pairs(spark):
    u, a, b, s = ("user", "hi\nthere"), ("assistant", "good"), ("assistant", "bad é"), ("system", "")
    cases = [
        ([s, u, a], [s, u, b], "pair", 2), ([u, a], [u, a], "identical", 2), ([u, a, u, b], [u, a], "prefix", 2),
        ([a], [b], "pair", 0), ([u, a, u, a], [u, b, u, a], "pair", 1), ([], [], "identical", 0), ([u], [], "prefix", 0),
        ([u, a, ("user", "x"), b], [u, a, ("user", "y"), b], "pair", 2),
    ]
    df = spark.createDataFrame([(n, c, r, "old") for n, (c, r, _, _) in enumerate(cases)], SCHEMA).drop("status")
    out = {x["id"]: x for x in pf.format_pairs(df).collect()}
    for n, (c, r, status, prefix) in enumerate(cases):
        got = out[n]
        assert (got["status"], got["n_prompt"]) == (status, prefix)
        assert got["prompt"] == render(c[:prefix])
        for side, turns in (("chosen", c), ("rejected", r)):
            assert got[side] == render(turns[prefix:])
            assert learned(got[f"{side}_mask"], got[side]) == "".join(t + pf.END for role, t in turns[prefix:] if role == "assistant")


def slow_report(rows):
    """What swapped conversations must give, one at a time."""
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None and turn is not None:
            turns.setdefault(conv, []).append((turn, role or "none", text or ""))
    turns = {c: [(r, t) for _, r, t in sorted(ts)] for c, ts in turns.items()}
    said = {c: [i for i, (r, _) in enumerate(ts) if r == "assistant"] for c, ts in turns.items()}
    ring, out = sorted(c for c in said if said[c]), {}
    for c, ts in turns.items():
        if not said[c]:
            out[c] = (None, "unanswered", len(ts), render(ts), None, None, "")
            continue
        partner = ring[(ring.index(c) + 1) % len(ring)]
        at, end = said[c][c % len(said[c])], said[c][-1] + 1
        chosen, rejected = ts[:end], [*ts[:at], ("assistant", turns[partner][said[partner][-1]][1])]
        n = next((i for i, (x, y) in enumerate(zip(chosen, rejected)) if x != y), len(rejected))
        status = "pair" if n < len(rejected) else "identical" if n == len(chosen) else "prefix"
        out[c] = (partner, status, n, render(ts[:n]), render(chosen[n:]), render(rejected[n:]), render(ts[end:]))
    return out


TURNS = "conv_id bigint, turn bigint, role string, text string, status string, turns string, branch int, n int, answer string"
FIELDS = ("partner_id", "status", "n_prompt", "prompt", "chosen", "rejected", "trailing")


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "k", "m", 1, 2, "z") for r in rows], TURNS)


def test_conversations(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a1"), (2, 0, "user", "q"), (2, 1, "assistant", "a2"), (2, 2, "user", "thanks"),
            (3, 0, "user", "only"), (4, 1, "assistant", "a1"), (4, 0, None, None), (None, 0, "user", "x"), (5, None, "user", "x"),
            (5000, 0, "user", "u"), (5000, 1, "assistant", "z"), (6, 0, "assistant", "a"), (6, 0, "assistant", "a"), (-7, 0, "assistant", None)]
    turns = conversations(spark, rows)
    out = {x["conv_id"]: x for x in pf.report(turns).collect()}
    assert {c: tuple(x[f] for f in FIELDS) for c, x in out.items()} == slow_report(rows)
    assert (out[1]["partner_id"], out[1]["status"], out[1]["n_prompt"]) == (2, "pair", 1)
    assert out[2]["trailing"] == render([("user", "thanks")]) and out[2]["chosen"] == render([("assistant", "a2")])
    assert (out[5000]["partner_id"], out[5000]["status"]) == (-7, "pair")
    assert pf.report(turns.limit(0)).collect() == []


def test_one_answered_conversation_is_its_own_partner(spark):
    rows = [(8, 0, "assistant", "a"), (9, 0, "user", "u")]
    out = {x["conv_id"]: x for x in pf.report(conversations(spark, rows)).collect()}
    assert (out[8]["partner_id"], out[8]["status"], out[8]["chosen"]) == (8, "identical", "")


def test_sparse_ids_and_chunks(spark):
    """Ids far apart, every status, turns after the last answer; any cut of the order gives the same partners."""
    import random

    r = random.Random(5)
    rows = []
    for c in range(120):
        conv = c * 1024 * (-1 if c % 7 == 0 else 1) + c
        roles = r.choices(["user", "assistant", "tool"], k=r.randrange(1, 9))
        rows += [(conv, i, role, r.choice(["yes", "no", f"t{r.randrange(30)}"])) for i, role in enumerate(roles)]
    want = slow_report(rows)
    assert {w[1] for w in want.values()} == {"pair", "prefix", "identical", "unanswered"}
    turns = conversations(spark, rows)
    out = {x["conv_id"]: x for x in pf.report(turns).collect()}
    assert {c: tuple(x[f] for f in FIELDS) for c, x in out.items()} == want
    for x in out.values():
        if x["status"] != "unanswered":
            for side in ("chosen", "rejected"):
                learned(x[f"{side}_mask"], x[side])
    pairs, _ = pf.swapped_pairs(turns, rows_per_chunk=9)
    assert {x["conv_id"]: x["partner_id"] for x in pairs.select("conv_id", "partner_id").collect()} == {c: w[0] for c, w in want.items() if w[0] is not None}
