"""The posterior decides, not the worst vote."""

import random

import numpy as np

from fieldscope.llm import weak_rules

WORDS = "the small river turns around a green valley where people often build houses and quiet gardens under tall trees".split()


def prose(rng, n):
    out = []
    for i in range(n):
        w = rng.choice(WORDS)
        out.append(w.capitalize() if i % 11 == 0 else w + "." if i % 11 == 10 else w)
    return "\n".join(" ".join(out[i : i + 30]) for i in range(0, n, 30))


def junk(rng, n):
    return " ".join(rng.choice(["###", "$$x%", "a1b2c3", "zz&&", "<|>", "QQQQ9"]) for _ in range(n))


def test_a_bad_vote_of_an_inaccurate_rule_is_forgiven(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.choice([60, 70, 120, 200, 300, 500]))) for i in range(300)] + [(1000 + i, prose(rng, 150) + " " + junk(rng, 120) if i % 3 else junk(rng, rng.choice([90, 200, 400]))) for i in range(60)]
    rows += [(2000, prose(rng, 70)), (2001, prose(rng, 100)), (2002, prose(rng, 150) + " " + junk(rng, 120))]
    votes = {i: np.array([r.vote(weak_rules.measure(t)) for r in weak_rules.RULES]) for i, t in rows}
    name = [r.name for r in weak_rules.RULES]
    assert [name[j] for j in np.flatnonzero(votes[2000] == -1)] == ["words"] and votes[2001][name.index("words")] == 0 and "symbols a word" in [name[j] for j in np.flatnonzero(votes[2002] == -1)]
    got = {r["doc_id"]: r for r in weak_rules.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2000]["kept"] and got[2001]["kept"] and not got[2002]["kept"]
    kept = {i for i, r in got.items() if r["kept"]}
    all_pass = {i for i in votes if not got[i]["base_failed"] and not (votes[i] == -1).any()}
    assert all_pass < kept and len(kept - all_pass) > 30 and not any(1000 <= i < 2000 for i in kept)
