import random
from itertools import product

import pytest

from orrery.llm import chats

COSTS = chats.Costs()


def cheapest(roles):
    """The least cost by trying every sequence of insertions, relabels and merges (at most two insertions a turn)."""
    best = [None]

    def go(k, state, cost):
        if best[0] is not None and cost > best[0]:
            return
        if k == len(roles):
            cost += 0 if state in chats.ENDS else COSTS.no_end
            best[0] = cost if best[0] is None else min(best[0], cost)
            return
        for new in chats.ROLES:
            price = 0 if new == roles[k] else COSTS.relabel if roles[k] in chats.ROLES else COSTS.unknown
            if state == new:
                go(k + 1, new, cost + price + COSTS.merge)
            for n in range(3):
                for run in product(("user", "assistant"), repeat=n):
                    at = state
                    for x in (*run, new):
                        if x not in chats.LEGAL[at]:
                            break
                        at = x
                    else:
                        go(k + 1, new, cost + price + n * COSTS.insert)

    go(0, "", 0)
    return best[0]


def legal(text):
    roles = [p.split("\n", 1)[0] for p in text.split("<|im_start|>")[1:]]
    assert text.count("<|im_end|>") == len(roles) and text.endswith("<|im_end|>\n")
    at = ""
    for r in roles:
        assert r in chats.LEGAL[at], roles
        at = r
    assert at in chats.ENDS
    return roles


@pytest.mark.parametrize("rows_per_piece", [2, 5, 4096])
def test_costs_are_least_whatever_the_pieces(spark, rows_per_piece):
    rng = random.Random(4)
    convs = {c: [rng.choice(["user", "assistant", "user", "assistant", "system", None, "tool", " User "]) for _ in range(rng.randrange(1, 7))] for c in range(60)}
    convs[99] = [rng.choice(["user", "assistant", "assistant"]) for _ in range(400)]
    rows = [(c, k, r, f"t{c}.{k}") for c, roles in convs.items() for k, r in enumerate(roles)]
    rng.shuffle(rows)
    found = chats.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), rows_per_piece=rows_per_piece).collect()
    assert len(found) == len(rows)
    for c, roles in convs.items():
        own = sorted((r for r in found if r.conv_id == c), key=lambda r: r.turn)
        text = "".join(r.rendered for r in own)
        out = legal(text)
        assert own[-1].seq + 1 == len(out) - (out == ["system", "user"] and own[-1].role == "system")
        assert all(f"t{c}.{k}" in r.rendered for k, r in enumerate(own))
        clean = [(r or "").strip().lower() for r in roles]
        cost = sum(r.cost for r in own) + (COSTS.no_end if own[-1].role == "system" else 0)
        if len(roles) < 7:
            assert cost == cheapest(clean), roles
        else:
            assert cost == min(x + (0 if chats.STATES[s] in chats.ENDS else COSTS.no_end) for s, x in enumerate(chats.ways(clean, 0, COSTS)[0]))
        seqs = [r.seq for r in own]
        assert seqs == sorted(seqs)


def test_legal_conversations_stay_as_they_are(spark, sf_dir):
    found = chats.op3_chat_format(spark, sf_dir).collect()
    assert len(found) == spark.read.parquet(f"{sf_dir}/conversations.parquet").count()
    assert all(r.role == r.role_in for r in found if r.action == "keep")
    assert sum(r.action != "keep" for r in found) < 0.1 * len(found)


def test_nulls_ties_and_clashing_columns(spark):
    schema = "conv_id long, turn long, role string, text string, part string, seq int"
    assert chats.format_chats(spark.createDataFrame([], schema)).collect() == []
    rows = [(None, None, "user", None, "p", 1), (None, 1, "assistant", "b", "p", 1), (3, 0, "user", "x", "p", 1), (3, 0, "user", "x", "p", 1), (4, 0, "system", "s", "p", 1)]
    found = chats.format_chats(spark.createDataFrame(rows, schema)).collect()
    text = lambda c: "".join(r.rendered for r in sorted((r for r in found if r.conv_id == c), key=lambda r: (r.turn or -1, r.seq, r.action)))
    assert text(None) == "<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n"
    assert text(3) == "<|im_start|>user\nx\n\nx<|im_end|>\n"
    assert text(4) == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
