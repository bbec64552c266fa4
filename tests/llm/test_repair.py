import random
import zlib
from functools import lru_cache
from hashlib import sha256

import pytest

from orrery.llm import repair

WS = " \t\n\x0b\x0c\r"
NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def plain_repair(rows):
    """(cost, audit, repaired) by trying every edit, whole audits compared; rows are (role, text, must go, truncated)."""

    @lru_cache(None)
    def best(i, q, put):
        found = []
        if i == len(rows) and q in ("", "a"):
            found.append((0, "", ()))
        for p in NEXT[q] if put < 3 else ():
            if p != "s":
                c, a, r = best(i, p, put + 1)
                found.append((c + 3, "I" + a, (({"u": "user", "a": "assistant"}[p], ""),) + r))
        if i < len(rows):
            role, text, gone, truncated = rows[i]
            c, a, r = best(i + 1, q, 0)
            found.append((c + 4, "D" + a, r))
            if not gone:
                if role[:1] and role[0] in NEXT[q]:
                    c, a, r = best(i + 1, NEXT[q][role[0]], 0)
                    found.append((c + 3 * truncated, "K" + a, ((role, text),) + r))
                for p in NEXT[q]:
                    if p != "s":
                        c, a, r = best(i + 1, p, 0)
                        found.append((c + 3 + 3 * truncated, "R" + a, (({"u": "user", "a": "assistant"}[p], text),) + r))
        return min(found, default=(1 << 40, "", ()))

    return best(0, "", 0)


def plain(table):
    """The query's rows from (conv_id, turn, role, text)."""
    out, convs = [], {}
    for conv, turn, role, text in table:
        own = convs.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        own.extend([] if kind == 0 else [(turn, role, text)] * (2 if kind == 3 else 1))
    for conv, own in convs.items():
        own.sort(key=lambda r: ((0, 0) if r[0] is None else (1, r[0])))
        turns = [t for t, *_ in own if t is not None]
        seen, rows, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in own:
            fault = "blank" if not text.strip(WS) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(WS)[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            rows.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, repaired = plain_repair(tuple(rows))
        digest = sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, digest))
    return sorted(out, key=repr)


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def random_table(seed, convs=60, most=14):
    rng = random.Random(seed)
    texts = ["Yes.", "No", " ", "", None, "Why?\n", "Then go on! ", "And so", " ", "a.\x0b"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "u", "System"]
    table = []
    for c in range(convs):
        turns = rng.sample([None, *range(-2, 40)], rng.randrange(0, most))
        table += [(c if c else None, t, rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"text {rng.random()}.") for t in turns]
    rng.shuffle(table)
    return table


def rows_of(spark, table, tmp_path):
    spark.createDataFrame(table, "conv_id long, turn long, role string, text string").write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    return sorted((tuple(r[c] for c in COLUMNS) for r in repair.op13_repair(spark, str(tmp_path)).collect()), key=repr)


@pytest.mark.parametrize(("seed", "piece"), [(1, 4096), (2, 2), (3, 1), (4, 3)])
def test_as_by_trying_every_edit_whatever_the_pieces(spark, tmp_path, monkeypatch, seed, piece):
    monkeypatch.setattr(repair, "ROWS_PER_PIECE", piece)
    table = random_table(seed)
    assert rows_of(spark, table, tmp_path) == plain(table)


def test_given_conversations(spark, sf_dir):
    table = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r[c] for c in COLUMNS) for r in repair.op13_repair(spark, sf_dir).collect()), key=repr)
    assert got == plain(table)


def test_a_conversation_of_a_third_of_all_rows_and_repeated_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(repair, "ROWS_PER_PIECE", 50)
    rng = random.Random(5)
    table = [(7, t, rng.choice(["user", "assistant"]), rng.choice(["On", "Off."]) + str(t // 3)) for t in range(700)]
    table += [(c, t, rng.choice(["user", "assistant", "system"]), f"Text {rng.random()}.") for c in range(100, 200) for t in range(7)]
    table += [(8, 3, "user", "Again.")] * 300
    import sys

    sys.setrecursionlimit(20000)
    assert rows_of(spark, table, tmp_path) == plain(table)


def test_edges(spark, tmp_path):
    assert rows_of(spark, [], tmp_path) == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert rows_of(spark, [(gone, 0, "user", "x")], tmp_path) == [(gone, 0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())]
    table = [(1, None, None, None), (1, None, "user", "a." * 100_000), (None, 5, "assistant", "Ok.")]
    assert rows_of(spark, table, tmp_path) == plain(table)


def test_other_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi.", 5, "x"), (1, 1, "assistant", "Hello.", 6, "y")], "conv_id long, turn long, role string, text string, seq int, `key` string")
    row = repair.repair_conversations(df).first()
    assert (row["edits"], row["cost"], [tuple(x) for x in row["repaired"]]) == ("KK", 0, [("user", "Hi."), ("assistant", "Hello.")])


def test_few_vectors_become_states():
    rep = repair.Repairs()
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randrange(1, 60)
        rep.scan(bytes(rng.randrange(9) for _ in range(n)), [rng.choice((1, 1, 3)) for _ in range(n)], rng.choice([rep.end, *rep.units]))
    assert len(rep.vectors) < 200
