"""Operator 12: against a plain search over all edits, on whole tables, odd rows and conversations cut into many fragments."""

import hashlib
import random
import re
import zlib

import pytest
from tidemark.llm.conversations import damaged, repair, repair_report
from tidemark.llm.queries import op12_conversation_repair

WHITE = " \t\n\x0b\x0c\r"
LEGAL = re.compile(r"(s?(ua)+)?")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        k = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).digest()))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        t = text.strip(WHITE)
        out.append("blank" if not t else "duplicate" if (role, text) in seen else "truncated" if t[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, fault):
    """(cost, audit, kept rows) of the cheapest edits: every choice tried from each (row, roles so far modulo the pattern)."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    end = {"": (0, "", ()), "s": (10, "II", (("user", ""), ("assistant", ""))), "u": (5, "I", (("assistant", ""),)), "a": (0, "", ())}
    full = {"u": "user", "a": "assistant"}
    best = end
    for (_, _, role, text), f in reversed(list(zip(rows, fault))):
        row = {}
        for q in follow:
            tries = [(best[q][0] + 2, "D" + best[q][1], best[q][2])]
            if f not in ("blank", "duplicate"):
                more = 5 * (f == "truncated")
                if role[:1] in follow[q] and role[:1]:
                    c, a, kept = best[role[:1]]
                    tries.append((c + more, "K" + a, ((role, text), *kept)))
                for x in set(follow[q]) - {"s"}:
                    c, a, kept = best[x]
                    tries.append((c + more + 1, "R" + a, ((full[x], text), *kept)))
            row[q] = min(tries)
        for _ in range(4):  # insertions in front of the row
            new = dict(row)
            for q in follow:
                for x in set(follow[q]) - {"s"}:
                    c, a, kept = row[x]
                    new[q] = min(new[q], (c + 5, "I" + a, ((full[x], ""), *kept)))
            row = new
        best = row
    return best[""]


def expected(original, rows):
    out = {}
    for conv in {r[0] for r in original}:
        own = in_order([r for r in rows if r[0] == conv])
        f = faults(own)
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, kept = cheapest(own, f)
        assert LEGAL.fullmatch("".join(r[:1] for r, _ in kept))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out[conv] = (conv, gaps, f.count("blank"), f.count("duplicate"), f.count("truncated"), illegal, cost, audit, sha)
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")


def random_rows(seed, conversations=60):
    r = random.Random(seed)
    rows = []
    for c in range(conversations):
        for t in range(r.randrange(1, 14)):
            role = r.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "Unknown"])
            text = r.choice(["Yes.", "No!", "cut", "", " \n", None, "why?  ", f"word {r.random()}.", f"open {r.random()}", "Yes."])
            rows.append((c if c else None, r.choice([t, t, t + 2, 5, None]), role, text))
    return rows


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r) for r in op12_conversation_repair(spark, sf).collect()}
    assert got == expected(rows, damage(rows))


@pytest.mark.parametrize("seed,longest", [(1, 1 << 20), (2, 1), (3, 2), (4, 3)])
def test_odd_rows_in_one_or_many_fragments(spark, seed, longest):
    rows = random_rows(seed)
    df = table(spark, rows)
    got = {r.conv_id: tuple(r) for r in repair_report(damaged(df), df, longest).collect()}
    assert got == expected(rows, damage(rows))


def test_long_runs_and_a_hot_conversation(spark):
    rows = [(1, t, "user", f"q {t}.") for t in range(700)] + [(1, 700 + t, "assistant", "Same.") for t in range(700)]
    rows += [(2, 3, "user", "Again.")] * 500 + [(2, 4, "assistant", "word " * 60_000 + "end.")] + [(3, 1, "system", "Only.")]
    df = table(spark, rows)
    for longest in (1 << 20, 97):
        got = {r.conv_id: tuple(r) for r in repair_report(df, df, longest).collect()}
        assert got == expected(rows, rows)


def test_rows_keep_texts_and_positions(spark):
    df = table(spark, [(7, 1, "user", "Hi."), (7, 2, "user", "Still here."), (7, 3, "assistant", "Yes.")])
    df = df.selectExpr("*", "turn AS position", "role AS edit", "1 AS fault")
    rows, counts = repair(df)
    assert [tuple(r)[1:] for r in sorted(rows.collect(), key=lambda r: r.position)] == [
        (0, "D", 1, "user", "Hi."), (1, "K", 2, "user", "Still here."), (2, "K", 3, "assistant", "Yes.")]
    assert [tuple(r) for r in counts.collect()] == [(7, 0, 0, 0, 0, 1, 2)]
    empty = df.limit(0)
    assert repair(empty)[0].collect() == [] and repair_report(empty, empty).collect() == []
    assert [tuple(r) for r in repair_report(empty, df).collect()] == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
