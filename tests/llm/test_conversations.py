import hashlib
import re
import zlib
from collections import Counter

from pollspark.llm import conversations as C

BLANK = r"[^\x20\x09-\x0D]"


def damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(c, t, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def brute(rows):
    """The summary of one conversation's damaged rows in order, by all cheapest edit strings of each prefix and state."""
    turns = [t for _, t, *_ in rows if t is not None]
    faults, seen = [], set()
    for _, _, role, text in rows:
        mark = re.findall(BLANK, text)
        faults.append("blank" if not mark else "duplicate" if (role, text) in seen else "truncated" if mark[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {"": (0, "", ())}  # initials so far ("", s, u, a) -> cost, audit, rows

    def better(table, state, entry):
        if state not in table or entry[:2] < table[state][:2]:
            table[state] = entry

    def follows(state, c):
        return {"s": state == "", "u": state in ("", "s", "a"), "a": state == "u"}.get(c, False)

    def inserted(table):
        for _ in range(4):
            for state, (cost, audit, kept) in list(table.items()):
                for role in ("user", "assistant"):
                    if follows(state, role[0]):
                        better(table, role[0], (cost + 2, audit + "I", kept + ((role, ""),)))
        return table

    for (_, _, role, text), fault in zip(rows, faults):
        now = {}
        for state, (cost, audit, kept) in inserted(best).items():
            better(now, state, (cost + 3, audit + "D", kept))
            if fault in ("", "truncated"):
                more = fault == "truncated"
                if follows(state, role[:1]):
                    better(now, role[:1], (cost + more, audit + "K", kept + ((role, text),)))
                for other in ("user", "assistant"):
                    if follows(state, other[0]):
                        better(now, other[0], (cost + 2 + more, audit + "R", kept + ((other, text),)))
        best = now
    cost, audit, kept = min(v for k, v in inserted(best).items() if k in ("", "a"))
    n = Counter(faults)
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())


def ordered(rows):
    def digest(r):
        return hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], digest(r)))


def check(spark, rows, block):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS fault", "'x' AS _conv", "'y' AS count", "'z' AS one")
    found = C.repaired_summaries(df.repartition(3), C.damaged(df.repartition(3)), block=block).collect()
    want = {c: brute(ordered([r for r in damage(rows) if r[0] == c])) for c in {r[0] for r in rows}}
    assert {r[0]: tuple(r)[1:] for r in found} == want and len(found) == len(want)


def test_repair_equals_brute_force(spark):
    import random
    r = random.Random(5)
    rows = []
    for c in range(150):
        for t in range(r.randint(1, 14)):
            role = r.choice(["system", "user", "user", "assistant", "assistant", "tool", "", "User"]) if c % 2 else ("system" if t == 0 else ("assistant", "user")[t % 2])
            rows.append((c, t + (r.random() < .2) * 3, role, r.choice(["a.", "b!", "open", " \n", "c? ", "d" * r.randint(0, 3)])))
    rows += [(200, None, "user", "x."), (200, None, None, None), (200, 4, "assistant", "x."), (None, 1, "user", "q?"), (None, None, "assistant", "r."), (None, 2, "assistant", None)]
    rows += [(201, 3, "user", "same.")] * 40 + [(202, None, "user", None)] * 3 + [(203, 0, "user", "w " * 50_000)] + rows[:5]
    for block in (4096, 3):
        check(spark, rows, block)


def test_long_conversation_in_blocks(spark):
    rows = [(1, t, ("assistant", "user", "system", "user", "user")[t * t % 5], ("ok.", f"open {t}", f"t{t}.", " ")[t * 7 % 4]) for t in range(500)]
    check(spark, rows, 16)


def test_pieces_hold_the_rows(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "hello."), (1, 1, "user", "bye")], "conv_id long, turn long, role string, text string")
    piece = C.repair(df).first()
    assert piece.edits == "IKD" and piece.cost == 5 and piece.roles == ["user", "assistant"] and piece.texts == ["", "hello."]


def test_no_rows(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.repaired_summaries(none, C.damaged(none)).count() == 0
