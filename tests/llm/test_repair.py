import hashlib
import heapq
import random
import re

from veiltab.llm import lattice, repair
from veiltab.llm.q_repair import op11_auction_repair

NEXT = {0: "u", 1: "u", 2: "a", 3: "u"}
DELTA = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}


def cheapest(roles, kinds):
    """Dijkstra on (cost, letters): the first arrival at the end is the least of the cheapest."""
    heap, done = [(0, "", 0, 0, 0)], set()
    while heap:
        cost, letters, stop, i, s = heapq.heappop(heap)
        if stop:
            return cost, letters
        if (i, s) in done:
            continue
        done.add((i, s))
        go = lambda c, x, j, t: heapq.heappush(heap, (cost + c, letters + x, 0, j, t))
        if i == len(roles) and s in (0, 3):
            heapq.heappush(heap, (cost, letters, 1, i, s))
        go(3, "I", i, DELTA[s, NEXT[s]])
        if i < len(roles):
            go(4, "D", i + 1, s)
            if kinds[i] != lattice.MUST_GO:
                extra = 3 if kinds[i] == lattice.TRUNCATED else 0
                if (s, roles[i]) in DELTA:
                    go(extra, "K", i + 1, DELTA[s, roles[i]])
                go(3 + extra, "R", i + 1, DELTA[s, NEXT[s]])


def brute(rows):
    """Rows ``(conv_id, turn, role, text)`` -> digest per conversation."""
    out = {}
    held = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    for conv in {r[0] for r in held}:
        mine = sorted((r[1:] for r in held if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, kinds, faults = set(), [], []
        for _, role, text in mine:
            core = re.sub(r"[\x20\x09-\x0D]+$", "", text)
            fault = "b" if not core else "d" if (role, text) in seen else "t" if core[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            kinds.append({"b": 1, "d": 1, "t": 2, "": 0}[fault])
        initials = [r[1][:1] if r[1][:1] in ("s", "u", "a") else " " for r in mine]
        cost, audit = cheapest(initials, kinds)
        state, body, i = 0, [], 0
        for x in audit:
            if x == "K":
                body.append(f"{mine[i][1]}:{mine[i][2]}")
                state = DELTA[state, initials[i]]
            elif x != "D":
                body.append(("user" if NEXT[state] == "u" else "assistant") + ":" + (mine[i][2] if x == "R" else ""))
                state = DELTA[state, NEXT[state]]
            i += x != "I"
        turns = [r[0] for r in mine if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(body).encode()).hexdigest(), body)
    return out


def test_auction_finds_the_least_of_the_cheapest():
    rnd = random.Random(3)
    for _ in range(3000):
        n = rnd.randrange(0, 14)
        roles, kinds = "".join(rnd.choice("suua a") for _ in range(n)), bytes(rnd.choice([0, 0, 0, 1, 2]) for _ in range(n))
        price = lattice.prices(roles, kinds)
        assert (price[0], lattice.trace(roles, kinds, price, 0)[0]) == cheapest(roles, kinds), (roles, kinds)


def test_work_is_in_proportion_to_the_messages():
    assert lattice.prices("ua" * 30_000, bytes(60_000))[0] == 0
    assert lattice.prices("u" * 60_000, bytes(60_000))[0] == 90_000  # every other one is given the other role


SCHEMA = "conv_id long, turn long, role string, text string"


def tables():
    rnd = random.Random(11)
    rows = [(c, t, rnd.choice(["system", "user", "assistant", "assistant", "tool", None, "", "User"]), rnd.choice(["Hello there.", "No end", "Why?", "", None, " \n\t", "Ünï 漢🙂!", "x" * 500 + "."]))
            for c in range(40) for t in rnd.sample(range(-3, 30), rnd.randrange(1, 12))]
    rows += [(None, None, None, None)] * 3 + [(None, 2, "user", "a."), (50, None, "user", "q?"), (50, None, "user", "q?"), (50, 4, "assistant", "z."), (51, 1, "user", "one."), (51, 1, "assistant", "two.")]
    return rows + [(77, t, ("user", "assistant", "user", "system")[t % 4], f"m{t % 50}" + "." * (t % 3)) for t in range(400)] + [(78, 5, "user", "same.")] * 200


def test_digest_and_messages(spark, monkeypatch):
    rows = tables()
    want = brute(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for piece_rows in (50_000, 25):  # the second cuts conversations into many pieces
        monkeypatch.setattr(repair, "PIECE_ROWS", piece_rows)
        repaired = repair.written(repair.repair(df))
        assert piece_rows > 25 or repaired.where("conv_id = 77").count() > 3
        got = {r.conv_id: tuple(r)[1:] for r in repair.digest(repaired).collect()}
        assert got == {c: w[:8] for c, w in want.items()}
        found = {}
        for r in sorted(repair.messages(repaired).collect(), key=lambda r: (r.part, r.place)):
            found.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
        assert found == {c: w[8] for c, w in want.items() if w[8]}


def test_other_columns_and_empty_tables(spark):
    assert repair.digest(repair.repair(spark.createDataFrame([], SCHEMA))).collect() == []
    clash = spark.createDataFrame([(1, 2, "user", "Hi.", "p", 3)], "c long, turn long, role string, text string, part string, copies int")
    assert [r.audit for r in repair.digest(repair.repair(clash, conv="c")).collect()] == ["KI"]


def test_query_returns_every_conversation(spark, tmp_path):
    rows = [(c, t, ("user", "assistant")[t % 2], f"Text {t}.") for c in range(300) for t in range(c % 5 + 1)] + [(None, None, None, None), (None, 1, "user", "Hm")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    import zlib

    hurt = []
    for c, t, r, x in rows:
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if d:
            r, x = " " if r is None else r, " " if x is None else x
            hurt += [(c, t, "user" if d == 4 else r, "" if d == 1 else re.sub("[.!?]", "", x) if d == 2 else x)] * (2 if d == 3 else 1)
    want = {c: (0, 0, 0, 0, 0, 0, "", repair.EMPTY_SHA) for c, *_ in rows} | {c: w[:8] for c, w in brute(hurt).items()}
    assert {r.conv_id: tuple(r)[1:] for r in op11_auction_repair(spark, str(tmp_path)).collect()} == want
    assert any(w[7] == repair.EMPTY_SHA and w[5] == 0 for w in want.values())
