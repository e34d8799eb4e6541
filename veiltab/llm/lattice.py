"""Cheapest edits of a run of messages, found by auction prices on a lattice.

A node is (messages done, role state). States: 0 nothing yet, 1 after a system message, 2 after a user message, 3 after an
assistant message; 0 and 3 may end a conversation. Arcs are the edits: Delete and Keep and Rerole go one message on, Insert
stays at the message. All costs are whole numbers, so prices are.

The auction keeps a price for every node, never above the cost of any arc out of it plus the price at its end. A path
starts at an origin and grows along the cheapest arc plus price. Where the price of its last node lies below that
sum, the price is raised to it and the path gives the node up (contraction); otherwise the path takes the arc (extension).
When the path reaches the end or a node already settled, all its nodes are settled: their prices are costs to the end.
Origins are taken from the last message backwards, and a node starts at the least price of the next message's nodes, so
a path stays within a few nodes and the work is in proportion to the messages.

With every price settled, an edit is part of a cheapest repair if and only if its arc is tight (cost plus price at its end
equals the price at its start). A state has at most one arc of each letter, so from a given state the least letter among
tight arcs, again and again, gives the least of all cheapest letter strings.
"""
from __future__ import annotations

FAR = 1 << 60  # price of what cannot be reached
REACH = 40     # states of one message differ by less: one deletion and three insertions lead from any path to any other
STATES = 4
OPEN_END = (0, FAR, FAR, 0)
# Costs of the edits, kinds of messages, and the state that a role leads to (-1: not allowed there).
KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 3, 4, 3, 3
SOUND, MUST_GO, TRUNCATED = 0, 1, 2
ROLES = "sua"
AFTER = {"s": (1, -1, -1, -1), "u": (2, 2, -1, 2), "a": (-1, -1, 3, -1), " ": (-1, -1, -1, -1)}
NEXT_ROLE = "uuau"  # the one role a state can be given by Rerole or Insert


def _arcs(state: int, role: str, kind: int, here: int, after: int) -> list[tuple[str, int, int]]:
    """``(letter, cost, node)`` of the edits at a message, in order of their letters."""
    found = [("D", DELETE_COST, after + state), ("I", INSERT_COST, here + AFTER[NEXT_ROLE[state]][state])]
    if kind != MUST_GO:
        extra = TRUNCATED_COST if kind == TRUNCATED else 0
        if AFTER[role][state] >= 0:
            found.append(("K", KEEP_COST + extra, after + AFTER[role][state]))
        found.append(("R", REROLE_COST + extra, after + AFTER[NEXT_ROLE[state]][state]))
    return found


_TABLE = {(r, k): [[(x, c, to) for x, c, to in _arcs(s, r, k, 0, STATES)] for s in range(STATES)] for r in AFTER for k in (SOUND, MUST_GO, TRUNCATED)}
_LAST = [[("I", INSERT_COST, AFTER[NEXT_ROLE[s]][s])] for s in range(STATES)]


def prices(roles: str, kinds: bytes, end: tuple[int, ...] = OPEN_END, final: bool = True) -> list[int]:
    """Settled prices of all nodes, four per message and four at the end.

    ``end``: price of leaving in each state; ``final``: the conversation ends here, so that messages may be inserted last.
    """
    n = len(roles)
    price = [0] * (STATES * n) + list(end)
    if final:
        _settle(price, STATES * n, _LAST, min(end), end)
    for i in range(n - 1, -1, -1):
        at = STATES * i
        _settle(price, at, _TABLE[roles[i], kinds[i]], min(price[at + STATES: at + 2 * STATES]), None)
    return price


def _settle(price: list[int], at: int, arcs: list, least: int, end: tuple[int, ...] | None) -> None:
    """Run the auction from each state of one message; the nodes of later messages are settled."""
    price[at: at + STATES] = [least] * STATES
    settled = [False] * STATES
    for origin in range(STATES):
        path = [origin]
        while not settled[path[-1]]:
            state = path[-1]
            best, to = (end[state], -1) if end is not None else (FAR, -1)
            for _, cost, node in arcs[state]:
                value = cost + price[at + node]
                if value < best:
                    best, to = value, node
            if best > least + REACH:
                best, to = FAR, -1
            if price[at + state] < best:          # contraction; the origin itself stays
                price[at + state] = best
                if len(path) > 1:
                    path.pop()
            elif 0 <= to < STATES:                # extension; a path meets no node twice, as every round trip costs
                path.append(to)
            else:                                 # the end, a settled message, or nowhere
                break
        for state in path:
            settled[state] = True


def trace(roles: str, kinds: bytes, price: list[int], state: int, end: tuple[int, ...] = OPEN_END, final: bool = True) -> tuple[str, int]:
    """Least cheapest letters from a state at the first message, and the state they leave in."""
    letters, i, n = [], 0, len(roles)
    while i < n or final and end[state] != price[STATES * n + state]:
        here = price[STATES * i + state]
        for letter, cost, node in (_TABLE[roles[i], kinds[i]] if i < n else _LAST)[state]:
            if here == cost + price[STATES * i + node]:
                letters.append(letter)
                i, state = i + node // STATES, node % STATES
                break
        else:
            raise AssertionError("no tight arc")
    return "".join(letters), state


def apply(letters: str, state: int, roles: list[str], texts: list[str]) -> list[tuple[str, str]]:
    """Repaired ``(role, text)`` messages."""
    names, out, i = {"u": "user", "a": "assistant"}, [], 0
    for letter in letters:
        if letter == "K":
            out.append((roles[i], texts[i]))
            state = AFTER[initial(roles[i])][state]
        elif letter != "D":
            role = NEXT_ROLE[state]
            out.append((names[role], texts[i] if letter == "R" else ""))
            state = AFTER[role][state]
        i += letter != "I"
    return out


def initial(role: str) -> str:
    """First letter of a role; what no state accepts counts as a space."""
    return role[0] if role and role[0] in ROLES else " "
