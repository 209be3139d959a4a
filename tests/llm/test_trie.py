"""The prefix trie against a dictionary of all prefixes."""

import hashlib
import random
import re
import zlib

import pytest

from ledgerloom.llm import prefix_trie

TURNS = "conv_id long, turn long, role string, text string, chain string, depth long"


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def brute(rows, rebuild=True):
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    after = lambda c: zlib.crc32(str(c).encode()) % 4
    base = lambda c: c - (abs(c) % 20) * (1 if c > 0 else -1)
    chains = {c: own.get(base(c), [])[: after(c)] + turns[after(c) :] for c, turns in own.items()} if rebuild else own
    nodes = {}
    for conv, turns in chains.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(conv)
    children = {}
    for key in nodes:
        if key:
            children.setdefault(key[:-1], []).append(key)
    leaves, saved = {}, {}
    for key in sorted(nodes, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", key[-1][1])) if key else 0
        below = children.get(key, [])
        leaves[key] = sum(leaves[k] for k in below) if below else 1
        saved[key] = (len(nodes[key]) - 1) * words + sum(saved[k] for k in below)
    ends = lambda key: hashlib.sha256(",".join(map(str, sorted(c for c in nodes[key] if len(chains[c]) == len(key)))).encode()).hexdigest()
    return sorted(
        (len(key), min(convs), min(nodes[key[:-1]]) if key else None, len(convs), len(children.get(key, [])), leaves[key], saved[key], ends(key))
        for key, convs in nodes.items()
    )


def shown(df):
    return sorted((r.depth, r.conv_id, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def generated(seed):
    rng, rows = random.Random(seed), []
    said = ["", None, "hello there", "a b  c\td", "é漢 x", "yes", "no"]
    for conv in [*range(-25, 60), *rng.sample(range(100, 2000), 40)]:
        if conv % 20 or rng.random() < 0.8:
            kind = rng.random()
            size = rng.randint(1, 4) if kind < 0.8 else rng.choice([5, 30])
            rows += [(conv, k, "user" if kind > 0.5 else rng.choice(["user", "assistant", None]), "same" if kind > 0.9 else rng.choice(said), "x", 1) for k in range(size)]
    rows += [(7, None, "user", "first of all", "x", 1), (7, 0, "b", "tie", "x", 1), (7, 0, "a", "tie", "x", 1), (8, 0, "user", "yes", "x", 1), (8, 0, "user", "yes", "x", 1), (None, 0, "user", "no id", "x", 1)]
    return rows + [(5000, k, "user", f"turn {k % 3}", "x", 1) for k in range(300)] + [(5001, k, "user", f"turn {k % 3}", "x", 1) for k in range(280)]


@pytest.mark.parametrize(("seed", "pack"), [(1, prefix_trie.PACK), (1, 100), (2, 1), (3, 1500)])
def test_nodes_equal_brute_force(spark, seed, pack):
    rows = generated(seed)
    found = prefix_trie.conversations(spark.createDataFrame(rows, TURNS).repartition(3))
    assert shown(prefix_trie.trie(prefix_trie.rebuilt(found), pack)) == brute(rows)


def test_equal_conversations_and_one_that_grows(spark):
    """Copies of one conversation stream through one task; each snapshot of a growing one ends on the way of the next."""
    rows = [(c, k, "user", f"copy {k}", "x", 1) for c in range(3000) for k in range(2)]
    rows += [(10_000 + c, k, "user", f"step {k}", "x", 1) for c in range(60) for k in range(c)]
    found = prefix_trie.conversations(spark.createDataFrame(rows, TURNS))
    got = shown(prefix_trie.trie(prefix_trie.chained(found), 2000))
    assert got == brute(rows, rebuild=False) and got[0][:6] == (0, 0, None, 3059, 2, 2)


def test_empty_and_turnless(spark):
    empty = spark.createDataFrame([], TURNS)
    assert prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.conversations(empty))).count() == 0
    alone = next(c for c in range(1, 100) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)  # its base is absent, its own turn is cut
    rows = [(alone, 0, "user", "gone", "x", 1)]
    got = shown(prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.conversations(spark.createDataFrame(rows, TURNS)))))
    assert got == brute(rows) == [(0, alone, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]
