import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from scriptorium.llm import prefix_trie as trie

CONV = "conv_id long, turn long, role string, text string, depth string, key string"


def plain_trie(rows, family=20, most=3):
    """The contract in plain Python."""
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % (most + 1)
        made[c] = own.get(c - c % family, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    words = lambda k: len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for k in members:
        if k:
            children[k[:-1]] += 1
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * words(k)
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(made[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def nodes(df, container):
    made = trie.prefix_trie(trie.forked(trie.turn_sequences(df)), container)
    assert made.columns == trie.COLUMNS
    return sorted((tuple(r) for r in made.collect()), key=str)


def some_rows(seed, convs, alphabet, most_turns):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(3 * convs), convs):
        for t in range(r.randint(1, most_turns)):
            rows.append((c, t if r.random() < 0.9 else None, r.choice(["user", "assistant", None]), r.choice(alphabet)))
    return rows + rows[:7]


@pytest.mark.parametrize("container", [2, 30, 100_000])
def test_against_plain_python(spark, container):
    rows = some_rows(1, 120, ["a b", "c", "", None], 6)
    rows += [(1000 + c, t, "user", f"same {t}") for c in range(60) for t in range(12)]  # many equal ones
    rows += [(2000, t, "user", f"long {t}") for t in range(300)] + [(None, 1, "user", "x")]
    df = spark.createDataFrame([(*x, "clash", "clash") for x in rows], CONV)
    assert nodes(df, container) == plain_trie(rows)


def test_chain_that_branches_at_every_turn(spark):
    rows = [(20 * c, t, "user", "go" if t < c else f"stop {c}") for c in range(12) for t in range(c + 1)]
    df = spark.createDataFrame([(*x, "", "") for x in rows], CONV)
    assert nodes(df, 8) == plain_trie(rows)


def test_ends_of_many_blocks(spark):
    rows = [(c, 0, "user", "same") for c in range(0, 5000)]
    df = spark.createDataFrame([(*x, "", "") for x in rows], CONV)
    assert nodes(df, 10) == plain_trie(rows)


def test_empty_and_turnless(spark):
    assert trie.prefix_trie(trie.forked(trie.turn_sequences(spark.createDataFrame([], CONV)))).count() == 0
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(c, 0, "user", "gone"), (c, 1, None, None)]  # no conversation 20: nothing is left
    df = spark.createDataFrame([(*x, "", "") for x in rows], CONV)
    assert nodes(df, 10) == plain_trie(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
