"""The prefix trie of conversations against a recursive version, and its SQL on odd rows."""

import hashlib
import random
import zlib

import duckdb
import pytest

from segquery.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """Nodes of nested dictionaries."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(c - 100 * int(c / 100))
        paths[c] = own.get(base, [])[:h] + turns[h:]
    nodes = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes.setdefault(tuple(p[:d]), []).append(c)
    out = []
    for key, members in nodes.items():
        under = [k for k in nodes if k[: len(key)] == key]
        kids = [k for k in under if len(k) == len(key) + 1]
        leaves = [k for k in under if not any(len(x) == len(k) + 1 and x[: len(k)] == k for x in under)]
        saved = sum((len(nodes[k]) - 1) * len(k[-1][1]) for k in under if k)
        ends = ",".join(str(c) for c in sorted(c for c in members if len(paths[c]) == len(key)))
        out.append((min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed, n=60):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-250, 520), n):
        rows += [(c, r.choice([k, k, k, None]), r.choice(["user", "assistant", None]), r.choice(["a", "b", "", "é😀", None])) for k in range(r.randrange(1, 9))]
    chain = [(100, k, "user", f"turn {k % 3}") for k in range(40)]
    copies = [(700 + c, k, "u", "same") for c in range(30) for k in range(7)]
    rows += [*chain, *copies, (None, 0, "user", "lost"), (500, 1, "u", "x"), (500, 1, "u", "x"), (500, 1, "a", "x")]
    r.shuffle(rows)
    return rows


def trie_of(df):
    got = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns_of(df))).select(*NAMES)
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_recursion(spark, seed):
    rows = made(seed)
    df = spark.createDataFrame([(*r, "?", "?") for r in rows], SCHEMA + ", node string, depth string").repartition(4)
    got = trie_of(df)
    assert got == plain(rows) and len(got) > 100


def test_many_ends_in_pieces(spark, monkeypatch):
    """The ids of one node travel packed, in pieces of any size."""
    rows = [(c, 0, "u", "same") for c in range(1, 1500)]
    want = plain(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert trie_of(df) == want
    monkeypatch.setattr(prefix_trie, "ENDS", 10)
    assert trie_of(df) == want


def test_digests_tell_turns_apart(spark):
    """Where one field ends and the next begins counts."""
    rows = [(1, 0, "a", "bc"), (2, 0, "ab", "c"), (3, 0, "abc", ""), (4, 0, "a", "b"), (4, 1, "c", "")]
    turns = spark.createDataFrame(rows, SCHEMA)
    nodes = prefix_trie.trie(prefix_trie.turns_of(turns))
    assert nodes.where("depth = 1").count() == 4


def test_long_conversation_and_deep_sharing(spark):
    """Two conversations of 3,000 shared turns: rows of the explosion stay in proportion to the turns."""
    rows = [(c, k, "u", str(k)) for c in (100_001, 100_002) for k in range(3000)]
    steps = prefix_trie.prefixes(prefix_trie.turns_of(spark.createDataFrame(rows, SCHEMA)))
    assert steps.count() == 6002
    got = prefix_trie.trie(prefix_trie.turns_of(spark.createDataFrame(rows, SCHEMA)))
    root = got.where("depth = 0").first()
    assert (root.n_convs, root.n_children, root.n_leaves, root.saved_tokens) == (2, 1, 1, sum(len(str(k)) for k in range(3000)))


def test_sql_on_odd_rows(spark, tmp_path):
    df = spark.createDataFrame([r for r in made(9) if r[0] is None or r[0] >= 0], SCHEMA)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    rel = con.sql(queries.SQL["op13_prefix_trie"])
    theirs = sorted((tuple(r[rel.columns.index(c)] for c in NAMES) for r in rel.fetchall()), key=str)
    assert sorted(map(tuple, queries.op13_prefix_trie(spark, str(tmp_path)).select(*NAMES).collect()), key=str) == theirs


def test_empty(spark):
    assert prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns_of(spark.createDataFrame([], SCHEMA)))).count() == 0
