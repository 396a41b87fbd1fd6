"""The prefix trie against its SQL, over odd conversations and with a sketch that is far too small."""

import random

import duckdb
import pytest

from tessella.llm import trie
from tessella.llm.queries import ORACLES, rebuilt

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversations():
    dice = random.Random(4)
    rows = []
    for conv in range(150):
        for turn in range(dice.randrange(5)):
            rows.append((conv, turn, dice.choice(["user", "assistant", None]), dice.choice(["a b", "a  b", "", None, "c\n"])))
    rows += [(300, t, "user", "same words here") for t in range(60)] + [(301, t, "user", "same words here") for t in range(70)]
    rows += [(400, None, "user", "no number"), (400, 0, "user", "a number"), (420, 1, "user", "long " * 30_000), (421, 1, "user", "long " * 30_000)]
    rows += [(500, 7, "user", "again")] * 5 + [(None, 0, "user", "nobody's"), (None, None, None, None), (-3, 0, "user", "below zero"), (2**40, 0, "user", "large id")]
    return rows


@pytest.fixture(scope="module")
def talk(spark):
    rows = [(*r, 1, "z") for r in conversations()]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos int, x1 string").repartition(5)


def expected(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    return con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLES['op12_prefix_trie']})").fetchall()


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: [(x is None, x or 0) if not isinstance(x, str) else (False, 0) for x in r] + [(False, r[7])])


@pytest.mark.parametrize("cells", [None, 8, 1 << 12])
def test_nodes(monkeypatch, talk, cells):
    monkeypatch.setattr(trie, "BLOCK", 4)  # several levels of blocks
    found = trie.nodes(*rebuilt(trie.turns(talk)), cells=cells)
    assert found.columns == COLUMNS
    assert ordered(found.collect()) == ordered(expected(conversations()))


def test_long_conversations(monkeypatch, spark):
    monkeypatch.setattr(trie, "ENDS", 3)  # several pieces of ids
    rows = [(c, t, "user", f"turn {t}") for c in (0, 1, 2) for t in range(2500)] + [(c, 0, "user", "turn 0") for c in range(40, 60)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert ordered(trie.nodes(*rebuilt(trie.turns(frame))).collect()) == ordered(expected(rows))


def test_sketch_never_says_one_for_two(spark):
    rows = spark.range(3000).selectExpr("explode(array(id * 7919, id * 7919, id * 104729 + 1)) AS x")
    bits = trie.sketch(rows.repartition(7), "x", 1 << 14)
    twice = trie._cells(spark.range(3000).selectExpr("id * 7919 AS x").toPandas()["x"].to_numpy(), 1 << 14)
    once = trie._cells(spark.range(3000).selectExpr("id * 104729 + 1 AS x").toPandas()["x"].to_numpy(), 1 << 14)
    met = lambda cells: sum((row[at >> 3] >> (7 - (at & 7)) & 1).astype(int) for row, at in zip(bits, cells)) == trie.HASHES
    assert met(twice).all() and met(once).mean() < 0.2


def test_no_conversation(spark, talk):
    assert trie.nodes(*rebuilt(trie.turns(talk.limit(0)))).count() == 0
    assert trie.nodes(*rebuilt(trie.turns(talk.where("conv_id IS NULL")))).count() == 0
