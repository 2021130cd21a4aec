"""Repair, prefix trie and shards against brute force, and on odd rows."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from codicil.llm import conversation_repair as repair
from codicil.llm import prefix_trie, sharding
from codicil.llm.common import shared_path
from codicil.llm.queries import ORACLE_SQL, QUERIES

WORD = re.compile("[^\x20\x09-\x0d]+")
TURNS = "conv_id long, turn long, role string, text string, position string, shard string, depth int"


@pytest.fixture(scope="module")
def odd_turns(spark):
    """Nulls everywhere, repeated and tied rows, a long text, equal conversations, and columns whose names operators use."""
    long = "word " * 200_000 + "."
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Hello."), (2, 0, "user", "Hi."), (2, 0, "user", "Hi."), (2, None, None, None), (2, 5, "assistant", long),
        (3, None, "user", None), (None, 1, "user", "Hm?"), (None, 2, "assistant", ""), (None, None, "assistant", "x."), (4, 1, "system", "Be kind."), (4, 2, "user", "Hi."), (4, 3, "assistant", "Hello."),
        (5, -(2**63), "tool", "A.\n "), (5, 2**63 - 1, "", "B"), (6, 1, "user", "q"), (6, 1, "assistant", "a."), (6, 1, "user", "q2?"),
    ]
    return spark.createDataFrame([(*r, "p", "s", 7) for r in rows], TURNS)


def forward(codes):
    """(cost, audit) by a table of the best prefix of each grammar state."""
    kept, made = ({0: 1, 1: 2}, {1: 2}, {2: 3}, {1: 2}), (2, 2, 3, 2)

    def better(table, state, way):
        if state not in table or way < table[state]:
            table[state] = way

    def inserted(table):
        for _ in range(3):
            for s, (c, a) in list(table.items()):
                better(table, made[s], (c + 2, a + "I"))
        return table

    best = {0: (0, "")}
    for code in codes:
        kind, fault = divmod(code, 3)
        table = {}
        for s, (c, a) in inserted(best).items():
            better(table, s, (c + 3, a + "D"))
            if fault != 1:
                if kind in kept[s]:
                    better(table, kept[s][kind], (c + (fault == 2), a + "K"))
                better(table, made[s], (c + 2 + (fault == 2), a + "R"))
        best = table
    return min(way for s, way in inserted(best).items() if s in (0, 3))


def test_cheapest_is_the_least_of_all():
    for n in range(4):
        for codes in itertools.product(range(12), repeat=n):
            assert repair.cheapest(bytes(codes)) == forward(codes)
    dealt = random.Random(5)
    for n in (7, 30, 200):
        for _ in range(150):
            codes = bytes(dealt.choices(range(12), k=n))
            assert repair.cheapest(codes) == forward(codes)


def test_bounds_never_exceed_the_cost():
    dealt = random.Random(6)
    for _ in range(200):
        codes = bytes(dealt.choices(range(12), k=12))
        assert repair.suffix_bounds(codes)[0] <= repair.cheapest(codes)[0]


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op13_prefix_trie"])
def test_sql(name, spark, small, duck):
    got, want = QUERIES[name](spark, small), duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_repair_odd(spark, odd_turns):
    plans = repair.repair_plans(odd_turns)
    by_id = {r.conv_id: r for r in plans.collect()}
    assert set(by_id) == {None, 1, 2, 3, 4, 5, 6}
    assert (by_id[1].cost, by_id[1].audit, by_id[1].gaps) == (0, "KKK", 0)
    assert (by_id[2].n_rows, by_id[2].gaps, by_id[2].blank, by_id[2].duplicate, by_id[2].illegal, by_id[2].audit, by_id[2].cost) == (4, 4, 1, 1, 2, "DKDK", 6)
    assert (by_id[3].blank, by_id[3].audit, by_id[3].gaps) == (1, "D", 0)
    assert by_id[5].gaps == 2**63 - 1 and by_id[6].n_rows == 3
    rows = collections.defaultdict(list)
    for r in repair.repaired(odd_turns.repartition(5), plans).collect():
        rows[r.conv_id].append(r)
    for c, part in rows.items():
        part.sort(key=lambda r: r.position)
        assert [r.position for r in part] == list(range(len(part)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in part))
        assert "".join(r.edit for r in part) == by_id[c].audit.replace("D", "")
    assert [len(r.text) for r in rows[2]] == [3, 1_000_001] and 3 not in rows
    assert repair.repair_plans(odd_turns.limit(0)).count() == 0
    assert repair.repaired(odd_turns.limit(0), plans.limit(0)).count() == 0


def test_repair_does_not_depend_on_partitions(spark, small):
    turns = repair.damaged(spark.read.parquet(f"{small}/conversations.parquet"))
    got = [sorted(map(repr, repair.digests(repair.repaired(t, repair.repair_plans(t))).collect())) for t in (turns, turns.repartition(7, "text"))]
    assert got[0] == got[1] and len(got[0]) > 10


def brute_trie(paths):
    """A row for each prefix of the paths {conv_id: ((role, text), ...)}."""
    members = collections.defaultdict(set)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
    out = set()
    for p, here in members.items():
        under = [x for x in members if x[: len(p)] == p]
        children = [x for x in under if len(x) == len(p) + 1]
        leaves = sum(not any(y[: len(x)] == x for y in under if len(y) == len(x) + 1) for x in under)
        saved = sum((len(members[x]) - 1) * len(WORD.findall(x[-1][1])) for x in under if x)
        ends = ",".join(map(str, sorted(c for c in here if len(paths[c]) == len(p))))
        out.add((min(here), len(p), min(members[p[:-1]]) if p else None, len(here), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def trie_rows(trie):
    return {tuple(r) for r in trie.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()}


def test_trie(spark, odd_turns, small):
    dealt = random.Random(8)
    paths = {c: tuple((dealt.choice(["user", "assistant"]), dealt.choice(["a b", "c", ""])) for _ in range(dealt.choice([0, 1, 2, 3, 9]))) for c in range(-40, 80)}
    rows = [(c, i, role, text, "p", "s", 7) for c, path in paths.items() for i, (role, text) in enumerate(path)]
    turns, ids = spark.createDataFrame(rows, TURNS), spark.createDataFrame([(c,) for c in [*paths, None]], "conv_id long")
    for sizes in ((4096, 128), (3, 2)):
        got = prefix_trie.prefix_trie(turns, ids, *sizes)
        assert trie_rows(got) == brute_trie(paths) and got.count() == got.select("path").distinct().count()
    own = collections.defaultdict(list)
    for r in odd_turns.filter("conv_id IS NOT NULL").collect():
        own[r.conv_id].append(((r.turn is not None, r.turn or 0), r.role or "", r.text or ""))
    key = lambda x: (x[0], x[1], hashlib.sha256(f"{len(x[1])}:{x[1]}{x[2]}".encode()).hexdigest())
    want = brute_trie({c: tuple((role, text) for _, role, text in sorted(rows, key=key)) for c, rows in own.items()})
    assert trie_rows(prefix_trie.prefix_trie(odd_turns, None, 2, 2)) == want
    assert prefix_trie.prefix_trie(odd_turns.limit(0)).count() == 0


def places(rows, n_shards):
    count = collections.Counter(r.shard for r in rows)
    assert set(count) <= set(range(n_shards)) and (not count or max(count.values()) - min(count[s] for s in range(n_shards)) <= 1)
    for s in count:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(count[s]))


def test_op12(spark, small, texts):
    rows = QUERIES["op12_shuffled_shards"](spark, small).collect()
    places(rows, 8)
    assert {(r.doc_id, r.size, r.text_crc32) for r in rows} == {(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts.items()}
    assert len(rows) == len(texts) and {(r.law, r.grown_shard) for r in rows} == {("rows", None)}


def test_fisher_yates_gives_each_order_about_as_often():
    found = collections.Counter(tuple(sharding.fisher_yates(4, 1, b)) for b in range(6000))
    assert len(found) == 24 and max(found.values()) < 2 * min(found.values())


def test_shards_hot_and_odd_rows(spark, odd, nothing, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    hot = docs.limit(1).select("*", F.explode(F.array_repeat(F.lit(1), 2500))).drop("col")
    whole = docs.unionByName(hot)
    got = [sharding.shuffled_shards(d, shared_path(spark, "test-shards"), shards=5, seed=s, bucket_bytes=100_000).select("shard", "slot", "row.*").collect() for d, s in ((whole, 3), (whole.repartition(9), 3), (whole, 4))]
    assert sorted(got[0]) == sorted(got[1]) != sorted(got[2])
    places(got[0], 5)
    assert collections.Counter(r.doc_id for r in got[0]) == collections.Counter(r.doc_id for r in whole.select("doc_id").collect())
    of_hot = collections.Counter(r.shard for r in got[0] if r.doc_id == docs.first().doc_id)
    assert min(of_hot[s] for s in range(5)) > 400  # also copies of one row are spread
    rows = sharding.shuffled_shards(odd, shared_path(spark, "test-shards"), shards=3).select("shard", "slot", "row.*")
    assert rows.columns[2:] == odd.columns
    places(rows.collect(), 3)
    assert collections.Counter(map(repr, rows.select(*odd.columns).collect())) == collections.Counter(map(repr, odd.collect()))
    assert sharding.shuffled_shards(nothing, shared_path(spark, "test-shards")).count() == 0
