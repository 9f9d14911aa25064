import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tallyscope.llm.prefix_trie import branched_turns, ids_sha256, numbered_turns, packed_trie, prefix_nodes


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own[c].append((turn is not None, turn or 0, role, key, text))
    own = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(rows):
    convs = rebuilt(rows)
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = sum(saved[k] for k in kids[node]) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    out = []
    for node, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(convs[c]) == len(node)))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(m), len(node), parent, len(m), len(kids[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def nodes(spark, rows, **how):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, key string").repartition(5)
    numbered = numbered_turns(df)
    got = prefix_nodes(branched_turns(numbered), numbered.select("conv_id").distinct(), **how)
    return sorted((tuple(r) for r in got.collect()), key=str)


def some_rows(seed):
    rng = random.Random(seed)
    texts = ["", "a", "bc", "déf", "😀 x", None]
    rows = []
    for c in [*range(0, 40), *range(100, 160), 200, 203, 251, 399, -3, -150]:
        for t in range(rng.choice([0, 1, 1, 2, 3, 5, 6, 8])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(texts[: 1 + rng.randint(1, 5)])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_like_brute_force(spark, seed):
    rows = some_rows(seed)
    rows += [(c, t, "user", f"same {t}") for c in range(500, 560) for t in range(4)]
    rows += [(600, None, "user", "first"), (600, None, None, None), (600, 0, "user", "second"), (600, 0, "user", "second"), (None, 1, "user", "left out")]
    for shard_turns in (200_000, 7):
        assert nodes(spark, rows, shard_turns=shard_turns) == brute(rows)


def test_long_conversations_go_over_levels(spark):
    rng = random.Random(3)
    rows = []
    for c in range(700, 760):
        n = rng.choice([31, 32, 33, 40, 64, 65, 97, 130])
        fork = rng.randint(0, n)
        rows += [(c, t, "user", f"t{t}" if t < fork else f"t{t} {c % 3}") for t in range(n)]
    for shard_turns in (200_000, 50):
        assert nodes(spark, rows, shard_turns=shard_turns) == brute(rows)


def test_few_partitions_or_many(spark):
    rows = some_rows(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for n in (1, 13):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            assert nodes(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_turnless_and_empty(spark):
    # conversations without a base and without turns of their own behind the first h belong to the root alone
    rows = [(c, 0, "user", "x") for c in range(901, 930)]
    want = brute(rows)
    assert nodes(spark, rows) == want and any(r[1] == 0 and r[3] == 29 for r in want)
    assert nodes(spark, [(None, 0, "user", "x")]) == []


def test_double_array_holds_each_sequence(words):
    rng = random.Random(6)
    seqs = sorted({tuple(rng.randrange(9) for _ in range(rng.randint(1, 7))) for _ in range(500)})
    seqs += sorted((100, c) for c in range(2000))
    lengths = np.array([len(s) for s in seqs])
    codes = np.zeros((len(seqs), 7), np.int64)
    for i, s in enumerate(seqs):
        codes[i, : len(s)] = s
    trie = packed_trie(codes, lengths)
    prefixes = {s[:d] for s in seqs for d in range(1, len(s) + 1)}
    places = set()
    for p in prefixes:
        node = 0
        for c in p:
            child = int(trie.base[node]) + c
            assert trie.check[child] == node
            node = child
        places.add(node)
    assert len(places) == len(prefixes) == int((trie.check[1:] != -1).sum())


def test_digests_of_large_groups(spark):
    ends = spark.range(5000).selectExpr("case when id % 5 = 0 then 'b' when id = 7 then '' else 'a' end as stop", "id * 3 - 6000 as conv_id").repartition(7)
    want = {s: hashlib.sha256(",".join(str(r.conv_id) for r in sorted(rows)).encode()).hexdigest() for s in ("a", "b", "") for rows in [ends.where(F_eq(s)).select("conv_id").collect()]}
    assert {r["stop"]: r["ends_sha256"] for r in ids_sha256(ends, chunk_ids=64).collect()} == want


def F_eq(stop):
    from pyspark.sql import functions as F

    return F.col("stop") == stop
