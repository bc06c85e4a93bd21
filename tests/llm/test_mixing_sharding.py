import itertools
import random
import time
from collections import Counter
from fractions import Fraction

import pytest

from assay.llm import mixing, sharding


def deviations(plan, weights):
    """By brute force in exact fractions: the largest distance of any source from its target in each phase."""
    worst, start = Fraction(0), 0
    for _, phase in itertools.groupby(plan, key=lambda x: x[2]):
        phase = list(phase)
        live = {i for i, *_ in plan[start:]}
        own = {i: Fraction(weights[i]) for i in live if weights[i]} or dict.fromkeys(live, Fraction(1))
        total, seen = sum(own.values()), Counter()
        for n, (i, *_) in enumerate(phase, 1):
            seen[i] += 1
            # between two blocks of a source the distance grows evenly, so its own slots and the phase's end suffice
            worst = max(worst, abs(seen[i] - n * own[i] / total), abs(seen[i] - 1 - (n - 1) * own[i] / total))
        worst = max([worst, *(abs(seen[i] - len(phase) * w / total) for i, w in own.items())])
        start += len(phase)
    return worst


WEIGHTS = [([100_000 // 3, 200_000 // 3], [1 / 3, 2 / 3]), ([60_000, 30_000, 9_000, 1_000], [0.6, 0.3, 0.09, 0.01]), ([10, 3, 7], [2, 1, 1]), ([1, 1, 1], [5, 3, 1]),
           ([100, 1], [1, 9]), ([4], [3]), ([5, 2, 0, 3], [0, 0.3, 1, 0]), ([400] * 25, [0.1**0.5 * i for i in range(1, 26)]), ([50, 5000], [1e-9, 1])]


@pytest.mark.parametrize("blocks,weights", WEIGHTS)
def test_schedule_is_less_than_a_block_from_the_exact_weights(blocks, weights):
    whole = mixing.whole_weights(dict(enumerate(weights)))
    plan = mixing.schedule(blocks, [whole[i] for i in range(len(weights))])
    assert Counter(i for i, *_ in plan) == {i: b for i, b in enumerate(blocks) if b}
    assert all(release <= slot < deadline for slot, (_, _, _, release, deadline) in enumerate(plan))
    for i in range(len(blocks)):
        assert [k for j, k, *_ in plan if j == i] == list(range(blocks[i]))
    assert deviations(plan, weights) < 1


def test_weight_zero_comes_last():
    plan = mixing.schedule([3, 4, 2], [0, 5, 0])
    assert [i for i, *_ in plan] == [1, 1, 1, 1, 0, 2, 0, 2, 0]


def test_many_sources_are_planned_quickly():
    began = time.perf_counter()
    rows = mixing.plan_rows([100 + i for i in range(1000)], [i * i + 1 for i in range(1000)], 32)
    assert time.perf_counter() - began < 5 and len(rows) == 1000


@pytest.mark.parametrize("weights", [{"s0": -1}, {"s0": float("nan")}, {"s0": float("inf")}])
def test_unusable_weights_are_refused(weights):
    with pytest.raises(ValueError):
        mixing.whole_weights(weights)


def test_mix_keeps_every_row(docs):
    got = mixing.mix(docs, block_rows=4).toPandas()
    assert sorted(got["mix_position"]) == list(range(docs.count()))
    assert set(docs.columns) < set(got.columns)
    assert ((got["slot"] >= got["release"]) & (got["slot"] < got["deadline"])).all()
    assert got.groupby("slot")["source"].nunique(dropna=False).max() == 1
    assert got["source"].isna().sum() == 3


def test_mix_given_weights(docs):
    got = mixing.mix(docs, weights={"s0": 0.5, "s1": 0.25, "s2": 0.25, "s3": 0.0}, block_rows=1).toPandas()
    first = got[got["mix_position"] < 16]["source"].value_counts()
    assert first["s0"] == 8 and first["s1"] == 4 and "s3" not in first


def test_mix_against_a_walk_over_the_blocks(docs):
    """The rows of each slot are one source's block, in the order that the schedule gives."""
    weights = {"s0": 1 / 3, "s1": 2 / 3, "s3": 0.1}
    got = mixing.mix(docs, weights=weights, block_rows=5).toPandas().sort_values("mix_position")
    counts = Counter(r.source for r in docs.select("source").collect())
    names = sorted(counts, key=lambda s: (s is not None, s))
    whole = mixing.whole_weights({s: weights.get(s, 0) for s in names})
    want = []
    for slot, (i, k, *_) in enumerate(mixing.schedule([-(-counts[s] // 5) for s in names], [whole[s] for s in names])):
        want += [(names[i], k, slot)] * min(5, counts[names[i]] - 5 * k)
    assert [(None if s != s else s, b, t) for s, b, t in zip(got["source"], got["block"], got["slot"])] == want


def test_blocks_grow_with_the_table(docs):
    got = mixing.mix(docs, block_rows=1, max_blocks=10).toPandas()
    assert got["slot"].max() < 10 + docs.select("source").distinct().count()
    assert sorted(got["mix_position"]) == list(range(docs.count()))


def test_mix_empty(empty):
    assert mixing.mix(empty).count() == 0


def test_shards_are_level_and_gapless(docs):
    got = sharding.shard_rows(docs, 7).toPandas()
    n = got.groupby("shard").size()
    assert len(got) == docs.count() and n.max() - n.min() <= 1 and len(n) == 7
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert (got[got["text"].isna()]["size"] == 8).all() and (got[got["text"].isna()]["text_crc32"] == 0).all()
    assert set(docs.columns) < set(got.columns)


def test_slots_follow_the_mix(spark, docs, monkeypatch, tmp_path):
    import corpus_pipeline

    monkeypatch.setattr(sharding, "SPAN", 16)

    def reread(df, name):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    def in_order(t):
        return t.sort_values("mix_position")[["source", "doc_id"]].fillna("").values.tolist()

    before = reread(docs, "before")
    mixed = corpus_pipeline.mix_sources(spark, before, "")
    assert mixed.columns == docs.columns
    got = corpus_pipeline.place_in_shards(spark, reread(mixed, "mixed"), "").toPandas()
    expected = mixing.mix(before).toPandas()
    assert sorted(got["mix_position"]) == list(range(len(expected)))
    assert in_order(got) == in_order(expected)
    assert {(r.doc_id, r.text, r.size, r.text_crc32, r.shard) for r in got.itertuples() if r.text and r.doc_id == r.doc_id} == {
        (r.doc_id, r.text, r.size, r.text_crc32, r.shard) for r in sharding.shard_rows(docs, corpus_pipeline.SHARDS).toPandas().itertuples() if r.text and r.doc_id == r.doc_id
    }
    for _, g in got.sort_values("mix_position").groupby("shard"):
        assert list(g["slot"]) == list(range(len(g)))
    # without the mixing stage the slots come out in another order
    assert in_order(corpus_pipeline.place_in_shards(spark, before, "").toPandas()) != in_order(expected)


def test_rows_from_no_files_keep_their_order(spark, empty):
    rows = spark.range(100).selectExpr("id AS doc_id", "concat('text ', id % 9) AS text", "id AS `a.b`").coalesce(1)
    got = sharding.shards_in_order(rows, 3).orderBy("mix_position").toPandas()
    assert list(got["doc_id"]) == list(range(100)) and list(got["a.b"]) == list(range(100))
    assert sharding.shards_in_order(empty, 3).count() == 0


def test_one_more_shard_moves_a_bounded_part(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    a = {r.doc_id: r.shard for r in sharding.shard_rows(df, 8).collect()}
    b = {r.doc_id: r.shard for r in sharding.shard_rows(df, 9).collect()}
    assert sum(a[k] != b[k] for k in a) < 0.3 * len(a)  # a ninth at least; a fresh hash would move eight of nine


def test_spill_plan_follows_the_ring():
    plan = sharding.spill_plan([0, 1, 2], {0: 9}, 3)
    assert [(p[0], p[1], p[2], p[3]) for p in plan] == [(0, 0, 3, 0), (0, 3, 6, 1), (0, 6, 9, 2)]


def walk_the_ring(owners, demand, shards):
    """Row by row: own shard while it has room, then clockwise to the next point of a shard with room."""
    total = sum(demand.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    where, over = {}, []
    for arc, shard in enumerate(owners):
        for i in range(demand.get(arc, 0)):
            if room[shard]:
                room[shard] -= 1
                where[arc, i] = shard
            else:
                over.append((arc, i))
    on_the_way = []
    for step in range(2 * len(owners)):
        at = step % len(owners)
        while on_the_way and room[owners[at]]:
            room[owners[at]] -= 1
            where[on_the_way.pop(0)] = owners[at]
        if step < len(owners):
            on_the_way += [x for x in over if x[0] == at]
    return where


@pytest.mark.parametrize("seed", range(6))
def test_spill_plan_matches_a_walk_by_rows(seed):
    rng = random.Random(seed)
    shards = rng.choice([1, 3, 24])
    owners, arc_of = sharding.ring(shards, 8)
    demand = Counter(arc_of[rng.randrange(len(arc_of))] for _ in range(2000))
    demand[rng.randrange(len(owners))] += 1000  # a third of all rows are copies
    got = {(arc, i): shard for arc, lo, hi, shard, _ in sharding.spill_plan(owners, demand, shards) for i in range(lo, hi)}
    assert got == walk_the_ring(owners, demand, shards)
    sizes = Counter(got.values())
    assert max(sizes.values()) - min(sizes.values()) <= 1


@pytest.mark.parametrize("counts", [(24, 25), (8, 9), (32, 33)])
def test_share_of_rows_that_one_more_shard_moves(counts):
    rng = random.Random(1)
    cells = [rng.getrandbits(40) for _ in range(50_000)]
    placed = []
    for shards in counts:
        owners, arc_of = sharding.ring(shards)
        arcs = [arc_of[c >> 41 - len(arc_of).bit_length()] for c in cells]
        plan = {(arc, i): shard for arc, lo, hi, shard, _ in sharding.spill_plan(owners, Counter(arcs), shards) for i in range(lo, hi)}
        seen = Counter()
        placed.append([])
        for arc in arcs:
            placed[-1].append(plan[arc, seen[arc]])
            seen[arc] += 1
    moved = sum(a != b for a, b in zip(*placed, strict=True)) / len(cells)
    print("moved", counts, moved)
    assert 1 / counts[1] <= moved < 2.5 / counts[1]


def test_shard_empty(empty):
    assert sharding.shard_rows(empty, 3).count() == 0
