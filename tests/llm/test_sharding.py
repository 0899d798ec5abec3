from terravane.llm import sharding as S
from terravane.llm._shared import new_path


def test_maps_keep_their_shards_and_moves(spark):
    path = new_path(spark, "map")
    first = S.initial_map(4, 64)
    grown = S.rebalance(first, {s: 10 + s % 3 for s in range(64)}, 6)
    idle = S.rebalance(first, {}, 6)  # shards without a slot
    S.write_map(spark, first, path)
    S.write_map(spark, grown, path)
    assert S.read_map(spark, path, 1) == first and S.read_map(spark, path) == grown
    assert grown.n_shards == 6 and grown.version == 2 and grown.moved and all(grown.shard_of[s] == b and first.shard_of[s] == a for s, a, b in grown.moved)
    load = [0] * 6
    for s in range(64):
        load[grown.shard_of[s]] += 10 + s % 3
    assert max(load) - min(load) <= 12
    other = new_path(spark, "map")
    S.write_map(spark, idle, other)
    assert S.read_map(spark, other).n_shards == 6
