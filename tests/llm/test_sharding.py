import zlib

from protomatch.llm.sharding import N_SLOTS, first_map, grow, place_records, read_map, rebalance, slot_sizes, write_map
from tests.llm.helpers import documents, odd_rows


def test_places_are_gapless_and_shards_near_equal(spark):
    docs = documents(spark, [(k, "x" * (k * 37 % 900), None, None, None) for k in range(6000)] + odd_rows(), clashes=True)
    sizes = slot_sizes(docs)
    rows = place_records(docs, first_map(sizes, 7)).collect()
    assert len(rows) == 6000 + len(odd_rows())
    assert sum(sizes) == sum(r["size"] for r in rows)
    load = [0] * 7
    for shard in range(7):
        inside = [r for r in rows if r["shard"] == shard]
        assert sorted(r["slot"] for r in inside) == list(range(len(inside)))
        load[shard] = sum(r["size"] for r in inside)
    assert max(load) <= 1.05 * sum(load) / 7
    texts = {r[0]: r[1] for r in odd_rows() if r[0] is not None and r[0] != 5}
    for r in rows:
        if r["doc_id"] == 12 and r["text_crc32"] == zlib.crc32(texts[12].encode()):
            assert r["size"] == len(texts[12].encode()) + 8


def test_growing_takes_slots_only_into_the_new_shard_and_evens_out(spark):
    sizes = [(k * 7919) % 1000 for k in range(N_SLOTS)]
    old = first_map(sizes, 24)
    new = grow(old, sizes)
    assert new.version == 2 and new.shards == 25
    assert all(b in (a, 24) for a, b in zip(old.shard_of, new.shard_of, strict=True))
    load = [sum(s for s, h in zip(sizes, new.shard_of, strict=True) if h == k) for k in range(25)]
    assert max(load) <= 1.05 * sum(sizes) / 25 and min(load) >= 0.95 * sum(sizes) / 25


def test_rebalancing_moves_little_and_keeps_versions(spark, tmp_path):
    sizes = [100] * N_SLOTS
    old = first_map(sizes, 8)
    sizes[:400] = [400 if old.shard_of[k] == 0 else 100 for k in range(400)]
    new = rebalance(old, sizes)
    load = [sum(s for s, h in zip(sizes, new.shard_of, strict=True) if h == k) for k in range(8)]
    assert max(load) <= 1.03 * sum(sizes) / 8
    assert sum(a != b for a, b in zip(old.shard_of, new.shard_of, strict=True)) < N_SLOTS / 20
    path = str(tmp_path / "maps")
    write_map(spark, old, sizes, path)
    write_map(spark, new, sizes, path)
    assert read_map(spark, path) == new and read_map(spark, path, 1) == old


def test_empty_table(spark):
    docs = documents(spark, [])
    assert place_records(docs, first_map(slot_sizes(docs), 3)).count() == 0
