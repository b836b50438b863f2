from zlib import crc32

from roamframe.llm.ring import bounded_walk, ring_nodes, ring_shards


def test_counts_slots_and_sizes(documents, odd):
    rows = [*odd, *[(100 + i, f"text {i % 7}") for i in range(500)]]
    got = ring_shards(documents(rows), shards=8).collect()
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) == set(range(8))
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = sorted((len((t or "").encode()) + 1, crc32((t or "").encode())) for _, t in rows)
    assert sorted((r["size"], r.text_crc32) for r in got) == sizes
    assert all(r.law == "rows" and r.grown_shard is None for r in got)


def test_same_rows_same_shards_in_any_order(documents):
    rows = [(i, f"t{i}") for i in range(300)]
    one = {r.doc_id: (r.shard, r.slot) for r in ring_shards(documents(rows)).collect()}
    other = {r.doc_id: (r.shard, r.slot) for r in ring_shards(documents(rows[::-1]).repartition(5)).collect()}
    assert one == other


def test_another_shard_moves_few_rows(documents):
    rows = [(i, "t") for i in range(2000)]
    before = {r.doc_id: r.shard for r in ring_shards(documents(rows), shards=8).collect()}
    after = {r.doc_id: r.shard for r in ring_shards(documents(rows), shards=9).collect()}
    # A ninth of the rows must move; dealing anew would move eight ninths.
    assert sum(before[i] != after[i] for i in before) < 0.5 * len(rows)


def test_overflow_goes_on_clockwise():
    taken = bounded_walk([5, 1, 0], [0, 1, 2], {0: 2, 1: 2, 2: 2})
    assert taken == [(0, 0, 2, 0), (1, 0, 1, 1), (0, 2, 1, 1), (0, 3, 2, 2)]


def test_nodes_are_in_order_and_stay_when_a_shard_comes():
    small, large = ring_nodes([0, 1], 16), ring_nodes([0, 1, 2], 16)
    assert small == sorted(small) and [n for n in large if n[1] < 2] == small


def test_few_rows_and_none(documents):
    assert sorted(r.slot for r in ring_shards(documents([(1, "a"), (2, None)])).collect()) == [0, 0]
    assert ring_shards(documents([])).count() == 0
