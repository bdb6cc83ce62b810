import heapq
import random
import zlib
from collections import Counter, defaultdict

import pytest

from tracewright.llm import sharding


def plain(sizes, shards):
    """Loads and how many of each size by a heap over all groups."""
    heap, given = [(0, s) for s in range(shards)], defaultdict(lambda: [0] * shards)
    for size in sorted(sizes, reverse=True):
        load, s = heapq.heappop(heap)
        given[size][s] += 1
        heapq.heappush(heap, (load + size, s))
    return [x for x, _ in sorted(heap, key=lambda x: x[1])], dict(given)


@pytest.mark.parametrize("most,n", [(50, 100_000), (10**6, 100_000), (3, 5000), (40, 60), (1, 1000)])
def test_loads_are_those_of_the_plain_heap(most, n):
    r = random.Random(most)
    sizes = [r.randrange(1, most + 1) for _ in range(n)] + [10**7, 10**7, n * most // 3]
    got = dict(sharding.longest_first(Counter(sizes).items(), 16))
    loads, given = plain(sizes, 16)
    assert got == given
    assert [sum(size * k[s] for size, k in got.items()) for s in range(16)] == loads


def test_longest_first_of_few():
    loads = lambda got: sorted(sum(size * k[s] for size, k in got) for s in range(2))
    assert loads(sharding.longest_first(Counter([7, 5, 4, 3, 3]).items(), 2)) == [10, 12]
    assert sharding.longest_first([], 4) == []


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_shard(spark, monkeypatch, broadcast):
    monkeypatch.setattr(sharding, "SLOTS_PER_TASK", 40)
    monkeypatch.setattr(sharding, "HOT", 20)
    monkeypatch.setattr(sharding, "BROADCAST_SIZES", broadcast)
    r = random.Random(3)
    texts = ["é" * r.randrange(1, 300) + str(r.randrange(90)) for _ in range(1500)]
    rows = [(i, t, "z") for i, t in enumerate(texts)] + [(5, texts[5], "z"), (5, texts[5], "z"), (None, "x", "z"), (None, "x", "z"), (9000, None, "z"), (9001, "", "z"), (9002, "y" * 1_200_000, "z")]
    rows += [(10_000 + i, "hot", "z") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string").repartition(5)
    got = sharding.shard(docs).collect()
    assert sorted((str(x.doc_id), x.size, x.text_crc32) for x in got) == sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    slots, load, of = defaultdict(list), defaultdict(int), {d: t or "" for d, t, _ in rows}
    homes = defaultdict(set)
    for x in got:
        slots[x.shard].append(x.slot)
        load[x.shard] += x.size
        homes[of[x.doc_id]].add(x.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(h) == 1 for h in homes.values())
    sizes = Counter()
    for _, t, _ in rows:
        sizes[t or ""] += len((t or "").encode()) + 1
    assert [load[s] for s in range(16)] == plain(sizes.values(), 16)[0]
    again = sharding.shard(docs.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert sharding.shard(docs.limit(0)).count() == 0
