import random
import re
import time

import numpy as np
import xxhash
from pyspark.sql import functions as F

from kinmesh.llm import decontam, simhash
from tests.llm.helpers import awkward, docs, save, with_clashes


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    prints = [slow_print(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, *_) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted((str(r[0]), f"{p:016x}", str(least.get(find(i)))) for i, (r, p) in enumerate(zip(rows, prints, strict=True)))


def near_copies(n=40, seed=5):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 999)}" for _ in range(900)]
    rows = []
    for k in range(n):
        words = list(base)
        words[rng.randrange(len(words))] = f"new{k}"
        rows.append((1000 + k, " ".join(words), "en", "s", 1))
    return rows


def test_simhash_components_equal_brute_force(spark, tmp_path):
    rows = awkward() + near_copies()
    d = save(spark, tmp_path, documents=docs(spark, rows))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.op4_simhash_near_dedup(spark, d).collect())
    assert got == slow_components(rows)


def test_links_are_complete_when_blocks_are_dealt_into_chunks(spark):
    rng = random.Random(1)
    center = rng.getrandbits(64)
    values = {center}
    while len(values) < 300:
        v = center
        for _ in range(rng.randint(1, 5)):
            v ^= 1 << rng.randrange(64)
        values.add(v)
    values |= {rng.getrandbits(64) for _ in range(50)}
    signed = [int(np.uint64(v).view(np.int64)) for v in values]
    links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp bigint"), chunk=32).collect()
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    u = lambda x: x % (1 << 64)
    for a, b in links:
        assert bin(u(a) ^ u(b)).count("1") <= 3
        parent[find(u(a))] = find(u(b))
    ordered = sorted(values)
    for i, x in enumerate(ordered):
        for y in ordered[:i]:
            if bin(x ^ y).count("1") <= 3:
                assert find(x) == find(y)


def test_keep_one_leaves_a_row_a_group(spark):
    rows = awkward() + near_copies()
    kept = simhash.keep_one(with_clashes(docs(spark, rows)))
    comps = slow_components([(k, *r[1:]) for k, r in enumerate(rows)])
    assert kept.count() == len({c for *_, c in comps})
    assert set(kept.columns) == set(with_clashes(docs(spark, [])).columns)
    assert simhash.keep_one(docs(spark, [])).count() == 0


def slow_tiling(text, item, least):
    free_t, free_i, tiles = [True] * len(text), [True] * len(item), []
    while True:
        best, found = least - 1, []
        for i in range(len(item)):
            for t in range(len(text)):
                n = 0
                while i + n < len(item) and t + n < len(text) and item[i + n] == text[t + n] and free_i[i + n] and free_t[t + n]:
                    n += 1
                if n > best:
                    best, found = n, [(i, t)]
                elif n == best and n >= least:
                    found.append((i, t))
        if best < least:
            return sorted(tiles)
        for i, t in found:
            if all(free_i[i : i + best]) and all(free_t[t : t + best]):
                free_i[i : i + best] = free_t[t : t + best] = [False] * best
                tiles.append((i, t, best))


def test_tiling_equals_the_plain_algorithm():
    rng = random.Random(3)
    for _ in range(250):
        item = [rng.randint(0, 3) for _ in range(rng.randint(0, 18))]
        text = [rng.randint(0, 3) for _ in range(rng.randint(0, 28))]
        as_hash = lambda xs: np.array(xs, np.uint64) * np.uint64(0x123456789ABCDEF1)
        assert sorted(decontam.tile(as_hash(text), as_hash(item), 3)) == slow_tiling(text, item, 3)


def test_rolled_hashes_agree_for_every_size():
    x = np.random.default_rng(0).integers(0, 1 << 62, 60).astype(np.uint64)
    for size in (1, 2, 5, 8, 9, 16, 23, 60, 61):
        got = decontam.rolled(x, size)
        want = [sum(int(v) * pow(0x9E3779B97F4A7C15, size - 1 - k, 1 << 64) for k, v in enumerate(x[i : i + size])) % (1 << 64) for i in range(len(x) - size + 1)]
        assert [int(v) for v in got] == want


def test_decontamination_finds_whole_reordered_and_cased_passages(spark, tmp_path):
    rng = random.Random(8)
    words = lambda n: [f"t{rng.randint(0, 5000)}" for _ in range(n)]
    item = words(40)
    clean = [(k, " ".join(words(80)), "en", "s", 1) for k in range(20)]
    hit = [
        (100, " ".join(words(30) + item + words(30)), "en", "s", 1),
        (101, " ".join(item[25:] + words(9) + item[:12] + words(4) + item[12:25]).upper(), "en", "s", 1),
        (102, " ".join(words(30) + item[:25] + words(3)), "en", "s", 1),
        (None, " ".join(item), "en", "s", 1), (103, " ".join(item), "en", "s", 1), (103, " ".join(item), "en", "s", 1),
    ]
    miss = [(200, " ".join(words(30) + item[:12] + words(30)), "en", "s", 1)]
    rows = awkward() + clean + hit + miss
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, "too short"), (5, " ".join(item))], "item_id bigint, text string")
    d = save(spark, tmp_path, documents=docs(spark, rows), benchmark=bench)
    found = decontam.op9_decontamination(spark, d).collect()
    assert sorted({str(r.doc_id) for r in found}) == ["100", "101", "102", "103", "None"]
    assert {r.item_id for r in found} == {1, 5}
    assert {r.coverage for r in found if r.doc_id == 101} == {1.0}
    short = spark.createDataFrame([(None, "too Short"), (8, "")], "item_id bigint, text string")
    rows_short = [(1, "Too, short!", "en", "s", 1), (2, "this is too short", "en", "s", 1), (3, "short", "en", "s", 1), (4, "", "en", "s", 1), (5, None, "en", "s", 1)]
    assert [(r.doc_id, r.item_id) for r in decontam.contaminated_documents(docs(spark, rows_short), short).collect()] == [(1, None)]
    left = decontam.decontaminate(with_clashes(docs(spark, rows)), bench)
    assert left.count() == len(rows) - len(hit)
    assert decontam.decontaminate(docs(spark, []), bench).count() == 0
    assert decontam.decontaminate(docs(spark, rows), bench.limit(0)).count() == len(rows)


def test_decontamination_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(12)
    vocabulary = [f"v{k}" for k in range(30)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(say(rng.choice([2, 4, 5, 9, 15, 24])))) for k in range(14)] + [(None, " ".join(say(12)))]
    rows = []
    for k in range(60):
        words = say(rng.randint(0, 25))
        for _ in range(rng.randint(0, 2)):
            part = items[rng.randrange(len(items))][1].split()
            at = rng.randint(0, len(words))
            words[at:at] = part[rng.randint(0, len(part) // 2) :]
        rows.append((k, " ".join(words), "en", "s", 1))
    rows += [(90 + k, t, "en", "s", 1) for k, (_, t) in enumerate(items)]
    d = save(spark, tmp_path, documents=docs(spark, rows), benchmark=spark.createDataFrame(items, "item_id bigint, text string"))
    want = set()
    for i, t, *_ in rows:
        text = re.findall(r"\w+", t.lower())
        for item_id, it in items:
            item = re.findall(r"\w+", it.lower())
            if len(item) < 5 and text != item:
                continue
            tiles = slow_tiling(text, item, min(5, len(item)))
            if sum(n for *_, n in tiles) >= 0.5 * len(item):
                want.add((i, item_id, round(sum(n for *_, n in tiles) / len(item), 6), len(tiles), max(n for *_, n in tiles)))
    got = decontam.op9_decontamination(spark, d).collect()
    assert {(r.doc_id, r.item_id, r.coverage, r.n_tiles, r.longest_tile) for r in got} == want and len(got) == len(want)


def test_tiling_of_equal_tokens_is_not_quadratic():
    began = time.time()
    tiles = decontam.tile(np.full(4000, 7, np.uint64), np.full(400, 7, np.uint64))
    assert tiles == [(0, 0, 400)] and time.time() - began < 1


def test_filter_lets_few_other_texts_pass():
    rng = np.random.default_rng(1)
    table = decontam.filter_of(rng.integers(0, 1 << 63, 100_000).astype(np.uint64))
    texts = [rng.integers(0, 1 << 63, 2000).astype(np.uint64) for _ in range(200)]
    assert sum(len(decontam.passing(table, t)) > 0 for t in texts) <= 2
    seeds = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    assert len(decontam.passing(decontam.filter_of(seeds), seeds)) == 1000


def test_hot_seeds_are_dealt(spark, monkeypatch):
    """A join with a key in most rows gives the rows of a plain join."""
    from kinmesh.llm.skew import dealt_join

    left = spark.createDataFrame([(k, 1 if k % 3 else k) for k in range(300)] + [(300, None)], "id long, key long")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (6, "c"), (None, "d")], "key long, value string")
    got = sorted(map(tuple, dealt_join(left, right, "key", F.col("id"), rows=10).collect()))
    assert got == sorted(map(tuple, left.join(right, "key").collect())) and len(got) == 401


def test_samples_lose_no_label(spark, monkeypatch):
    from kinmesh.llm import sampling

    monkeypatch.setattr(sampling, "MOST_CHARS", 1000)
    rows = [(k, "short", "x" * 10) for k in range(20)] + [(100 + k, "long", "y" * 600) for k in range(20)]
    got = sampling.bounded_sample(spark.createDataFrame(rows, "id long, label string, text string"), "label", 10, 100, "id")
    assert {r.label for r in got} == {"short", "long"} and sum(r.label == "long" for r in got) == 1 and sum(r.label == "short" for r in got) == 10
