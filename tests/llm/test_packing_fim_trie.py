"""Packing, fill-in-middle and the prefix trie, held to the libraries and to plain versions."""

import hashlib
import math
import random
import sys
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from kinmesh.llm import fim, packing, trie
from tests.llm.helpers import awkward, docs, save, with_clashes

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


@pytest.fixture(scope="module")
def chunks():
    with open(VOCABULARY, "rb") as f:
        return packing.Chunks(f.read(), 2000)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def ids_of(packed: bytes) -> list[int]:
    return np.frombuffer(packed, "<u4").tolist()


def test_ids_equal_the_library_on_every_code_point(chunks, library):
    for at in range(0, sys.maxunicode + 1, 37):
        points = [chr(c) for c in range(at, min(at + 37, sys.maxunicode + 1)) if not 0xD800 <= c < 0xE000]
        for text in ("".join(points), "x".join(points), "".join(f"a{p}B 's{p}1" for p in points[::9])):
            assert ids_of(chunks.text(text)) == library.encode(text, add_special_tokens=False).ids, hex(at)


def test_ids_equal_the_library_on_random_strings(chunks, library):
    rng = random.Random(3)
    marks = ["a", "B", "é", "É", "é", "İ", "ß", "Σ", "'s", "'LL", "’", "—", "²", "½", "9", " ", "\n", " ", " ", "\x1c", "\x85", "<|endoftext|>", "<|", "漢", "🙂", "̀", "ŉ", "ĸ", "_", "€", "­"]
    for _ in range(3000):
        text = "".join(rng.choice(marks) for _ in range(rng.randint(0, 30)))
        assert ids_of(chunks.text(text)) == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_chunks_of_the_same_matches_are_merged_once(library):
    """1,600 chunks of 40 words and two marks, in either case: only the matches are merged and held."""
    words = [f"{a}{b}o" for a in "bcdfghkl" for b in "aeiou"]
    text = " ".join(f"{v.title()},{w}." for v in words for w in words)
    with open(VOCABULARY, "rb") as f:
        chunks = packing.Chunks(f.read(), 2000)
    assert ids_of(chunks.text(text)) == library.encode(text, add_special_tokens=False).ids
    assert len(chunks) + len(chunks.old) == 42


def test_ids_equal_the_library_where_plain_and_odd_chunks_alternate(chunks, library):
    long = "a" * 30_000
    odd = ["漢字", "e\u0301te\u0301", "x🙂'S", "\u0300", "Σας", "ŉ", "a" * 200 + "漢", "İ\u0307"]
    plain = ["It'S", "1½2", "É-é,", "<|endoftext|>", "x<|startoftext|>y", "<|ENDOFTEXT|>", "!!", long]
    for white in (" ", "\n", "\u00a0", "\u3000", "\x85", " \t"):
        for text in (white.join([a, b, a]) for a in odd for b in plain):
            for whole in (text, white + text + white):
                assert ids_of(chunks.text(whole)) == library.encode(whole, add_special_tokens=False).ids, repr(whole[:80])


def check_packing(rows, capacity):
    by_sequence = defaultdict(list)
    for r in rows:
        assert 1 <= r["length"] <= capacity
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in by_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_packs_near_the_least_number_of_sequences(spark, parts):
    rng = random.Random(parts)
    lengths = [min(2048, int(rng.lognormvariate(5.5, 1.2)) + 1) for _ in range(6000)]
    items = spark.createDataFrame([(k, n, None) for k, n in enumerate(lengths)], "bin long, length long, fill string").repartition(parts)
    rows = packing.pack_best_fit(items).collect()
    assert sorted((r["bin"], r["length"]) for r in rows) == list(enumerate(lengths))
    assert check_packing(rows, 2048) <= 1.01 * -(-sum(lengths) // 2048) + 1


def test_underfull_bins_join_across_partitions(spark):
    """One small item in each of 40 partitions: the tree joins them all, by several levels."""
    items = spark.range(0, 40, 1, 40).select("id", F.lit(100).cast("long").alias("length"))
    rows = packing.pack_best_fit(items).collect()
    assert check_packing(rows, 2048) <= 3  # 16 join in each of two nodes, and bins of 1600, 1600 and 800 are left
    alone = spark.range(0, 40, 1, 40).select("id", F.lit(1500).cast("long").alias("length"))
    assert check_packing(packing.pack_best_fit(alone).collect(), 2048) == 40
    mixed = spark.range(0, 40, 1, 40).select("id", F.when(F.col("id") % 2 == 0, 1500).otherwise(548).cast("long").alias("length"))
    assert check_packing(packing.pack_best_fit(mixed).collect(), 2048) == 20


def test_a_node_passes_on_a_bounded_number_of_bins():
    links, fit = packing.join_bins(list(range(50_000)), [1100] * 50_000, 2048)
    assert not links and len(fit.underfull(packing.NEARLY, 120)) == 120


def test_pieces_of_awkward_documents(spark, library, tmp_path):
    df = with_clashes(docs(spark))
    path = save(spark, tmp_path, documents=df)
    rows = packing.op11_best_fit_packing(spark, path).collect()
    want = []
    for row in awkward():
        ids = [*library.encode(row[1] or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want.append((row[0], piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(want, key=key)
    check_packing(rows, 2048)
    # the sequences themselves hold the pieces' ids in order
    pieces = packing.token_pieces(df, VOCABULARY)
    whole = packing.packed_sequences(packing.pack_best_fit(pieces)).collect()
    assert sum(r["length"] for r in whole) == sum(w[3] for w in want) and all(len(r["ids"]) == 4 * r["length"] for r in whole)
    empty = packing.pack_best_fit(packing.token_pieces(df.limit(0), VOCABULARY))
    assert empty.count() == 0 and {"sequence_id", "offset"} <= set(empty.columns)


def test_elias_fano_selects_every_entry():
    rng = np.random.default_rng(1)
    for n, top in ((1, 1), (1, 10**6), (5, 5), (1000, 1000), (700, 10**6), (3, 2**31 - 1)):
        ends = np.sort(rng.choice(np.arange(1, top + 1), n, replace=False)) if top < 10**7 else np.array([1, 7, top])
        packed = fim.elias_fano(ends)
        assert [fim.select(packed, k) for k in range(n)] == ends.tolist()
        assert len(packed) <= 11 + n * (3 + max(0, int(np.log2(top / n)))) / 8
    with pytest.raises(IndexError):
        fim.select(fim.elias_fano(np.array([], np.int64)), 0)


def plain_fim(doc_id, text):
    text = text or ""
    x = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    lines = text.split("\n")
    lines = [s + "\n" for s in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
    n = len(lines)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    form = "spm" if h[3] % 100 < 50 else "psm"
    return doc_id, n, form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def test_fill_in_middle_equals_a_plain_version(spark, tmp_path):
    more = [(100, "a\nb\n\nc", "en", "a", 1), (101, "\n\n\n", "en", "a", 1), (102, "x<P>\ny", "en", "a", 1), (103, "é\n漢<\n<S\n>M>🙂", "en", "a", 1), (104, "line\n" * 5000, "en", "a", 1), *[(2000 + k, "l\n" * k, "en", "a", 1) for k in range(120, 300)], (105, "a\r\nb c\x0bd\n", "en", "a", 1)]
    copies = [(1000 + k, "one\ntwo\nthree of a hot text", "en", "hot", 1) for k in range(900)]
    table = awkward() + more + copies
    path = save(spark, tmp_path, documents=with_clashes(docs(spark, table)))
    got = fim.op12_fill_in_middle(spark, path).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(*w[:5], sha(w[5]), sha(r[1] or "")) for r in table for w in [plain_fim(r[0], r[1])]]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert fim.fill_in_middle(docs(spark, []), keep=("lang",)).count() == 0


def test_rates_and_kept_columns(spark):
    df = docs(spark, [(k, "a\nb\nc\n", "en", "s", 6) for k in range(400)])
    some = fim.fill_in_middle(df, keep=("lang", "source"), rate=50, spm_rate=100)
    forms = {r["form"]: r["count"] for r in some.groupBy("form").count().collect()}
    assert set(forms) == {"plain", "spm"} and 120 < forms["plain"] < 280
    assert some.columns[:3] == ["doc_id", "lang", "source"]


def plain_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out, leaves, saved = [], {}, {}
    for p in sorted(members, key=len, reverse=True):
        kids = children[p]
        leaves[p] = sum(leaves[k] for k in kids) if kids else 1
        words = len(p[-1][1].encode().split()) if p else 0
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in kids)
        ends = ",".join(str(c) for c in members[p] if len(whole[c]) == len(p))
        out.append((members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(kids), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversations(n, seed, words=("hi", "ok", "a b", "", None)):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant", None]) if t > 2 else "user", rng.choice(words)) for c in range(n) for t in range(rng.randint(1, 7))]


@pytest.mark.parametrize("case", ["random", "hot", "awkward", "long"])
def test_trie_equals_a_plain_version(spark, tmp_path, monkeypatch, case):
    rows = conversations(150, 5)
    if case == "hot":
        rows += [(c, t, "user", "same words here") for c in range(200, 700) for t in range(3)]
        monkeypatch.setattr(trie, "HOT", 50)
    if case == "awkward":
        rows += [(None, 1, "user", "lost"), (3, None, "user", "first"), (3, None, "user", "first"), (4, 2, "x", "tie"), (4, 2, "x", "tie"), (4, 2, None, None), (-7, 1, "user", "hi"), (10**12, 0, "user", "hi"), (161, 0, "user", "only")]
    if case == "long":
        monkeypatch.setattr(trie, "BLOCK", 16)
        rows += [(c, t, "user", f"turn {t % 7}") for c in (300, 301) for t in range(200)] + [(302, t, "user", f"turn {t % 7}") for t in range(150)] + [(303, t, "user", "same") for t in range(100)]
    df = spark.createDataFrame(rows, TURNS).withColumns({"depth": F.lit("x"), "pos": F.lit("y"), "block": F.lit(1), "digest": F.lit("z")})
    got = [tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in trie.op13_prefix_trie(spark, save(spark, tmp_path, conversations=df)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain_trie(rows)))


def test_trie_of_few_conversations(spark):
    kinds = "conv_id long, pos long, key string, words long"
    none = spark.createDataFrame([], kinds)
    assert trie.prefix_trie(none.select("conv_id"), none).count() == 0
    bare = trie.prefix_trie(spark.createDataFrame([(5,), (9,)], "conv_id long"), none).collect()
    assert [tuple(r)[:7] for r in bare] == [(5, 0, None, 2, 0, 1, 0)] and bare[0]["ends_sha256"] == hashlib.sha256(b"5,9").hexdigest()


def test_totals_reach_over_deep_chains(spark):
    """Each chain hangs on the one before: the sums pass 40 levels in a few rounds."""
    chains = spark.createDataFrame([(k, k - 1 if k else None, 1, k) for k in range(40)], "conv_id long, parent long, leaves long, saved long")
    got = {r["conv_id"]: (r["leaves"], r["saved"]) for r in trie.subtree_totals(chains).collect()}
    assert got == {k: (40 - k, sum(range(k, 40))) for k in range(40)}
