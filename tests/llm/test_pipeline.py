import hashlib

import public_tokenizers as P
import tiktoken

import corpus_pipeline as cp
from kinmesh.llm import bpe, langid, secrets
from kinmesh.session import materialize
from tests.llm.helpers import awkward, docs, save, with_clashes
from tests.llm.test_duplicates import near_copies, slow_print


def test_every_stage_equals_its_brute_force(spark, tmp_path):
    rows = awkward() + near_copies(12) + [(5000, "the key is AKIA" + "Z" * 16 + " and so on", "en", "s", 1), (5001, " ".join(f"b{k}" for k in range(30)), "en", "s", 1)]
    bench = spark.createDataFrame([(1, " ".join(f"b{k}" for k in range(30)))], "item_id bigint, text string")
    d = save(spark, tmp_path, documents=docs(spark, rows), benchmark=bench)
    table = spark.read.parquet(f"{d}/documents.parquet")
    stages = dict(cp.STAGES)
    assert list(stages) == ["language", "dedup", "decontam", "secrets", "encode"]

    kept = materialize(stages["language"](spark, table, d))
    model = langid.fit_languages(table)
    want = [r for r in rows if model.predict(r[1])[0] != "und"]
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs(spark, want).collect()))

    one = materialize(stages["dedup"](spark, kept, d))
    prints = [slow_print(r[1]) for r in want]
    group = list(range(len(want)))
    for i in range(len(want)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    assert one.count() == len(set(group))
    order = lambda r: (r[0] is None, r[0] or 0, hashlib.sha256(r[1].encode()).hexdigest())
    firsts = [min((order(r), r[1]) for r, g in zip(want, group, strict=True) if g == h)[1] for h in set(group)]
    assert sorted(r.text for r in one.collect()) == sorted(firsts)

    clean = materialize(stages["decontam"](spark, one, d))
    assert {r.doc_id for r in one.collect()} - {r.doc_id for r in clean.collect()} == {5001}

    bare = materialize(stages["secrets"](spark, clean, d))
    assert bare.columns == table.columns
    by_id = {r.doc_id: r for r in bare.collect()}
    assert by_id[5000].text == "the key is [REDACTED:access] and so on" and by_id[5000].n_chars == len(by_id[5000].text)
    assert not any(secrets.base_spans(r.text) for r in by_id.values())

    with open(P.path(cp.RANKS), "rb") as f:
        enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(f.read()), special_tokens={})
    coded = {r.doc_id: r for r in stages["encode"](spark, bare, d).collect()}
    assert {i: r.n_tokens for i, r in coded.items()} == {i: len(enc.encode_ordinary(r.text)) for i, r in by_id.items()}


def test_stages_take_empty_tables_and_extra_columns(spark, tmp_path):
    bench = spark.createDataFrame([(1, " ".join(f"b{k}" for k in range(30)))], "item_id bigint, text string")
    for name, rows in (("empty", []), ("odd", awkward(8))):
        d = save(spark, tmp_path / name, documents=docs(spark, rows), benchmark=bench)
        df = with_clashes(docs(spark, rows))
        for stage, f in cp.STAGES[:-1]:
            out = f(spark, df, d)
            assert out.columns == df.columns, stage
            df = materialize(out)
        assert cp.STAGES[-1][1](spark, df, d).columns[0] == "doc_id"
