"""The five stages, each on its own input, against what plain Python says."""

import random

import corpus_pipeline
from citeforge.llm import bpe, pii

EN = [f"{a}{b}" for a in ("ri", "sto", "hou", "wa", "li", "gar", "win", "mor") for b in ("ver", "ne", "se", "ter", "ght", "den", "dow", "ning")]


def test_stages(spark, tmp_path):
    r = random.Random(1)
    rows, labels = [], []
    for i in range(240):
        ws = [r.choice(EN) + r.choice(EN) for _ in range(60)]
        toxic = i % 6 == 0
        if toxic:
            ws[r.randrange(60)] = r.choice(["gronkle", "blarfed"])
        rows.append((i, " ".join(ws), "en", f"s{i % 3}" if i % 7 else None, 0))
        labels.append((i, 1, int(toxic)))
    rows.append((1000, rows[1][1], "en", "s0", 0))  # exact copy of 1
    rows.append((1001, rows[2][1].rsplit(" ", 1)[0] + " changed", "en", "s0", 0))  # near copy of 2
    rows.append((1002, "a gr0nkle and g r o n k l e of the river", "en", "s1", 0))
    rows.append((1003, "write to a@b.co or +1 (555) 555-1234 from the silver house near water", "en", "s1", 0))
    rows += [(1004, None, None, None, None), (1005, "", "en", "s2", 0)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs, kept = spark.read.parquet(f"{d}/documents.parquet"), {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, d).write.parquet(f"{d}/{n}")
        before, docs = docs, spark.read.parquet(f"{d}/{n}")
        kept[name] = docs.collect()
        if n < 4:
            assert docs.columns == before.columns
    text = {i: t for i, t, *_ in rows}
    ids = lambda name: sorted(x.doc_id for x in kept[name])
    clean = [i for i in sorted(text) if not (i < 1000 and i % 6 == 0) and i != 1002]
    assert ids("toxicity") == clean
    # null and empty text are one group, as are 1 and 1000, 2 and 1001
    assert ids("simhash_near_dedup") == [i for i in clean if i not in (1000, 1001, 1005)]
    masked = {x.doc_id: x for x in kept["pii"]}
    assert masked[1003].text == "write to <EMAIL> or <PHONE> from the silver house near water" and masked[1003].n_chars == len(masked[1003].text)
    assert all(x.text == text[i] for i, x in masked.items() if i != 1003)
    size = {i: len((x.text or "").split()) for i, x in masked.items()}
    taken = [x.doc_id for x in kept["mix_sources"]]
    assert max(taken.count(i) for i in set(taken)) <= 2 and abs(sum(size[i] for i in taken) - 1.5 * sum(size.values())) <= 4 * 120
    assert sorted(taken) == ids("byte_bpe")
    t = bpe.tokenizer()
    for x in kept["byte_bpe"]:
        assert x.decoded == (masked[x.doc_id].text or "") and x.ids == t.encode(x.decoded) and x.n_tokens == len(x.ids)


def test_run_and_empty_table(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(EN) for _ in range(60)), "en", f"s{i % 2}", 0) for i in range(40)]
    for name, kept in (("some", rows), ("none", [])):
        d = str(tmp_path / name)
        spark.createDataFrame(kept, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        out = corpus_pipeline.run(spark, d)
        assert {"doc_id", "n_tokens", "ids", "decoded"} <= set(out.columns)
        text = {i: t for i, t, *_ in kept}
        assert all(x.decoded == text[x.doc_id] for x in out.collect()) and bool(out.count()) == bool(kept)


def test_redact_overlaps():
    assert pii.redact("abcdef", [("ip", 1, 4), ("id", 2, 5)]) == "a<IP>f"
