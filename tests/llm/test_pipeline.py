"""The pipeline: stages as they are listed, each on what the one before kept."""

import random

import corpus_pipeline
from loomrank.llm import repeats

rng = random.Random(8)


def words(n):
    return " ".join("".join(rng.choice("aeioubcdfgl") for _ in range(rng.randint(2, 9))) for _ in range(n)).capitalize() + "."


def test_pipeline(spark, tmp_path):
    good = [words(80) for _ in range(60)]
    bad = [" ".join(w.upper() + "!!" for w in words(40).split()) for _ in range(30)]
    item = words(30)
    near = good[0].split()
    near[40] = "changed"
    rows = [(i, t) for i, t in enumerate([*good, *bad, good[1], " ".join(near), f"{words(20)} {item}", None, ""])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "near-duplicates", "repeated strings", "decontamination", "packing"]
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    ids = []
    for n, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, d, str(tmp_path))
        assert out.columns == d.columns
        out.write.parquet(str(tmp_path / n.replace(" ", "-")))
        d = spark.read.parquet(str(tmp_path / n.replace(" ", "-")))
        ids.append({r[0] for r in d.select("doc_id").collect()})
    assert not ids[0] & set(range(60, 90)) and set(range(60)) <= ids[0]
    assert 90 not in ids[1] and 91 not in ids[1] and {0, 1} <= ids[1]
    assert ids[2] == ids[1] and 92 in ids[2] and ids[3] == ids[2] - {92}
    packed = corpus_pipeline.pack(spark, d, str(tmp_path))
    assert {r[0] for r in packed.select("doc_id").collect()} == ids[3]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == packed.count()


ODD = "_id long, _key string, spans int, _spans string, row string, key string, z int, doc_id long, text string, lang string, source string, n_chars long, words int, items string, n int, id long, h long, score double, predicted int"


def odd_rows():
    good = [words(60) for _ in range(12)]
    texts = [*good, good[0], good[1], None, None, "", f"{words(3)} {good[2]} {words(3)}", words(4000)]
    ids = [*range(len(texts) - 3), None, None, 7]
    return [(i, "k", 3, "s", "r", None, 1, i, t, "en", None, len(t or ""), 2, "it", 4, 5, 6, 0.5, 1) for i, t in zip(ids, texts, strict=True)]


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, ODD)
    spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "no such words in any of the texts")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    plain = {r["text"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema], name
        got = got.collect()
        if name in ("quality classifier", "decontamination"):  # all rows are good and clean
            assert sorted(map(str, got)) == sorted(map(str, docs.collect())), name
        if name == "near-duplicates":
            assert len(got) == len({r["text"] or "" for r in rows_of(got)}) and all(any(tuple(g) == t for t in rows) for g in got)
            assert {r["text"] for r in got if r["text"]} >= {t for t in plain if t and len(t.split()) > 100}
        if name == "repeated strings":
            assert len(got) == len(rows) and all(g["_id"] == g["doc_id"] and g["_spans"] == "s" and g["row"] == "r" and g["n_chars"] == len(g["text"] or "") for g in got if g["text"] is not None)
            assert sum(g["text"] == "" for g in got) >= 5  # the copies and the one that holds a text whole are cut
        none = stage(spark, docs.limit(0), str(tmp_path))
        assert none.columns == docs.columns and none.count() == 0, name
    assert corpus_pipeline.pack(spark, docs, str(tmp_path)).select("doc_id").distinct().count() == len({r[7] for r in rows})
    assert corpus_pipeline.pack(spark, docs.limit(0), str(tmp_path)).count() == 0


def rows_of(got):
    return [r.asDict() for r in got]


def test_only_texts_with_repeats_are_packed(spark, monkeypatch):
    """Where few texts hold a string that repeats, the others are neither packed nor shuffled for its sake."""
    counts, plain = [], repeats._packed
    monkeypatch.setattr(repeats, "_packed", lambda docs: (counts.append(docs.count()), plain(docs))[1])
    passage = words(60)
    texts = [words(80) for _ in range(50)] + [f"{words(30)} {passage} {words(30)}" for _ in range(2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in repeats.without_repeats(docs).collect()}
    assert all(got[i] == texts[i] for i in range(50)) and all(passage[1:-1] not in got[i] for i in (50, 51))
    assert counts and max(counts) <= 5
