import random

import corpus_pipeline
from textloom.llm import pieces

from . import brute


def test_pipeline_matches_a_plain_version(spark, tmp_path):
    r = random.Random(12)
    vocab = ["the", "river", "and", "stone", "lamp", "went", "over", "hill", "of", "green", "cloud", "from"]
    prose = lambda n: " ".join(r.choice(vocab) + r.choice(["", "s", "ed", "ing"]) for _ in range(n))
    item = " ".join(f"item{k}" for k in range(20))
    rows = [(k, prose(r.randrange(60, 140))) for k in range(60)]
    rows += [(100 + k, " ".join(r.choice(["$$$A", "###B", "%%%C"]) for _ in range(90))) for k in range(40)]
    rows += [(200, rows[0][1]), (201, rows[1][1] + " more"), (202, prose(60) + " " + item), (203, prose(80) + " mail a.b@c.example now")]
    docs = [(i, t, "en", "s", len(t)) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(i < 100), 0) for i, _ in rows if i < 130]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "benchmark_leaks", "personal_data", "encoding"]
    good = [(i, t) for i, t in rows if i < 100 or i >= 200]
    first = {i for i, (c, *_) in brute.classes(good).items() if c == i}
    clean = {i: t for i, t in good if i in first and brute.hits(t, [(1, item)])[1] == 0}
    out = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == set(clean)
    assert all(x.lossless for x in out.values())
    model = pieces.pieces(pieces.MODEL)
    for i, t in clean.items():
        ids, _ = model.encode([t.replace("a.b@c.example", "<email>")], [pieces.document_key(i)])
        assert bytes(out[i].ids) == ids.astype("<i4").tobytes()
