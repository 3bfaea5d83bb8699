"""The pipeline's stages on a small table with planted cases."""

import random

from pyspark.sql import functions as F

import corpus_pipeline


def table(spark, tmp_path):
    r = random.Random(11)
    word = lambda: "".join(r.choice(["an", "the", "er", "ing", "on", "ti", "wh", "st"]) for _ in range(r.randint(1, 4)))
    text = lambda n=150: "\n".join(" ".join(word() for _ in range(15)) for _ in range(n // 15))
    docs, labels = [], []
    for i in range(400):
        t = text()
        if i % 5 == 0:
            w = t.split(" ")
            for j in range(0, len(w), 15):
                w[j] = r.choice(["zorkface", "blugrat"])
            t = " ".join(w)
        docs.append((i, t))
        labels.append((i, int(i % 5 == 0)))
    copy = text()
    docs += [(1000, copy), (1001, copy), (1002, copy.replace("the", "teh", 1)), (1003, text()), (1004, ""), (1005, None), (None, text())]
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("quality", F.lit(1)).write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_stages(spark, tmp_path):
    sf = table(spark, tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    columns = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.columns == columns, name
            out.write.parquet(f"{sf}/{name}")
            docs = spark.read.parquet(f"{sf}/{name}")
        kept.append(ids(out))
    toxic = {i for i in range(0, 400, 5)}
    assert len(kept[0] & toxic) <= 3 and {i for i in range(400) if i % 5} <= kept[0] and {1000, 1001, 1002, 1003, 1004, 1005, None} <= kept[0]
    assert kept[1] == kept[0]
    # A copy loses all its lines, so it and the empty texts are one component; the edited copy keeps its edited line.
    assert {1000, 1003, None} <= kept[2] and len(kept[2] & {1001, 1004, 1005}) == 1 and kept[3] == kept[2]
    assert corpus_pipeline.run(spark, sf).count() >= len(kept[3])
