"""The pipeline on planted documents, stage by stage against brute force."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import decontam, mixing, near_dup
from quillspark.llm.common import text_words


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n)) + "."


def test_pipeline(spark, tmp_path):
    r = random.Random(9)
    items = [prose(30, 9_000 + i) for i in range(4)]
    texts, bad, leaks, copies = [], set(), set(), set()
    for i in range(240):
        if i % 4 == 3:
            texts.append(" | ".join(prose(60, i).split()))
            bad.add(i)
        elif i % 40 == 8:
            texts.append(prose(60, i) + " " + items[i % 4] + " " + prose(60, i + 5_000))
            leaks.add(i)
        elif i % 40 == 20:
            near = texts[i - 10].split()
            near[r.randrange(len(near))] = "changed"
            texts.append(" ".join(near))
            copies.add(i)
        else:
            texts.append(prose(80, i))
    rows = [(i, t, "en" if i % 3 else "fr", f"src{i % 5}", len(t)) for i, t in enumerate(texts)] + [(None, None, None, None, None), (999, "", "en", "src0", 0)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i not in bad), 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, i % 3) for i in range(0, 240, 2)], "vec_id long, label int").write.parquet(f"{folder}/embeddings.parquet")

    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/{k}")
        out = spark.read.parquet(f"{folder}/{k}")
        assert k == 4 or sorted(out.columns) == sorted(docs.columns)
        seen.append({x["doc_id"] for x in out.select("doc_id").collect()})
        docs = out
    good = set(range(240)) - bad
    assert len((seen[0] & set(range(240))) ^ good) <= 2  # the classifier may err at the edge
    words = dict(zip(range(240), text_words(texts)))
    near = {j for j in seen[0] & good for i in seen[0] & good if i < j and near_dup.similar(words[i], words[j])}
    assert near == copies & seen[0] and seen[1] == seen[0] - near
    held = {i for i in seen[1] & set(words) for t in items if decontam.common_words(next(text_words([t])), words[i]) >= 0.75 * 30}
    assert held == leaks & seen[1] and seen[2] == seen[1] - held
    kept = mixing.mix(spark.read.parquet(f"{folder}/2"), spark.read.parquet(f"{folder}/embeddings.parquet")).filter("kept")
    assert seen[3] == {x["doc_id"] for x in kept.collect()} and len(seen[3]) > 0.6 * len(seen[2])
    assert seen[4] == seen[3] and docs.filter(F.col("shard").isNull()).count() == 0
    assert {x["doc_id"] for x in corpus_pipeline.run(spark, folder).select("doc_id").collect()} == seen[4]
