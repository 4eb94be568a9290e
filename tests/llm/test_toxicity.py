import random
import zlib

import numpy as np
import pyarrow as pa

from vecloom.llm import toxicity as T


def corpus(n, seed):
    rng = random.Random(seed)
    clean = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    bad = ["vilename", "scumbucket", "nastyword"]
    rows = []
    for i in range(n):
        words = [rng.choice(clean) for _ in range(rng.randint(20, 80))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randint(0, len(words)), rng.choice(bad))
        rows.append((" ".join(words), int(toxic)))
    return rows


def test_held_out_and_misspelt_words():
    rows = corpus(900, 1)
    w, b = T.train([t for t, _ in rows[:700]], np.array([y for _, y in rows[:700]]))
    s = T.score_texts(pa.array([t for t, _ in rows[700:]]), w, b)
    y = np.array([y for _, y in rows[700:]])
    assert ((s >= 0.3) == y).mean() > 0.97
    clean = rows[701][0]
    near = T.score_texts(pa.array([clean, clean + " scumbuckets vilenames nastyworde", clean + " SCUMBUCKET vilename nastyword"]), w, b)
    assert near[0] < 0.1 and near[1] > 5 * near[0] and near[2] > 0.3


def test_one_class_or_none():
    assert T.score_texts(pa.array(["a", None]), *T.train([], np.zeros(0, np.int64))).max() < 1e-9
    assert T.score_texts(pa.array(["a", ""]), *T.train(["x y"], np.array([1]))).min() > 0.999
    assert np.isfinite(T.score_texts(pa.array(["ab cd"] * 3), *T.train(["", "1 2", "?"], np.array([1, 0, 1])))).all()


def test_table(spark, odd, none):
    df, rows = odd
    labels = spark.createDataFrame([(i, int(i % 3 == 0) if i % 7 else None, 1) for i in range(160)], "doc_id long, toxic int, text int").select("doc_id", "toxic")
    w, b = T.fit(df, labels)
    got = T.score(df, w, b).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {}
    for (i, t), s in zip(rows, T.score_texts(pa.array([t for _, t in rows]), w, b), strict=True):
        by.setdefault(t or "", set()).add(round(float(s), 9))
    assert all(len(v) == 1 for v in by.values())
    assert T.score(none, w, b).count() == 0 and T.fit(none, labels)[1] == -30
    wide = df.selectExpr("doc_id", "text", "1 AS score")
    kept = T.keep(wide, w, b, 0.3)
    assert kept.columns == wide.columns and kept.count() == sum(r.score < 0.3 for r in got)


def test_labels_of_the_held_out_are_not_learnt(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(corpus(200, 3))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(corpus(200, 3))], "doc_id long, toxic int")
    texts, _ = T.sample(docs, labels.filter("crc32(cast(doc_id as string)) % 4 <> 2"))
    held = {t for i, (t, _) in enumerate(corpus(200, 3)) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert texts and not held & set(texts)
    assert len(T.sample(docs, labels, rows=50)[0]) == 50
