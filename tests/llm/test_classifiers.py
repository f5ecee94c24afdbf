"""Quality and language: held-out accuracy, and defined results at the edges."""

import zlib

from pyspark.sql import functions as F

from tidemark.llm import langid, quality

SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = quality.classify(docs, labels).withColumnRenamed("doc_id", "id")
    rows = out.join(labels, out["id"] == labels["doc_id"], "left").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.quality is not None]
    assert sum(r.predicted == r.quality for r in held) >= 0.97 * len(held)


def test_labels_of_held_out_rows_teach_nothing(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").limit(300), spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(quality.crc_mod("doc_id", 3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in quality.classify(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_contexts_stay_within_a_text_and_count_each_pair_once(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 40, n).astype("<u2") for n in (0, 1, 2, 3, 50, 7, 333)]
    place, sign = quality.index_vectors()
    want = np.zeros((quality.BUCKETS, quality.DIM))
    for t in texts:
        for i, x in enumerate(t):
            for j in range(max(0, i - quality.NEAR), min(len(t), i + quality.NEAR + 1)):
                if j != i:
                    np.add.at(want[x], place[t[j]], sign[t[j]])
    for pooled in (5, 64, 1 << 14):
        monkeypatch.setattr(quality, "POOLED", pooled)
        total = np.zeros((quality.BUCKETS + 1) * quality.DIM)
        quality.add_contexts(total, texts)
        assert (total.reshape(-1, quality.DIM)[:-1] == want).all()


def test_pooled_vectors_and_network_are_plain_sums():
    import numpy as np

    rng = np.random.default_rng(4)
    context = rng.normal(size=(quality.BUCKETS, quality.DIM)).astype(np.float32)
    for n in (0, 1, 7, quality.POOLED + 5):
        ids = rng.integers(0, quality.BUCKETS, n).astype("<u2")
        want = np.concatenate([x[ids].sum(0) if n else np.zeros(quality.DIM) for x in (context.astype(float), quality.index_matrix().astype(float))]) / max(1, n)
        assert np.allclose(quality.pooled(ids.tobytes(), context), want, atol=1e-3)
    x = rng.normal(size=(600, 6))
    y = (x[:, 0] + 0.5 * x[:, 1] + 0.3 * rng.normal(size=600) > 0).astype(int)
    network = quality.Network(6)
    network.train(x, y)
    w1, b1, w2, b2 = network.weights
    for row, p in zip(x[:20], network.probability(x[:20]), strict=True):
        hidden = [np.tanh(sum((row[i] - network.mean[i]) / network.scale[i] * w1[i, k] for i in range(6)) + b1[k]) for k in range(quality.HIDDEN)]
        odds = sum(h * w for h, w in zip(hidden, w2, strict=True)) + b2[0]
        assert abs(p - 1 / (1 + np.exp(-odds / network.temperature))) < 1e-9
    assert ((network.probability(x) >= 0.5) == y).mean() > 0.85


def test_the_temperature_calibrates():
    """Of all temperatures tried, the one taken loses least on the rows kept out of the training."""
    import numpy as np

    rng = np.random.default_rng(9)
    x = rng.normal(size=(500, 4))
    y = (x[:, 0] + 2 * rng.normal(size=500) > 0).astype(int)  # noisy: the network is too sure
    network = quality.Network(4)
    network.train(x, y)
    apart = np.random.default_rng(quality.SEED).permutation(len(x))[len(x) * 4 // 5 :]
    odds = network.log_odds(x[apart])

    def loss(t):
        return np.logaddexp(0, -np.where(y[apart] == 1, odds, -odds) / t).mean()

    assert network.temperature > 1 and all(loss(network.temperature) <= loss(t) + 1e-12 for t in np.exp(np.linspace(np.log(0.25), np.log(8), 60)))


def test_quality_is_the_same_however_rows_are_dealt(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 400"), spark.read.parquet(f"{SF}/labels.parquet")
    a, b = ({r.doc_id: r.score for r in quality.classify(x, labels).collect()} for x in (docs.coalesce(1), docs.repartition(7, "text")))
    assert a == b


def test_quality_edges(spark, docs):
    rows = [(1, None), (2, ""), (3, "w " * 50_000), (4, "a b"), (4, "a b"), (None, "z")]
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (2, None, 1)], "doc_id long, quality int, toxic int")
    out = quality.classify(docs(rows), labels).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 and r.held_out is not None for r in out)
    assert quality.classify(docs([]), labels).count() == 0
    assert {r.score for r in quality.classify(docs(rows), labels.limit(0)).collect()} == {1.0}


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    out = langid.identify(docs).collect()
    assert len(out) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)


def test_language_matches_plain_bayes():
    import numpy as np

    texts = ["the cat sat", "der hund lief", "", None, "1234 !?", "Ähnlich ÄHNLICH"]
    rng = np.random.default_rng(0)
    matrix = np.vstack([rng.normal(size=(langid.BUCKETS, 3)), np.zeros((1, 3))]).astype(np.float32)
    model = langid.Model(["a", "b", "c"], matrix, np.zeros(3))
    joint, has = model.log_odds(texts)
    assert has.tolist() == [True, True, False, False, False, True]
    for row, text in zip(joint, texts, strict=True):
        letters = np.array([langid.letter_table()[ord(c)] for c in f" {text or ''} "])
        expected = sum(matrix[g].sum(0) for g in langid.grams(letters, langid.BUCKETS))
        assert np.allclose(row, expected, atol=1e-3)
    for limit in (1, 2, 3, 7):
        parts, has_too = model.log_odds(texts, limit)
        assert np.allclose(parts, joint, atol=1e-3) and (has == has_too).all()


def test_language_is_learnt_as_by_the_book(spark, monkeypatch):
    import math
    from collections import Counter

    import numpy as np

    rows = [(1, "hola que tal", "es"), (2, "hello there you", "en"), (3, "hello again", "en"), (4, "Adiós", "es"), (5, None, "en"), (6, "x", None), (6, "x", None), (7, "hello", "en")]
    for part in (3, 1 << 19):
        monkeypatch.setattr(langid.count_batches, "__defaults__", (part,))
        model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
        assert model.languages == ["en", "es"]
        assert np.allclose(model.prior, [math.log(4 / 6), math.log(2 / 6)])
        for k, lang in enumerate(model.languages):
            counts = Counter()
            for _, text, own in rows:
                if own == lang:
                    x = [langid.letter_table()[ord(c)] for c in f" {text or ''} "]
                    for g in langid.grams(np.array(x), langid.BUCKETS):
                        counts.update(int(v) for v in g if v < langid.BUCKETS)
            total = sum(counts.values()) + langid.SMOOTHING * langid.BUCKETS
            want = [math.log((counts[b] + langid.SMOOTHING) / total) for b in range(langid.BUCKETS)]
            assert np.allclose(model.matrix[:-1, k], want, atol=1e-4)


def test_language_edges(spark, docs):
    rows = [(1, None), (2, ""), (3, "123 -- "), (4, "hola"), (4, "hola"), (5, "x" * 1_200_000), (None, "abc")]
    model = langid.fit(spark.createDataFrame([(1, "hola que tal", "es"), (2, "hello there you", "en"), (3, None, "en"), (6, "x", None)], "doc_id long, text string, lang string"))
    out = langid.predict(docs(rows), model).collect()
    assert len(out) == 7
    assert all(r.lang_pred == "und" and r.score == 0 for r in out if r.doc_id in (1, 2, 3))
    assert all(r.lang_pred in ("en", "es") for r in out if r.doc_id not in (1, 2, 3))
    assert {r.lang_pred for r in langid.identify(docs(rows)).collect()} == {"und"}
    assert langid.identify(docs([])).count() == 0
