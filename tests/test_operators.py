import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom.operators import content, evaluation, graph, learning
from webloom.streaming import ingest


def test_page_rank_against_numpy(spark):
    edges = [("a", "b", 1.0), ("b", "c", 2.0), ("a", "c", 1.0), ("c", "a", 1.0), ("d", "a", 3.0), ("b", "e", 1.0)]
    got = {r.node: r.authority for r in graph.page_rank(spark.createDataFrame(edges, "s string, t string, weight double"), 15).collect()}
    names = sorted({x for s, t, _ in edges for x in (s, t)})
    m = np.zeros((len(names), len(names)))
    for s, t, w in edges:
        m[names.index(t), names.index(s)] += w
    out = m.sum(0)
    rank = np.full(len(names), 1 / len(names))
    for _ in range(15):
        flow = sum(m[:, i] / out[i] * rank[i] for i in range(len(names)) if out[i])
        rank = 0.15 / len(names) + 0.85 * (flow + rank[out == 0].sum() / len(names))
    assert [got[n] for n in names] == pytest.approx(list(rank / rank.max()))


def test_empty_graph(spark):
    assert graph.page_rank(spark.createDataFrame([], "s string, t string, weight double"), 3).count() == 0


def test_components(spark):
    pairs = [(1, 2), (2, 3), (7, 8), (5, 3), (9, 9)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 1, 7: 7, 8: 7, 9: 9}


def test_duplicates_against_brute_force(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    base = [rng.choices(words, k=80) for _ in range(6)]
    texts = []
    for b in base:
        for edits in (0, 1, 2, 6):
            t = list(b)
            for _ in range(edits):
                t[rng.randrange(len(t))] = "x"
            texts.append(" ".join(t))
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, texts[0]), (101, None), (102, ""), (103, "one two")]
    got = {(r.a, r.b) for r in content.duplicate_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in enumerate(texts)}
    first = {t: min(i for i, u in enumerate(texts) if u == t) for t in texts}
    ids = sorted(set(first.values()))
    want = {(a, b) for a, b in itertools.combinations(ids, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert want <= got | set() and got <= want and want


def test_delete_variants(spark):
    got = spark.createDataFrame([("abcd",)], "w string").select(content.delete_variants(F.col("w")).alias("v")).collect()[0].v
    want = {"abcd"} | {"".join(x) for n in (2, 3) for x in itertools.combinations("abcd", n)}
    assert set(got) == want


def test_isotonic_never_falls():
    x, y = np.arange(50.0), np.sin(np.arange(50.0)) + np.arange(50.0) / 20
    thresholds, values = learning.isotonic(x, y, np.ones(50))
    assert (np.diff(values) >= 0).all() and len(thresholds) == len(values)
    assert values.mean() is not None and np.isclose(sum(v for v in values), sum(values))


def test_platt_separates():
    x = np.r_[np.linspace(-2, 0, 50), np.linspace(0, 2, 50)]
    slope, offset = learning.platt(x, (x > 0.2).astype(float), np.ones(100))
    assert slope > 0 and abs(offset) < 5


def test_coordinate_ascent_finds_the_peak():
    best, top = learning.coordinate_ascent(lambda w: -((w[0] - 1) ** 2 + (w[1] - 0.5) ** 2), np.array([0.5, 0.0]))
    assert top > -0.05 and best == pytest.approx([1, 0.5], abs=0.2)


def test_linear_and_boosted_models_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    grade = (x[:, 0] > 0.5).astype(float) + (x[:, 0] > 1).astype(float)
    groups = [np.arange(i, i + 30) for i in range(0, 300, 30)]
    w = learning.fit_linear(x, grade, groups, np.array([1, -1, 0]))
    assert w[0] > 0.1 and w[0] > 3 * abs(w[2]) and w[1] <= 0
    assert learning.fit_boosted(x, grade, groups, trees=3)[0].get("feature") == 0


def test_bootstrap_and_promotion():
    mean, low, high = evaluation.paired_bootstrap(np.full(30, 0.1))
    assert (mean, low, high) == pytest.approx((0.1, 0.1, 0.1))
    assert evaluation.paired_bootstrap(np.array([])) == (0.0, 0.0, 0.0)
    assert evaluation.promoted(0.05, 0.01, 30, 0, 0, (10, 11)) == (True, [])
    assert evaluation.promoted(0.01, -0.1, 3, -1, -1, (10, 30))[1] != []


def test_newest_wins_over_batches(spark, tmp_path):
    rows = [[("u", 5, 1), ("v", None, 2)], [("u", 3, 3), ("v", 1, 4)], [("u", 5, 1), ("u", 9, 5)]]
    for i, part in enumerate(rows):
        spark.createDataFrame(part, "url string, observed long, number long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = ingest.stream_of(spark, f"file://{tmp_path}/in", files_per_batch=1)
    got = sorted((r.url, r.number, r.verdict) for r in ingest.run_to_end(ingest.newest_wins(stream)).collect())
    assert ("u", 5, "current") in got and ("u", 3, "superseded") in got and ("v", 4, "current") in got
    assert sorted(v for u, n, v in got if (u, n) == ("u", 1)) == ["current", "duplicate"]


def test_back_off(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:00:{i:02d}", 1, "error" if i < 6 else "view") for i in range(7)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").write.parquet(f"{tmp_path}/in")
    got = ingest.run_to_end(ingest.back_off(ingest.stream_of(spark, f"file://{tmp_path}/in")), "update").collect()
    assert [(r.host, r.pause, r.parked) for r in got] == [(1, 32.0, False)]


def test_catalog_refuses_a_stale_activation(spark, tmp_path):
    from webloom.operators.hooks import Catalog

    catalog = Catalog(spark, f"file://{tmp_path}/models")
    first = catalog.activate({"w": 1}, None)
    with pytest.raises(ValueError):
        catalog.activate({"w": 2}, None)
    with pytest.raises(ValueError):
        catalog.rollback()
    catalog.activate({"w": 2}, first)
    assert catalog.rollback() == 3 and catalog.history().count() == 3


def test_quality_gate_judges_every_text(spark):
    rng = random.Random(4)
    names = [f"{a}{b}" for a in ("stad", "fluss", "wagen", "garten", "wolke") for b in ("tor", "mann", "licht", "berg", "haus", "weg", "bach", "feld", "rad", "turm")]
    plain = rng.sample(names, 50) + rng.sample(names, 50)
    varied = " ".join(["und", "nicht"] + plain)
    rows = [
        (1, "de", varied),
        (2, None, varied),
        (3, "русский", " ".join(["и", "не"] + [f"с{w}" for w in plain])),
        (4, "de", " ".join(plain)),
        (5, "de", "der rote Wagen " * 40),
        (6, "fr", varied + " " + " ".join(names[:12]) + " " + " ".join(names[:12])),
        (7, "zh", "这是一个没有空格的句子"),
        (8, None, None),
        (9, "pt", "Lorem Ipsum dolor"),
    ]
    got = {r.doc_id: r.rule for r in content.quality_gate(spark.createDataFrame(rows, "doc_id long, lang string, text string")).collect()}
    assert got == {1: "ok", 2: "ok", 3: "ok", 4: "no-function-words", 5: "top-ngram", 6: "repeated-ngram", 7: "ok", 8: "too-few-words", 9: "lorem-ipsum"}


def test_content_clusters_join_near_duplicates(spark):
    words = [f"w{i}" for i in range(120)]
    near = words[:60] + ["other"] + words[61:]
    rows = [
        (1, "https://a.test/1", " ".join(words)),
        (2, "https://b.test/2", " ".join(near)),
        (3, None, " ".join(words)),
        (4, "https://a.test/4", " ".join(words[:40] + [f"x{i}" for i in range(80)])),
        (5, "https://a.test/4", "short text of its own"),
        (6, None, None),
        (7, None, "!!!"),
        (8, None, "???"),
    ]
    got = {r.page_id: r.cluster for r in graph.content_clusters(spark.createDataFrame(rows, "page_id long, url string, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8}


def test_fingerprint_counts_every_shingle(spark):
    rng = random.Random(8)
    head = [f"w{i}" for i in range(4200)]
    texts = [" ".join(head + [f"{c}{rng.randrange(10**9)}" for _ in range(70_000)]) for c in "ab"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in content.fingerprints(rows).collect()}
    hashes = rows.select("doc_id", content.T.word_tokens(F.col("text")).alias("w")).select("doc_id", content.shingles(F.col("w")).alias("s")).collect()
    for r in hashes:
        bits = (np.array(r.s, dtype=np.int64).view(np.uint64)[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
        want = sum(1 << i for i, n in enumerate(bits.sum(axis=0)) if 2 * n > len(r.s))
        assert got[r.doc_id] % 2**64 == want
    assert len(hashes[0].s) > 65_536 and got[0] != got[1]


def test_edits_of_whole_texts(spark):
    rows = [(1, "привет мир", "пример мир"), (2, "a" * 60, "a" * 59 + "b"), (3, None, "x"), (4, "x", None)]
    got = {r.doc_id: r.edits for r in content.title_edits(spark.createDataFrame(rows, "doc_id long, title string, text string")).collect()}
    assert got == {1: 2, 2: 1, 4: None}


def test_character_model_scores_every_title(spark):
    rng = random.Random(5)
    words = {"de": "der und nicht straße schön über wagen zeitung freundschaft".split(), "en": "the with which thought history through machine weather".split()}
    rows = [(i, lang, " ".join(rng.choices(words[kind], k=6))) for i in range(1600) for kind, lang in [rng.choice([("de", "de"), ("en", "en"), ("de", "Deutsch"), ("en", "en_GB")])]]
    rows += [(5000, None, "der wagen"), (5001, "fr", "le vent"), (5002, "de", None)]
    scores, fitted = learning.character_model(spark.createDataFrame(rows, "doc_id long, lang string, title string"))
    got = {r.doc_id: r for r in scores.collect()}
    assert set(got) == {*range(1600), 5000, 5001} and fitted.count() == learning.FITTED
    assert got[5000].label is None and sum((r.score > 0) == r.label for r in got.values() if r.label is not None) > 1500


def test_bootstrap_beyond_the_bound_takes_all_runs(spark, monkeypatch):
    rng = np.random.default_rng(2)
    gains = np.r_[rng.normal(0.0, 0.1, 300), rng.normal(0.5, 0.1, 300)]
    frame = spark.createDataFrame([(f"q{i:04}", float(g)) for i, g in enumerate(gains)], "query_id string, gain double")
    exact = evaluation.bootstrap_of_all(frame)
    monkeypatch.setattr(evaluation, "MAX_GAINS", 100)
    got = evaluation.bootstrap_of_all(frame)
    assert got[0] == exact[0] == 600 and got[1] == pytest.approx(gains.mean())
    assert got == pytest.approx(exact, abs=0.01)
    picks = np.random.default_rng(1).integers(0, 600, (2000, 600))
    assert exact[2] == pytest.approx(np.sort(gains[picks].mean(axis=1))[50])


def test_back_off_does_not_depend_on_chunks(spark, tmp_path):
    rng = random.Random(8)
    kinds = [rng.choice(["error", "click"]) for _ in range(60)]
    rows = [(i % 2, i, kinds[i], float(i)) for i in range(60)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "user_id long, event_id long, event_type string, ts double").coalesce(1).write.parquet(str(tmp_path / "e.parquet"))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(key)
    spark.conf.set(key, "4")
    try:
        got = {r.host: (r.pause, r.parked) for r in ingest.run_to_end(ingest.back_off(ingest.stream_of(spark, str(tmp_path / "e.parquet"))), "update").collect()}
    finally:
        spark.conf.set(key, usual)
    for host in (0, 1):
        pause, failures = ingest.LEAST_PAUSE, 0
        for kind in kinds[host::2]:
            pause, failures = (min(ingest.MOST_PAUSE, pause * 2), failures + 1) if kind == "error" else (max(ingest.LEAST_PAUSE, pause / 2), 0)
        assert got[host] == (pause, failures >= ingest.PARK_AFTER)
