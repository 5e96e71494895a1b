import itertools
import os
import random

import numpy as np
import pytest

from webloom.llm import fusion, mixing, packing, tokens


def brute_fullest(lengths, room):
    items = [x for x, n in lengths for _ in range(n)]
    return max(s for k in range(len(items) + 1) for c in itertools.combinations(items, k) if (s := sum(c)) <= room)


@pytest.mark.parametrize("seed", range(25))
def test_fullest_is_optimal(seed):
    rng = random.Random(seed)
    lengths = [(x, rng.randrange(1, 3)) for x in rng.sample(range(1, 40), 6)]
    room = rng.randrange(1, 90)
    chosen = packing.fullest(lengths, room)
    have = dict(lengths)
    assert all(0 < times <= have[x] for x, times in chosen)
    assert sum(x * t for x, t in chosen) == brute_fullest(lengths, room)


def check_containers(rows, sizes, capacities):
    for cap_id, cap in capacities:
        mine = [r for r in rows if r.capacity_id == cap_id]
        total, contents = {}, {}
        for r in mine:
            total[r.doc_id] = total.get(r.doc_id, 0) + r.piece_tokens
            contents.setdefault(r.container_id, []).append(r)
        assert total == {d: t for d, t in sizes if t}
        for parts in contents.values():
            assert sum(p.piece_tokens for p in parts) == parts[0].container_tokens <= cap
        for d, t in sizes:
            if 0 < t <= cap:
                assert sum(r.doc_id == d for r in mine) == 1


def test_containers(spark, monkeypatch):
    rng = random.Random(2)
    sizes = [(i, rng.choice([rng.randrange(1, 60), rng.randrange(1, 300)])) for i in range(900)] + [(5000, 0), (5001, 1000), (5002, 256), (5003, 512)]
    capacities = [(1, 256), (2, 64)]
    frames = spark.createDataFrame(sizes, "doc_id long, tokens long"), spark.createDataFrame([(*c, "x") for c in capacities], "capacity_id int, capacity_tokens int, tokens string")
    for group in (packing.GROUP, 120):
        monkeypatch.setattr(packing, "GROUP", group)
        packed = packing.containers(*frames)
        check_containers(packed.collect(), sizes, capacities)
        fills = {r.capacity_id: r.fill for r in packing.fill(packed).collect()}
        assert fills[1] > 0.98 and fills[2] > 0.95


def test_no_items(spark):
    none = spark.createDataFrame([], "doc_id long, tokens long")
    room = spark.createDataFrame([(1, 64)], "capacity_id int, capacity_tokens int")
    assert packing.containers(none, room).count() == 0
    assert packing.containers(spark.createDataFrame([(1, 5)], "doc_id long, tokens long"), room.where("false")).count() == 0


def test_rake_meets_margins():
    rng = np.random.default_rng(1)
    have = rng.integers(1, 100, 24).astype(float)
    a, b = np.arange(24) % 4, np.arange(24) // 4
    weight = mixing.rake(have, have * 10, [(b, np.full(6, 40.0)), (a, np.array([96.0, 72, 48, 24]))])
    assert np.bincount(a, weights=weight) == pytest.approx([96, 72, 48, 24], rel=1e-6)
    assert np.bincount(b, weights=weight) == pytest.approx(np.full(6, 40.0), rel=0.02)


def documents(spark, n=3000):
    rng = random.Random(3)
    rows = [(i, "t", ["a-src", "A_SRC", "b-src", "c-src", None][min(4, int(rng.random() ** 2 * 5))], rng.choice(["en", "DE", None, "??"]), rng.choice(["note", "mail", None]), 1, "x") for i in range(n)]
    sizes = [(r[0], rng.randrange(1, 400)) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, doc_kind string, tokens int, expected string"), spark.createDataFrame(sizes, "doc_id long, tokens long")


def test_mixture_meets_shares(spark, monkeypatch):
    docs, sizes = documents(spark)
    targets = spark.createDataFrame([("a-src", 0.2, 2), ("B_src ", 0.5, 3), ("c-src", 0.3, 4), ("nowhere", 0.0, 4)], "source string, target_share double, max_repeats int")
    for group in (mixing.GROUP, 200):
        monkeypatch.setattr(mixing, "GROUP", group)
        drawn = mixing.mixture(docs, sizes, targets)
        got = {r.source: r for r in mixing.shares(drawn, targets).collect()}
        assert got["a-src"].actual_share == pytest.approx(0.2, abs=0.01) and got["b-src"].actual_share == pytest.approx(0.5, abs=0.01)
        assert all(r.most_repeats <= r.max_repeats for r in got.values()) and got["nowhere"].tokens == 0
        assert drawn.groupBy("doc_id").count().where("count > 1").count() == 0


def test_mixture_with_a_total_beyond_the_caps(spark):
    docs, sizes = documents(spark, 500)
    targets = spark.createDataFrame([("a-src", 0.5, 1), ("b-src", 0.5, 2)], "source string, target_share double, max_repeats int")
    drawn = mixing.mixture(docs, sizes, targets, total=10**9)
    assert {(r.source, r.repeats) for r in drawn.select("source", "repeats").distinct().collect()} == {("a-src", 1), ("b-src", 2)}


def test_empty_mixture(spark):
    docs, sizes = documents(spark, 5)
    none = spark.createDataFrame([], "source string, target_share double, max_repeats int")
    assert mixing.mixture(docs, sizes, none).count() == 0
    assert mixing.mixture(docs.where("false"), sizes, spark.createDataFrame([("a-src", 1.0, 1)], none.schema)).count() == 0


@pytest.mark.skipif(not os.path.isdir(tokens.TOKENIZERS), reason="no tokenizers here")
def test_token_counts(spark):
    rows = [(1, "Hello world"), (2, ""), (3, None), (4, "ÄÖ 日本 <|endoftext|> " * 50), (5, "x" * 50_000)]
    got = {r.doc_id: r.tokens for r in tokens.token_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    encode = tokens.encoding(tokens.TOKENIZERS)
    assert got[1] == 2 and got[2] == got[3] == 0
    assert encode.decode(encode.encode_ordinary(rows[3][1])) == rows[3][1] and got[4] == len(encode.encode_ordinary(rows[3][1]))


SCORE_SCHEMA = "query_id long, url string, retrieval_score double, quality double, quality_known boolean, spam_risk double, spam_risk_known boolean, proximity double, proximity_known boolean, score int, value string, n string"


def runs(seed=5, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        v = [rng.choice([None, float("nan"), 1.0, rng.random() * 10]), rng.choice([None, 0.0, round(rng.random(), 1)]), rng.choice([None, rng.random()]), rng.choice([None, 0.0, rng.random()])]
        k = [rng.choice([True, True, False, None]) for _ in range(3)]
        rows.append((rng.randrange(8), f"u{rng.randrange(30)}", v[0], v[1], k[0], v[2], k[1], v[3], k[2], 1, "x", "y"))
    return rows + [(None, "u", 1.0, *[None] * 9), (9, None, 1.0, *[None] * 9), (11, "only", *[None] * 10)]


def brute_first(rows):
    from collections import defaultdict
    from math import comb, isnan

    known = defaultdict(lambda: [[], [], [], []])
    for q, u, r, a, ka, s, ks, p, kp, *_ in rows:
        if q is None or u is None:
            continue
        for i, (v, k) in enumerate(((r, True), (a, ka), (s, ks), (p, kp))):
            cell = known[q, u][i]
            if v is not None and not isnan(v) and k:
                cell.append(v)
    out = {}
    for q in {q for q, _ in known}:
        urls = sorted(u for x, u in known if x == q)
        ranks = {u: [] for u in urls}
        for i in range(4):
            v = {u: sum(known[q, u][i]) / len(known[q, u][i]) * (1 if i == 2 else -1) for u in urls if known[q, u][i]}
            for u in urls:
                ranks[u].append((sum(x < v[u] for x in v.values()) + (sum(x == v[u] for x in v.values()) + 1) / 2) / len(v) if u in v else 0.5)
        def rho(u):
            r = sorted(ranks[u])
            return min(1.0, 4 * min(sum(comb(4, j) * r[k - 1] ** j * (1 - r[k - 1]) ** (4 - j) for j in range(k, 5)) for k in range(1, 5)))
        out[q] = min(urls, key=lambda u: (round(rho(u), 12), round(sum(ranks[u]) / 4, 12), u))
    return out


def test_ranking_against_brute_force(spark):
    rows = runs()
    frame = spark.createDataFrame(rows, SCORE_SCHEMA)
    got = {r.query_id: r.url for r in fusion.first_places(frame).collect()}
    assert got == brute_first(rows)
    placed = fusion.ranking(frame).collect()
    assert {r.query_id: r.url for r in placed if r.place == 1} == got
    for q in got:
        places = sorted(r.place for r in placed if r.query_id == q)
        assert places == list(range(1, len(places) + 1))
    assert fusion.first_places(frame.where("false")).count() == 0


def test_equal_long_rows_fill_containers_of_their_own(spark):
    sizes = spark.createDataFrame([(7, 250), (7, 250), (7, 250), (8, 100)], "doc_id long, tokens long")
    packed = packing.containers(sizes, spark.createDataFrame([(1, 100)], "capacity_id int, capacity_tokens int")).collect()
    load = {}
    for r in packed:
        load[r.container_id] = load.get(r.container_id, 0) + r.piece_tokens
    assert max(load.values()) <= 100 and sum(load.values()) == 850
