import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from tests.llm import cases
from webloom.llm import near, repeats


def edited(rng, words, share):
    out = []
    for w in words:
        x = rng.random()
        if x < share / 3:
            continue
        out.append(f"w{rng.randrange(9999)}" if x < 2 * share / 3 else w)
        if x > 1 - share / 3:
            out.append(f"n{rng.randrange(9999)}")
    return out


def versions():
    """Bodies with versions of growing distance, exact copies under other frames, and odd texts."""
    rng = random.Random(9)
    rows = []
    for k in range(14):
        words = cases.paragraph(rng, 24).split()
        for share in (0, 0, 0.04, 0.08, 0.12, 0.5):
            text = " ".join(edited(rng, words, share))
            host = list(cases.FRAMES)[rng.randrange(3)]
            framed = "\n".join([*cases.FRAMES[host][:-1], text, cases.FRAMES[host][-1]])
            rows.append((len(rows), f"https://{host}/v/{len(rows)}", framed, text))
    return rows


def brute(rows):
    sets = {i: set(zip(w, w[1:], w[2:])) for i, _, _, t in rows for w in [t.lower().split()]}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 45 * len(sets[a] | sets[b])}


def test_pairs_against_brute_force(spark):
    rows = versions()
    filler = [(1000 + c["id"], c["url"], c["text"]) for c in cases.crawl(60)]
    got = {tuple(r) for r in near.version_pairs(cases.results_frame(spark, [r[:3] for r in rows] + filler)).collect()}
    want = brute(rows)
    assert want and len(got & want) >= 0.97 * len(want) and got <= want


def test_one_edited_group_of_a_third_of_the_rows(spark):
    rng = random.Random(21)
    base = [f"b{rng.randrange(9999)}" for _ in range(200)]
    texts = [" ".join(edited(rng, base, 0.08)) for _ in range(80)] + [" ".join(f"w{rng.randrange(9999)}" for _ in range(200)) for _ in range(160)]
    rows = [(i, f"https://h{i % 40}.test/{i}", t, t) for i, t in enumerate(texts)]
    want = brute(rows)
    got = {tuple(r) for r in near.version_pairs(cases.results_frame(spark, [r[:3] for r in rows])).collect()}
    assert len(want) > 2000 and len(got & want) >= 0.99 * len(want) and got <= want


def test_groups(spark):
    rows = versions()
    frame = cases.results_frame(spark, [r[:3] for r in rows])
    got = {r.result_id: (r.group_id, r.links) for r in near.version_groups(frame).collect()}
    pairs = {tuple(r) for r in near.version_pairs(frame).collect()}
    assert len(got) == len(rows)
    for a, b in pairs:
        assert got[a][0] == got[b][0]
    degree = {i: sum(i in p for p in pairs) for i in got}
    assert {i: n for i, (_, n) in got.items()} == degree


def test_odd_rows(spark):
    odd = [(i, None if i % 2 else "https://alpha.test/", t) for i, t in enumerate(cases.ODD_TEXTS)]
    copies = [(100, "https://alpha.test/", "two words"), (101, None, "two words"), (102, "https://beta.test/", cases.ODD_TEXTS[7]), (103, "x", ""), (104, "x", None)]
    got = {tuple(r) for r in near.version_pairs(cases.results_frame(spark, odd + copies)).collect()}
    assert got == {(100, 101), (7, 102)}
    assert near.version_pairs(cases.results_frame(spark, [])).count() == 0
    assert near.version_groups(cases.results_frame(spark, [])).count() == 0


def test_ids_beyond_the_broadcast_bound_are_joined(spark, monkeypatch):
    rows = [r[:3] for r in versions()]
    want = {tuple(r) for r in near.version_pairs(cases.results_frame(spark, rows)).collect()}
    monkeypatch.setattr(near, "MAX_IDS", 0)
    assert {tuple(r) for r in near.version_pairs(cases.results_frame(spark, rows)).collect()} == want


def passes(spark, left, right):
    """Which pairs of sketches leave the join with an equal segment and a chain that holds."""
    (keys_a, rings_a), (keys_b, rings_b) = near.ring_postings(left), near.ring_postings(right)
    rows = [(int(i), *(int(r[i, s]) for r in rings_a), *(int(r[i, s]) for r in rings_b)) for i, s in zip(*np.nonzero(keys_a == keys_b))]
    names = ["i", *(f"a{k}" for k in range(len(rings_a))), *(f"b{k}" for k in range(len(rings_b)))]
    if not rows:
        return np.zeros(len(left), bool), np.zeros(len(left), bool)
    chain = near.chain_holds([(F.col(f"a{k}"), F.col(f"b{k}")) for k in range(len(rings_a))])
    kept = {r.i for r in spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names)).where(chain).select("i").distinct().collect()}
    return np.isin(np.arange(len(left)), list(kept)), (keys_a == keys_b).any(axis=1)


def sketch_pairs(agreement, n, seed=3):
    rng = np.random.default_rng(seed)
    left = rng.integers(0, 1 << 16, (n, near.HASHES), dtype=np.uint16)
    same = rng.random((n, near.HASHES)) < agreement
    return left, np.where(same, left, rng.integers(0, 1 << 16, (n, near.HASHES), dtype=np.uint16))


def test_chain_keeps_close_pairs_and_prunes_others_before_the_hamming_check(spark):
    close, _ = passes(spark, *sketch_pairs(0.55, 2000))
    assert close.mean() > 0.99
    far, shared = passes(spark, *sketch_pairs(0.1, 12000))
    assert shared.sum() > 200 and far.sum() <= 0.1 * shared.sum()
    # a chain within the budgets in plain words, on the four bits that postings carry
    left, right = sketch_pairs(0.4, 300)
    got, _ = passes(spark, left, right)
    differ = ((left & 15) != (right & 15)).reshape(len(left), near.SEGMENTS, near.WIDTH).sum(axis=2)
    equal = (left == right).reshape(differ.shape + (near.WIDTH,)).all(axis=2)
    want = [any(e[s] and all(sum(d[(s + k) % near.SEGMENTS] for k in range(1, n)) <= near.budget(n) for n in near.LENGTHS) for s in range(near.SEGMENTS)) for d, e in zip(differ, equal)]
    assert got.tolist() == want and 0 < sum(want) < len(want)


def test_rows_do_not_depend_on_the_layout(spark):
    frame = cases.results_frame(spark, [r[:3] for r in versions()])
    want = {tuple(r) for r in near.version_pairs(frame.coalesce(1)).collect()}
    assert all({tuple(r) for r in near.version_pairs(frame.repartition(n)).collect()} == want for n in (8, 64)) and want


def test_lines_that_vary_by_a_word_are_one_cluster(spark):
    rng = random.Random(31)
    words = cases.NOUNS
    rows, want, kept = [], set(), {}
    for site in range(6):
        notice = rng.sample(words, 18)
        for k in range(12):
            varied = list(notice)
            for place in rng.sample(range(18), 1 + k % 2):
                varied[place] = f"{rng.choice(words)}ly"
            i = len(rows)
            own = " ".join(rng.choice(words) for _ in range(18))
            rows.append((i, f"https://s{site}.test/{i}", "\n".join([own, " ".join(notice if k == 0 else varied)])))
            want.add(i)
            kept[i] = own
    got = {r.result_id: r for r in repeats.without_repeats(cases.results_frame(spark, rows)).collect()}
    assert all(kept[i] in got[i].text for i in want)
    assert sum(got[i].removed_lines for i in want) >= 0.9 * len(want)


def test_unrelated_headings_stay(spark):
    heads = ["Paris London Rome", "Anna Schmidt Berlin", "Opening Hours Sunday", "Release Notes Summary", "Das Haus Wien", "Kernel Panic Debugging", "Night Train Home", "Green Tea Cake", "First Aid Box", "Old Town Hall"]
    rows = [(i, f"https://a.test/{i}", f"{h}\nText number {h.lower()} of its own.") for i, h in enumerate(heads)]
    assert all(r.removed_lines == 0 for r in repeats.without_repeats(cases.results_frame(spark, rows)).collect())


def test_names_are_masked_with_evidence_only():
    lines = repeats.Lines(repeats.pa.array(["By Anna Kowalski\nBY ANNA  Okafor\nVon Mira Quillane am 3.4.2024\nVon Ada Okafor am 12.11.2023\nBy J. Smith\nOpening Hours Sunday\nGreen Tea Cake"]))
    keys = repeats.Masked(lines, frozenset({"anna"})).keys.tolist()
    assert keys[0] == keys[1] == keys[4] and keys[2] == keys[3] and len(set(keys)) == 4


def test_large_buckets_are_split(spark, monkeypatch):
    frame = cases.results_frame(spark, [(c["id"], c["url"], c["text"]) for c in cases.crawl(60)])
    want = {(r.result_id, r.text) for r in repeats.without_repeats(frame).collect()}
    monkeypatch.setattr(repeats, "LINES_PER_TASK", 3)
    assert {(r.result_id, r.text) for r in repeats.without_repeats(frame).collect()} == want


def repeated(rows, urls=8):
    import re
    from collections import defaultdict

    norm = lambda line: re.sub(r"\d+", "0", " ".join(line.lower().split()))
    site = lambda u: re.sub(r"^www\.", "", re.match(r"https?://([^/:]+)", u).group(1).lower())
    seen = defaultdict(set)
    for _, u, t in rows:
        for line in (t or "").split("\n"):
            if u and line.strip():
                seen[site(u), norm(line)].add(u)
    return {(i, k) for i, u, t in rows if u for k, line in enumerate((t or "").split("\n")) if line.strip() and len(seen[site(u), norm(line)]) >= urls}


def test_repeated_lines_against_brute_force(spark):
    rows = [(c["id"], c["url"], c["text"].upper() if c["id"] % 5 == 0 else c["text"].replace(" ", "  ")) for c in cases.crawl(60)]
    rows += [(500, rows[0][1], rows[0][2]), (501, None, "Skip to content"), (502, "https://ALPHA.test:443/z", "skip TO content\n\n x "), (503, "https://alpha.test/q", None)]
    frame = cases.results_frame(spark, rows)
    assert {tuple(r) for r in repeats.repeated_lines(frame).collect()} == repeated(rows)
    cleaned = {r.result_id: r for r in repeats.without_repeats(frame).collect()}
    assert len(cleaned) == len(rows) and cleaned[501].text == "Skip to content" and cleaned[503].text is None
    assert "© 2025 Alpha" not in cleaned[3].text and cleaned[3].removed_lines > 3


def test_keys_beyond_the_broadcast_bound_are_joined(spark, monkeypatch):
    frame = cases.results_frame(spark, [(c["id"], c["url"], c["text"]) for c in cases.crawl(60)])
    lines = {tuple(r) for r in repeats.repeated_lines(frame).collect()}
    texts = {(r.result_id, r.text, r.removed_lines) for r in repeats.without_repeats(frame).collect()}
    monkeypatch.setattr(repeats, "MAX_BROADCAST_KEYS", 2)
    assert {tuple(r) for r in repeats.repeated_lines(frame).collect()} == lines and lines
    assert {(r.result_id, r.text, r.removed_lines) for r in repeats.without_repeats(frame).collect()} == texts


def test_chains_of_lines_do_not_depend_on_the_broadcast_bound(spark, monkeypatch):
    # each line shares 18 of 22 words with the next, so few buckets hold three of them
    rows = []
    for site in range(12):
        words = [f"w{chr(97 + site)}{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(40)]
        rows += [(8 * site + k, f"https://s{site}.test/{k}", " ".join(words[2 * k : 2 * k + 20]) + f"\nown text {words[k]}") for k in range(8)]
    frame = cases.results_frame(spark, rows)
    got = {(r.result_id, r.text, r.removed_lines) for r in repeats.without_repeats(frame).collect()}
    assert sum(r[2] for r in got) >= 0.9 * len(rows) and max(r[2] for r in got) == 1
    monkeypatch.setattr(repeats, "MAX_BROADCAST_KEYS", 2)
    assert {(r.result_id, r.text, r.removed_lines) for r in repeats.without_repeats(frame).collect()} == got
    monkeypatch.setattr(repeats, "MAX_LINKS", 6)
    assert {(r.result_id, r.text, r.removed_lines) for r in repeats.without_repeats(frame).collect()} == got


def test_versions_with_joined_anchors(spark, monkeypatch):
    frame = cases.results_frame(spark, [r[:3] for r in versions()])
    want = {tuple(r) for r in near.version_pairs(frame).collect()}
    monkeypatch.setattr("webloom.llm.frames.MAX_BROADCAST_PARTS", 1)
    assert {tuple(r) for r in near.version_pairs(frame).collect()} == want


def test_no_repeats(spark):
    assert repeats.repeated_lines(cases.results_frame(spark, [])).count() == 0
    assert repeats.repeated_lines(cases.results_frame(spark, [(1, None, "a"), (2, "https://a.test/", None)])).count() == 0
