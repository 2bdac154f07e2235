import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixframe.llm import components, decontamination, near_texts, queries, vectors

RNG = random.Random(4)
WORDS = ["".join(RNG.choices("abcdefghij", k=RNG.randint(2, 7))) for _ in range(3000)]


def text(n, seed):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def edited(t, edits, seed):
    rng, words = random.Random(seed), t.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


def groups_of(links, ids):
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {i: top(i) for i in ids}


def jaccard_groups(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        n = min(5, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    ids = [i for i, _ in rows]
    texts = dict(rows)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[:x] if (texts[a] or "") == (texts[b] or "") or sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    return groups_of(links, ids)


def corpus():
    rows = [(i, text(RNG.randint(1, 150), i)) for i in range(60)]
    base = text(120, 900)
    rows += [(100 + i, edited(base, i % 4, i)) for i in range(40)]  # near copies
    rows += [(200 + i, rows[5][1]) for i in range(5)] + [(210, rows[5][1].upper()), (211, None), (212, ""), (213, "  "), (214, "one two"), (215, "One  two"), (216, "one two three")]
    shared = text(40, 901)
    rows += [(300 + i, shared + " " + text(60, 400 + i)) for i in range(30)]  # a passage in common
    rows.append((400, text(20_000, 77)))
    return rows


def test_near_duplicates_against_brute_force(spark):
    rows = corpus()
    expected = jaccard_groups(rows)
    # A text without words is linked only with equal ones; null counts as empty.
    assert expected[212] == 211 and expected[213] == 213
    df = spark.createDataFrame(rows + [(5, rows[5][1])] * 3, "doc_id long, text string")
    got = near_texts.near_duplicates(df, "doc_id", "text").collect()
    assert {r.doc_id: r.class_id for r in got} == expected and len(got) == len(rows)
    assert next(r.copies for r in got if r.doc_id == 5) == 4 and all(r.kept == (r.doc_id == r.class_id) for r in got)


def test_large_groups_are_split(spark, monkeypatch):
    monkeypatch.setattr(near_texts, "BLOCK", 7)
    monkeypatch.setattr(near_texts, "EXACT_BLOCK", 5)
    rows = corpus()
    got = near_texts.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    assert {r.doc_id: r.class_id for r in got} == jaccard_groups(rows)


def test_repeated_shingles_weigh_against_brute_force(spark):
    rng = random.Random(12)
    lines = [text(7, 8000 + i) for i in range(12)]
    rows = []
    for g in range(8):  # texts of repeated lines, some with other counts, some with other lines
        own = rng.sample(lines, 5) + [text(8, 8100 + g)]
        counts = [rng.choice((1, 2, 9, 40)) for _ in own]
        for c in range(5):
            changed = list(counts)
            if c:
                changed[rng.randrange(6)] = rng.choice((1, 3, 60))
            rows.append((10 * g + c, " ".join(" ".join([line] * n) for line, n in zip(own, changed)) + (" " + text(c * 3, 8200 + 10 * g + c) if c > 2 else "")))

    def similar(a, b):
        found = []
        for t in (a, b):
            w = t.split()
            found.append({k: 1 + np.log(n) for k, n in Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)).items()})
        both = found[0].keys() | found[1].keys()
        least, most = (sum(pick(found[0].get(k, 0), found[1].get(k, 0)) for k in both) for pick in (min, max))
        return max(least / most, len(found[0].keys() & found[1].keys()) / len(both)) >= 0.8

    expected = groups_of([(a, b) for a, s in rows for b, t in rows if b < a and similar(s, t)], [i for i, _ in rows])
    got = near_texts.near_duplicates(spark.createDataFrame(rows, "kept long, text string"), "kept", "text").collect()
    assert {r["kept_"]: r.class_id for r in got} == expected and 8 < len(set(expected.values())) < 40


def test_one_row_of_each_group_stays(spark):
    t = text(50, 1)
    rows = [(1, t, "a"), (1, t, "a"), (1, t, "b"), (2, t, "c"), (3, edited(t, 1, 3), "d"), (3, text(50, 9), "e"), (None, text(50, 10), "f"), (4, None, "g"), (5, "", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _cls string")
    kept = near_texts.without_near_duplicates(df, "doc_id", "text").collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept if r.text) == sorted([(1, t), (3, rows[5][1]), (0, rows[6][1])])
    assert [r.doc_id for r in kept if not r.text] == [4] and kept[0].asDict().keys() == {"doc_id", "text", "_cls"}
    assert near_texts.without_near_duplicates(df.limit(0), "doc_id", "text").count() == 0


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    base = near_texts.mixed(np.arange(1, 401, dtype=np.uint64))
    wa, wb = rng.uniform(0.2, 6, 400), rng.uniform(0.2, 6, 400)
    wb[:200] = wa[:200]
    sig = near_texts.dart_signatures([base, base, base[:1]], [wa, wb, wa[:1]], 4096)
    true = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert (sig[0] == sig[1]).mean() == pytest.approx(true, abs=0.035)
    a, b = base[:300], base[100:400]
    flat = near_texts.dart_signatures([a, b], [np.ones(300), np.ones(300)], 4096)
    assert (flat[0] == flat[1]).mean() == pytest.approx(0.5, abs=0.035)


def test_components_and_spanning_links(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (7, 7), (100, 101)]
    as_bytes = spark.createDataFrame(edges, "a int, b int").select(F.col("a").cast("string").cast("binary").alias("a"), F.col("b").cast("string").cast("binary").alias("b"))
    got = {int(r.id): r.component for r in components.connected_components(as_bytes).collect()}
    assert len(got) == 53 and len({bytes(v) for k, v in got.items() if k <= 50}) == 1 and got[100] == got[101] != got[1]
    m = np.zeros((6, 6), bool)
    for a, b in ((0, 3), (3, 5), (1, 2)):
        m[a, b] = m[b, a] = True
    assert sorted(components.spanning_links(m)) == [(2, 1), (3, 0), (5, 0)]
    assert near_texts._first_links(np.array([[True, False], [True, True], [False, False]])) == [(0, 0), (1, 0), (1, 1)]


def vectors_rows():
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=16)) for i in range(300)]
    rows += [(400 + i, rows[3][1] + rng.normal(size=16) * 0.05) for i in range(60)]
    rows += [(500 + i, rows[9][1]) for i in range(30)] + [(540, rows[9][1] * 7.5), (541, -rows[9][1]), (542, rows[9][1] * 1e30)]
    rows += [(600 + i, rows[20][1] + rng.normal(size=16) * 0.12) for i in range(40)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    return rows + [(700, None), (701, [0.0] * 16), (702, [float("nan")] * 16), (703, [None] + [1.0] * 15), (704, [float("inf")] * 16), (705, []), (706, [1.0, 2.0]), (707, [2.0, 4.0]), (5, rows[9][1])]


def brute_vectors(rows):
    units = []
    for _, v in rows:
        a = None if v is None or None in v else np.array(v, dtype=np.float64)
        units.append(a / np.abs(a).max() / np.linalg.norm(a / np.abs(a).max()) if a is not None and len(a) and np.isfinite(a).all() and a.any() else None)
    link = [[False] * len(rows) for _ in rows]
    for x, a in enumerate(units):
        for y, b in enumerate(units):
            link[x][y] = x != y and a is not None and b is not None and len(a) == len(b) and a @ b >= 0.95
    groups = groups_of([(x, y) for x in range(len(rows)) for y in range(x) if link[x][y]], range(len(rows)))
    low = {}
    for x, g in groups.items():
        low[g] = min(low.get(g, 1 << 60), rows[x][0])
    return Counter((rows[x][0], sum(link[x]), low[groups[x]]) for x in range(len(rows)))


@pytest.mark.parametrize("block", [1024, 16])
def test_near_vectors_against_brute_force(spark, block):
    rows = vectors_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = Counter((r.vec_id, r.n_links, r.component_id) for r in vectors.near_vectors(df, "vec_id", "embedding", block=block).collect())
    expected = brute_vectors(rows)
    found = sum((got & expected).values())
    links = sum(n * c for (_, n, _), c in got.items()) / sum(n * c for (_, n, _), c in expected.items())
    assert sum(got.values()) == len(rows) and 0.98 <= links <= 1 and found >= 0.97 * len(rows)
    assert vectors.near_vectors(df.limit(0), "vec_id", "embedding").count() == 0


@pytest.mark.parametrize("n, common", [(4000, 2.5), (50_000, 0.0)])
def test_recall_of_links_at_the_threshold(spark, n, common):
    """Planted pairs just above the threshold; with a common direction the mean cosine is about 0.86."""
    rng = np.random.default_rng(n)
    base = rng.normal(size=(n, 32)) / np.sqrt(32)
    base[:, 0] += common
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise = rng.normal(size=(500, 32))
    noise -= (noise * base[:500]).sum(axis=1, keepdims=True) * base[:500]
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    rows = np.vstack([base, 0.953 * base[:500] + np.sqrt(1 - 0.953**2) * noise]).astype(np.float32)
    own = spark.createDataFrame(pa.table({"n_links": np.arange(len(rows)), "v": pa.array(list(rows), pa.list_(pa.float32()))}))
    got = vectors.near_vectors(own, "n_links", "v")
    assert got.columns == ["n_links_", "n_links", "component_id", "kept"]
    found = sum(r["n_links"] for r in got.collect())
    units = rows.astype(np.float64) / np.linalg.norm(rows.astype(np.float64), axis=1, keepdims=True)
    true = sum(int((units[i : i + 1000] @ units.T >= 0.95).sum()) for i in range(0, len(units), 1000)) - len(units)
    assert true >= 1000 and 0.98 * true <= found <= true
    if n < 5000:
        assert sum(r["n_links"] for r in vectors.near_vectors(own, "n_links", "v", exact=True).collect()) == true


def edit_distance_within(passage, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(passage, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_passages_against_brute_force():
    rng = random.Random(8)
    items = [text(rng.randint(10, 40), 3000 + i) for i in range(12)]
    index = decontamination.Passages(list(range(12)), [decontamination.folded(t) for t in items])
    for trial in range(40):
        i = rng.randrange(12)
        s = list(items[i])
        for _ in range(rng.randint(0, int(len(s) * 0.14))):
            p = rng.randrange(len(s))
            s[p : p + rng.choice((0, 1))] = rng.choice(("", "x", "yz"))
        doc = decontamination.folded(text(40, trial) + " " + "".join(s) + " " + text(40, trial + 100))
        best = edit_distance_within(index.texts[i], doc)
        hit = [h for h in index.search(["", doc, "short"])[1] if h[0] == i]
        assert bool(hit) == (best <= index.edits[i]), (trial, best)
        if hit:
            assert hit[0][3] == best and edit_distance_within(index.texts[i], doc[hit[0][1] : hit[0][2]]) == best


def test_few_pairs_at_once_find_the_same(monkeypatch):
    rng = random.Random(9)
    items = [text(rng.randint(10, 40), 3100 + i) for i in range(9)] + ["ab" * 60, "ab" * 50, "abc " * 20]
    docs = [decontamination.folded(text(300, i) + " " + edited(items[i % 12], 1, i) + " " + text(200, 50 + i) + " " + items[(i + 5) % 12] + " tail") for i in range(6)] + ["ab" * 2000]
    find = lambda: decontamination.Passages(list(range(12)), items).search(docs)
    whole = find()
    for limit in (300, 40):
        monkeypatch.setattr(decontamination, "TOGETHER", limit)
        assert [[(h[0], h[3]) for h in hits] for hits in find()] == [[(h[0], h[3]) for h in hits] for hits in whole]
    assert all(whole[i] for i in range(6))


def test_items_of_any_length_against_brute_force(spark):
    items = [(n, text(40, 5000 + n)[:n].strip() or "x") for n in range(1, 61)]
    docs = [(i, text(30, 6000 + i) + " " + items[i % 60][1] + " " + text(30, 7000 + i)) for i in range(60)]
    found = decontamination.find_passages(spark.createDataFrame(docs, "doc_id long, text string"), "text", spark.createDataFrame(items, "item_id long, text string"), "item_id", "text", keep=["doc_id"])
    got = {r.doc_id: {h.item: h.edits for h in r.hits} for r in found.collect()}
    for i, doc in docs:
        for n, item in items:
            if len(item) < decontamination.LEAST:
                expected = f" {item} " in f" {doc} "
            else:
                expected = edit_distance_within(item, doc) <= min(int(len(item) * 0.1), (len(item) - 8) // 8)
            assert (n in got[i]) == expected, (i, n)


def test_passage_rows(spark, monkeypatch):
    item = text(30, 1)
    bench = spark.createDataFrame([(1, item), (2, "too short"), (3, None), (4, item), (5, text(25, 2))], "item_id int, text string")
    docs = spark.createDataFrame([(1, "x\n" + item.upper().replace(" ", "\n") + " y", "h"), (2, text(200, 3), None), (3, None, None), (4, "", None), (4, item, None), (4, item, None)], "doc_id long, text string, HITS string")
    for chars in (1 << 20, 100):
        monkeypatch.setattr(decontamination, "PASS_CHARS", chars)
        got = decontamination.find_passages(docs, "text", bench, "item_id", "text").collect()
        assert [sorted(h.item for h in r["hits_"]) for r in got] == [[1, 4], [], [], [], [1, 4], [1, 4]]
        hit = got[0]["hits_"][0]
        assert (hit.begin, hit.end, hit.edits) == (2, 2 + len(item), 0) and got[0]["HITS"] == "h"
    monkeypatch.setattr(decontamination, "HELD", 1)  # one block a pass, with saved tables between
    again = decontamination.find_passages(docs, "text", bench, "item_id", "text").collect()
    assert sorted((r.doc_id, str(r["text"]), sorted(h.item for h in r["hits_"])) for r in again) == sorted((r.doc_id, str(r["text"]), sorted(h.item for h in r["hits_"])) for r in got)
    none = decontamination.find_passages(docs, "text", bench.limit(0), "item_id", "text").collect()
    assert all(r["hits_"] == [] for r in none) and len(none) == 6
    assert decontamination.find_passages(docs.limit(0), "text", bench, "item_id", "text").count() == 0


def test_whole_groups_cross_batches():
    from helixframe.llm.shared import whole_groups

    batches = [pa.RecordBatch.from_pydict({"k": [1, 1, 2]}), pa.RecordBatch.from_pydict({"k": [2, 2]}), pa.RecordBatch.from_pydict({"k": [3, 4]})]
    assert [g.column("k").to_pylist() for g in whole_groups(iter(batches), ["k"])] == [[1, 1], [2, 2, 2], [3], [4]]


def test_queries_read_whole_tables(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, rows[400 % len(rows)][1][:10]), (2, rows[20][1] + " tail " + text(9, 5))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert queries.op9_near_texts(spark, str(tmp_path)).count() == len(rows)
    assert set(queries.op8_decontamination(spark, str(tmp_path)).columns) == {"doc_id", "item_id", "begin", "end", "edits"}


def test_short_benchmark_items_are_found_between_word_boundaries(spark):
    items = [(1, "What is the capital of Peru?"), (2, "art"), (3, " ?! "), (4, "   "), (5, None), (6, "What is the capital of Peru?")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [(1, "Q: WHAT is the\ncapital of Peru? Lima"), (2, "a start and parts"), (3, "art"), (4, "so ?! and (art)"), (5, "What is the capital of Perus?"), (6, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: [tuple(h) for h in r.hits] for r in decontamination.find_passages(docs, "text", bench, "item_id", "text").collect()}
    assert got == {1: [(1, 3, 31, 0), (6, 3, 31, 0)], 2: [], 3: [(2, 0, 3, 0)], 4: [(2, 11, 14, 0), (3, 3, 5, 0)], 5: [(1, 0, 27, 1), (6, 0, 27, 1)], 6: []}


def test_items_of_sixteen_characters_and_more_are_found_with_edits(spark):
    """Substituted, inserted and left-out characters, one more than allowed too, against the plain distance."""
    rng, items, docs = random.Random(77), [], []
    for n in range(10, 61):
        item = text(40, 8000 + n)[:n].strip()
        items.append((n, item))
        for more in (0, 1, 2, 4):
            s = list(item)
            for _ in range(more):
                at = rng.randrange(1, len(s) - 1)
                s[at : at + rng.choice((0, 1))] = rng.choice(("", "q", "zy"))
            docs.append((len(docs), text(8, n) + " " + "".join(s) + " " + text(8, n + 500)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.find_passages(spark.createDataFrame(docs, "doc_id long, text string"), "text", bench, "item_id", "text", keep=["doc_id"])
    got = {r.doc_id: {h.item: h.edits for h in r.hits} for r in found.collect()}
    edited_hits = 0
    for i, doc in docs:
        for n, item in items[max(i // 4 - 3, 0) : i // 4 + 4]:
            if len(item) >= 16:
                best = edit_distance_within(item, doc)
                assert got[i].get(n) == (best if best <= min(int(len(item) * 0.1), (len(item) - 8) // 8) else None), (i, n)
                edited_hits += bool(got[i].get(n))
    assert edited_hits > 40
