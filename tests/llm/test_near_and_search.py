"""SimHash groups, vector search, sharding, the classifier and the pipeline, against brute force and edge cases."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from quillmesh.llm import registry, similar
from quillmesh.llm.components import components
from quillmesh.llm.quality import classify, labelled_sample
from quillmesh.llm.sharding import assign_shards, write_shards
from quillmesh.llm.similar import similar_groups
from quillmesh.llm.simhash import near_groups, near_links
from quillmesh.llm.vector_search import nearest, top_k


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(name, spark, data, same_as_sql):
    assert same_as_sql(registry.QUERIES[name](spark, data), registry.ORACLES[name]) > 0


def roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def near(bits):
    return roots(len(bits), [(i, j) for i in range(len(bits)) for j in range(i) if (bits[i] ^ bits[j]).bit_count() <= 4])


def test_links_of_dense_and_sparse_clusters(spark):
    rng = random.Random(7)
    centres = [rng.getrandbits(64) for _ in range(60)]
    bits = sorted({rng.choice(centres[: rng.choice([2, 60])]) ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 6))}) for _ in range(700)})
    signed = [b - (1 << 64) if b >> 63 else b for b in bits]
    found = {r.node: r.root for r in components(near_links(spark.createDataFrame([(b,) for b in signed], "fp long"), shard=40)).collect()}
    mine, theirs = {}, {}
    for b, r in zip(signed, near(bits)):
        mine.setdefault(found.get(b, b), set()).add(b)
        theirs.setdefault(r, set()).add(b)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def simhash(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = lower.split() if lower.isascii() else [w for w in __import__("re").split("[\x20\x09-\x0d]+", lower) if w]
    parts = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_groups(spark):
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 3000)}" for _ in range(300)]
    rows = [(10, " ".join(base)), (3, " ".join(base)), (7, " ".join(base[:150] + ["new"] + base[151:])), (20, "Other É text here now"), (21, None), (22, ""), (23, "one two"), (24, " \n"), (10, " ".join(base))]
    out = near_groups(spark.createDataFrame([(i, t, 0, "c") for i, t in rows], "doc_id long, text string, fp int, component_id string")).collect()
    bits = [simhash(t) for _, t in rows]
    want = sorted((i, b, min(rows[k][0] for k in range(len(rows)) if near(bits)[k] == r)) for (i, _), b, r in zip(rows, bits, near(bits)))
    assert sorted((r.doc_id, r.fp % (1 << 64), r.component_id) for r in out) == want
    assert near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(k, k + 1) for k in range(300, 340)] + [(400, k) for k in range(401, 440)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "x long, y long")).collect()}
    want = roots(440, pairs)
    assert all(got.get(k, k) == want[k] for k in range(440))


def test_vector_search_edges(spark):
    rng = random.Random(0)
    rows = [(i, [float(rng.randint(-3, 3)) for _ in range(3)]) for i in range(200)] + [(1000, None), (1020, [1.0, None, 2.0]), (1040, [float("nan"), 1.0, 1.0]), (1060, [0.0, 0.0, 0.0]), (None, [1.0] * 3), (1100, [1.0, 2.0]), (1120, [])]
    frame = spark.createDataFrame([(i, v, 5) for i, v in rows], "vec_id long, embedding array<double>, score int")
    good = [(i, v) for i, v in rows if i is not None and v and len(v) == 3 and None not in v and all(np.isfinite(v))]
    tops, nears = top_k(frame, k=7, columns=5).collect(), nearest(frame, columns=5).collect()
    for q, v in good:
        if q % 20 == 0:
            want = sorted((-int(sum(np.floor(64 * a) * np.floor(64 * b) for a, b in zip(v, w))), i) for i, w in good if i != q)[:7]
            assert [(-r.score, r.vec_id) for r in sorted(tops, key=lambda r: r["rank"]) if r.query_id == q] == want
        if q % 50 == 0 and any(v):
            cos = lambda a, b: float(np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b)))
            want = sorted((-round(cos(v, w), 10), i) for i, w in good if i != q and any(w))[:5]
            assert [(-round(r.score, 10), r.vec_id) for r in sorted(nears, key=lambda r: r["rank"]) if r.query_id == q] == want
    assert top_k(frame.limit(0)).count() == 0


def searched(rows, modulus, k, score):
    """Every row's list by brute force: all rows but the query's own, by row and not by id."""
    out = []
    for a, (q, v) in enumerate(rows):
        if q % modulus == 0:
            best = sorted((-score(v, w), i) for b, (i, w) in enumerate(rows) if b != a)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def whole_product(v, w):
    return sum(int(np.floor(64 * a)) * int(np.floor(64 * b)) for a, b in zip(v, w))


def cosine(v, w):
    return round(float(np.dot(v, w) / np.sqrt(np.dot(v, v) * np.dot(w, w))), 9)


@pytest.mark.parametrize("options", [{}, {"columns": 3, "cell_bytes": 3000}, {"columns": 20, "cell_bytes": 900}])
def test_search_by_row_where_ids_repeat(spark, options):
    rng = random.Random(11)
    rows = [(rng.randrange(40), [float(rng.randint(-2, 2)) + 0.25 for _ in range(4)]) for _ in range(150)]
    rows += [(0, [1.0, 2.0, 3.0, 4.0])] * 3 + [(0, [4.0, 3.0, 2.0, 1.0]), (20, [1.0, 2.0, 3.0, 4.0])] + [(7, [1.25, 1.0, 1.0, 1.0])] * 30
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, query_id string").repartition(5)
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(frame, k=6, **options).collect()]
    assert sorted(got) == searched(rows, 20, 6, whole_product)
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in nearest(frame, modulus=10, **options).collect()]
    want = searched(rows, 10, 5, cosine)
    assert [(q, n, s) for q, n, _, s in sorted(got, key=lambda x: (x[0], x[1], x[3], x[2]))] == [(q, n, s) for q, n, _, s in sorted(want, key=lambda x: (x[0], x[1], x[3], x[2]))]


@pytest.mark.parametrize("scale", [2.0**20, 2.0**25, 2.0**40, 1e200])
def test_products_of_any_size_keep_their_order(spark, scale):
    rows = [(0, [scale, 1.0]), (1, [scale, 1.0]), (2, [scale, 1.5]), (3, [scale, 1.9]), (20, [-scale, 0.5]), (4, [scale * 1.375, 0.0])]
    found = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=9).collect()
    ends = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == [(q, n, i, ends(s)) for q, n, i, s in searched(rows, 20, 9, whole_product)]


def test_products_past_doubles(spark):
    frame = spark.createDataFrame([(0, [2.0**40, 1.0]), (1, [2.0**40, 3.0]), (2, [2.0**40, 2.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in sorted(top_k(frame, k=2).filter("query_id = 0").collect(), key=lambda r: r["rank"])] == [1, 2]


def test_shards(spark):
    rows = [(1, "x" * 300)] * 20 + [(None, None), (2, "y" * 5000), (3, "")] + [(1, "z" * 900)] * 3 + [(k, "w" * 90) for k in range(10, 200)]
    out = assign_shards(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, depth int"), limit=1000).collect()
    held = {}
    for r in out:
        held.setdefault((r.depth, r.prefix, r.part), []).append(r.bytes)
    assert len(out) == len(rows)
    assert all(sum(b) <= 1000 or len(b) == 1 for b in held.values())
    assert assign_shards(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shards_are_the_shallowest_that_fit(spark):
    import hashlib

    rng = random.Random(3)
    rows = [(k, "x" * rng.choice([0, 5, 40, 300])) for k in range(3000)]
    bits = {k: int(hashlib.md5(str(k).encode()).hexdigest()[:15], 16) for k, _ in rows}
    out = {r.doc_id: (r.depth, r.prefix, r.part) for r in assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), limit=700).collect()}

    def split(own, depth, prefix):
        if sum(len(t) for _, t in own) <= 700 or len(own) == 1:
            return {k: (depth, prefix, 0) for k, _ in own}
        sides = [[x for x in own if bits[x[0]] >> (59 - depth) & 1 == side] for side in (0, 1)]
        return {k: v for side in (0, 1) for k, v in split(sides[side], depth + 1, 2 * prefix + side).items()}

    assert out == split(rows, 0, 0)


def test_written_shards_hold_every_row_once(spark, tmp_path):
    rows = [(1, "x" * 300, k, "a") for k in range(20)] + [(None, None, 1, None), (2, "y" * 5000, 2, "b"), (3, "", 3, "c")] + [(k, "w" * 90, k, "d") for k in range(10, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bytes long, depth string")
    write_shards(docs, str(tmp_path / "s"), limit=1000)
    back = spark.read.parquet(str(tmp_path / "s"))
    order = lambda x: sorted(map(str, x))
    assert order(tuple(r) for r in back.select(*docs.columns).collect()) == order(rows)
    held = {}
    for r in back.collect():
        held.setdefault(r.shard, []).append(len(r.text or ""))
    assert all(sum(b) <= 1000 or len(b) == 1 for b in held.values())
    with pytest.raises(ValueError):
        write_shards(docs.withColumnRenamed("depth", "shard"), str(tmp_path / "t"))


def test_classifier_on_held_out_rows(spark, data):
    docs, labels = (spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    seen = labels.filter(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(4)) > 0)
    rest = labels.join(seen, "doc_id", "left_anti").select("doc_id", F.col("quality").alias("q"), F.col("toxic").alias("t"))
    rows = classify(docs, seen).join(rest, "doc_id").select("_keep", "q", "t").collect()
    clean, junk = [r for r in rows if r.q == 1 and r.t == 0], [r for r in rows if r.q == 0]
    assert np.mean([r["_keep"] for r in clean]) > 0.97
    assert np.mean([not r["_keep"] for r in junk]) > 0.9


def test_classifier_finds_toxic_rows_of_each_language(spark, data):
    docs, labels = (spark.read.parquet(f"{data.replace('sf0.001', 'sf0.1')}/{t}.parquet") for t in ("documents", "labels"))
    seen = labels.filter(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(4)) > 0)
    rest = labels.join(seen, "doc_id", "left_anti").select("doc_id", F.col("quality").alias("q"), F.col("toxic").alias("t"))
    rows = classify(docs, seen).join(rest, "doc_id").select("lang", "_keep", "q", "t").collect()
    for lang, least in (("en", 0.95), ("de", 0.85), ("fr", 0.7), ("es", 0.6)):
        assert np.mean([not r["_keep"] for r in rows if r.t == 1 and r.lang == lang]) > least, lang
    assert np.mean([r["_keep"] for r in rows if r.q == 1 and r.t == 0]) > 0.98


def test_posterior_against_plain_sums(spark):
    from quillmesh.llm.quality import posterior, site_priors

    rng = random.Random(12)
    rows = [(f"h{rng.randrange(4)}", rng.choice(["en", "de", None]), min(0.99, max(0.01, rng.gauss(0.6 + 0.1 * k % 0.3, 0.2)))) for k in range(400)]
    found = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, host string, path string, p double")
    got = {r.k: (r.site_prior, r.quality) for r in posterior(found, site_priors(found)).collect()}
    hosts, paths = {}, {}
    for h, q, p in rows:
        hosts.setdefault(h, []).append(p)
        paths.setdefault((h, q), []).append(p)
    n, total, squares = len(rows), sum(p for *_, p in rows), sum(p * p for *_, p in rows)
    mean = total / n
    between = {name: sum(len(g) * np.mean(g) ** 2 for g in groups.values()) for name, groups in (("h", hosts), ("p", paths))}

    def precision(groups, b, centre):
        inside = (squares - b) / (n - groups)
        spread = ((b - centre) / (groups - 1) - inside) / (n / groups)
        return float(np.clip(mean * (1 - mean) / spread - 1, 10, 1e6)) if spread > 1e-12 else 1e6

    k_host, k_path = precision(len(hosts), between["h"], n * mean**2), precision(len(paths), between["p"], between["h"])
    logit = lambda x: np.log(x / (1 - x))
    for k, (h, q, p) in enumerate(rows):
        host = (k_host * mean + sum(hosts[h]) - p) / (k_host + len(hosts[h]) - 1)
        path = (k_path * host + sum(paths[h, q]) - p) / (k_path + len(paths[h, q]) - 1)
        assert got[k] == pytest.approx((path, 1 / (1 + np.exp(-(logit(p) - logit(mean) + logit(path))))), rel=1e-6)


def test_classifier_edges(spark):
    ddl = "doc_id long, text string, source string, lang string, quality int"
    docs = spark.createDataFrame([(1, None, None, None, 1), (2, "", "a", "en", 2), (3, "some text", "a", "en", 3), (3, "some text", "a", "en", 3)], ddl)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = classify(docs, none).collect()
    assert len(rows) == 4 and all(r["_keep"] for r in rows)
    odd = spark.createDataFrame([(3, 1, None), (None, 0, 0), (2, 0, 0), (3, 1, 0)], none.schema)
    assert classify(docs, odd).count() == 4
    assert classify(docs.limit(0), none).count() == 0


def test_pipeline_keeps_its_promises(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "line dedup", "simhash near-dedup", "secret scans", "packing"]
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in at.select("doc_id").collect()}
        at = spark.createDataFrame(stage(spark, at, data).collect(), docs.schema)
        assert {r.doc_id for r in at.collect()} <= before, name
        assert at.schema == docs.schema
    assert all(r.n_chars == len(r.text) for r in at.collect())
    pieces = corpus_pipeline.run(spark, data)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in at.collect()}


def shingles(text, k=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def alike(x, y):
    return x == y or 5 * len(x & y) >= 4 * len(x | y) > 0


def edited(rng, words, edits):
    out = list(words)
    for k in rng.sample(range(len(out)), edits):
        out[k] = f"n{rng.getrandbits(40)}"
    return " ".join(out)


def copies(seed=3):
    """Texts and copies of them with similarities from about 0.6 to 1, a passage that many share, and short texts."""
    rng = random.Random(seed)
    texts = [None, "", " \n", "one", "one two", "One Two", "a b c d e", "a b c d e f"]
    passage = [f"p{k}" for k in range(60)]
    for size in (30, 100, 300):
        for _ in range(8):
            base = [f"w{rng.randint(0, 5000)}" for _ in range(size)]
            texts += [edited(rng, base, rng.randint(0, max(2, size // 25))) for _ in range(5)]
    texts += [" ".join([f"w{rng.randint(0, 5000)}" for _ in range(rng.choice([0, 5, 20, 90]))] + passage) for _ in range(40)]
    texts += [edited(rng, base, rng.randint(1, 14)) for base in [base] for _ in range(40)]
    return texts


def groups_by_force(texts):
    sets = [shingles(t) for t in texts]
    return roots(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if alike(sets[i], sets[j])])


@pytest.mark.parametrize("together", [2000, 3])
def test_similar_groups_against_all_pairs(spark, monkeypatch, together):
    monkeypatch.setattr(similar, "TOGETHER", together)
    texts = copies()
    out = similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want = groups_by_force(texts)
    assert 10 < len(set(want)) < len(texts) - 40
    assert {r.doc_id: r.component_id for r in out} == dict(enumerate(want))
    assert len(out) == len(texts)
    assert similar_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_duplicates_stage_against_all_pairs(spark):
    texts = copies(4)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(groups_by_force(texts)))


def test_near_duplicates_stage_keeps_one_row_of_a_group(spark):
    base = [f"w{k}" for k in range(100)]
    near_copy = " ".join(base[:50] + ["new"] + base[51:])
    rows = [(5, " ".join(base), "a"), (5, " ".join(base), "a"), (5, " ".join(base), "b"), (5, near_copy, "a"), (2, near_copy, "a"), (2, "another text of this id", "a"), (None, "of no id", "a"), (None, "of no id", "b"), (None, " ".join(base), "c"), (None, "also of no id", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(r.text for r in kept) == sorted([near_copy, "another text of this id", "of no id", "also of no id"])
    assert {r.doc_id for r in kept if r.text == near_copy} == {2}
    repeated = corpus_pipeline.near_duplicates(spark, docs.filter("doc_id = 5"), "").collect()
    assert [r.doc_id for r in repeated] == [5]
    same = corpus_pipeline.near_duplicates(spark, docs.filter("doc_id = 5 AND lang = 'a'").limit(2), "").collect()
    assert len(same) == 1
    assert len(corpus_pipeline.near_duplicates(spark, docs.filter("doc_id = 5").limit(2), "").collect()) == 1


def test_pages_of_one_template_lose_no_link(spark):
    """Two of a template's hundred words are changed in each text: most pairs are too different, and all share buckets."""
    r = random.Random(1)
    texts = []
    for k in range(600):
        words = [f"w{i}" for i in range(100)]
        for p in r.sample(range(100), 2):
            words[p] = f"x{k}_{p}"
        texts.append(" ".join(words))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(96)} for t in texts]
    pairs = [(b, a) for a in range(600) for b in range(a) if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))]
    got = {x["doc_id"]: x["component_id"] for x in similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(pairs) > 400 and sum(got[a] == got[b] for a, b in pairs) >= 0.99 * len(pairs)
    want = roots(600, pairs)
    assert sum(got[k] != want[k] for k in range(600)) <= 6


def test_labelled_rows_are_bounded_and_do_not_depend_on_order(spark):
    docs = spark.createDataFrame([(7, f"text {k}") for k in range(5000)] + [(8, None), (9, "nine")], "doc_id long, t string").repartition(4)
    rows = [(7, 1, 0), (7, 0, 1), (8, 1, 0), (9, 1, 1), (9, None, 0), (None, 1, 0), (10, 1, 0)]
    for labels in (rows, rows[::-1]):
        frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1)
        found = sorted(map(tuple, labelled_sample(docs, frame, 10, "doc_id", "t").select("doc_id", "t", "quality", "toxic").collect()))
        assert found == [(7, "text 0", 0, 1), (8, None, 1, 0), (9, "nine", 1, 1)]
    assert labelled_sample(docs, frame, 2, "doc_id", "t").count() <= 2


def template_texts(n, seed=1):
    """Two of a template's hundred words are changed in each text."""
    r = random.Random(seed)
    texts = []
    for k in range(n):
        words = [f"w{i}" for i in range(100)]
        for p in r.sample(range(100), 2):
            words[p] = f"x{k}_{p}"
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("whole", [16_000, 0])
def test_crowded_buckets_lose_no_link(spark, monkeypatch, whole):
    """Sets that share only large buckets are all held against each other, at once or after longer bands; few copies of them are made."""
    monkeypatch.setattr(similar, "WHOLE", whole)
    monkeypatch.setattr(similar, "BLOCK", 150)
    monkeypatch.setattr(similar, "DEEPER", ((8, 1),))
    texts = template_texts(600)
    sets = [{tuple(t.split()[i : i + 5]) for i in range(96)} for t in texts]
    want = roots(600, [(b, a) for a in range(600) for b in range(a) if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))])
    got = {x["doc_id"]: x["component_id"] for x in similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[k] for k in range(600)] == want


def test_shared_counts_against_sets(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(similar, "COLUMNS", 7)
    sets = [np.unique(rng.integers(0, 90, rng.integers(0, 60))).astype(np.uint32) for _ in range(40)]
    sets[3] = np.unique(np.append(rng.integers(1000, 4000, 200), [5, 6])).astype(np.uint32)
    left, right = sets[:25], sets[25:]
    assert similar.shared_counts(left, right).tolist() == [[len(np.intersect1d(x, y)) for y in right] for x in left]
    assert similar.shared_counts(left, left).tolist() == [[len(np.intersect1d(x, y)) for y in left] for x in left]


def test_words_of_labelled_rows_stay_out_of_the_driver(spark, data, monkeypatch):
    """The models see every labelled row, but the driver gets a few numbers of each, however long its text is."""
    from quillmesh.llm.quality import train

    frame, most = type(spark.range(0)), []
    for name in ("collect", "toPandas", "toArrow"):

        def spied(self, *a, _f=getattr(frame, name), _name=name, **b):
            out = _f(self, *a, **b)
            rows = out if _name == "collect" else out.values.tolist() if _name == "toPandas" else [tuple(r.values()) for r in out.to_pylist()]
            most.append(max((sum(len(x) if isinstance(x, (bytes, bytearray, str)) else 8 for x in r) for r in rows), default=0))
            return out

        monkeypatch.setattr(frame, name, spied)
    model = train(*[spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels")])
    assert len(model.lexicon) and len(model.junk[0]) == 32 and len(model.toxic[0]) == 4
    assert max(most) <= 200, most


def test_workers_give_freed_memory_back(monkeypatch):
    """The pool gives back what it has freed once all batches are through, and these come as they are."""
    import types

    import pyarrow as pa

    from quillmesh.llm.common import lean

    done = []
    monkeypatch.setattr(pa, "default_memory_pool", lambda: types.SimpleNamespace(release_unused=lambda: done.append(len(seen))))
    seen = []
    for x in lean(lambda batches: (2 * b for b in batches))(iter([1, 2, 3])):
        seen.append(x)
        assert not done
    assert seen == [2, 4, 6] and done == [3]
