"""The operators against brute force, on small tables with nulls, empty texts, ties, repeated rows and clashing column names."""

import math
import os
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trellis.llm import op1_minhash, op2_mix, op3_lines, op4_decontaminate, op5_topk, op6_language, op7_quality, op8_shard, op9_suffix_tree, op10_urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string, nid string, key string, size string, m string"


def words(n, seed, kind="abc"):
    r = random.Random(seed)
    return " ".join("".join(r.choice(kind + "defgh") for _ in range(r.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    out = [(None, "no id", "en", "a"), (900, None, "en", None), (901, "", None, "a"), (902, " \t\n ", "en", "b"), (903, "one two", "en", "b"), (903, "one two", "en", "b"), (904, "One TWO", "en", None), (905, words(3000, 5), "en", "a")]
    for k in range(60):
        base = words(60, k % 25).split()
        if k >= 25:  # near copies at various distances
            for _ in range(k // 20):
                base[r.randrange(len(base))] = "zz"
        out.append((k, " ".join(base) + ("" if k % 3 else "\nl1\nl2\nl3\nl4"), "en" if k % 2 else "xx", "ab"[k % 2]))
    return [(a, b, c, d, len(b or ""), "x", "y", "z", "s", "m") for a, b, c, d in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def tokens(text):
    return (text or "").encode().lower().split()


def shingles(text, k=5):
    w = tokens(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_near_dedup(docs, rows, none):
    got = {(r.doc_id, r.n_shingles): r for r in op1_minhash.near_duplicates(docs).collect()}
    own = [(r[0], shingles(r[1])) for r in rows if r[0] is not None]
    root = list(range(len(own)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(own):
        for j, (_, b) in enumerate(own[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    for i, (doc, s) in enumerate(own):
        component = min(own[j][0] for j in range(len(own)) if find(j) == find(i))
        assert got[doc, len(s)].component_id == component and got[doc, len(s)].kept == (doc == component)
    assert op1_minhash.near_duplicates(docs).count() == len(rows)
    assert got[None, 1].component_id is None and got[None, 1].kept
    kept = op1_minhash.representatives(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({min(own[j][0] for j in range(len(own)) if find(j) == find(i)) for i in range(len(own))})
    assert op1_minhash.near_duplicates(none).count() == 0


def test_representatives_keep_unrelated_texts_of_one_id(spark):
    a, b, c = words(40, 1), words(40, 2), words(40, 3)
    data = [(1, a), (1, b), (1, b), (1, ""), (1, f"{a} x"), (2, f"{b} x"), (2, c), (3, c), (None, a)]
    got = Counter((r.doc_id, r.text) for r in op1_minhash.representatives(spark.createDataFrame(data, "doc_id long, text string")).collect())
    first = [x for x in (a, f"{a} x") if (1, x) in got]
    assert len(first) == 1 and got == Counter([(1, first[0]), (1, b), (1, ""), (2, c), (None, a)])


def test_large_bucket_is_compared_in_blocks(spark, monkeypatch):
    """Texts that share half their words with all others fill buckets; near pairs among them must be found."""
    monkeypatch.setattr(op1_minhash, "SPLIT", 8)
    common = words(90, 99)
    data = [(k, f"{common} {words(12, 1000 + k // 2)}{' x' if k % 2 else ''}") for k in range(200)]
    got = {r.doc_id: r.component_id for r in op1_minhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    sets = [shingles(t) for _, t in data]
    root = list(range(200))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(200):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert got == {k: find(k) for k in range(200)}


def test_keys_are_made_in_tasks_of_few_sets(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(op1_minhash, "KEYED", 100)
    spark.range(2_000).selectExpr("id AS nid", "transform(sequence(0, 15), j -> xxhash64(id, j)) AS chunks").coalesce(1).write.parquet(str(tmp_path / "nodes"))
    nodes = spark.read.parquet(str(tmp_path / "nodes"))  # one file, so one task reads all
    sizes = op1_minhash._keyed(nodes).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in sizes) == 64 * 2_000 and max(r["count"] for r in sizes) <= 64 * 200
    want = {tuple(r) for r in nodes.select(F.posexplode(op1_minhash._keys(F.col("chunks"))), "nid").collect()}
    assert want == {tuple(r) for r in op1_minhash._keyed(nodes).collect()}
    assert op1_minhash._keyed(nodes.limit(0)).count() == 0


def test_mix(docs, rows, none):
    got = op2_mix.mix(docs).collect()
    assert len(got) == len(rows) and sorted((r.doc_id or -1, r.taken) for r in got) == sorted((r.doc_id or -1, r.taken) for r in op2_mix.mix(docs.repartition(7)).collect())
    size = Counter()
    for r in rows:
        size[r[3]] += len(tokens(r[1]))
    names = sorted((s for s in size if s is not None)) + [None]
    weight = dict(zip(names, [5, 2, 1]))
    target, free, left = {}, set(names), float(sum(size.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * size[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
        free -= over
    by = Counter()
    source = {r[0]: r[3] for r in rows}
    for r in got:
        assert r.taken <= 3 * r.size and r.source_size == size[source[r.doc_id]] and abs(r.target - target[source[r.doc_id]]) < 1e-6
        by[source[r.doc_id]] += r.taken
    assert all(abs(by[s] - target[s]) <= 1 for s in names)
    assert op2_mix.mix(none).count() == 0


def test_mix_reruns_agree(spark):
    """Rows without doc_id, with a shared one and repeated ones, in several partitionings."""
    data = [(None, words(3 + k, k), "a") for k in range(20)] + [(k % 3, words(5 + k, 100 + k), "a") for k in range(20)] + [(7, "same words here", "b")] * 10 + [(8, words(40, 1), "b"), (9, None, "b"), (9, "", "b"), (10, words(90, 2), None)]
    d = spark.createDataFrame(data, "doc_id long, text string, source string")
    runs = [Counter((r.doc_id, r.size, r.taken) for r in op2_mix.mix(d.repartition(n)).collect()) for n in (1, 3, 7)]
    assert runs[0] == runs[1] == runs[2] and sum(runs[0].values()) == len(data)


def test_mixture_counts_rows_without_or_with_shared_ids(spark):
    """Sources of null and of repeated ids are cut and repeated like others; a cut text keeps its line breaks."""
    import corpus_pipeline

    data = [(None, f" l{k}\n\nm{k}\t\tn  o\np ", "a") for k in range(40)] + [(k // 4, words(30, k), "b") for k in range(40)] + [(100 + k, words(9, k), "c") for k in range(20)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(3)
    target = {("abc"[k]): t for k, t in enumerate(r.target for r in op2_mix.targets(docs.groupBy("source").agg(op2_mix.F.sum(op2_mix.n_words(op2_mix.F.col("text"))).alias("source_size"))).orderBy("source").collect())}
    got, whole = Counter(), {x[1] for x in data}
    made = dict(corpus_pipeline.STAGES)["mix_sources"](spark, docs, "").collect()
    for r in made:
        got[r.source] += len(tokens(r.text))
    assert got == {s: math.floor(t) for s, t in target.items()}
    cut = [r.text for r in made if r.text not in whole]
    assert len(cut) <= 3 and all(any(x.startswith(t) for x in whole) for t in cut)
    assert [r[0] for r in spark.createDataFrame([(" a\n\nb\tc  ",)], "t string").select(*[op2_mix.first_words(op2_mix.F.col("t"), op2_mix.F.lit(2))]).collect()] == [" a\n\nb"]


def test_line_dedup(spark, docs, rows, none):
    data = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "b\nc\nd\nb\nc\nd"), (4, "a\nb"), (5, None), (6, ""), (7, "\n\n\n\n"), (None, "a\nb\nc"), (8, "q\nq\nq\nq\nq"), (9, "m\nn\nm\nn\nm")]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in op3_lines.dedup_lines(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {1: (4, 0, "a\nb\nc\nd"), 2: (5, 3, "x\ny"), 3: (6, 6, ""), 4: (2, 0, "a\nb"), 5: (0, 0, None), 6: (1, 0, ""), 7: (5, 0, "\n\n\n\n"), None: (3, 3, ""), 8: (5, 2, "q\nq\nq"), 9: (5, 2, "m\nn\nm")}
    assert op3_lines.dedup_lines(docs).count() == len(rows) and op3_lines.dedup_lines(none).count() == 0


def weighted(a, b):
    a, b = Counter(a), Counter(b)
    return sum((a & b).values()) / sum((a | b).values())


def bag(w, k=5):
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]


def test_decontaminate(spark, docs, none):
    items = [(k, words(15 + 3 * k, 500 + k)) for k in range(6)] + [(6, "tiny item"), (7, None), (8, ""), (None, "null id item here now"), (9, words(15, 500)), (10, "ab cd ab cd ab cd ab cd ab cd ab")]
    data = []
    for k in range(30):
        item = tokens(items[k % 6][1])
        r = random.Random(k)
        for _ in range(k % 4):
            item[r.randrange(len(item))] = b"other"
        data.append((k, f"{words(40, k)} \n {b' '.join(item).decode().upper()}\t{words(30, 40 + k)}"))
    data += [(100, "a TINY  item there"), (101, None), (102, ""), (103, words(200, 77)), (None, "tiny item"), (104, "tiny item"), (104, "tiny item"), (105, items[2][1][:-3])]
    d = spark.createDataFrame([(*x, 1) for x in data], "doc_id long, text string, m int")
    got = Counter((r.doc_id, r.item_id, round(r.similarity, 9)) for r in op4_decontaminate.matches(d, spark.createDataFrame(items, "item_id long, text string")).collect())
    want = Counter()
    for doc, text in data:
        for item, other in items:
            i, w = tokens(other), tokens(text)
            if item is None or not i or not w:
                continue
            k = min(5, len(i))
            mine, line = bag(i, k), bag(w, k)
            best = max((weighted(mine, line[s : s + len(mine)]) for s in range(max(1, len(line) - len(mine) + 1))), default=0) if line else 0
            if best >= 0.75:
                want[doc, item, round(best, 9)] = 1
    assert {k for k in got} == set(want)
    clean = {r.doc_id for r in op4_decontaminate.clean(d, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert clean == {x for x, _ in data} - {k[0] for k in want}
    assert op4_decontaminate.matches(none, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert op4_decontaminate.matches(d, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_decontaminate_finds_masked_passages(spark):
    """A run of one repeated word in place of part of a passage: few shingles, of large weight, differ."""
    items = [(k, words(200 + 100 * (k % 4), 7000 + k)) for k in range(24)]
    data = []
    for k, text in items:
        w = text.split()
        n = len(w) // 9
        data.append((k, " ".join(w[:40] + ["mask"] * n + w[40 + n :])))
    got = {(r.doc_id, r.item_id, round(r.similarity, 9)) for r in op4_decontaminate.matches(spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(k, k, round(weighted(bag(tokens(text)), bag(tokens(items[k][1]))), 9)) for k, text in data}
    assert all(s >= 0.75 for _, _, s in want) and got == want


def test_decontaminate_verifies_all_texts_of_an_item(spark):
    """Variants under one item_id, as long as each other and all near the passage in fingerprint; only one is similar enough."""
    items, data = [], []
    for k in range(12):
        w = words(60, 8000 + k).split()
        data.append((k, " ".join(w)))
        items.append((k, " ".join([*w[:30], "other", *w[31:]])))
        items += [(k, " ".join([*w[:20], f"v{v}", *w[21:40], f"u{v}", *w[41:]])) for v in range(6)]
    got = {r.doc_id: (r.item_id, round(r.similarity, 9)) for r in op4_decontaminate.matches(spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {k: (k, round(51 / 61, 9)) for k in range(12)}


def test_top_k(spark):
    r = random.Random(3)
    data = [(k, [r.gauss(0, 1 + k % 3) for _ in range(12)], 0) for k in range(400)] + [(400 + k, [0.5] * 12, 0) for k in range(30)]
    data += [data[40]] * 3 + [(40, [r.gauss(0, 2) for _ in range(12)], 0), data[41], (41, [9.0] * 12, 0)]  # repeated rows, and ids that rows share
    bad = [(460, None, 0), (480, [float("nan")] * 12, 0), (500, [1.0, None], 0), (520, [float("inf")] * 12, 0), (None, [1.0] * 12, 0), (540, [1.0, 2.0], 0), (541, [1.0, 3.0], 0)]
    rows = spark.createDataFrame(data + bad, "vec_id long, embedding array<float>, norm int").repartition(5)
    import numpy as np

    whole = [(k, [math.floor(64 * float(np.float32(x))) for x in v]) for k, v, _ in data + [bad[5], bad[6]]]
    want = Counter()
    for i, (q, a) in enumerate(whole):
        if q % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, v)), k) for j, (k, v) in enumerate(whole) if j != i and len(v) == len(a))[:20]
            want.update((q, n + 1, k, -s) for n, (s, k) in enumerate(best))
    assert Counter(tuple(r) for r in op5_topk.top_k(rows, op5_topk.F.col("vec_id") % 20 == 0).collect()) == want
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert op5_topk.top_k(empty, op5_topk.F.lit(True)).count() == 0


def out_of(doc, mod):
    return doc is not None and zlib.crc32(str(doc).encode()) % mod == 2


def test_language(spark, docs, rows, none):
    data = [(k, words(30, k, "aeiou" if k % 2 else "xyzwvq"), "ab"[k % 2]) for k in range(200)] + [(200, "12 !!", "a"), (201, None, "a"), (202, "", None), (203, "Ωμέγα αβγ", None)]
    d = spark.createDataFrame([(a, b, c, "s") for a, b, c in data], "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in op6_language.predictions(d).collect()}
    assert all(got[k].held_out == out_of(k, 4) and 0 <= got[k].score <= 1 for k in got)
    assert sum(got[k].lang_pred == "ab"[k % 2] for k in range(200)) >= 195
    assert [got[k].lang_pred for k in (200, 201, 202)] == ["und"] * 3 and {r.doc_id for r in op6_language.accepted(d).collect()} >= set(range(200))
    assert op6_language.predictions(docs).count() == len(rows) and op6_language.predictions(none).count() == 0


def test_language_against_plain_sums(spark):
    """Prototypes and cosines once more, trigram by trigram."""
    import numpy as np

    data = [(k, words(20 + k % 40, k, "aeiouäß" if k % 3 else "xyzwvq") + (" 42!" if k % 5 else ""), "ab"[k % 3 > 0]) for k in range(60)] + [(60, "ΑΒΓ αβγ", "c"), (60, "ΑΒΓ αβγ", "c"), (61, "same", None), (62, "-- 7", "a"), (None, "no id", "a")]
    got = {r.doc_id: r for r in op6_language.predictions(spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(5)).collect()}

    def bundle(text):
        kept = "".join(c if c.isalpha() else " " for c in text.lower())
        kept = " " + " ".join(kept.split()) + " "
        out = np.zeros(op6_language.DIM)
        for a, b, c in zip(kept, kept[1:], kept[2:]):
            a, b, c = (op6_language._letter(ord(x)).astype(float) for x in (a, b, c))
            out += np.roll(a, 2) * np.roll(b, 1) * c
        return out if kept.strip() else None

    sums = {}
    for doc, text, lang in data:
        v = bundle(text)
        if lang is not None and v is not None and not out_of(doc, 4):
            sums[lang] = sums.get(lang, 0) + v
    for doc, text, _ in data:
        v = bundle(text)
        if v is None:
            assert (got[doc].lang_pred, got[doc].score) == ("und", 0)
            continue
        cos = {x: float(p @ v / np.linalg.norm(p) / np.linalg.norm(v)) for x, p in sums.items()}
        best = max(sorted(cos), key=cos.get)
        assert got[doc].lang_pred == best and abs(got[doc].score - min(1, max(0, cos[best]))) < 1e-9


def test_quality_against_plain_algebra(spark):
    """The fit once more: moments, Fourier map, ridge by least squares, isotonic means by the min-max rule."""
    import numpy as np

    data = [(k, words(10 + k % 60, k) if k % 3 else " ".join(["spam $$$", words(4, k)] * (5 + k % 9))) for k in range(240)] + [(240, None), (241, "")]
    labels = [(k, int(k % 3 == 0) if k % 11 else 1) for k in range(200)] + [(5, 0), (6, None)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r.score for r in op7_quality.scores(spark.createDataFrame(data, "doc_id long, text string").repartition(5), marks).collect()}
    x = np.array([op7_quality.statistics(t) for _, t in data]) / op7_quality.FIX
    by = {}
    for doc, y in labels:
        if y is not None and not out_of(doc, 4):
            by.setdefault(doc, []).append(y)
    y = np.array([np.mean(by[d]) if d in by else np.nan for d, _ in data])
    known = ~np.isnan(y)
    mean, std = x[known].mean(0), x[known].std(0)
    rng = np.random.Generator(np.random.PCG64(11))
    w, b = rng.standard_normal((x.shape[1], op7_quality.FEATURES)) / np.sqrt(x.shape[1]), rng.uniform(0, 2 * np.pi, op7_quality.FEATURES)
    z = np.clip((x - mean) / np.where(std > 1e-9, std, 1), -6, 6)
    phi = np.hstack([np.rint(np.cos(z @ w + b) * op7_quality.FIX) / op7_quality.FIX, np.ones((len(x), 1))])
    check = known & np.array([zlib.crc32(str(d).encode()) % 4 == 3 for d, _ in data])
    fit = known & ~check
    rows = np.vstack([phi[fit], np.sqrt(op7_quality.RIDGE) * np.eye(phi.shape[1])])
    theta = np.linalg.lstsq(rows, np.concatenate([np.rint(y[fit] * op7_quality.FIX) / op7_quality.FIX, np.zeros(phi.shape[1])]), rcond=None)[0]
    raw = phi @ theta
    order = np.argsort(raw[check])
    s, v = raw[check][order], y[check][order]
    level = [max(min(v[i : j + 1].mean() for j in range(k, len(v))) for i in range(k + 1)) for k in range(len(v))]
    pools = {}
    for a, at in zip(s, level):
        pools.setdefault(round(at, 9), []).append(a)
    want = np.clip(np.interp(raw, [np.mean(p) for p in pools.values()], list(pools)), 0, 1)
    assert len(pools) > 2 and len(got) == len(data)
    assert max(abs(got[d] - q) for (d, _), q in zip(data, want)) < 1e-3


def test_language_rejects_unknown_ones(spark):
    """Texts of a language nothing was learned of go, however many letters they share with known ones; known ones stay, short or repeated."""

    def said(vocabulary, seed):
        r = random.Random(seed)
        return " ".join(r.choice(vocabulary) for _ in range(120))

    a, b, c = (words(80, seed, kind).split() for seed, kind in ((1, "aeiou"), (2, "xyzwvq"), (3, "mnprst")))
    known = [(k, said(a if k % 2 else b, k), "ab"[k % 2]) for k in range(300)]
    odd = [(1000 + k, said(c, k), None) for k in range(20)] + [(1100 + k, "".join(chr(0x4E00 + (k * 97 + i * 31) % 9000) for i in range(200)), None) for k in range(5)]
    plain = [(2000, "ae", "a"), (2001, "edi " * 500, "a"), (2002, None, "a"), (2003, "12 3", "a")]
    d = spark.createDataFrame([(a, b, c, "s") for a, b, c in known + odd + plain], "doc_id long, text string, lang string, _lid string").drop("_lid").repartition(4)
    kept = {r.doc_id for r in op6_language.accepted(d).collect()}
    assert kept == {k for k, *_ in known} | {2000, 2001}
    assert op6_language.accepted(d.where("lang is null")).count() == 0
    with_name = d.withColumn("score", d.text).withColumn("kinds", d.lang)
    assert op6_language.accepted(with_name).columns == with_name.columns


def test_language_is_predicted_once_a_text(docs):
    judged = op6_language.identify(docs, *op6_language.learn(docs))
    filtered = judged.where((F.col("_lid.lang_pred") != "und") & (F.col("_lid.score") > 0.1))
    for out in (filtered.select("_lid.score", "_lid.second"), filtered.drop("_lid"), judged.select("_lid.lang_pred", "_lid.score")):
        assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_quality(spark, docs, rows, none):
    data = [(k, words(50, k) if k % 3 else " ".join(["spam $$$"] * 25)) for k in range(300)] + [(300, None), (301, ""), (None, "x")]
    labels = [(k, int(k % 3 > 0), 0) for k in range(250)] + [(260, None, 0), (None, 1, 1), (3, 0, 0)]
    d, marks = spark.createDataFrame([(*x, "h") for x in data], "doc_id long, text string, held_out string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in op7_quality.scores(d, marks).collect()}
    assert len(got) == len(data) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == out_of(r.doc_id, 4) for r in got.values())
    assert sum(got[k].predicted == int(k % 3 > 0) for k in range(250, 300)) >= 47
    assert {r.score for r in op7_quality.scores(d, marks.limit(0)).collect()} == {0.5}
    assert op7_quality.scores(none, marks).count() == 0


def test_shard(docs, rows, none):
    got = op8_shard.shard(docs).collect()
    assert len(got) == len(rows) and all(r.grown_shard in (r.shard, 24) and 0 <= r.shard < 24 and r.law == "key" for r in got)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    text = {r[0]: (r[1] or "").encode() for r in rows}
    assert all(r.size == len(text[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id]) for r in got)
    assert op8_shard.shard(none).count() == 0


def test_shards_are_even_and_stay(spark):
    from pyspark.sql import functions as F

    ids = spark.range(50_000).withColumnRenamed("id", "doc_id")
    counts = [r["count"] for r in ids.groupBy(op8_shard.place(F.col("doc_id"), op8_shard.topology(24)).alias("s")).count().collect()]
    assert len(counts) == 24 and max(counts) < 1.15 * min(counts)
    for n in (24, 25, 40):
        a, b = (op8_shard.place(F.col("doc_id"), op8_shard.topology(k)) for k in (n, n + 1))
        assert ids.where((a != b) & (b != n)).count() == 0
    tree = op8_shard.topology(24)
    heavy = [(r, k, s, w * 3 if k == "k1" else w) for r, k, s, w in tree]
    moved = ids.select(op8_shard.place(F.col("doc_id"), tree).alias("a"), op8_shard.place(F.col("doc_id"), heavy).alias("b")).where("a <> b")
    assert moved.where("b >= 12").count() == 0  # nothing moves into the region whose weight stays


def test_suffix_tree(spark, docs, rows, none):
    got = op9_suffix_tree.score(docs).collect()
    count, texts = Counter(), {}
    for r in rows:
        texts[r[0]] = tokens(r[1]) + [None]
        if not out_of(r[0], 7):
            count.update(texts[r[0]])
    n, v = sum(count.values()), len(count)
    assert len(got) == len(rows)
    for r in got:
        t = texts[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(count[x] > 0 for x in t), n, out_of(r.doc_id, 7))
        assert abs(r.base_score - sum(math.log10((count[x] + 1) / (n + v + 1)) for x in t)) < 1e-6 * max(1, abs(r.base_score))
        assert r.score <= 0
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)
    assert op9_suffix_tree.score(none).count() == 0
    alone = op9_suffix_tree.score(docs.where("doc_id in (1, 2, 3)")).collect()
    assert all(math.isfinite(r.score) for r in alone)


def tree_scores(data, least=2):
    """The suffix tree in dictionaries, contexts grown from retained ones one word at a time: (doc, tokens, score) for every text."""
    texts = [(d, [*tokens(t), None]) for d, t in data]
    count = Counter(w for d, t in texts if not out_of(d, 7) for w in t)
    n, v = sum(count.values()), len(count)
    p = [[(count[w] + 1) / (n + v + 1) for w in t] for _, t in texts]
    live, k = [(x, i) for x, (_, t) in enumerate(texts) for i in range(len(t))], 0
    retained = []
    while live:
        k += 1
        by = {}
        for x, i in live:
            t = texts[x][1]
            if i >= k - 1:
                by.setdefault(tuple(t[i - k : i]) if i >= k else ("^", *t[:i]), []).append((x, i))
        live = []
        for c, places in by.items():
            seen = [(x, i) for x, i in places if not out_of(texts[x][0], 7)]
            listed = {w: m for w, m in Counter(texts[x][1][i] for x, i in seen).items() if m >= least}
            below = {texts[x][1][i]: p[x][i] for x, i in seen}
            stored = sum(listed.values())
            gain = sum(m * math.log(m / len(seen) / below[w]) for w, m in listed.items())
            if not listed or gain <= 0.5 * math.log(max(2, n)) * len(listed):
                continue
            retained.append(c)
            weight = len(seen) - stored + len(listed)
            for x, i in places:
                p[x][i] = (listed.get(texts[x][1][i], 0) + weight * p[x][i]) / (stored + weight)
            live += places
    return [(d, len(t), sum(map(math.log10, q))) for (d, t), q in zip(texts, p)], retained


@pytest.mark.parametrize("block", [5_000, 500_000])
def test_suffix_tree_against_dictionaries(spark, rows, monkeypatch, block):
    """Contexts of any length, in texts whose next word depends on several before; blocks of few and of many texts."""
    monkeypatch.setattr(op9_suffix_tree, "BLOCK_TOKENS", block)
    r = random.Random(4)
    data = [(x[0], x[1]) for x in rows] + [(2000 + k, "f " * r.randint(1, 400)) for k in range(45)]
    for k in range(300):  # each of the last five words tells something of the next
        w = ["a", "b", "a", "b", "a"]
        for _ in range(60):
            pull = sum(c * (1 if x == "a" else -1) for c, x in zip((0.5, 0.5, 0.6, 0.7, 0.8), w[::-1]))
            w.append("a" if r.random() < 1 / (1 + math.exp(-pull)) else "b")
        data.append((3000 + k, " ".join(w)))
    want, retained = tree_scores(data)
    assert max(map(len, retained)) >= 4
    got = op9_suffix_tree.score(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect()
    key = lambda x: (x[0] if x[0] is not None else -1, x[1], x[2])
    for a, b in zip(sorted(((x.doc_id, x.n_tokens, x.score) for x in got), key=key), sorted(want, key=key), strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-5 * max(1, abs(b[2]))


def test_suffix_tree_exchanges_once_a_level(spark, monkeypatch):
    """A level's grams and contexts go in one message and come back in one; texts with separators at their ends, of separators alone, and longer than a block."""
    monkeypatch.setattr(op9_suffix_tree, "BLOCK_TOKENS", 50)
    made, keep = [], op9_suffix_tree.keep
    monkeypatch.setattr(op9_suffix_tree, "keep", lambda df, label, *rest: made.append(label) or keep(df, label, *rest))
    r = random.Random(5)
    odd = [None, "", " ", "\t\n\x0b\x0c\r ", "  a b", "a b \n", "A\u00a0b a\x85b \x1c a\x1cb", "\u00c4 \u00e4 \u0130 K k \u212a", "a b c " * 70]
    data = [(k, odd[k % len(odd)]) for k in range(60)] + [(100 + k, " ".join(r.choice("abc") for _ in range(30))) for k in range(40)]
    want, retained = tree_scores(data)
    got = op9_suffix_tree.score(spark.createDataFrame(data, "doc_id long, text string").repartition(2)).collect()
    levels = max(map(len, retained)) + 1
    assert made[:3] == ["op9-blocks", "op9-words", "op9-texts"] and len(made) % 2 and made[3:] == ["op9-notes", "op9-places"] * ((len(made) - 3) // 2) and len(made) <= 3 + 2 * levels
    for a, b in zip(sorted((x.doc_id, x.n_tokens, x.score) for x in got), sorted(want), strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-5 * max(1, abs(b[2]))


def test_suffix_tree_deals_out_frequent_contexts(spark, monkeypatch):
    """The next words of a context that is half of all places go to many parts, and the scores stay those of the dictionaries."""
    monkeypatch.setattr(op9_suffix_tree, "SPLIT", 20)
    monkeypatch.setattr(op9_suffix_tree, "BLOCK_TOKENS", 1000)
    shares, keep = [], op9_suffix_tree.keep

    def kept(df, label, *rest):
        out = keep(df, label, *rest)
        if label == "op9-notes":
            shares.append([r[1] for r in out.groupBy("part").agg(F.sum("grams")).collect()])
        return out

    monkeypatch.setattr(op9_suffix_tree, "keep", kept)
    r = random.Random(8)
    pairs = [f"x w{k % 200}" for k in range(1800)]
    r.shuffle(pairs)
    data = [(k, " ".join(pairs[k * 36 : k * 36 + 36])) for k in range(50)] + [(100 + k, "x y z " * 20 + r.choice(["a", "b"])) for k in range(30)]
    want, retained = tree_scores(data)
    assert (b"x",) in retained and max(map(len, retained)) >= 2
    got = op9_suffix_tree.score(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect()
    assert max(shares[0]) < 0.3 * sum(shares[0])
    for a, b in zip(sorted((x.doc_id, x.n_tokens, x.score) for x in got), sorted(want), strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-5 * max(1, abs(b[2]))


def test_suffix_tree_is_a_distribution(spark):
    """The probabilities of all known words behind a context, and of one unknown word, add up to 1."""
    r = random.Random(9)
    data = [(7 * k, " ".join(r.choice("abcd") for _ in range(30))) for k in range(40)]
    data = [x for x in data if not out_of(x[0], 7)]
    ids = [k for k in range(100_000) if out_of(k, 7)][:6]
    for i, w in zip(ids, ["a", "b", "c", "d", "zz", ""]):
        data.append((i, f"a b a {w}"))
    got = {r.doc_id: r.score for r in op9_suffix_tree.score(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    # a b a w end: the last but one factor is P(w | ... a b a); without w it is P(end | ... a b a).
    head = {x: y for x, y in zip(ids, [got[i] for i in ids])}
    both, _ = tree_scores(data)
    assert all(abs(head[d] - s) < 1e-5 for d, _, s in both if d in head)


def test_urls(spark):
    urls = ["https://a.Example.NET/en/1?x", "http://example.net/en", "http://net/x", "http://x.net?y", "http://badnet/x", "ftp://q.example.com/de/#t", "http://example.com/de", "http://a.org/fr/x", "http://org/fr/", "no scheme", None, "", "http://", "http:///en/", "http://example.net/en/1", "http://example.net/en/1"]
    pages = spark.createDataFrame([(k, u, "h", "p") for k, u in enumerate(urls)] + [(None, "http://x.net/", "h", "p")], "page_id long, url string, host string, path string")
    rules = spark.createDataFrame(op10_urls.RULES, "host string, path string, verdict string")
    got = {r.page_id: tuple(r)[1:] for r in op10_urls.judge(pages, rules).collect()}
    assert len(got) == len(urls) + 1 and got[None] == ("x.net", "/", "net/", "block")
    for k, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fit = [(len(h + p), h + p, v) for h, p, v in op10_urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, None, "allow"))
        assert got[k] == (host, path, best[1], best[2])
    odd = op10_urls.judge(pages, spark.createDataFrame([("net", "/en", "block"), ("net", "/e", "allow")], "host string, path string, verdict string"))
    rule = {r.page_id: (r.rule, r.verdict) for r in odd.collect()}
    assert rule[0] == rule[1] == rule[14] == ("net/en", "block") and rule[2] == rule[3] == (None, "allow")


def test_urls_of_any_length(spark):
    """A path of 200,000 characters, a host of many labels: few expressions, in seconds."""
    import time

    urls = ["http://x.net/" + "a/" * 100_000, "http://" + "a." * 5_000 + "example.com/de/" + "b/" * 1_000, "http://" + "net." * 5_000, "http://x.org/fr/" + "/" * 50_000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    began = time.time()
    got = {r.page_id: (r.rule, r.verdict) for r in op10_urls.judge(pages, spark.createDataFrame(op10_urls.RULES, "host string, path string, verdict string")).collect()}
    assert got == {0: ("net/", "block"), 1: ("example.com/de/", "block"), 2: (None, "allow"), 3: ("org/fr/", "allow")} and time.time() - began < 60


def test_pipeline(spark, docs, rows, tmp_path):
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, rows[20][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, str(tmp_path))
        assert after.columns == docs.columns
        after.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count() > 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
@pytest.mark.parametrize("name", ["op1_near_dedup", "op2_mix", "op3_line_dedup", "op4_decontaminate", "op5_top_k", "op8_shard", "op10_url_filter"])
def test_sql(spark, name):
    import duckdb

    from trellis.llm.queries import QUERIES, SQL

    c, d = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("documents", "embeddings", "pages", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    want, got = c.execute(SQL[name]).df(), QUERIES[name](spark, d).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    rows = lambda df: sorted(map(str, df[sorted(want.columns)].astype(object).where(df[sorted(want.columns)].notna(), None).values.tolist()))
    assert rows(want) == rows(got)
