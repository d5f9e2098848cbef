"""Operators 3, 5, 6, 7 and 8, and the pipeline."""

import collections
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factweave.llm import license_scan, mixing, multi_index, nce_lm, resampling
from factweave.llm.queries import oracle_sql

WORD = re.compile("[^\x20\x09-\x0D]+")


def test_mixing_equals_sql(docs):
    got = mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken").toPandas()
    con = duckdb.connect()
    con.register("documents", docs.toPandas()[["doc_id", "text", "source"]])
    want = con.sql(oracle_sql()["op3_entropy_mixing"]).df()
    columns = sorted(got.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert len(a) == docs.count()
    assert (a["taken"] == b["taken"]).all() and (a["size"] == b["size"]).all() and np.allclose(a["target"], b["target"])


def test_mixing_meets_targets(docs):
    rows = mixing.mix(docs).collect()
    taken, target = collections.Counter(), {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert math.isclose(sum(target.values()), 1.5 * sum(r["size"] for r in rows))


def test_newton_solves_the_dual_of_uneven_tilts(spark):
    mass = {"a": [(8, 100.0), (24, 50.0), (90, 400.0)], "b": [(8, 10.0), (70, 30.0)], None: [(16, 10.0)], "c": [(9, 4.0)], "d": [(9, 4.0)]}
    target = {"a": 160.0, "b": 75.0, None: 15.0, "c": 8.0, "d": 0.0}
    rows = [(s, t, w) for s, own in mass.items() for t, w in own]
    got = mixing.entropy_balance(spark.createDataFrame(rows, "source string, tilt long, words double"), spark.createDataFrame(list(target.items()), "source string, target double"), 2.0).collect()
    rate = {(r.source, r.tilt): r.rate / mixing.UNIT for r in got}
    for s, own in mass.items():
        assert math.isclose(sum(w * rate[s, t] for t, w in own), target[s], rel_tol=1e-7, abs_tol=1e-7)
        inner = {math.log(rate[s, t]) / t for t, _ in own if 0 < rate[s, t] < 2 - 1e-6}  # one multiplier for all that are not at the cap
        assert not inner or max(inner) - min(inner) < 1e-8
    assert rate["c", 9] == 2 and rate["d", 9] == 0 and rate["a", 90] < rate["a", 8] < 1 < rate["b", 8] < rate["b", 70]


def test_mixing_tilts_documents_by_size(docs, empty):
    rates = {}
    for r in mixing.mix(docs).collect():
        rates.setdefault(r.source, {}).setdefault(r["size"], set()).add(r.rate)
    assert all(len(x) == 1 for own in rates.values() for x in own.values())
    assert any(len({next(iter(x)) for x in own.values()}) > 3 for own in rates.values())
    assert mixing.mix(empty).count() == 0


def test_classifier_drops_the_telling_documents(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    rows, labels, bad = [], [], set()
    for i in range(1200):
        text = " ".join(rng.choice(words, 60))
        if i % 8 == 0:
            text, _ = text.replace("w1 ", "dreadful "), bad.add(i)
            text += " dreadful"
        rows.append((i, text))
        labels.append((i, int(i % 8 != 0), 0)) if i % 2 == 0 or i % 8 else None
    docs = spark.createDataFrame([*rows, (None, None), (5000, ""), rows[3]], "doc_id long, text string")
    good = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").where("quality = 1")
    out = resampling.resample(docs, good, share=0.5).collect()
    assert len(out) == docs.count()
    assert {r.doc_id for r in out if not r.accepted} == bad
    accepted = [r for r in out if r.accepted]
    chosen = [r for r in accepted if r.selected]
    assert abs(len(chosen) - len(accepted) // 2) <= 1
    assert min(r.key for r in chosen) >= max(r.key for r in accepted if not r.selected)
    assert {r.log_weight for r in out if r.doc_id in (None, 5000)} == {0.0}
    kept = resampling.accepted(docs.withColumn("accepted", F.lit(1)), good)
    assert kept.count() == len(accepted) and "accepted" in kept.columns


def test_importance_weights_equal_brute_force(docs):
    """Every weight from plain counts of n-grams, hashed as the operator hashes them."""
    from factweave.llm import textkernel as K

    rows = [(r.doc_id, r.text) for r in docs.collect()]
    good = {d for d, _ in rows if d is not None and d % 2 == 0}
    spark = docs.sparkSession
    model = resampling.fit(docs, spark.createDataFrame([(d,) for d in sorted(good)], "doc_id long"))
    apart = {r.doc_id for r in spark.createDataFrame([(d,) for d in good], "doc_id long").where(F.pmod(F.xxhash64(F.lit(2), "doc_id"), F.lit(resampling.CALIBRATION)) == 0).collect()}
    word = lambda w: int(K.span_hash(K.prefix_hash(w), np.array([0]), np.array([len(w)]))[0])
    pair = lambda a, b: int(K.mix(np.array([a], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(b))[0])
    grams = []
    for _, t in rows:
        low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())
        h = [word(np.frombuffer(m, np.uint8)) for m in re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\t-\r ]+", low)]
        grams.append(collections.Counter(x >> 20 for x in [*h, *map(pair, h[:-1], h[1:])]))
    ratio = []
    for shift in (0, resampling.BITS):
        bucket = lambda g: (g >> shift) & (resampling.BUCKETS - 1)  # noqa: B023, E731
        count = lambda keep: collections.Counter(bucket(g) for (d, _), c in zip(rows, grams) if keep(d) for g in c)  # noqa: B023, E731
        target = lambda d: d in good and d not in apart
        raw, own, share = count(lambda d: True), count(target), sum(target(d) for d, _ in rows) / len(rows)
        a, tell, out = resampling.SHAPE, resampling.TELLING, {}
        for b, n in raw.items():
            c, e = own[b], n * share
            slab = math.exp(math.lgamma(c + a) - math.lgamma(a) - math.lgamma(c + 1)) * (a / (a + e)) ** a * (e / (a + e)) ** c
            spike = math.exp(-e) * e**c / math.factorial(c)
            out[b] = tell * slab / (tell * slab + (1 - tell) * spike) * math.log((c + a) / (e + a))
        ratio.append((bucket, out))
    want = [sum(n * min((ratio[0][1][g & (resampling.BUCKETS - 1)], ratio[1][1][(g >> resampling.BITS) & (resampling.BUCKETS - 1)]), key=abs) for g, n in c.items()) for c in grams]
    got = resampling.weigh(docs, model).collect()
    assert len(got) == len(rows) and sum(abs(w) > 0.001 for w in want) > 40
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    mine, theirs = sorted(((r.doc_id, r.log_weight) for r in got), key=key), sorted(((d, w) for (d, _), w in zip(rows, want)), key=key)
    assert all(a == b and math.isclose(x, y, abs_tol=2e-4, rel_tol=1e-4) for (a, x), (b, y) in zip(mine, theirs))
    assert all(r.accepted == (r.log_weight >= model.floor) for r in got)


def test_floor_of_good_weights():
    assert resampling.floor_of([]) == (float("-inf"), 0.0)
    assert resampling.floor_of([-4.0, -2.0, 0.0])[0] == pytest.approx(-6.0, abs=1e-5)
    many = [float(i) for i in range(-1000, 0)]
    assert resampling.floor_of(many)[0] == pytest.approx(-996.0, abs=1e-5) and resampling.floor_of(many[::-1])[1] == -500.0
    assert resampling.floor_of([1.0, 1.5, 2.0])[0] == pytest.approx(0.0, abs=1e-5)


def test_classifier_weighs_small_tables(spark, empty):
    """Two hundred documents are enough for weights that tell, and nothing switches off."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choice(words, 50)) + (" foul foul foul" if i % 4 == 0 else "")) for i in range(200)]
    docs, good = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i,) for i in range(200) if i % 4], "doc_id long")
    weights = {r.doc_id: r.log_weight for r in resampling.resample(docs, good).collect()}
    assert max(w for d, w in weights.items() if d % 4 == 0) < min(w for d, w in weights.items() if d % 4)
    assert {r.doc_id for r in resampling.accepted(docs, good).collect()} == {d for d in weights if d % 4}
    assert resampling.resample(empty, good).count() == 0 and resampling.accepted(empty, good).count() == 0
    assert resampling.accepted(docs, good.limit(0)).count() == 200


def test_kth_largest(spark, monkeypatch):
    monkeypatch.setattr(resampling, "FEW", 5)
    monkeypatch.setattr(resampling, "BINS", 4)
    values = [1.0, 2.0, 2.0, 2.0, 3.5, -4.0, 9.0, 9.0, 0.25, 7.5, 7.25, 6.0]
    keys = spark.createDataFrame([(v,) for v in values], "key double")
    assert [resampling.kth_largest(keys, k) for k in range(1, 13)] == sorted(values, reverse=True)
    assert resampling.kth_largest(keys, 13) is None and resampling.kth_largest(keys, 0) is None


def test_language_model_scores(docs, texts):
    rows = nce_lm.score(docs).collect()
    assert len(rows) == docs.count()
    tokens = lambda t: WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")) + [None]
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    counts = collections.Counter(w for r in docs.collect() if not held(r.doc_id) for w in tokens(r.text))
    n, v = sum(counts.values()), len(counts)
    want = {(d, held(d), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for d, t in texts}
    assert {(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows} == want
    assert all(r.score < 0 for r in rows)


def test_language_model_beats_the_base_on_held_out_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{w}" for w in rng.integers(0, 40, 200))) for i in range(400)]
    out = nce_lm.score(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.count("*")).first()
    assert out[2] > 20 and out[0] > out[1] + 10


def test_language_model_is_normalised():
    rng = np.random.default_rng(0)
    theta = nce_lm.start(20, rng.integers(1, 50, 20)) + rng.normal(0, 0.3, 2 * 21 * 32 + 20 * 32 + 20).astype(np.float32)
    one, two, normal = nce_lm.log_probabilities(theta, 20)
    p = np.exp(one[:, None, :] + two[None, :, :] - normal[:, :, None])
    assert np.allclose(p.sum(axis=2), 1)


def test_language_model_does_not_depend_on_the_layout(spark, docs):
    held = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for n in (2, 6):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(sorted(map(tuple, nce_lm.score(docs.repartition(n)).collect()), key=str))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert found[0] == found[1]


def test_language_model_scores_equal_brute_force(docs):
    """Each token's probability from the returned parameters, normalised over every class, one token at a time."""
    from factweave.llm.scratch import Scratch

    *_, model = nce_lm.prepare(docs, Scratch(docs.sparkSession, "t"), top=60)
    words, n = model.words, model.words.classes
    first, second, out, bias = (x.astype(float) for x in nce_lm.tables(model.theta, n))
    split = lambda t: WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    rows = {(r.doc_id, r.text) for r in docs.collect() if r.text is None or len(r.text) < 4000}
    counts = collections.Counter(w for r in docs.collect() if not nce_lm.held_out(r.doc_id) for w in split(r.text))
    hashed = {w: nce_lm.read_words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[:2] for _, t in rows for w in split(t)}
    got = {}
    for r in nce_lm.score(docs, top=60).collect():
        got.setdefault(r.doc_id, []).append(r.score)
    for d, t in rows:
        before, total = [n, n], 0.0
        for w in [*split(t), None]:
            c = int(words.class_of(*hashed[w])[0]) if w else 0
            logits = (first[before[-1]] + second[before[-2]]) @ out.T + bias
            total += (logits[c] - np.log(np.exp(logits).sum())) / np.log(10)
            if c >= n - nce_lm.REST:  # a word has its smoothed share of its class
                k = c - (n - nce_lm.REST)
                total += math.log10((counts[w] + 1) / (words.rest_n[k] + words.rest_v[k] + 1))
            before.append(c)
        assert any(math.isclose(total, x, rel_tol=1e-5, abs_tol=1e-4) for x in got[d])


def test_language_model_without_training_rows(spark, empty):
    assert nce_lm.score(empty).count() == 0
    held = [i for i in range(60) if nce_lm.held_out(i)]
    rows = nce_lm.score(spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows} == {(3, 0, 0, 0.0)}


def vectors(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(4, 64))
    rows = [(i, (centre[i % 4] + rng.normal(size=64) * (0.05 if i % 3 else 1)).tolist()) for i in range(900)]
    rows += [(1000 + i, centre[0].tolist()) for i in range(40)] + [(2000, None), (None, centre[1].tolist()), (2001, []), (2050, [1.0, None, -1.0]), (50, rows[50][1])]
    return spark.createDataFrame([(i, v, "d") for i, v in rows], "vec_id long, embedding array<double>, distance string")


def test_multi_index_is_exact(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "BLOCK_CODES", 200)
    monkeypatch.setattr(multi_index, "BLOCK_QUERIES", 5)
    df = vectors(spark)
    got = {tuple(r) for r in multi_index.nearest(df, F.col("vec_id") % 50 == 0, k=7).collect()}
    codes = {}
    for r in df.collect():
        if r.vec_id is not None and r.embedding:
            codes[r.vec_id] = [x is not None and x > 0 for x in (r.embedding + [None] * 64)[:64]]
    want = set()
    for q in (i for i in codes if i % 50 == 0):
        near = sorted((sum(a != b for a, b in zip(codes[q], codes[i])), i) for i in codes if i != q)[:7]
        want |= {(q, rank, i, d) for rank, (d, i) in enumerate(near, 1)}
    assert got == want


def test_multi_index_takes_every_dimension(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=200 if i % 5 else 130).tolist()) for i in range(150)]
    got = {tuple(r) for r in multi_index.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, k=5).collect()}
    codes = {i: np.array([x > 0 for x in v] + [False] * (200 - len(v))) for i, v in rows}
    want = set()
    for q in (0, 50, 100):
        near = sorted((int((codes[q] != c).sum()), i) for i, c in codes.items() if i != q)[:5]
        want |= {(q, rank, i, d) for rank, (d, i) in enumerate(near, 1)}
    assert got == want


def test_multi_index_of_few_rows(spark):
    df = vectors(spark)
    assert multi_index.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    two = spark.createDataFrame([(0, [1.0]), (1, [-1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in multi_index.nearest(two, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 1)]


def test_license_scan(spark):
    mit, apache = license_scan.TEMPLATES["mit"], license_scan.TEMPLATES["apache-2.0-header"]
    worded = apache.replace("may obtain a copy", "can get one copy")
    rows = [(1, f"some words\n{mit}\nmore"), (2, "x " * 3000 + worded + " y" * 3000), (3, None), (4, ""), (5, "This license plate is not a licence."), (6, f"{mit}\n{license_scan.TEMPLATES['gpl-3.0']}"), (1, f"some words\n{mit}\nmore")]
    found = sorted(map(tuple, license_scan.find_notices(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "license", "exact", "n_missing").collect()))
    assert found == [(1, "mit", True, 0), (1, "mit", True, 0), (2, "apache-2.0-header", False, 3), (6, "gpl-3.0", True, 0), (6, "mit", True, 0)]


def test_license_scan_finds_what_all_windows_confirm(spark, docs, empty):
    """Worded notices among prose, against the wording test at every word of every text, whatever its words."""
    rng = np.random.default_rng(6)
    known, prose = license_scan.Templates(license_scan.TEMPLATES), [w for r in docs.collect() for w in (r.text or "").split()[:200]]
    rows = []
    for i, (name, text) in enumerate(list(license_scan.TEMPLATES.items()) * 4):
        words = text.split()
        for _ in range(i % 4 if len(words) > 15 else i % 2):
            at = int(rng.integers(len(words)))
            words[at : at + 1] = [[], ["anything"], [words[at], "more"]][int(rng.integers(3))]
        filler = lambda: " ".join(rng.choice(prose, int(rng.integers(0, 60))))
        rows.append((i, f"{filler()} {' '.join(words)} {filler()}"))
    rows += [(100 + i, " ".join(rng.choice(prose, 80))) for i in range(20)] + [(200, None), (201, ""), (202, "the work is under this License")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string")
    found = {}
    for r in license_scan.find_notices(frame).collect():
        found.setdefault(r.doc_id, []).append((r.begin, r.end))
    total = hit = 0
    for d, t in rows:
        starts = [m.start() for m in re.finditer(r"\S+", t or "")]
        confirmed = set()
        for name, words in known.words.items():
            for k, at in enumerate(starts):
                stop = starts[min(k + int(1.4 * len(words)) + 2, len(starts) - 1)] if k + 1 < len(starts) else len(t)
                w = known.confirm(name, t[at : stop if stop > at else len(t)])
                if w:
                    confirmed.add((at + w[0], at + w[1]))
        total += len(confirmed)
        hit += sum(any(b < y and x < e for x, y in found.get(d, [])) for b, e in confirmed)
        assert confirmed or d not in found
    assert total > 40 and hit >= 0.95 * total
    assert license_scan.find_notices(empty).count() == 0


def test_license_scan_of_many_notices(spark):
    line = license_scan.TEMPLATES["mit"]
    text = "\n".join([line, "words between them"] * 400)
    out = license_scan.find_notices(spark.createDataFrame([(1, text), (1, text), (None, line)], "doc_id long, text string")).collect()
    assert len(out) == 801 and all(r.license == "mit" and r.exact for r in out)
    assert {text[r.begin : r.end] for r in out if r.doc_id == 1} == {line[:-1]} and len({r.begin for r in out if r.doc_id == 1}) == 400


@pytest.fixture(scope="module")
def tables(spark, docs, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    docs.coalesce(2).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(d, 1, 0) for d in range(0, 100, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    leak = next(r.text for r in docs.where("doc_id = 0").collect())
    spark.createDataFrame([(0, " ".join((leak or "").split()[:30])), (1, None)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def test_pipeline_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables)
        if name != "mix":
            assert out.columns == docs.columns
            before, after = ({tuple(r) for r in df.collect()} for df in (docs, out))
            if name == "lines":  # texts lose lines, nothing else changes but their number of characters
                rest = lambda rows: {(r[0], *r[2:4], *r[5:]) for r in rows}
                assert rest(after) <= rest(before)
            else:
                assert after <= before
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert [c in docs.columns for c in ("doc_id", "size", "source_size", "target", "taken")] == [True] * 5
    assert sorted(map(tuple, corpus_pipeline.run(spark, tables).collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)


def test_pipeline_of_nothing(spark, tables, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
