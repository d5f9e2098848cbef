"""The pipeline's stages against brute force, each on its own input."""

import re

import pytest

import corpus_pipeline

WORD = re.compile("[^\x20\x09-\x0D]+")
STAGES = dict(corpus_pipeline.STAGES)


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("stages"))
    leak = next(r.text for r in docs.where("doc_id = 18").collect())
    spark.createDataFrame([(0, " ".join((leak or "").split()[:14])), (1, None), (2, "")], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame([(d, 1, 0) for d in range(0, 100, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root


def test_one_of_each_group_of_near_copies_stays(spark, docs, texts, folder):
    def shingles(text):
        w = WORD.findall(lower(text))
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = {(d, t): shingles(t) for d, t in texts}
    label = {k: k for k in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if label[a] != label[b] and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b], key=lambda x: x[0])
                    changed = True
    gone = {d for (d, _), first in label.items() if first[0] != d}
    kept = {(r.doc_id, r.text) for r in STAGES["near_duplicates"](spark, docs, folder).collect()}
    assert gone and kept == {(d, t) for d, t in texts if d not in gone}


def test_documents_with_test_items_go(spark, docs, texts, folder):
    items = [lower(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if r.text]
    token = lambda t: re.findall(rb"[0-9A-Za-z\x80-\xff]+", lower(t).encode())

    def overlaps(text):
        doc = token(text)
        for item in map(token, items):
            for shift in range(1 - len(item), len(doc)):
                low, high = max(0, -shift), min(len(item), len(doc) - shift)
                same = [doc[i + shift] == item[i] for i in range(low, high)]
                for s in range(len(same)):
                    for e in range(s + min(12, len(item)), len(same) + 1):
                        if 5 * sum(same[s:e]) >= 4 * (e - s):
                            return True
        return False

    short = [(d, t) for d, t in texts if t is None or len(t) < 3000]
    some = docs.where("text is null or length(text) < 3000")
    kept = {(r.doc_id, r.text) for r in STAGES["decontaminate"](spark, some, folder).collect()}
    want = {(d, t) for d, t in short if not overlaps(t)}
    assert kept == want and len(want) < len(short)


def test_mix_takes_what_the_operator_takes(spark, docs, folder):
    rows = STAGES["mix"](spark, docs, folder).collect()
    assert len(rows) == docs.count() and all(0 <= r.taken <= 2 * r["size"] for r in rows)


def test_quality_keeps_good_documents_and_all_columns(spark, docs, folder):
    out = STAGES["quality"](spark, docs, folder)
    assert out.columns == docs.columns
    kept, before = out.count(), docs.count()
    assert kept >= 0.9 * before
