"""Operators 1, 2, 4, 9 and 10 against brute force on a fixture with every edge case."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from factweave.llm import fuzzy_lines, hyperminhash, sentence_spans, spaced_seeds, suffix_dedup
from factweave.llm.scratch import Scratch

WORD = re.compile("[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def test_suffix_dedup_equals_brute_force(docs, texts):
    seen = {}
    for d, t in texts:
        raw = (t or "").encode()
        for i in range(len(raw) - 49):
            w = raw[i : i + 50]
            seen[w] = min(seen.get(w, d), d)
    want = {}
    for d, t in texts:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 49):
            if seen[raw[i : i + 50]] < d:
                gone[i : i + 50] = True
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(raw) else 0
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        want[d, hashlib.sha256(raw).hexdigest()] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    rows = suffix_dedup.remove_repeats(docs).collect()
    assert len(rows) == docs.count()
    assert {(r.doc_id, *r[1:]) for r in rows} == {(d, *v) for (d, _), v in want.items()}


def test_suffix_sort_orders_suffixes():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, 600).astype(np.uint8)
    from factweave.llm import textkernel as K

    start = rng.permutation(540)
    order = suffix_dedup.sort_suffixes(data, K.prefix_hash(data), start, np.zeros(540, np.int64), 50)
    got = [data[s : s + 50].tobytes() for s in start[order]]
    assert got == sorted(got)


def test_suffix_dedup_deals_out_hot_anchors(docs, monkeypatch):
    want = sorted(map(tuple, suffix_dedup.remove_repeats(docs).collect()))
    monkeypatch.setattr(suffix_dedup, "HOT_SPANS", 0)
    hot = suffix_dedup._repeat_reader(11)
    monkeypatch.setattr(suffix_dedup, "_repeat_reader", lambda parts: hot if parts == 11 else None)
    assert sorted(map(tuple, suffix_dedup.remove_repeats(docs).collect())) == want


def shingles(text):
    w = WORD.findall(lower(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(sets, linked):
    label = {k: k for k in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if label[a] != label[b] and linked(sets[a], sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_near_duplicates_equal_brute_force(docs, texts):
    sets = {(d, t or ""): shingles(t) for d, t in texts}
    label = components(sets, lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= 85 * len(a | b))
    rows = hyperminhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    want = {(d, len(sets[d, t]), label[d, t][0], label[d, t][0] == d) for d, t in sets}
    assert {tuple(r) for r in rows} == want


def test_near_duplicates_join_large_mixed_buckets(spark, monkeypatch):
    base = [f"w{i}" for i in range(150)]
    family = [" ".join(base)]
    for i in range(60):
        words = list(base)
        for j in range(1 + i % 6):
            words[(7 * i + 31 * j) % 150] = f"own{i}x{j}"
        family.append(" ".join(words))
    sets = {(i, t): shingles(t) for i, t in enumerate(family)}
    label = components(sets, lambda a, b: 100 * len(a & b) >= 85 * len(a | b))
    monkeypatch.setattr(hyperminhash, "SMALL_BUCKET", 2)
    rows = hyperminhash.near_duplicates(spark.createDataFrame(list(sets), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in rows} == {d: c for (d, _), (c, _) in label.items()}


def test_registers_estimate_jaccard():
    rng = np.random.default_rng(1)
    from factweave.llm import textkernel as K

    pool = K.mix(rng.integers(0, 2**63, 3000).astype(np.uint64))
    a, b = np.unique(pool[:2000]), np.unique(pool[500:2500])
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    got = hyperminhash.estimate(hyperminhash.registers(a)[None], hyperminhash.registers(b)[None])[0]
    assert abs(got - true) < 0.2


def test_collisions_follow_from_the_sizes():
    rng = np.random.default_rng(5)
    for n, m in ((400, 400), (200, 6000), (40, 40)):
        same = filled = 0
        for _ in range(1500):
            a, b = (hyperminhash.registers(np.unique(rng.integers(0, 2**64, k, dtype=np.uint64))) for k in (n, m))
            both = (a != hyperminhash.EMPTY) & (b != hyperminhash.EMPTY)
            same, filled = same + int((a[both] == b[both]).sum()), filled + int(both.sum())
        want = float(hyperminhash.collision_chance(np.array([n]), np.array([m]))[0])
        assert abs(same / filled - want) < 4 * (want / filled) ** 0.5 + 1e-5


def test_sentence_spans_equal_brute_force(docs, texts):
    order = sorted(texts, key=lambda x: (x[0], x[1] or ""))
    ids = [d for d, _ in order]
    once = [x for x in order if ids.count(x[0]) == 1]  # texts that share an id are told apart, not ordered
    assert len(once) > 60
    spans, first = {}, {}
    for d, t in order:
        found = [(m.group(), m.end(), m.start()) for m in WORD.finditer(t or "")]
        sentences, current = [], []
        for i, (w, end, _) in enumerate(found):
            current.append(lower(w))
            if w[-1] in ".!?" or i + 1 == len(found) or "\n" in t[end : found[i + 1][2]]:
                sentences.append(current)
                current = []
        pairs = {(k, k + n - 1) for n in (2, 3) for k in range(len(sentences) - n + 1) if sum(map(len, sentences[k : k + n])) >= 10}
        spans[d, t] = len(sentences), {p: tuple(w for s in sentences[p[0] : p[1] + 1] for w in s) for p in sorted(pairs)}
        for p, key in spans[d, t][1].items():
            first[key] = min(first.get(key, (d, p)), (d, p))
    rows = {r.doc_id: r for r in sentence_spans.remove_repeated_spans(docs).collect()}
    for d, t in once:
        n, own = spans[d, t]
        gone = {k for p, key in own.items() if first[key] != (d, p) for k in range(p[0], p[1] + 1)}
        assert (rows[d].n_sentences, rows[d].n_removed) == (n, len(gone))
        assert gone or rows[d].kept == (t or "")


def test_repeated_passages_of_sentences_go_from_end_to_end(spark):
    passage = "One two three four five. Six seven eight nine ten! Eleven twelve thirteen."
    rows = [(1, f"Own words of one. {passage} After it."), (2, f"Other start here. {passage.upper()}"), (3, "Yes. No. Yes. No."), (4, "Yes. No. Yes. No."), (5, "Six seven eight nine ten! But not the rest of it at all.")]
    out = {r.doc_id: r for r in sentence_spans.remove_repeated_spans(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept string")).collect()}
    assert {d: r.n_removed for d, r in out.items()} == {1: 0, 2: 3, 3: 0, 4: 0, 5: 0}
    assert out[2].kept == "Other start here. "


def test_lines_keep_one_of_each_group(docs, spark):
    rows = [(1, "First line of eight words that are all kept here.\nshared LINE again\n\n"), (2, " Shared line again\nfirst line of eight words that are all kept HERE. \n\nown"), (3, None), (4, ""), (2, " Shared line again\nfirst line of eight words that are all kept HERE. \n\nown"), (None, "shared line again")]
    out = fuzzy_lines.dedup_lines(spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, _uid string")).collect()
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r.text, r._n_lines, r._n_removed, r["_uid"]) for r in out), key=str)
    assert got == sorted(
        [(-1, "shared line again", 1, 0, "c"), (1, "First line of eight words that are all kept here.\n\n", 4, 1, "c"), (3, None, 0, 0, "c"), (4, "", 1, 0, "c")] + [(2, "\nown", 4, 2, "c")] * 2,
        key=str,
    )


def test_common_runs_are_given_up_for_the_next(spark, monkeypatch):
    """Lines that share a long passage and little else, so that most of their blocks are crowded."""
    rng = np.random.default_rng(11)
    passage = [f"p{i}" for i in range(25)]
    lines = [[*passage, *(f"w{i}x{j}" for j in range(20))] for i in range(60)]
    lines += [[w if rng.random() > 0.1 else f"n{rng.integers(10**6)}" for w in line] for line in lines[:30]]
    label = components(dict(enumerate(lines)), lambda a, b: word_edits(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9))
    docs = spark.createDataFrame([(i, " ".join(line)) for i, line in enumerate(lines)], "doc_id long, text string")
    for small in (32, 2):
        monkeypatch.setattr(fuzzy_lines, "SMALL_BUCKET", small)
        kept = {r.doc_id for r in fuzzy_lines.dedup_lines(docs).collect() if r._n_removed == 0}
        # Pairs can be lost all of whose own runs are touched, so that they share common ones only.
        assert kept >= set(label.values()) and len(kept) <= len(set(label.values())) + 0.1 * 30


def test_no_pair_is_lost_by_common_runs(spark, monkeypatch):
    """Pairs all of whose own runs are touched share runs of a common passage only."""
    lines = []
    for i in range(40):
        own = [f"w{i}x{j}" for j in range(6)]
        # Two of ten words are changed, and no run of three that holds one of the own words stays.
        lines += [["p0", "p1", "p2", "p3", *own], ["p0", "p1", "p2", "p3", *(w if j % 3 else f"n{i}x{j}" for j, w in enumerate(own))]]
    label = components(dict(enumerate(lines)), lambda a, b: word_edits(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9))
    assert len(set(label.values())) == 40
    docs = spark.createDataFrame([(i, " ".join(line)) for i, line in enumerate(lines)], "doc_id long, text string")
    for small in (64, 8, 2):
        monkeypatch.setattr(fuzzy_lines, "SMALL_BUCKET", small)
        assert {r.doc_id for r in fuzzy_lines.dedup_lines(docs).collect() if r._n_removed == 0} == set(label.values())


def test_lines_that_share_a_run_by_chance_make_no_buckets(spark):
    """Each line shares three words with the next; only the last is similar to another, by one word in five changed."""
    lines = [[*(f"long{i}word{j}" for j in range(37)), *(f"shared{i + 1}word{j}" for j in range(3))] for i in range(30)]
    lines = [[*(f"shared{i}word{j}" for j in range(3)), *line[3:]] for i, line in enumerate(lines)]
    lines.append([w if j % 5 else f"changed{j}" for j, w in enumerate(lines[-1])])
    docs = spark.createDataFrame([(i, " ".join(line)) for i, line in enumerate(lines)], "doc_id long, text string")
    scratch = Scratch(spark, "lines")
    hashed = scratch.save(fuzzy_lines.hashed_lines(docs), "hashed")
    assert {len(r["keys"]) for r in hashed.collect()} == {3 * 8 + 1 + fuzzy_lines.MORE}
    names = {r.h: r.doc_id for r in hashed.collect()}
    # One run on either side is shared, and is no sign of a similar line.
    assert {names[r.id] for r in fuzzy_lines.buckets(hashed, scratch).collect()} == {29, 30}


def test_lines_that_share_common_words_make_no_buckets(spark):
    """Eight words in a row are in every line; their runs come last, and no line has need of them for its blocks."""
    passage = [f"passage{j}" for j in range(8)]
    lines = [" ".join([*(f"own{i}word{j}" for j in range(16)), *passage, *(f"own{i}word{j}" for j in range(16, 32))]) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    scratch = Scratch(spark, "lines")
    assert fuzzy_lines.buckets(scratch.save(fuzzy_lines.hashed_lines(docs), "hashed"), scratch).count() == 0


def test_lines_that_share_a_passage_leave_the_crowd(spark):
    """Thirty lines of sixty words have a passage of twelve words in common; ten more are like the first by one word in six changed."""
    passage = [f"passage{j}" for j in range(12)]
    lines = [[*(f"own{i}word{j}" for j in range(24)), *passage, *(f"own{i}word{j}" for j in range(24, 48))] for i in range(30)]
    lines += [[w if j % 6 != 5 or w in passage else f"changed{i}x{j}" for j, w in enumerate(lines[0])] for i in range(10)]
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(lines)], "doc_id long, text string")
    scratch, classes = Scratch(spark, "lines"), [0] * fuzzy_lines.SLOTS
    hashed = scratch.save(fuzzy_lines.hashed_lines(docs, classes=classes), "hashed")
    names = {r.h: r.doc_id for r in hashed.collect()}
    links = fuzzy_lines.Links(docs, hashed, scratch, 0.8)
    held = scratch.save(fuzzy_lines.buckets(hashed, scratch), "held")
    crowded = {names[r.id] for r in held.where(F.col("n") > fuzzy_lines.CROWD).collect()}
    assert crowded > {0, *range(30, 40)}
    assert {names[r.id] for r in links.known(held, classes).collect()} == {0, *range(30, 40)}
    assert {r.doc_id for r in fuzzy_lines.dedup_lines(docs).collect() if r._n_removed} == set(range(30, 40))


def test_long_lines_are_linked_whatever_the_edits_touch(spark):
    """One word in five is changed; where it is the long one, the runs that stay are those of few letters."""
    rng = np.random.default_rng(29)
    lines, pairs = [], []
    for i in range(100):
        short = [[f"{'abcdefghijklm'[j]}{k}{i}" for k in range(4)] for j in range(13)]
        base = [w for j in range(13) for w in [*short[j], f"longword{i}x{j}"]][: 60 + i % 6]
        longer = [w if not w.startswith("longword") else f"otherlong{i}x{j}" for j, w in enumerate(base)]
        plain = [f"w{rng.integers(10**9)}" for _ in range(60 + i % 6)]
        other = [f"n{rng.integers(10**9)}" if j % 5 == 4 else w for j, w in enumerate(plain)]
        for a, b in ((base, longer), (plain, other)):
            assert word_edits(a, b) == len(a) // 5
            pairs.append((len(lines), len(lines) + 1))
            lines += [a, b]
    docs = spark.createDataFrame([(i, " ".join(line)) for i, line in enumerate(lines)], "doc_id long, text string")
    assert {r.doc_id for r in fuzzy_lines.dedup_lines(docs).collect() if r._n_removed} == {b for _, b in pairs}


def test_line_pairs_at_the_similarity_are_recalled(spark):
    """Changed, added and missing words at random places, of lines of every length: nine pairs in ten at least."""
    rng = np.random.default_rng(23)
    lines, pairs = [], []
    for n in [5, 6, 8, 10, 12, 15, 20, 25, 30, 40, 60, 100] * 25:
        base = [f"w{rng.integers(10**9)}" for _ in range(n)]
        other = list(base)
        for _ in range(int(0.2 * n)):
            at, kind = int(rng.integers(len(other))), int(rng.integers(3))
            other[at : at + (kind < 2)] = [] if kind == 1 else [f"n{rng.integers(10**9)}"]
        if word_edits(base, other) <= int(0.2 * max(len(base), len(other)) + 1e-9):
            pairs.append((len(lines), len(lines) + 1))
            lines += [base, other]
    docs = spark.createDataFrame([(i, " ".join(line)) for i, line in enumerate(lines)], "doc_id long, text string")
    gone = {r.doc_id for r in fuzzy_lines.dedup_lines(docs).collect() if r._n_removed}
    assert len(pairs) > 200 and gone <= {b for _, b in pairs}
    assert len(gone) >= 0.9 * len(pairs)


def word_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_lines_of_every_size_are_linked_by_edit_similarity_alone(spark, monkeypatch):
    rng = np.random.default_rng(3)
    lines = []
    for family, n in enumerate([1, 2, 3, 4, 5, 5, 6, 7, 9, 10, 14, 15, 15, 20, 29, 40, 60] * 2):
        vocabulary = [f"{'ab'[k % 2] * (k % 9)}{family}q{k}" for k in range(n)] if family % 3 else ["so", "it", f"f{family}"]
        base = [vocabulary[k] if family % 3 else vocabulary[int(rng.integers(3))] for k in range(n)]
        lines.append(base)
        for copy in range(5):
            words = list(base)
            for _ in range(int(rng.integers(1, n // 4 + 2))):
                at, kind = int(rng.integers(len(words))), rng.integers(3)
                words[at : at + (kind < 2)] = [] if kind == 1 and len(words) > 1 else [f"new{rng.integers(99)}"]
            lines.append(words)
    lines += [list("机器学习模型需要大量的数据"), list("机器学习方法需要大量的数据")]
    text = ["".join(w) if ord(w[0][0]) > 255 else " ".join(w) for w in lines]
    label = components({i: w for i, w in enumerate(lines)}, lambda a, b: word_edits(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9))
    assert label[len(lines) - 1] == len(lines) - 2 and 50 < len(set(label.values())) < len(lines) - 50
    docs = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")
    kept = lambda: {r.doc_id for r in fuzzy_lines.dedup_lines(docs).collect() if r._n_removed == 0}
    assert kept() == set(label.values())
    monkeypatch.setattr(fuzzy_lines, "SMALL_BUCKET", 1)
    assert kept() == set(label.values())


def test_lines_differ_by_punctuation_and_space(spark):
    rows = [(1, "shared LINE, again"), (2, "Shared  line again!"), (3, "-- * --"), (4, "-- * --"), (5, "==="), (6, " \t")]
    out = fuzzy_lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in out if r._n_removed} == {2, 4}


def test_spaced_seeds_tolerate_substitutions(spark, docs):
    item = [f"t{i}" for i in range(20)]
    changed = list(item)
    changed[4], changed[11], changed[15] = "x", "y", "z"
    rows = [(1, "before " + " ".join(item) + " after"), (2, "aa, bb; " + " ".join(changed).upper()), (3, " ".join(item[3:17])), (4, " ".join(item[:8])), (5, None), (6, ""), (7, " ".join(reversed(item)))]
    benchmark = spark.createDataFrame([(10, " ".join(item)), (11, None), (12, ""), (13, "two words"), (14, " ".join(item))], "item_id long, text string")
    found = spaced_seeds.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), benchmark)
    assert {(r.doc_id, r.item_id, r.overlap, r.equal, r.doc_token, r.item_token) for r in found.collect()} == {(d, i, *x) for i in (10, 14) for d, x in ((1, (20, 20, 1, 0)), (2, (20, 17, 2, 0)), (3, (14, 14, 0, 3)))}
    assert spaced_seeds.decontaminate(docs, benchmark).count() == docs.count()


def test_spaced_seeds_find_the_longest_stretch(spark):
    rng = np.random.default_rng(7)
    items, rows = [], []
    for size in (12, 15, 16, 20, 30):
        for k in range(30):
            item = [f"i{size}k{k}t{j}" for j in range(size)]
            changed = [f"x{j}" if rng.random() < 0.15 else w for j, w in enumerate(item)]
            items.append(item)
            rows.append(["before", "it"] + changed + ["after"])
    items.append([f"run{j}" for j in range(15)])  # 11 equal, 1 changed, 3 equal
    rows.append([w if j != 11 else "x" for j, w in enumerate(items[-1])])
    want = set()
    for i, (item, row) in enumerate(zip(items, rows)):
        shift = row.index(next(w for w in row if w in item)) - item.index(next(w for w in row if w in item))
        same = [row[j + shift] == w for j, w in enumerate(item)]
        seeds = (all(same[a + o] for o, c in enumerate(m) if c == "1") for m in spaced_seeds.MASKS for a in range(len(item) - len(m) + 1))
        found = [(e - s, sum(same[s:e]), s + shift, s) for s in range(len(item)) for e in range(s + 1, len(item) + 1) if 5 * sum(same[s:e]) >= 4 * (e - s)]
        if any(seeds) and max(found)[0] >= 12:
            want.add((i, i, *max(found), len(item)))
    frame = lambda texts, key: spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], f"{key} long, text string")
    got = {tuple(r) for r in spaced_seeds.contaminated(frame(rows, "doc_id"), frame(items, "item_id")).collect()}
    assert (len(rows) - 1, len(rows) - 1, 15, 14, 0, 0, 15) in want and len(want) > 50
    assert got == want


def test_spaced_seeds_equal_all_diagonals(spark, monkeypatch):
    """Items of 1 to 30 tokens with changed tokens, against every diagonal of every pair; tables by broadcast and by shuffle."""
    rng = np.random.default_rng(13)
    items = [[f"w{rng.integers(30)}" for _ in range(n)] for n in [*range(1, 31)] * 2] + [[f"w{i}" for i in range(40)]]
    rows = []
    for item in items:
        changed = [f"x{rng.integers(9)}" if rng.random() < 0.18 else w for w in item]
        rows.append([f"w{rng.integers(30)}" for _ in range(rng.integers(4))] + changed + [f"y{rng.integers(30)}" for _ in range(rng.integers(4))])
    items, rows = [*items, items[20], []], [*rows, [], ["w1"] * 50, [*items[3], *items[3]]]
    want = set()
    for d, row in enumerate(rows):
        for i, item in enumerate(items):
            best = ()
            for shift in range(1 - len(item), len(row)):
                low, high = max(0, -shift), min(len(item), len(row) - shift)
                total = np.concatenate([[0], np.cumsum([row[j + shift] == item[j] for j in range(low, high)])])
                for s in range(high - low):
                    for e in range(high - low, s, -1):
                        n = int(total[e] - total[s])
                        if 5 * n >= 4 * (e - s):
                            best = max(best, (e - s, n, low + s + shift, low + s)) if e - s >= min(12, len(item)) else best
                            break
            if best:
                want.add((d, i, *best, len(item)))
    frame = lambda texts, key: spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], f"{key} long, text string")
    got = lambda: {tuple(r) for r in spaced_seeds.contaminated(frame(rows, "doc_id"), frame(items, "item_id")).collect()}
    assert len(want) > 80 and got() == want
    monkeypatch.setattr(spaced_seeds, "BROADCAST_BYTES", 0)
    assert got() == want


def test_seeds_miss_no_placing_of_changed_tokens():
    for size in (*range(5, 12), 12, 13, 14, 15, 16, 20):
        for changed in itertools.combinations(range(size), size // 5):
            same = [i not in changed for i in range(size)]
            assert any(all(same[a + o] for o, c in enumerate(m) if c == "1") for m, _ in spaced_seeds.masks_of(size) for a in range(size - len(m) + 1)), (size, changed)


def test_decontaminate_tells_rows_of_one_id_apart(spark):
    leak = " ".join(f"t{i}" for i in range(14))
    docs = spark.createDataFrame([(1, leak, "a"), (1, "clean words", "b"), (None, leak, "c"), (None, None, "d"), (2, "", "e")], "doc_id long, text string, item_id string")
    benchmark = spark.createDataFrame([(7, leak, 1)], "item_id long, text string, doc_id int")
    assert sorted(r.item_id for r in spaced_seeds.decontaminate(docs, benchmark).collect()) == ["b", "d", "e"]
    none = benchmark.limit(0)
    assert spaced_seeds.decontaminate(docs, none).count() == 5 and spaced_seeds.contaminated(docs.limit(0), benchmark).count() == 0


def test_empty_tables(spark, empty):
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert hyperminhash.near_duplicates(empty).count() == 0
    assert sentence_spans.remove_repeated_spans(empty).count() == 0
    assert fuzzy_lines.dedup_lines(empty).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert spaced_seeds.contaminated(empty, none).count() == 0


def test_components(spark):
    from factweave.llm.components import connected_components
    from factweave.llm.scratch import Scratch

    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(chain, "u long, v long"), Scratch(spark, "test")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}
    assert collections.Counter(got.values())[0] == 40


def test_suffix_dedup_verifies_what_hashes_say(docs, monkeypatch):
    """With spans told apart by one bit of their hash, only bytes that are equal go."""
    want = sorted(map(tuple, suffix_dedup.remove_repeats(docs).collect()))
    text = np.frombuffer(b"x" * 20 + bytes(range(60)) + b"y" + bytes(range(60, 120)), np.uint8)
    other = text.copy()
    other[30] = 0
    begin, size = suffix_dedup._equal_stretches(text, other, 50)
    assert list(zip(begin.tolist(), size.tolist())) == [(31, 110)]
    head = suffix_dedup.pack(*(np.array([v], t) for v, t in zip((7, 0, 9, 0, 141, 5), suffix_dedup._STRETCH_TYPES)))
    raw = np.int64(len(head)).tobytes() + head + suffix_dedup._squeeze(text.tobytes())
    assert suffix_dedup._verified({7: [other]}, [raw], 50) == [(9, 31, 110, 5)]
    assert suffix_dedup._verified({7: [text[::-1]]}, [raw], 50) == [] and suffix_dedup._verified({8: [text]}, [raw], 50) == []
    assert any(r[2] for r in want)


def test_parts_follow_bytes_not_partitions(spark, docs):
    from factweave.llm.packing import parts_for

    held = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        counts = set()
        for n in (2, 96):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            counts.add(parts_for(docs))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert counts == {11}


def test_lines_of_repeated_words_have_unlike_sketches(spark):
    """Every word comes an even number of times, so that by parity alone all such lines look alike."""
    lines = [["a", "b", "c", "d"] * 10, ["e", "f", "g", "h"] * 10, ["e", "f", "g", "h"] * 10 + ["e"]]
    words = spark.createDataFrame(list(enumerate(lines)), "h int, w array<string>").select("h", fuzzy_lines._word_hashes([0] * fuzzy_lines.SLOTS).alias("wh"))
    sketched = words.select("h", F.expr(fuzzy_lines._SKETCH).alias("sim"))
    x, y = sketched.alias("x"), sketched.alias("y")
    near = x.join(y, F.expr("x.h < y.h") & fuzzy_lines._near("x.sim", "y.sim", 0.8)).select("x.h", F.col("y.h").alias("o"))
    assert [tuple(r) for r in near.collect()] == [(1, 2)]


def test_similar_lines_share_as_many_blocks_as_both_need(spark):
    rng = random.Random(5)
    texts = []
    for n in range(6, 160, 3):
        line = [f"w{rng.randrange(60)}" for _ in range(n)]
        other, shorter = list(line), list(line)
        for i in rng.sample(range(n), n // 5):
            other[i] = f"x{rng.randrange(60)}"
        for i in sorted(rng.sample(range(n), n // 5), reverse=True):
            del shorter[i]
        texts += [" ".join(x) for x in (line, other, shorter)]
    hashed = fuzzy_lines.hashed_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    found = {r.doc_id: (set(r["keys"] or ()), r.need) for r in hashed.collect()}
    for i in range(0, len(texts), 3):
        for j in (i + 1, i + 2):
            (a, m), (b, n) = found[i], found[j]
            if len(texts[j].split()) > 5:
                assert len(a & b) >= max(m, n), (texts[i], texts[j])
