"""The ten operators against brute force on small fixtures, and their edge cases."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemill.llm import bpe, chat, decontam, groups, license, pii, simhash, spotsigs, substrings, toxicity, words, wrapper

DOCS = "doc_id long, text string, lang string"
WORDS = [a + b + c for a in ("ka", "lo", "mi", "ter", "su") for b in ("ra", "ne", "vo") for c in ("l", "n", "st", "x")]


def prose(rng, n, stop=True):
    return " ".join(rng.choice(["the", "of", "and"]) if stop and rng.random() < 0.35 else rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def edited(rng, text, k):
    w = text.split()
    for _ in range(k):
        w[rng.randrange(len(w))] = rng.choice(WORDS)
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus():
    """Prose, exact and near copies, a shared passage, nulls, empty and very long texts, repeated rows."""
    rng = random.Random(7)
    rows, base = [], [prose(rng, rng.randrange(60, 300)) for _ in range(30)]
    rows += list(enumerate(base))
    rows += [(100 + i, base[i % 5]) for i in range(20)]
    rows += [(200 + i, edited(rng, base[5 + i % 6], 4)) for i in range(24)]
    passage = prose(rng, 70)
    rows += [(300 + i, prose(rng, 80) + " " + passage + " " + prose(rng, 50 + i)) for i in range(8)]
    rows += [(400, None), (401, ""), (402, "one"), (403, prose(rng, 20_000)), (None, base[0]), (404, "."), (0, base[0]), (405, prose(rng, 55) * 3)]
    return [(i, t, "en") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def clash(df):
    """Extra columns with names that the operators use themselves."""
    return df.withColumns({c: F.lit(1) for c in ("id", "fp", "size", "key", "h", "part", "n", "_drop_id.x")})


def brute_classes(rows, near):
    """Sorted (id, class, links) of rows (id, key), by all pairs of keys; a key of None is linked with nothing."""
    copies = Counter(k for _, k in rows if k is not None)
    partners = {k: [u for u in copies if u != k and near(k, u)] for k in copies}
    own = {}
    for i, k in rows:
        own.setdefault(i, set()).update([k] if k is not None else [])
    low = {i: i for i in own}
    holders = {}
    for i, ks in own.items():
        for k in ks:
            holders.setdefault(k, []).append(i)
    while True:
        new = {i: min([low[i], *(low[j] for k in own[i] for u in (k, *partners[k]) for j in holders[u])]) for i in own}
        if new == low:
            break
        low = new
    return sorted((i, low[i], 0 if k is None else copies[k] - 1 + sum(copies[u] for u in partners[k])) for i, k in rows)


def classes(df):
    return sorted((r.doc_id, r.class_id, r.n_links) for r in df.collect())


# 6
def test_simhash_classes_equal_brute_force(docs, corpus, empty):
    ids, texts = zip(*[(i, t) for i, t, _ in corpus if i is not None])
    w = words.words(pa.array(texts, pa.large_string()))
    fp, size = simhash.fingerprint(w.hash, w.row, w.rows)
    rows = [(i, (f, s) if s else None) for i, f, s in zip(ids, fp.tolist(), size.tolist())]
    want = brute_classes(rows, lambda a, b: (a[0] ^ b[0]).bit_count() <= simhash.RADIUS and min(a[1], b[1]) >= simhash.RATIO * max(a[1], b[1]))
    assert any(n for *_, n in want)
    assert classes(simhash.near_classes(clash(docs))) == want
    # finer shards, and shards that are parted, have the same result
    assert classes(simhash.near_classes(docs, agree=2)) == want
    assert classes(simhash.near_classes(docs, agree=1, shard=3)) == want
    assert simhash.near_classes(empty).count() == 0
    assert simhash.agreeing(10**6) == 1 and simhash.agreeing(10**9) > simhash.agreeing(10**8) > 1


def test_vantage_point_tree_equals_brute_force():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fp = np.concatenate([base[rng.integers(0, 40, 600)] ^ (np.uint64(1) << rng.integers(0, 64, 600).astype(np.uint64)) for _ in range(2)])
    got = set()
    simhash.vp_join(fp, np.arange(len(fp)), None, 9, lambda x, y: got.update((min(i, j), max(i, j)) for i, j in zip(x.tolist(), y.tolist())), leaf=16)
    assert got == {(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if int(fp[i] ^ fp[j]).bit_count() <= 9}


def test_forests_and_components_of_a_chain(spark):
    forest, n = groups.Forest(50), np.arange(49)
    forest.add(n[::2], n[::2] + 1, np.full(50, 2))
    forest.add(n[1::2], n[1::2] + 1, np.full(50, 2))
    rows = forest.rows(np.arange(50) * 10)
    assert set(rows["root"].to_pylist()) == {0} and rows["n"].to_pylist() == [2] + [4] * 48 + [2]
    pairs = [(i, i + 1) for i in range(200)] + [(1000, 1001), (5, 5)]
    got = groups.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {(r.id, r.root) for r in got} == {(i, 0) for i in range(201)} | {(1000, 1000), (1001, 1000)}


def test_simhash_dedup_keeps_one_of_each_group(docs, empty, corpus):
    kept = [r.doc_id for r in simhash.dedup(clash(docs)).collect()]
    assert {0, 1, 2, 3, 4} <= set(kept) and not set(range(100, 120)) & set(kept)
    assert kept.count(0) == 1 and {400, 401, None} <= set(kept)
    assert simhash.dedup(empty).count() == 0
    assert simhash.dedup(clash(docs)).columns == clash(docs).columns


# 2
def test_spotsigs_equals_brute_force(docs, corpus, empty):
    ids, texts = zip(*[(i, t) for i, t, _ in corpus if i is not None])
    off, m = spotsigs.signatures(pa.array(texts, pa.large_string()), spotsigs._anchor_hashes())
    sets = [frozenset(m[off[k] : off[k + 1]].tolist()) for k in range(len(ids))]
    rows = [(i, s or (t.strip(".") or None if t else None)) for i, s, t in zip(ids, sets, texts)]
    want = brute_classes(rows, lambda a, b: isinstance(a, frozenset) and isinstance(b, frozenset) and len(a & b) / len(a | b) >= spotsigs.THRESHOLD - 1e-12)
    assert any(n for *_, n in want)
    assert classes(spotsigs.near_classes(clash(docs))) == want
    assert spotsigs.near_classes(empty).count() == 0


def test_spotsigs_links_exact_copies_without_signatures(spark):
    rows = [(5, "Some junk"), (2, "some, JUNK!"), (9, "junk some"), (7, "some junk"), (1, ""), (3, ""), (4, None), (6, "..."), (8, "..."), (None, "some junk"), (2, "some junk"), (10, "some junk here")]
    got = classes(spotsigs.near_classes(spark.createDataFrame([(i, t, "en") for i, t in rows], DOCS)))
    assert got == [(1, 1, 0), (2, 2, 3), (2, 2, 3), (3, 3, 0), (4, 4, 0), (5, 2, 3), (6, 6, 0), (7, 2, 3), (8, 8, 0), (9, 9, 0), (10, 10, 0)]


def test_spotsigs_groups_do_not_grow_with_a_shared_passage(spark):
    """A passage of all documents makes no large group of postings, and what is linked stays that of brute force."""
    rng = random.Random(5)
    passage = prose(rng, 60)
    texts = [passage + " " + prose(rng, 40 + rng.randrange(40)) for _ in range(300)]
    texts += [edited(rng, texts[k], 2) for k in range(100)] + [passage] * 3 + [edited(rng, passage, 1) for _ in range(5)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], DOCS)
    anchors = spotsigs._anchor_hashes()
    last = spotsigs.frequent(docs.select(F.col("doc_id").alias("id"), "text"), anchors, spotsigs.CHAIN)
    column = pa.array(texts, pa.large_string())
    largest = []
    for order in (None, spotsigs.Order(last)):
        off, m = spotsigs.signatures(column, anchors, spotsigs.CHAIN, order)
        largest.append(int(np.unique(spotsigs._postings(off, m, spotsigs.THRESHOLD)["sig"], return_counts=True)[1].max()))
    assert largest[0] > 250 and largest[1] < 40
    sets = [frozenset(m[off[k] : off[k + 1]].tolist()) for k in range(len(texts))]
    want = brute_classes(list(enumerate(sets)), lambda a, b: len(a & b) / len(a | b) >= spotsigs.THRESHOLD - 1e-12)
    assert sum(n for *_, n in want) > 150
    assert classes(spotsigs.near_classes(docs)) == want


def test_spotsigs_order_is_a_permutation():
    top = (1 << 32) - 1
    order = spotsigs.Order(np.array([7, top, 5, top - 3, 1 << 20], np.uint32))
    v = np.array([7, top, 5, top - 3, 1 << 20, top - 1, top - 2, top - 4, 6, (1 << 20) + 7], np.uint32)
    got = order(v).tolist()
    assert got[:5] == [top - 4, top - 3, top - 2, top - 1, top] and got[8:] == [6, (1 << 20) + 7]
    assert sorted(got) == sorted(v.tolist())
    assert spotsigs.Order(np.zeros(0, np.uint32))(v).tolist() == v.tolist()


@pytest.mark.parametrize("large", [2, 1 << 30])
def test_spotsigs_surviving_keeps_every_pair_at_least(monkeypatch, large):
    """Groups compared on their own or together: every true pair stays in the group of its least shared member."""
    monkeypatch.setattr(spotsigs, "LARGE", large)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 32, (12, 40), dtype=np.uint64)
    sets = [np.unique(np.where(rng.random(40) < 0.06, rng.integers(0, 1 << 32, 40, dtype=np.uint64), base[k % 12])).astype(np.uint32) for k in range(150)]
    off, m = np.cumsum([0, *map(len, sets)]), np.concatenate(sets)
    sig, h = spotsigs.surviving(spotsigs._postings(off, m, 0.7), 0.7)
    kept, hashes = set(zip(sig.tolist(), h.tolist())), spotsigs._set_hash(off, m).tolist()
    pairs = 0
    for a, b in itertools.combinations(range(150), 2):
        both = np.intersect1d(sets[a], sets[b])
        if 0.7 <= len(both) / (len(sets[a]) + len(sets[b]) - len(both)) < 1:
            pairs += 1
            assert {(int(both[0]), hashes[a]), (int(both[0]), hashes[b])} <= kept
    assert pairs > 300


# 8
def brute_repeats(rows, least):
    w = words.words(pa.array([t for _, t in rows], pa.large_string()))
    f, h = w.first, (w.hash >> np.uint64(32)).tolist()
    owners = {}
    for k, (i, _) in enumerate(rows):
        for p in range(f[k], f[k + 1] - least + 1):
            owners.setdefault(tuple(h[p : p + least]), set()).add(i)
    want = {}
    for k, (i, _) in enumerate(rows):
        for p in range(f[k], f[k + 1] - least + 1):
            if len(owners[tuple(h[p : p + least])]) > 1:
                want.setdefault(i, set()).update(range(p - f[k], p - f[k] + least))
    return {(i, x) for i, s in want.items() for x in s}


def test_repeats_equal_brute_force(docs, corpus, empty):
    rows = [(i, t) for i, t, _ in corpus if i is not None and t is not None]
    got = substrings.repeats(clash(docs)).collect()
    assert {(r.doc_id, x) for r in got for x in range(r.first, r.past)} == brute_repeats(rows, substrings.LEAST)
    assert not {403, 405} & {r.doc_id for r in got} and {300, 307} <= {r.doc_id for r in got}
    assert len({(r.doc_id, r.first) for r in got}) == len(got)
    assert substrings.repeats(empty).count() == 0


def test_fm_index_counts_occurrences():
    rng = np.random.default_rng(5)
    text = np.concatenate([rng.integers(1, 6, 500), [0]])
    ix = substrings.FMIndex(text, len(text))
    for n in (1, 2, 3, 5):
        for p in range(0, 480, 37):
            pattern = text[p : p + n]
            lo, hi = np.array([0]), np.array([len(text)])
            for c in pattern[::-1]:
                lo, hi = ix.step(np.array([c]), lo, hi)
            assert hi[0] - lo[0] == sum((text[i : i + n] == pattern).all() for i in range(len(text) - n + 1))


# 4
def test_leaks_and_near_leaks_are_found_and_clean_texts_stay(spark, empty):
    rng = random.Random(11)
    items = [prose(rng, 40, stop=False) for _ in range(6)] + ["too short"]
    bench = spark.createDataFrame([*enumerate(items), (None, items[0]), (99, None)], "item_id long, text string")
    typo = items[1][:30] + "z" + items[1][31:]
    rows = [(1, prose(rng, 50) + " " + items[0] + " " + prose(rng, 50)), (2, prose(rng, 30) + " " + typo.upper()), (3, prose(rng, 900)), (4, None), (5, ""), (6, items[2]), (6, items[2])]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], DOCS)
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(clash(docs), bench).collect()} == {(1, 0), (2, 1), (6, 2)}
    assert sorted(r.doc_id for r in decontam.clean(clash(docs), bench).collect()) == [3, 4, 5]
    assert decontam.leaks(empty, bench).count() == 0 and decontam.clean(docs, bench.limit(0)).count() == 7


def least_edits(window, text):
    """The least edits between a window and any part of a text, by the whole table."""
    row, ramp = np.zeros(len(text) + 1, np.int64), np.arange(len(text) + 1)
    for i, c in enumerate(window, 1):
        new = np.concatenate([[i], np.minimum(row[:-1] + (text != c), row[1:] + 1)])
        row = np.minimum.accumulate(new - ramp) + ramp
    return row.min()


def test_leaks_equal_brute_force(spark):
    rng = random.Random(31)
    items = [prose(rng, n, stop=False) for n in (14, 9, 16, 4)]

    def typed(text, k):
        for _ in range(k):
            p, c = rng.randrange(len(text)), rng.choice("abcxyz")
            text = rng.choice([text[:p] + c + text[p:], text[:p] + text[p + 1 :], text[:p] + c + text[p + 1 :]])
        return text

    texts = [prose(rng, 20) + " " + typed(rng.choice(items), rng.randrange(9)) + " " + prose(rng, 15) for _ in range(36)] + [items[0][30:100], items[2].upper().replace(" ", "--"), prose(rng, 60), items[3] * 9]
    flat = lambda t: "".join(c if c.isalnum() else " " for c in t.lower())
    code = lambda t: np.frombuffer(" ".join(flat(t).split()).encode(), np.uint8)
    want = set()
    for k, item in enumerate(items):
        a = code(item)
        n = min(len(a), decontam.WINDOW)
        budget = min(int(n * decontam.EDITS), max(n // decontam.Q - 1, 0))
        for i, text in enumerate(texts):
            t = code(text)
            if any(least_edits(a[w : w + n], t) <= budget for w in range(len(a) - n + 1)):
                want.add((i, k))
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], DOCS)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert 10 < len(want) < 40
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()} == want
    # chunks of the index have the same result
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench, limit=100).collect()} == want


# 1
def test_maximal_segments_equal_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        s = [rng.choice([-1.0, -2.0, -0.5, 1.0, 3.0, 0.0]) for _ in range(rng.randrange(1, 25))]

        def split(a, b):
            best = max(((sum(s[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
            if best[0] <= 0:
                return []
            i, j = best[3:]
            return [*split(a, i), (i, j, best[0]), *split(j, b)]

        assert [round(x, 9) for *_, x in toxicity.segments(s)] == [round(x, 9) for *_, x in split(0, len(s))]


def test_toxicity_on_held_out_labels(spark, empty):
    rng = random.Random(4)
    bad = ["vilescum", "rotgut", "dimwitted", "foulish"]

    def toxic():
        w = prose(rng, 60).split()
        for p in rng.sample(range(20, 40), 6):
            w[p] = rng.choice(bad)
        return " ".join(w)

    rows = [(i, toxic() if i % 5 == 0 else prose(rng, 60), "en") for i in range(600)] + [(900, None, "en"), (901, "", "en"), (None, toxic(), "en")]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)] + [(7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.toxic for r in toxicity.passages(clash(docs), model).collect()}
    held = range(300, 600)
    assert all(got[i] for i in held if i % 5 == 0) and not any(got[i] for i in held if i % 5)
    assert not got[900] and not got[901] and got[None]
    assert toxicity.reject(clash(docs), model).count() == 480 + 2
    assert toxicity.fit(docs, labels.where("toxic = 0")) is None and toxicity.reject(docs, None).count() == len(rows)
    assert toxicity.passages(empty, model).count() == 0 and toxicity.fit(empty, labels) is None


def test_toxicity_learns_from_all_texts_but_copies(spark):
    rng = random.Random(12)
    # every text has the one long word; of each toxic text there is a copy with a lower id and a clean label
    toxic = [f"{prose(rng, 20)} vilescum rotgut vilescum internationally {i}" for i in range(40)]
    rows = [(i, t.upper(), "en") for i, t in enumerate(toxic)] + [(100 + i, t, "en") for i, t in enumerate(toxic)] + [(200 + i, prose(rng, 20) + " internationally", "en") for i in range(200)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(100 <= i < 200)) for i, _, _ in rows], "doc_id long, toxic int")
    seen = toxicity._training(docs, labels, "doc_id", "text", 1000).groupBy("key").agg(F.max("toxic").alias("toxic")).collect()
    assert len(seen) == 240 and sum(r.toxic for r in seen) == 40
    model = toxicity.fit(docs, labels)
    assert {words.hash_word("vilescum"), words.hash_word("rotgut")} <= set(model.keys.tolist())


# 5
def test_notices(spark, empty):
    rng = random.Random(9)
    gpl = "This work is licensed under the GNU General Public License, version 3."
    rows = [(1, prose(rng, 90) + "\n" + gpl), (2, "Released under the MIT License " + gpl), (3, "a license of version 3 in general for the public"), (4, None), (5, ""), (6, prose(rng, 5000)),
            (7, "This work is kindly licensed under the GNU General Public License version 3"), (8, "This work is licensed under the GNU General Public License, version 7"), (1, gpl)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], DOCS)
    got = sorted((r.doc_id, r.license) for r in license.notices(clash(docs)).collect())
    assert got == [(1, "GPL-3.0"), (1, "GPL-3.0"), (2, "GPL-3.0"), (2, "MIT"), (7, "GPL-3.0")]
    assert license.notices(empty).count() == 0


def test_published_notices():
    def header(kind, version, program="program"):
        return f"""/*
 * This {program} is free software: you can redistribute it and/or modify
 * it under the terms of the GNU {kind} Public License as published by
 * the Free Software Foundation, either version {version} of the License, or
 * (at your option) any later version.
 */"""

    bsd = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
    1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
    2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
    third = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    cases = [
        (header("General", "3"), ["GPL-3.0"]), (header("General", "2").replace(":", ";").replace(", either", "; either"), ["GPL-2.0"]), (header("Lesser General", "2.1", "library"), ["LGPL-2.1"]),
        (header("Lesser General", "3"), ["LGPL-3.0"]), (header("Affero General", "3"), ["AGPL-3.0"]), (header("General", "7"), []),
        ("you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", ["GPL-2.0"]),
        ("under the Creative Commons Attribution 4.0 International License", ["CC-BY-4.0"]), ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International", ["CC-BY-NC-SA-4.0"]),
        ("// SPDX-License-Identifier: GPL-3.0-or-later", ["GPL-3.0"]), ("# SPDX-License-Identifier: MIT", ["MIT"]), ("# SPDX-License-Identifier: CC-BY-SA-4.0", ["CC-BY-SA-4.0"]),
        (bsd, ["BSD-2-Clause"]), (bsd + "\n" + third, ["BSD-3-Clause"]), (bsd + "\n" + third + "\n" + bsd, ["BSD-2-Clause", "BSD-3-Clause"]),
    ]
    t = license.compiled()
    ix = license.index(t, t.vocabulary, np.zeros(len(t.vocabulary), np.int64))
    got = license.find(t, ix, pa.array([x for x, _ in cases], pa.large_string()))
    assert [sorted(t.names[i] for row, i, *_ in got if row == k) for k in range(len(cases))] == [want for _, want in cases]


def test_notices_equal_brute_force(spark):
    rng = random.Random(10)
    t = license.compiled()
    own = sorted({w for _, text, _ in license.TEMPLATES for w in text.lower().split()})
    texts = [" ".join(rng.choice(own) for _ in range(rng.randrange(5, 60))) + " " + rng.choice(license.TEMPLATES)[1] + " " + " ".join(rng.choice(own) for _ in range(9)) for _ in range(60)]
    want = set()
    for i, text in enumerate(texts):
        h = words.words(pa.array([text], pa.large_string())).hash
        for k in range(len(t.names)):
            for start in range(-license.SLACK, len(h)):
                n, a, z = license._aligned(t.hashes[k], h, start, license.SLACK)
                if n >= math.ceil(license.COVERAGE * len(t.hashes[k])) and all(license._has(h[max(0, a - license.SLACK) : z + license.SLACK], p) for p in t.phrases[k]):
                    want.add((i, t.names[k]))
    docs = spark.createDataFrame([(i, x, "en") for i, x in enumerate(texts)], DOCS)
    assert {(r.doc_id, r.license) for r in license.notices(docs).collect()} == want


# 10
def test_pseudonyms_keep_format_link_and_invert(spark, empty):
    text = "+1 (017) 555-7713, 4111111111111111 4111 1111 1111 1111 2024-02-29 29.02.2024 38.101.105.188 ann.b.77@mail3.example.com GB82WEST12345698765432 123-45-6789"
    invalid = "4111111111111112 2023-02-30 300.1.2.3 version 4.0 GB00WEST12345698765432 000-12-3456"
    rows = [(1, text), (2, "again 4111111111111111 " + "x " * 50_000), (3, invalid), (4, None), (5, ""), (1, text)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], DOCS)
    got = [(r.doc_id, r.text, r.n_values) for r in pii.pseudonyms(clash(docs)).collect()]
    by = {i: t for i, t, _ in got}
    assert by[3] == invalid and by[4] is None and by[5] == ""
    card = by[2].split()[1]
    assert card != "4111111111111111" and card in by[1] and pii.luhn_digit(card[:-1]) == card[-1]
    assert by[1].replace(" ", "").count(card) == 2 and not any(x in by[1] for x in ("4111", "38.101.105.188", "ann.b.77", "555-7713", "2024-02-29"))
    y, m, d = by[1].split()[8].split("-") if "-" in by[1].split()[8] else by[1].split()[7].split("-")
    assert f"{d}.{m}.{y}" in by[1]
    back = pii.rewrite(pii.rewrite(clash(docs)), back=True)
    assert sorted((r.doc_id, r.text or "") for r in back.collect()) == sorted((i, t or "") for i, t in rows) and back.columns == clash(docs).columns
    assert pii.pseudonyms(empty).count() == 0


def test_pseudonyms_of_common_forms():
    of, back = pii.rewriter(b"k"), pii.rewriter(b"k", back=True)
    forms = ["GB29 NWBK 6016 1331 9268 19", "DE89 3704 0044 0532 0130 00", "AT61 1904 3002 3457 3201", "05/03/84", "05.03.84", "13/12/1984", "15 March 1984", "March 15, 1984", "15th of March 1984", "15. März 1984",
             "15 mars 1984", "15 de marzo de 1984", "15 MAR 1984", "+49 30 12345678", "+49 (0)30 12345678", "+33 1 23 45 67 89", "+44 (0)20 7946 0958", "123 45 6789"]
    for x in forms:
        for text in (f"so {x}, and", x, f"{x} THEN 2024"):
            new, n = of(text)
            assert n == 1 and x not in new and len(new.split()) == len(text.split()), (text, new)
            again, n = back(new)
            # "15th" may come back from a day with another ending, never with another number
            assert n == 1 and again == text, (text, new, again)
    new, n = of("1984-03-05T00:00:00Z")
    assert n == 1 and new.endswith("T00:00:00Z") and new[:10] == of("1984-03-05")[0] and back(new)[0] == "1984-03-05T00:00:00Z"
    assert of("15 March 1984")[0].split()[2] == of("1984-03-15")[0][:4]
    for a, b in [("GB29 NWBK 6016 1331 9268 19", "GB29NWBK60161331926819"), ("123 45 6789", "123-45-6789")]:
        assert of(a)[0].replace(" ", "") == of(b)[0].replace("-", "")
    iban = of("DE89 3704 0044 0532 0130 00")[0].replace(" ", "")
    assert pii._mod97(iban[4:] + iban[:4]) == 1
    # what is no IBAN hides no card
    assert of("AB12 4111 1111 1111 1111")[1] == of("DE12 4111 1111 1111 1111 22")[1] == 1
    for x in ("version 1.2.34", "31/02/84", "000 12 3456", "DE88 3704 0044 0532 0130 00", "32 March 1984", "may 1984"):
        assert of(x) == (x, 0)


def test_long_mail_names_and_keys(spark):
    for name in ("a" * 100_000, "Ab9." * 2000 + "x", "q", "7", "a.b-c_1"):
        text = f"to {name}@mail.example.com now"
        new, n = pii.rewriter(b"k")(text)
        # the format stays, the name doesn't
        got = new[3:].split("@")[0]
        assert n == 1 and len(new) == len(text) and [(c.isdigit(), c.isupper(), c.islower()) for c in got] == [(c.isdigit(), c.isupper(), c.islower()) for c in name]
        assert sum(a == b for a, b in zip(got, name) if a.isalnum()) <= max(1, 0.2 * len(name))
        assert pii.rewriter(b"k", back=True)(new) == (text, 1)
    docs = spark.createDataFrame([(1, "4111111111111111", "en")], DOCS)
    with pytest.warns(UserWarning):
        public = pii.pseudonyms(docs).first().text
    try:
        spark.conf.set(pii.KEY_SETTING, "secret")
        assert pii.pseudonyms(docs).first().text == pii.rewriter(b"secret")("4111111111111111")[0] != public
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def brute_pii(text, key):
    """text with pseudonyms, by trying every kind's own pattern at every place."""
    cipher, out, at = pii.Cipher(key), [], 0
    kinds = ("mail", "iban", "phone", "card", "ssn", "date", "ip")
    while at < len(text):
        m = pii.PATTERN.match(text, at)
        kind = next(k for k in kinds if m[k] is not None) if m else None
        new = pii.pseudonym(kind, m[0], cipher) if m else None
        out.append(text[at] if new is None else new)
        at = at + 1 if new is None else m.end()
    return "".join(out)


def test_pseudonyms_equal_brute_force(spark):
    rng = random.Random(21)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        body = digits(15)
        return body + pii.luhn_digit(body)

    def value():
        return rng.choice([card, lambda: digits(16), lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", lambda: f"+{digits(2)} {digits(3)} {digits(3)} {digits(4)}", lambda: f"{rng.randrange(1890, 2110)}-{rng.randrange(14)}-{rng.randrange(33)}",
                           lambda: ".".join(str(rng.randrange(300)) for _ in range(4)), lambda: f"{rng.choice(WORDS)}.{digits(2)}@{rng.choice(WORDS)}.org", lambda: f"{rng.randrange(1, 32)} March 19{digits(2)}", lambda: digits(9)])()

    texts = [" ".join(rng.choice([value(), rng.choice(WORDS), rng.choice(WORDS) + ","]) for _ in range(40)) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.text for r in pii.pseudonyms(docs, key=b"k").collect()}
    assert got == {i: brute_pii(t, b"k") for i, t in enumerate(texts)}
    assert sum(got[i] != t for i, t in enumerate(texts)) > 50


def test_feistel_is_a_permutation():
    got = {tuple(pii.Cipher(b"k").permute_places(np.array(x), np.array([3, 4, 5]), b"t").tolist()) for x in itertools.product(range(3), range(4), range(5))}
    assert len(got) == 60
    c = pii.Cipher(b"k")
    for size in (2, 7, 100, 1000):
        out = [c.permute(x, size, b"t") for x in range(size)]
        assert sorted(out) == list(range(size)) and [c.permute(y, size, b"t", back=True) for y in out] == list(range(size))


# 9
def test_bpe_equals_the_reference_encoder_and_round_trips(spark, empty):
    import tiktoken

    ranks = bpe.load()
    enc = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["Hello  world's\n\n  tokens", "日本語 ñandú 🙂 é", "", None, "a" * 3000, "x" * 255 + " " + "y1" * 400, " \t\n", "don't 123456 <|endoftext|>"]
    docs = spark.createDataFrame([*[(i, t, "en") for i, t in enumerate(texts)], (None, "null id", "en"), (0, texts[0], "en")], DOCS)
    rows = bpe.encode_and_check(clash(docs)).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        t = "null id" if r.doc_id is None else texts[r.doc_id]
        assert (r.ids is None) if t is None else (r.ids == enc.encode_ordinary(t) and r.n_tokens == len(r.ids) and r.round_trip)
    assert bpe.encode_and_check(empty).count() == 0


def test_heap_merges_equal_the_fold():
    ranks = bpe.load()
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pairs = bpe.merges(ranks)
    for w in ("hellohellohello", "aaaaaaaaab", "ñññ", "zqxj"):
        assert bpe.heap_encode(w.encode(), pairs, ranks) == enc.encode_ordinary(w)


# 7
def test_preferences(spark):
    turn = "array<struct<role:string,text:string>>"
    p, a, b = ("user", "hi there"), ("assistant", "good  reply"), ("assistant", "bad")
    rows = [(1, [p, a], [p, b]), (2, [p, a], [p, a]), (3, None, [p]), (4, [("system", None), p, b, p, a], [("system", ""), p, b, p, b]), (5, [a], [b]), (6, [p], [p, a])]
    got = {r.pair_id: r for r in chat.format_pairs(spark.createDataFrame(rows, f"pair_id int, chosen {turn}, rejected {turn}")).collect()}
    assert set(got) == {1, 4, 5}
    assert got[1].prompt == "<|user|>\nhi there\n<|end|>\n" and got[1].chosen == "<|assistant|>\ngood  reply\n<|end|>\n" and got[1].chosen_mask == "0111" and got[1].rejected_mask == "011"
    assert got[4].prompt_turns == 4 and got[5].prompt == ""
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_pairs(chat.contrast(none)).count() == 0
    turns = spark.createDataFrame([(0, 0, "user", "q", 1), (0, 1, "assistant", "a", 1), (1, 0, None, None, 1), (1, 1, "assistant", "b", 1), (2, 0, "user", "alone", 1), (None, 0, "user", "x", 1)], "conv_id long, turn long, role string, text string, other int")
    assert {(r.pair_id, r.chosen.split()[1], r.rejected.split()[1]) for r in chat.format_pairs(chat.contrast(turns)).collect()} == {(0, "a", "b"), (1, "b", "a")}


# 3
def test_wrapper_splits_template_and_content(spark):
    def page(i, words_):
        return f"<html><head><title>{words_}</title><script>x()</script></head><body><ul><li>Home<li>About</ul><p>{words_}<p>more {i}</p><div class=foot>&copy; Shop</div></body></html>"

    rng = random.Random(1)
    rows = [(i, f"https://Shop.example.com/{i}", page(i, prose(rng, 5))) for i in range(9)] + [(20, "http://solo.example/", page(20, "only one")), (21, None, None), (22, "x", ""), (23, "https://shop.example.com/", "<p>broken <b>tags <li>x")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, host int")
    got = {r.page_id: r for r in wrapper.extract(pages).collect()}
    assert len(got) == len(rows)
    for i in range(9):
        assert "Home" not in got[i].content and "Shop" not in got[i].content and f"more {i}" in got[i].content and got[i].n_template == 3 and "x()" not in got[i].content
    assert "Home" in got[20].content and got[21].content == "" and got[22].content == "" and "broken" in got[23].content
    assert wrapper.extract(pages.limit(0)).count() == 0


def test_wrapper_needs_no_single_reference_page(spark):
    rng = random.Random(3)

    def page(lang, login, extra, nav, words_):
        return f'<html lang="{lang}"><body><div class="top">{login}</div>{extra}<ul><li>{nav}</ul><p>{words_}</p></body></html>'

    def other(words_):
        return f'<html lang="en"><body><table><tr><td>Sitemap<td>Imprint</table><section>{words_}</section></body></html>'

    rows = []
    # a block that the page of least id lacks, and a text of which it has a rare variant
    rows += [(i, "http://a.example/", page("en", "Logout" if i == 0 else "Login", "" if i in (0, 1) else "<p class=x>Subscribe now</p>", "Home", f"{prose(rng, 6)} {i}")) for i in range(12)]
    # three languages, and a layout, none with half of the pages
    rows += [(100 + i, "http://b.example/", page(("en", "de", "fr")[i % 3], "Shop", "", ("Home", "Start", "Accueil")[i % 3], f"{prose(rng, 6)} {i}")) for i in range(15)]
    rows += [(200 + i, "http://b.example/", other(f"{prose(rng, 6)} {i}")) for i in range(5)]
    # texts that two pages of a small layout share are content
    rows += [(300 + i, "http://b.example/", f"<main><h6>{'twice' if i else 'once'}</h6></main>") for i in range(3)]
    got = {r.page_id: r for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    for i, _, _ in rows[:32]:
        assert not {"Login", "Subscribe", "Home", "Start", "Accueil", "Shop", "Sitemap", "Imprint"} & set(got[i].content.split()), got[i]
        assert str(i % 100) in got[i].content.split() and len(got[i].content.split()) >= 7
    assert "Logout" in got[0].content and got[301].content == "twice" and got[300].content == "once"


def test_tree_matching_equals_brute_force():
    rng = random.Random(6)

    def tree(n):
        parent = [-1] + [rng.randrange(0, i) for i in range(1, n)]
        return ["#root"] + [rng.choice("ab") for _ in range(n - 1)], parent, [""] * n

    def best(a, b, x, y):
        ca, cb = [i for i, p in enumerate(a[1]) if p == x], [i for i, p in enumerate(b[1]) if p == y]
        top = 0
        for k in range(min(len(ca), len(cb)) + 1):
            for s in itertools.combinations(ca, k):
                for u in itertools.combinations(cb, k):
                    if all(a[0][i] == b[0][j] for i, j in zip(s, u)):
                        top = max(top, sum(best(a, b, i, j) for i, j in zip(s, u)))
        return top + 1

    for _ in range(40):
        a, b = tree(rng.randrange(1, 8)), tree(rng.randrange(1, 8))
        assert len(wrapper.align(a, b)) == best(a, b, 0, 0)
