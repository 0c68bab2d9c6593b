"""The operators' methods: second paths, bounds and models, each against a direct computation."""

import itertools
import re
import struct
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from recall.llm import (components, exact_dedup, license_scan, line_dedup, packing, quality_classifier, quality_rules, sharding, simhash,
                        rows, spm_codec, toxicity)
from recall.llm.rows import documents, labels, located
from tests.conftest import SF01
from tests.llm import brute
from tests.llm.test_contracts import rows_of


# exact dedup

def test_digest_collisions_are_told_apart_by_text(spark, edge_dir):
    weak = lambda text: F.unhex(F.hex(F.octet_length(text) % 3))
    found = exact_dedup.exact_groups(located(documents(spark, edge_dir)), digest=weak).collect()
    want = Counter((i, k, n) for i, k, n, _ in brute.exact_groups(rows_of(spark, edge_dir)))
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in found) == want


def test_state_over_many_batches(spark, edge_dir):
    found = exact_dedup.exact_groups(located(documents(spark, edge_dir)), files_per_batch=1).collect()
    want = Counter((i, k, n) for i, k, n, _ in brute.exact_groups(rows_of(spark, edge_dir)))
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in found) == want


# sharding

def test_overfull_ranges_are_subdivided(spark):
    rows = [(i, "same text") for i in range(3000)] + [(i, f"text {i}") for i in range(3000, 4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    records = sharding.record_keys(located(docs)).cache()
    ranged, totals = sharding.ranges_of(records, ranges=30)
    share = totals["bytes"].sum() / 30
    assert totals["rows"].sum() == 4000 and totals["bytes"].max() <= sharding.OVERFULL * share
    spans = ranged.groupBy("range").agg(F.min(F.struct("key", "tie")).alias("a"), F.max(F.struct("key", "tie")).alias("b")).orderBy("range").collect()
    assert all(tuple(x["b"]) < tuple(y["a"]) for x, y in zip(spans, spans[1:]))


def test_repeated_rows_are_subdivided(spark):
    rows = [(1, "same text")] * 1500 + [(None, "another")] * 1500 + [(i, f"text {i}") for i in range(3000, 4000)]
    records = sharding.record_keys(located(spark.createDataFrame(rows, "doc_id long, text string"))).cache()
    ranged, totals = sharding.ranges_of(records, ranges=30)
    assert totals["rows"].sum() == 4000 and totals["bytes"].max() <= sharding.OVERFULL * totals["bytes"].sum() / 30
    assert len(sharding.sampled(records, 1.0, 0)) == 4000
    spans = ranged.groupBy("range").agg(F.min(F.struct(*sharding.KEY)).alias("a"), F.max(F.struct(*sharding.KEY)).alias("b")).orderBy("range").collect()
    assert all(tuple(x["b"]) < tuple(y["a"]) for x, y in zip(spans, spans[1:]))


def test_splitter_search_on_equal_keys(spark):
    splitters = np.array([(1, 5), (2, -3), (2, 0), (2, 9), (7, 1)], np.int64)
    keys = [(k, t) for k in (0, 1, 2, 3, 7, 8) for t in (-4, -3, 0, 5, 8, 9, 10)]
    found = sharding.in_ranges(spark.createDataFrame(keys, "key long, tie long"), splitters).collect()
    for r in found:
        assert r["range"] == sum(tuple(s) <= (r["key"], r["tie"]) for s in splitters.tolist())


def test_shards_as_files(spark, edge_dir, tmp_path):
    source = located(documents(spark, edge_dir))
    placed = sharding.shards(source, 5).cache()
    sharding.write_shards(source, placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == source.count()
    assert back.select("shard", "slot", "doc.doc_id").exceptAll(placed.select("shard", "slot", "doc_id")).isEmpty()


# line dedup

def test_perfect_hash_is_minimal_and_rejects_others():
    rng = np.random.default_rng(1)
    place, check = rng.integers(0, 2 ** 63, (2, 5000)).astype("<u8")
    place[:2] = place[0]  # one equal half: the other half tells them apart
    index = line_dedup.PerfectHash(line_dedup.PerfectHash.build(place, check))
    assert sorted(index.slots(place, check).tolist()) == list(range(5000))
    empty = line_dedup.PerfectHash([])
    assert (empty.slots(place, check) == -1).all()


@pytest.mark.parametrize("keys_per_shard,probes_per_task", [(1, 1 << 22), (1000, 1 << 22), (100, 7)])
def test_probes_routed_to_shards(spark, edge_dir, keys_per_shard, probes_per_task):
    found = line_dedup.drop_shared_lines(located(documents(spark, edge_dir)), 10, 1, broadcast_bytes=0, keys_per_shard=keys_per_shard,
                                         probes_per_task=probes_per_task)
    want = Counter(brute.shared_lines(rows_of(spark, edge_dir), 10))
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in found.collect()) == want


def test_the_index_counts_every_distinct_line(spark, edge_dir):
    docs = Counter()
    for _, t in rows_of(spark, edge_dir):
        docs.update({line.strip(brute.SPACES).translate(brute.LOWER) for line in (t or "").split("\n")} - {""})
    index, shards = line_dedup.build_index(line_dedup.line_counts(documents(spark, edge_dir).select("text"), 1), 50)
    arrays = {r["shard"]: (line_dedup.Shard(r.asDict()), r["probes"]) for r in index.collect()}
    assert shards > 5 and sum(n for _, n in arrays.values()) == sum(docs.values())
    place, check = line_dedup.halves([line_dedup.line_hashes(k, 1)[1][0] for k in docs])
    found = np.zeros(len(docs), np.int64)
    for shard, ours in line_dedup.by_shard(place, shards):
        found[ours] = arrays[shard][0].counts(place[ours], check[ours])
    assert found.tolist() == list(docs.values())
    assert not any(a.counts(check, place).any() for a, _ in arrays.values())  # other hashes are in none


def test_probes_over_several_broadcast_shards(spark, edge_dir):
    found = line_dedup.drop_shared_lines(located(documents(spark, edge_dir)), 2, 1, keys_per_shard=3)
    want = Counter(brute.shared_lines(rows_of(spark, edge_dir), 2))
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in found.collect()) == want


# license scan

def test_join_finds_all_blocks(spark):
    rng = np.random.default_rng(3)
    templates = [("a", frozenset("abcdefghij")), ("b", frozenset("cdk")), ("c", frozenset("xyzabk")), ("d", frozenset("m"))]
    letters = sorted(frozenset().union(*(t for _, t in templates)))
    blocks = [(i, sorted(rng.choice(letters, rng.integers(0, 12), replace=False).tolist())) for i in range(400)]
    found = license_scan.matches(spark.createDataFrame(blocks, "at int, block array<string>"), templates, 0.7).collect()
    want = {(i, label, len(t & set(b)) / len(t)) for i, b in blocks for label, t in templates if len(t & set(b)) >= 0.7 * len(t)}
    assert {(r["at"], r["label"], r["containment"]) for r in found} == want and want


def test_notice_without_a_phrase(spark, tmp_path):
    text = "Head.\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files.\nEnd."
    docs = spark.createDataFrame([(1, text), (2, "Nothing here."), (3, "Licensed under CC BY-NC 4.0.")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in license_scan.scan(located(docs)).collect()}
    assert found[1]["labels"] == "mit" and found[1]["base_labels"] == "" and found[1]["score"] == 1.0
    assert found[2]["labels"] == "" and found[3]["labels"] == "cc-by-nc"


def notice_labels(text):
    """Labels and best containment over every window of each template's width, one by one."""
    words, found, score = re.findall(license_scan.WORD, text.lower()), set(), 0.0
    for (label, template), width in zip(license_scan.TEMPLATES, license_scan.widths(license_scan.TEMPLATES, license_scan.THRESHOLD)):
        listed = template.split(" ")
        own, best = set(listed), 0
        must = own & license_scan.DECIDING
        for i in range(len(words)):
            window, head = set(words[i:i + width]), set(words[i:i + len(listed) + 1])
            if words[i] in own and must <= window and not (must and head & (license_scan.VARIANTS - own)):
                best = max(best, len(own & window) / len(own))
        if best >= license_scan.THRESHOLD:
            found.add(label)
            score = max(score, best)
    return ",".join(sorted(found)), score


NOTICES = {
    "licensed under CC BY-SA 4.0": "cc-by-sa",
    "Licensed under CC BY 4.0": "cc-by",
    "This text is licensed under CC BY 3.0, see the file.": "cc-by",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "licensed under CC-BY-NC-SA 4.0": "cc-by-nc-sa",
    "Licensed under CC BY-ND 4.0": "cc-by-nd",
    "released under the BSD license": "bsd",
    "Released under the Apache license": "apache",
    "Released under the MIT license": "mit",
    "Licensed under the Apache License, Version 2.0 (the License)": "apache",
    "This work is licensed under the GNU General Public License version 3.": "gpl",
    "This work is licensed under the GNU General Public License version 2.1.": "gpl",
    "Licensed under the GNU Lesser General Public License, version 2.1": "gpl,lgpl",  # gpl by the phrase, not by a template
    "licensed under the GNU Affero General Public License version 3": "agpl,gpl",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": "cc-by",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl",
    "This is free and unencumbered software released into the public domain.": "unlicense",
    "Copyright 2020. All rights reserved. No part may be reproduced without written permission.": "proprietary",
    "The film was released in May; tickets sell under the license of the venue.": "",
    "The drug was released under the name of a license holder.": "",
    "He was licensed under the old law by 4 of 10 votes.": "",
    "Permission to use the pool is granted to any person without fee.": "",
    "All rights of the tenant are reserved for the owner.": "",
    "a copy of the license may be obtained in compliance with the file at the office": "",
}


def test_licences_are_told_apart(spark):
    docs = spark.createDataFrame(list(enumerate(NOTICES)), "doc_id long, text string")
    found = {r["doc_id"]: r["labels"] for r in license_scan.scan(located(docs)).collect()}
    assert {t: found[i] for i, t in enumerate(NOTICES)} == NOTICES


def test_notices_at_any_wrapping_and_start(spark):
    bsd = dict(license_scan.TEMPLATES)["bsd"].split(" ")
    texts = {}
    for lines in range(2, 13):
        cuts = [round(i * len(bsd) / lines) for i in range(lines + 1)]
        wrapped = [" ".join(bsd[a:b]) for a, b in zip(cuts, cuts[1:])]
        for before in range(8):
            for mark in ("", "# ", "\n * "):
                texts["\n".join([f"head line {i}" for i in range(before)] + [mark + w for w in wrapped] + ["tail"])] = "bsd"
    for before in range(0, 240, 7):  # on one line, at any place against the blocks
        texts["word " * before + " ".join(bsd) + " word" * 100] = "bsd"
    texts[(" " + "word " * 12).join(bsd)] = ""  # scattered over one long line
    rng = np.random.default_rng(5)
    vocabulary = sorted({w for _, t in license_scan.TEMPLATES for w in t.split(" ")})
    for _ in range(40):  # templates with words lost and put in between
        out = rng.choice(vocabulary, rng.integers(0, 90)).tolist()
        for _, t in [license_scan.TEMPLATES[k] for k in rng.integers(0, len(license_scan.TEMPLATES), 3)]:
            for w in t.split(" "):
                out += [w] * bool(rng.random() > 0.15) + ["other"] * int(rng.integers(0, 4))
            out += ["other"] * int(rng.integers(0, 90))
        texts["\n".join(out)] = None
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    found = {r["doc_id"]: r for r in license_scan.scan(located(docs), phrases=[("no such phrase", "none")]).collect()}
    for i, (text, label) in enumerate(texts.items()):
        assert (found[i]["labels"], found[i]["score"]) == notice_labels(text)
        assert label is None or found[i]["labels"] == label


def test_license_scan_is_native(spark, edge_dir):
    plan = license_scan.scan(located(documents(spark, edge_dir)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# SimHash

def dense_prints(n, seed):
    """Fingerprints scattered around two centres and anywhere, with chains of small steps."""
    rng = np.random.default_rng(seed)
    out = []
    for centre, flips, k in ((0x0123456789ABCDEF, 3, n), (0x0123456789ABCDE0 ^ (0x3F << 40), 2, n // 4)):
        for _ in range(k):
            x = centre
            for b in rng.integers(0, 64, flips):
                x ^= 1 << int(b)
            out.append(x)
    x = 77
    for i in range(30):
        for b in rng.choice(64, 4, replace=False):
            x ^= 1 << int(b)
        out.append(x)
    return sorted(set(out + rng.integers(0, 2 ** 63, 100).tolist()))


@pytest.mark.parametrize("chunk_rows", [simhash.CHUNK, 40])
def test_links_span_all_components(spark, chunk_rows):
    prints = dense_prints(400, 5)
    signed = [(int(np.uint64(p).astype(np.int64)),) for p in prints]
    links = simhash.fingerprint_links(spark.createDataFrame(signed, "fp long"), 4, chunk_rows)
    found = [(int(np.int64(a).astype(np.uint64)), int(np.int64(b).astype(np.uint64))) for a, b in links.collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in found)
    place = {p: i for i, p in enumerate(prints)}
    up = list(range(len(prints)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in found:
        x, y = root(place[a]), root(place[b])
        up[max(x, y)] = min(x, y)
    assert [root(i) for i in range(len(prints))] == brute.link_roots(prints, 4)


def test_components_of_a_long_path_and_a_star(spark):
    n = 300
    edges = [(i, i + 1) for i in range(n)] + [(10_000, 10_000 + i) for i in range(1, 400)] + [(5, 5), (20_001, 20_000)]
    found = {r["a"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(1, n + 1)} | {10_000 + i: 10_000 for i in range(1, 400)} | {20_001: 20_000}


def test_few_words_and_long_texts_have_the_plain_fingerprint(monkeypatch):
    for text in (None, "", "a", "a b c", "a b c d", "A  b\tc d\ne", "w" * 70_000, " ".join(f"w{i % 977}" for i in range(70_000))):
        assert simhash.fingerprint(memoryview((text or "").encode()), 4) == brute.fingerprint(text, 4)


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1 << 18])
def test_word_blocks_are_the_words_of_the_text(block):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=200, deadline=None)
    @given(st.text(st.sampled_from("aBü \t\n\x0b\x1c."), max_size=30))
    def check(text):
        found = [w.decode() for words in rows.word_blocks(memoryview(text.encode()), block=block) for w in words]
        assert found == brute.words(text)

    check()


def test_a_very_long_text_takes_little_memory():
    """In a process of its own: a text of 64 MB raises the peak by less than 200 MB."""
    code = """
import resource
import numpy as np
from recall.llm import simhash
words = [b"w%d" % i for i in range(50_000)]
part = b" ".join(words)
text = memoryview(b" ".join([part] * (64_000_000 // len(part))))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
simhash.fingerprint(text, 4)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert int(done.stdout) < 200


def test_bpe_files_with_another_merge_order_are_refused(tmp_path):
    import json

    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    merges = spec["model"]["merges"]
    merges[0], merges[-1] = merges[-1], merges[0]
    other = tmp_path / "other.json"
    other.write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError, match="merge"):
        packing.byte_bpe(str(other))


# models

def test_machine_scores_pairs():
    rng = np.random.default_rng(0)
    m = toxicity.Machine(np.arange(0, 40, 2), 0.3, rng.normal(size=20), rng.normal(size=(20, 4)))
    columns = m.columns(np.array([0, 1, 4, 8, 9, 38]))
    assert columns.tolist() == [0, 2, 4, 19]
    direct = 0.3 + m.weights[columns].sum() + sum(m.factors[i] @ m.factors[j] for i, j in itertools.combinations(columns, 2))
    assert abs(m.logit(columns) - direct) < 1e-9


def test_machine_learns_an_interaction():
    rng = np.random.default_rng(2)
    docs = [np.unique(np.r_[rng.choice(30, 6, replace=False) + 10, np.flatnonzero(rng.random(2) < 0.5)]) for _ in range(1500)]
    y = np.array([float(0 in d and 1 in d) for d in docs])
    m = toxicity.fit(docs, y, np.arange(40))
    right = [(m.logit(m.columns(d)) > 0) == bool(t) for d, t in zip(docs, y)]
    assert np.mean(right) > 0.95


def test_a_pair_without_effects_of_its_own_is_learnt(spark):
    """Toxic with both of two words or with neither: each alone is as common in toxic as in clean texts."""
    rng = np.random.default_rng(6)
    noise = [f"{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(150)]
    rows, marks = [], []
    for i in range(2500):
        a, b = rng.random(2) < 0.5
        words = [w for w in noise if rng.random() < 0.1] + ["xqz"] * int(a) + ["vkj"] * int(b)
        rows.append((i, " ".join(rng.permutation(words))))
        marks.append((i, int(a == b)))
    m = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int"))
    right = [(m.logit(m.columns(toxicity.term_hashes(memoryview(t.encode())))) > 0) == bool(y) for (i, t), (_, y) in zip(rows, marks)
             if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(right) > 400 and np.mean(right) > 0.95


def test_every_frequent_term_has_parameters(spark):
    rows = spark.createDataFrame([([1, 2, 3],), ([1, 2],), ([1, 3],), ([1, 9],), ([1, 2],)], "terms array<int>")
    assert toxicity.frequent_terms(rows, 2).tolist() == [2, 3]  # 1 is in all, 9 in one
    assert toxicity.frequent_terms(rows.limit(0), 2).size == 0


def test_a_repeated_id_is_learnt_from_once(spark):
    """The smallest of its texts, however many rows it has."""
    marks = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    rows = [(i, ("bad thing " if i % 2 else "good day ") + str(i)) for i in range(60)]
    hot = [(i, f"zzz {k} good bad") for i in (1, 2, 3) for k in range(200)]
    one = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"), marks)
    many = toxicity.learn(spark.createDataFrame(hot + rows, "doc_id long, text string"), marks)
    assert one.terms.tolist() == many.terms.tolist() and np.allclose(one.weights, many.weights) and one.bias == many.bias


def test_models_without_contrast():
    assert toxicity.fit([], np.array([]), np.empty(0, int)).logit(np.empty(0, int)) < -10
    assert toxicity.fit([np.array([1, 2])] * 3, np.ones(3), np.arange(3)).logit(np.empty(0, int)) > 10
    chain = quality_rules.fit([], np.array([]))
    assert quality_rules.content_share(chain, "a b c\nd") == 1.0


def test_viterbi_finds_the_best_labelling():
    rng = np.random.default_rng(4)
    chain = quality_rules.Chain(rng.normal(size=len(quality_rules.FEATURES)), rng.normal(size=(2, 2)))
    for n in (1, 2, 7):
        x = rng.integers(0, 2, (n, len(quality_rules.FEATURES))).astype(float)
        own = x @ chain.weights

        def value(labels):
            return sum(own[i] for i in range(n) if labels[i]) + sum(chain.steps[a, b] for a, b in zip(labels, labels[1:]))

        best = max(itertools.product((0, 1), repeat=n), key=value)
        assert chain.boilerplate(x).tolist() == [bool(b) for b in best]


def test_chain_separates_junk_lines():
    good = quality_rules.line_features("This is a plain line of words.\nAnd this is the next one.")[0]
    junk = quality_rules.line_features("*** ### $$$ |||\n%%% &&& ***")[0]
    chain = quality_rules.fit([good, junk] * 20, np.array([0, 1] * 20))
    assert not chain.boilerplate(good).any() and chain.boilerplate(junk).all()


def test_expected_labels_and_steps_against_all_labellings():
    rng = np.random.default_rng(12)
    steps, lengths = rng.normal(size=(2, 2)), [5, 3, 3, 1]
    codes = [np.arange(n, dtype=np.uint16) + 10 * i for i, n in enumerate(lengths)]
    (order, ends, _), = quality_rules.groups_of(codes, np.array([0, 1, 0, 1]))
    score = rng.normal(size=quality_rules.CODES)
    share, found = quality_rules.expected(score[order], steps, ends)
    want, pairs = {}, np.zeros((2, 2))
    for own in codes:
        every = list(itertools.product((0, 1), repeat=len(own)))
        p = np.exp([sum(score[c] for c, b in zip(own, x) if b) + sum(steps[a, b] for a, b in zip(x, x[1:])) for x in every])
        for x, q in zip(every, p / p.sum()):
            for c, b in zip(own.tolist(), x):
                want[c] = want.get(c, 0) + q * b
            for a, b in zip(x, x[1:]):
                pairs[a, b] += q
    assert share == pytest.approx([want[c] for c in order.tolist()]) and found == pytest.approx(pairs)


def test_groups_do_not_change_the_fit(monkeypatch):
    rng = np.random.default_rng(13)
    texts = [rng.integers(0, 2, (n, len(quality_rules.FEATURES))) for n in rng.integers(1, 60, 30)]
    y = np.arange(30) % 2
    whole = quality_rules.fit(texts, y)
    monkeypatch.setattr(quality_rules, "GROUP_LINES", 50)
    assert len(quality_rules.groups_of([quality_rules.line_codes(t) for t in texts], y)) > 5
    parts = quality_rules.fit(texts, y)
    assert parts.weights == pytest.approx(whole.weights, abs=1e-3) and parts.steps == pytest.approx(whole.steps, abs=1e-3)


def test_lines_late_in_a_text_are_learnt(spark):
    def plain(i, n):
        return [f"This is the plain line number {k} of text {i}." for k in range(n)]

    junk = [f"*** ### $$$ ||| {k}" for k in range(40)]
    rows = [(i, "\n".join(plain(i, 64) + junk if i % 2 else plain(i, 104))) for i in range(60)]
    labelled = spark.createDataFrame([(i, 1 - i % 2) for i, _ in rows], "doc_id long, quality int")
    chain = quality_rules.learn(spark.createDataFrame(rows, "doc_id long, text string"), labelled)
    assert chain.boilerplate(quality_rules.line_features("\n".join(junk))[0]).all()
    assert not chain.boilerplate(quality_rules.line_features("\n".join(plain(99, 64)))[0]).any()


def junk_of(text, n):
    """Lines of a text, over and over, of ``n`` characters in all."""
    lines = list(filter(None, text.split("\n"))) or [text]
    out = "\n".join(lines * (1 + n // max(1, sum(map(len, lines)))))
    return out[:n]


def test_a_fitted_chain_finds_the_junk_in_mixed_texts(spark):
    docs, marks = documents(spark, SF01), labels(spark, SF01)
    chain = quality_rules.learn(docs, marks)
    known = [tuple(r) for r in docs.join(marks, "doc_id").select("doc_id", "text", "quality").orderBy("doc_id").collect()]
    held = [(t, q) for i, t, q in known if zlib.crc32(str(i).encode()) % 5 == 0 and t]
    good = [t for t, q in held if q == 1 and t.count("\n") >= 5]
    bad = [t for i, t, q in known if q == 0 and t and len(t) > 200]
    size = lambda t: len("".join(t.split()))
    for share in (0.3, 0.5, 0.7):
        found, true = [], []
        for i, t in enumerate(good):
            junk = junk_of(bad[i % len(bad)], int(len(t) * share / (1 - share)))
            found.append(1 - quality_rules.content_share(chain, t + "\n" + junk))
            true.append(size(junk) / size(t + junk))
        assert len(good) > 20 and abs(np.mean(found) - np.mean(true)) < 0.1
        assert np.mean(np.abs(np.array(found) - true) < 0.1) > 0.9
    judged = quality_rules.judge(located(docs), chain).collect()
    assert any(0 < r["content_share"] < 1 for r in judged)
    assert np.mean([quality_rules.keeps(chain, t, 0.5) == bool(q) for t, q in held]) > 0.95


def test_mixtures_label_their_lines():
    good, bad = [np.arange(10, 10 + n, dtype=np.uint16) for n in (1, 5, 9, 2)], [np.arange(1000, 1004, dtype=np.uint16)]
    texts, marks = quality_rules.mixtures(good + bad, np.array([0, 0, 0, 0, 1]))
    assert len(texts) == 2
    for t, label in zip(texts, marks):
        assert ((t >= 1000) == label.astype(bool)).all() and 0 < label.sum() <= 4 and (label == 0).any()
    assert quality_rules.mixtures(good, np.zeros(4)) == ([], [])
    cut, own = quality_rules.pieces([np.arange(3000)], [np.arange(3000) % 2])
    assert [len(c) for c in cut] == [1024, 1024, 952] and np.concatenate(own).tolist() == (np.arange(3000) % 2).tolist()


def test_repeated_ids_do_not_enlarge_the_sample(spark):
    marks = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    rows = [(i, "A plain line of words.\nAnd one more." if i % 2 else "### *** |||\n$$$ %%%") for i in range(40)]
    many = rows + [(1, "zzz zzz\n" * 50)] * 300
    one, two = (quality_rules.learn(spark.createDataFrame(r, "doc_id long, text string"), marks) for r in (rows, many))
    assert np.allclose(one.weights, two.weights) and np.allclose(one.steps, two.steps)


def test_repeated_windows():
    rng = np.random.default_rng(6)
    for _ in range(50):
        words = [bytes([97 + c]) for c in rng.integers(0, 3, rng.integers(0, 40))]
        assert quality_rules.repeated_words(words) == brute.base_counts(b" ".join(words).decode())[4]


def test_fourier_features_approximate_the_kernel():
    k = len(quality_classifier.STATISTICS)
    rng = np.random.default_rng(8)
    w = rng.normal(0, 1 / (quality_classifier.BANDWIDTH * np.sqrt(k)), (k, 20_000))
    z = quality_classifier.Fourier(np.zeros(k), np.ones(k), w, rng.uniform(0, 2 * np.pi, 20_000))
    x = rng.normal(size=(6, k))
    gram = z(x)[:, 1:] @ z(x)[:, 1:].T
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * quality_classifier.BANDWIDTH ** 2 * k))
    assert np.abs(gram - exact).max() < 0.05


def test_isotonic_is_the_best_monotone_fit():
    rng = np.random.default_rng(9)
    n, p = rng.integers(1, 20, 12).astype(float), None
    p = np.floor(n * rng.random(12))
    places, shares = quality_classifier.isotonic(np.arange(12.0), n, p)
    assert (np.diff(shares) > 0).all()
    # Minimax formula of isotonic regression.
    want = [max(min(p[a:b + 1].sum() / n[a:b + 1].sum() for b in range(i, 12)) for a in range(i + 1)) for i in range(12)]
    at = 0
    for place, share in zip(places, shares):
        total = 0.0
        members = [i for i in range(12) if abs(want[i] - share) < 1e-9]
        assert members and abs(sum(i * n[i] for i in members) / sum(n[i] for i in members) - place) < 1e-9
        at += len(members)
    assert at == 12


def test_normal_equations_equal_the_direct_sum(spark):
    k = len(quality_classifier.STATISTICS)
    rng = np.random.default_rng(10)
    x, y = rng.normal(size=(50, k)), rng.integers(0, 2, 50)
    rows = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y)], "x array<double>, label int").repartition(7)
    z = quality_classifier.fourier(rows)
    a, b = quality_classifier.normal_equations(rows, z)
    assert np.allclose(a, z(x).T @ z(x)) and np.allclose(b, z(x).T @ y)


# tokens

def model_proto(pieces, kind, byte_fallback=True):
    def number(field, value):
        out = bytes([field << 3 & 127 | (128 if field > 15 else 0)]) + (bytes([field >> 4]) if field > 15 else b"")
        while value > 127:
            out, value = out + bytes([value & 127 | 128]), value >> 7
        return out + bytes([value])

    def block(field, data):
        head, n = bytes([field << 3 | 2]), len(data)
        while n > 127:
            head, n = head + bytes([n & 127 | 128]), n >> 7
        return head + bytes([n]) + data

    out = b""
    for piece, score, type_ in pieces:
        out += block(1, block(1, piece.encode()) + b"\x15" + struct.pack("<f", score) + number(3, type_))
    out += block(2, number(3, kind) + (number(35, 1) if byte_fallback else b""))
    return out + block(3, block(1, b"identity") + number(3, 1) + number(4, 0) + number(5, 1))


def test_unigram_model_has_parity():
    import sentencepiece

    pieces = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    pieces += [("▁", -2.5, 1), ("▁th", -3.1, 1), ("the", -4.2, 1), ("▁the", -3.7, 1), ("e", -3.3, 1), ("re", -3.9, 1), ("h", -5.1, 1),
               ("t", -4.9, 1), ("r", -4.4, 1), ("er", -3.8, 1), ("here", -6.0, 1)]
    data = model_proto(pieces, spm_codec.UNIGRAM)
    codec, original = spm_codec.Codec(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    assert codec.model.kind == spm_codec.UNIGRAM and codec.apart
    texts = ["the there", " the  ere t", "", "xé the", "\n", "▁the ▁"]
    for text, (ids, parity) in zip(texts, codec.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == original.encode(text) and parity
        assert codec.decode(np.frombuffer(ids, "<u4")) == original.decode(original.encode(text))


def test_whole_texts_agree_with_both_libraries(spark):
    import public_tokenizers

    data = spm_codec.model_bytes(public_tokenizers.path("piece_bpe_32k.model"))
    codec = spm_codec.Codec(data)
    whole = spm_codec.build(codec.model)
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + ["", "  a  b ", "a▁b", "\x00"]
    for text, (ids, parity) in zip(texts, codec.encode(texts)):
        own = np.frombuffer(ids, "<u4")
        assert own.tolist() == codec.original.encode(text) and parity
        if text:
            assert whole.encode(text, add_special_tokens=False).ids == own.tolist()
            assert whole.decode(own.tolist(), skip_special_tokens=False) == codec.original.decode(own.tolist()) == codec.decode(own)


def test_decoding_gives_the_texts_back(spark, edge_dir):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    found = spm_codec.decode(spm_codec.encode(located(documents(spark, edge_dir)), path), path).collect()
    assert Counter((r["doc_id"], r["decoded"]) for r in found) == Counter(
        (i, (t or "").replace(spm_codec.MARK, " ")) for i, t in rows_of(spark, edge_dir))
    assert all(r["decoded_crc32"] == r["text_crc32"] for r in found)


def test_words_are_kept_for_two_generations(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(spm_codec, "CACHED_WORDS", 5)
    codec = spm_codec.Codec(spm_codec.model_bytes(public_tokenizers.path("piece_bpe_32k.model")))
    for text in ["a b c d", "a e f g", "h i a", "b c d e f g h", "a"]:
        assert np.frombuffer(codec.encode([text])[0][0], "<u4").tolist() == codec.original.encode(text)
        assert len(codec.known) <= 5 + 7


def test_byte_bpe_agrees_with_its_own_library():
    import public_tokenizers
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, ids_of = Tokenizer.from_file(path), packing.encoder(path)

    @settings(max_examples=300, deadline=None)
    @given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t 　 'a1.")), max_size=40))
    def check(text):
        assert np.frombuffer(ids_of(text), "<u4").tolist() == own.encode(text, add_special_tokens=False).ids

    check()


def test_added_tokens_are_found_in_texts():
    import public_tokenizers
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, ids_of, end = Tokenizer.from_file(path), packing.encoder(path), "<|endoftext|>"

    def check(text):
        assert np.frombuffer(ids_of(text), "<u4").tolist() == own.encode(text, add_special_tokens=False).ids

    assert np.frombuffer(ids_of(f"a {end} b"), "<u4").tolist() == [64, 220, 50256, 275]
    for text in (end, end * 3, f"{end}a", f"a{end}", f"a{end}b", f" {end}", f"{end} ", f"a  {end}  b", f"a\n\n{end}\nb", f"<|{end}|>", f"{end[:-1]} {end}",
                 end.upper(), f"don{end}'t", f"1{end}2 3"):
        check(text)

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.one_of(st.just(end), st.sampled_from([" ", "  ", "\n", " a", "b ", "'s", "1", "<|", "|>", "\u3000", "é"]), st.text(max_size=5)), max_size=12))
    def mixed(parts):
        check("".join(parts))

    mixed()


def test_added_token_in_the_packed_pieces(spark):
    import public_tokenizers

    docs = spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string")
    found = packing.digests(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))).collect()
    assert [(r["doc_tokens"], r["ids_crc32"]) for r in found] == [(5, brute.packed_ids([64, 220, 50256, 275, 0]))]


def test_sequences_hold_every_id(spark, edge_dir):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    cut = packing.pieces(documents(spark, edge_dir), path, 64)
    whole = packing.sequences(cut, 64).orderBy("sequence_id").collect()
    ids = np.concatenate([np.frombuffer(r["ids"], "<u4")[:r["n_tokens"]] for r in whole])
    assert all(len(r["ids"]) == 256 for r in whole) and [r["n_tokens"] for r in whole[:-1]] == [64] * (len(whole) - 1)
    ids_of = packing.encoder(path)
    want = Counter(ids_of(t or "") for _, t in rows_of(spark, edge_dir))
    ends = np.flatnonzero(ids == packing.END)
    # Id 0 also stands for a character, so documents are matched as one multiset of ids.
    assert len(ids) == sum((len(k) // 4 + 1) * n for k, n in want.items()) and len(ends) >= sum(want.values())
    every = np.concatenate([np.frombuffer(k, "<u4") for k in want.elements()])
    assert Counter(ids.tolist()) == Counter(every.tolist()) + Counter({packing.END: sum(want.values())})
