"""Filter audit, phrase collocations and spot signatures, each against a plain model."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from recall.llm import collocations, filter_audit, spot_signatures
from recall.llm.queries import QUERIES
from recall.llm.rows import documents, labels, located
from tests.conftest import SF001
from tests.llm import brute


@pytest.fixture(scope="module", params=["edge", "sf0.001"])
def place(request, edge_dir):
    return edge_dir if request.param == "edge" else SF001


AUDIT = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
PHRASES = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def counted(df, columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def plain(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


# filter audit

def test_filter_audit(spark, place):
    docs, marks = documents(spark, place), labels(spark, place)
    want = brute.filter_audit(plain(docs, "doc_id", "text", "source"), plain(marks, "doc_id", "quality", "toxic"))
    assert counted(QUERIES["op11_filter_audit"](spark, place), AUDIT) == want


def test_audit_of_copies_over_parts(spark):
    """Equal texts in several parts, with repeated and missing ids; another column names the parts."""
    rng = random.Random(5)
    texts = ["", None, "one two", "A B C #", "word " * 60, " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(60)) + " | |"]
    rows = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice(["x", "y", "", None])) for _ in range(300)]
    marks = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [None, *range(30), *range(10)]]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, site string, digest string, mask int")
    found = filter_audit.audit(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), part="site")
    assert counted(found, AUDIT) == brute.filter_audit(rows, marks)


def test_swaps_visit_every_order_and_keep_the_counts():
    rng = np.random.default_rng(3)
    masks = {int(m): tuple(map(int, rng.integers(0, 5, 3))) for m in rng.choice(32, 20, replace=False)}
    diagram, seen = filter_audit.Diagram(masks, "ABCDE"), set()
    for level in [None, *filter_audit.swap_sequence(5)]:
        if level is not None:
            diagram.swap(level)
        seen.add(diagram.order)
        for mask in range(32):
            node = diagram.root
            for f in diagram.order:
                node = node[2] if mask >> filter_audit.FILTERS.index(f) & 1 else node[1]
            assert node[0] == masks.get(mask, (0, 0, 0))
    assert len(seen) == 120


# collocations

def test_collocations(spark, place):
    want = brute.collocations(plain(documents(spark, place), "lang", "text"), 3, 10, 50, 2000)
    assert counted(QUERIES["op12_collocations"](spark, place), PHRASES) == want and want


def phrase_rows():
    rng = random.Random(7)
    rows = [(rng.choice(["en", "de", None, ""]), " ".join(rng.choice("aabcdeÄé") + rng.choice(["", "", ".", "\t", ",", "\n"]) for _ in range(rng.randint(0, 40))))
            for _ in range(300)]
    return rows + [("en", "of the " * 500), ("en", None), ("en", ""), (None, "x"), ("de", "a" * 5000 + " b c")] + [("fr", "je ne sais pas")] * 12


@pytest.mark.parametrize("budget,words,tokens", [(1 << 20, 3, 1 << 20), (40, 3, 500), (15, 4, 97), (10, 2, 1 << 20)])
def test_prefixes_over_the_budget_are_made_longer(spark, monkeypatch, budget, words, tokens):
    monkeypatch.setattr(collocations, "TOKENS_AT_ONCE", tokens)
    monkeypatch.setattr(collocations, "BLOCK", 64)
    rows = phrase_rows()
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "lang string, text string, phrase string, n int").repartition(5)
    found = collocations.collocations(docs, words, 10, 50, 30, budget=budget)
    assert counted(found, PHRASES) == brute.collocations(rows, words, 10, 50, 30)


def test_counts_beyond_64_bits(spark):
    nodes = spark.createDataFrame(
        [("en", "a", 1, 10**13, []), ("en", "b", 1, 9 * 10**12, []), ("en", "a b", 2, 8 * 10**12 + 1, [10**13])], collocations.NODES)
    row = collocations.scored(nodes).first()
    assert row["score"] == 1_000_000 * (8 * 10**12 + 1) ** 2 // (10**13 * 9 * 10**12)


def test_wide_ids_are_sorted_by_columns():
    rng = np.random.default_rng(1)
    small = [rng.integers(0, 4, 200).astype(np.int32) for _ in range(3)]
    wide = [np.where(c == 3, 1 << 30, c).astype(np.int32) for c in small]
    for n in (None, rng.integers(1, 9, 200)):
        (a, x), (b, y) = collocations.tallied(small, n), collocations.tallied(wide, n)
        assert x.tolist() == y.tolist() and [np.where(c == 1 << 30, 3, c).tolist() for c in b] == [c.tolist() for c in a]


# spot signatures

def check_prints(found, rows, anchors):
    want = brute.spot_rows(rows, set(anchors))
    key = lambda i, n, sha, a, b: (i is None, i or 0, n, sha, round(a, 9), round(b, 9))
    assert sorted(key(r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in found) == \
        sorted(key(*w[:5]) for w in want)
    prints = {}
    for r in found:
        prints.setdefault((r["doc_id"], r["n_chars"], r["edited_sha256"]), (r["fingerprint"], r["edited_fingerprint"]))
    by_set = {}
    for i, n, sha, _, _, a, b in want:
        for have, signatures in zip(prints[(i, n, sha)], (a, b)):
            assert by_set.setdefault(frozenset(signatures), have) == have
            assert len(have) == 8 * len(signatures) and have == "".join(sorted(have[k:k + 8] for k in range(0, len(have), 8)))
    assert len(set(by_set.values())) == len(by_set)


def in_order(df):
    """(doc_id, text) in the order of ids, null ids last, equal ids by their place in the files."""
    at = df.select("doc_id", "text", F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r"))
    return [(i, t) for i, t, _, _ in sorted(plain(at, "*"), key=lambda x: (x[0] is None, x[0] or 0, x[2], x[3]))]


@pytest.mark.parametrize("ranges", [1, 4, 37])
def test_fingerprints(spark, place, ranges):
    docs, before = documents(spark, place), spark.conf.get("spark.sql.shuffle.partitions")
    anchors = spot_signatures.anchor_words(docs)
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        found = spot_signatures.fingerprints(located(docs), anchors, least=0.0001).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    check_prints(found, in_order(docs), anchors)


def test_anchors_are_common_words(spark, place):
    rows = plain(documents(spark, place), "lang", "text")
    import regex

    size, seen = Counter(lang or "" for lang, _ in rows), Counter()
    for lang, t in rows:
        seen.update((lang or "", w) for w in set(regex.findall(r"[\p{L}\p{M}\p{N}]+", (t or "").lower())))
    want = set()
    for lang in size:
        common = sorted((-n, w) for (x, w), n in seen.items() if x == lang and n >= 0.25 * size[lang])
        want.update(w for _, w in common[:50])
    assert spot_signatures.anchor_words(documents(spark, place)) == sorted(want)


def test_a_single_document_and_texts_of_anchors(spark, tmp_path):
    rows = [(3, "the of the of the of the of the of the of the of " * 9 + "end of it")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/one.parquet")
    docs = spark.read.parquet(f"{tmp_path}/one.parquet")
    found = spot_signatures.fingerprints(located(docs), ["of", "the"]).collect()
    check_prints(found, in_order(docs), ["of", "the"])
    assert found[0]["near_next"] == 1.0


def test_sets_of_very_unlike_length_are_not_compared(spark):
    rows = [(list(range(n)), list(range(m))) for n in (1, 2, 9, 10, 40, 100, 3000) for m in (1, 5, 12, 99, 101, 4000)]
    df = spark.createDataFrame(rows, "a array<long>, b array<long>").select(
        F.size("a").alias("n"), F.size("b").alias("m"), spot_signatures.likeness(F.col("a"), F.col("b"), 0.1).alias("near"))
    for r in df.collect():
        low, high = sorted((r["n"], r["m"]))
        assert r["near"] == low / high or (r["near"] == 0 and low / high < 0.1)
