"""Each registered query against a plain model: on odd rows, on nothing, and on sf0.001."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from recall.llm import quality_rules, toxicity
from recall.llm.queries import ORACLE_SQL, QUERIES
from recall.llm.rows import documents, labels
from tests.conftest import SF001
from tests.llm import brute


@pytest.fixture(scope="module", params=["edge", "sf0.001"])
def place(request, edge_dir):
    return edge_dir if request.param == "edge" else SF001


def rows_of(spark, place):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{place}/documents.parquet").select("doc_id", "text").collect()]


def got(spark, name, place, *columns):
    rows = QUERIES[name](spark, place).collect()
    return Counter(tuple(r[c] for c in columns) for r in rows)


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_table(spark, empty_dir, name):
    assert QUERIES[name](spark, empty_dir).collect() == []


def test_exact_dedup(spark, place):
    rows = rows_of(spark, place)
    columns = ("doc_id", "keep_id", "group_size", "text_sha256")
    assert got(spark, "op1_exact_dedup", place, *columns) == Counter(brute.exact_groups(rows))
    found = QUERIES["op1_exact_dedup"](spark, place).collect()
    kept = Counter(r["text_sha256"] for r in found if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len({r["text_sha256"] for r in found})
    assert all(r["doc_id"] == r["keep_id"] for r in found if r["kept"])


def test_sentencepiece(spark, place):
    import public_tokenizers
    import sentencepiece
    import zlib

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter()
    for i, t in rows_of(spark, place):
        ids = sp.encode(t or "")
        want[(i, len(ids), brute.packed_ids(ids), zlib.crc32(sp.decode(ids).encode()) if ids else 0, True, True)] += 1
    assert got(spark, "op2_sentencepiece", place, "doc_id", "n_tokens", "ids_crc32", "decoded_crc32", "parity", "round_trip") == want


def test_sharding(spark, place):
    import zlib

    rows = rows_of(spark, place)
    raw = [(t or "").encode() for _, t in rows]
    found = QUERIES["op3_sharding"](spark, place).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == \
        Counter((i, len(b) + 16, zlib.crc32(b)) for (i, _), b in zip(rows, raw))
    shards = defaultdict(list)
    for r in found:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 40
        shards[r["shard"]].append(r)
    total, largest = sum(r["size"] for r in found), max(r["size"] for r in found)
    for own in shards.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 40) <= largest


def test_line_dedup(spark, place):
    import hashlib

    want = Counter((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute.shared_lines(rows_of(spark, place), 10))
    assert got(spark, "op4_line_dedup", place, "doc_id", "n_lines", "n_dropped", "kept_sha256") == want


def test_license_scan(spark, place):
    want = Counter((i, *brute.license_base(t)) for i, t in rows_of(spark, place))
    assert got(spark, "op5_license_scan", place, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == want
    for r in QUERIES["op5_license_scan"](spark, place).collect():
        all_ = list(filter(None, r["labels"].split(",")))
        assert all_ == sorted(set(all_)) and set(filter(None, r["base_labels"].split(","))) <= set(all_)
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(all_)


def test_simhash(spark, place):
    want = Counter(brute.near_groups(rows_of(spark, place)))
    assert got(spark, "op6_simhash", place, "doc_id", "fingerprint", "component_id") == want


@pytest.mark.parametrize("name,threshold", [("op7_toxicity", 0.5), ("op10_quality_classifier", 0.3)])
def test_scores(spark, place, name, threshold):
    import zlib

    found = QUERIES[name](spark, place).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(i for i, _ in rows_of(spark, place))
    for r in found:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold)
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0)
    by_row = defaultdict(set)
    for r in found:
        by_row[r["doc_id"]].add(r["score"])
    assert len(by_row[1]) == 1  # a repeated row scores alike


def test_quality_rules(spark, place):
    want = Counter()
    for i, t in rows_of(spark, place):
        c = brute.base_counts(t)
        want[(i, *c, c[0] < 10 or 100 * c[4] > 20 * c[0])] += 1
    found = QUERIES["op8_quality_rules"](spark, place).collect()
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter(tuple(r[c] for c in columns) for r in found) == want
    assert not any(r["kept"] and r["base_failed"] for r in found)


def check_pieces(found, rows):
    """Pieces make up every document's ids exactly, and windows of 1024 without gaps."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    # Rows of one id are told apart by the place of their first piece.
    by_id, windows = defaultdict(list), defaultdict(list)
    for r in found:
        by_id[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    want = defaultdict(Counter)
    for i, t in rows:
        want[i][tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [0])] += 1
    for i, texts in want.items():
        pieces = sorted(by_id[i], key=lambda r: (r["sequence_id"], r["offset"]))
        docs = []
        for r in pieces:
            if r["start"] == 0:
                docs.append([])
            docs[-1].append(r)
        assert len(docs) == sum(texts.values())
        left = Counter(texts)
        for own in docs:
            crcs = [(r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in own]
            match = next(ids for ids in left if left[ids] and crcs == [
                (s, n, brute.packed_ids(ids[s:s + n]), len(ids)) for s, n, _, _ in crcs] and sum(c[1] for c in crcs) == len(ids))
            left[match] -= 1
    short = 0
    for own in windows.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        short += at < 1024
        assert at <= 1024
    assert short <= 1


def test_packing(spark, place):
    check_pieces(QUERIES["op9_packing"](spark, place).collect(), rows_of(spark, place))


def test_pipeline(spark, place):
    docs = documents(spark, place)
    machine, chain = toxicity.learn(docs, labels(spark, place)), None
    rows = [(i, t) for i, t in rows_of(spark, place)
            if toxicity.sigmoid(machine.logit(machine.columns(toxicity.term_hashes(memoryview((t or "").encode()))))) < 0.5]
    kept = spark.createDataFrame(rows, "doc_id long, text string")
    chain = quality_rules.learn(kept, labels(spark, place))
    rows = [(i, t) for i, t in rows
            if not quality_rules.base_failed(*[brute.base_counts(t)[k] for k in (0, 4)]) and quality_rules.content_share(chain, t) >= 0.5]

    def one_each(rows, group):
        best = {}
        for r, g in zip(rows, group):
            if g not in best or (r[0] is None, r[0] or 0) < (best[g][0] is None, best[g][0] or 0):
                best[g] = r
        return list(best.values())

    rows = one_each(rows, [x[3] for x in brute.exact_groups(rows)])
    rows = one_each(rows, brute.link_roots([brute.fingerprint(t) for _, t in rows], 4))
    found = corpus_pipeline.run(spark, place).collect()
    assert {r["doc_id"] for r in found} == {i for i, _ in rows}
    assert sum(r["length"] for r in found if r["start"] == 0) <= sum(r["length"] for r in found)
    check_pieces(found, rows)


def test_pipeline_stages_keep_columns_and_empty_tables(spark, edge_dir, empty_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "exact dedup", "SimHash near-dedup", "packing"]
    for place in (edge_dir, empty_dir):
        docs = documents(spark, place)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, place)
            assert out.schema.simpleString() == docs.schema.simpleString()
            assert out.exceptAll(docs).isEmpty()
    assert corpus_pipeline.run(spark, empty_dir).collect() == []


def test_sql_names_are_queries():
    assert set(ORACLE_SQL) <= set(QUERIES) and corpus_pipeline.ORACLE_SQL is None
