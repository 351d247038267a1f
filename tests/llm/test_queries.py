"""Registered queries on the driver's small tables: brute force, round trips, held-out accuracy."""

import collections
import hashlib
import os
import zlib

import numpy as np
import pytest

import corpus_pipeline
from wayfare.llm import licenses, minhash, queries, simhash

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(MORE), reason="no test tables")


def texts(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def shingles(text):
    words = text.encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_every_operator_is_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 13))


def test_fingerprints(spark):
    docs = texts(spark, SMALL)
    order = sorted(docs, reverse=True)
    got = {r.doc_id: r for r in queries.op2_one_permutation_minhash(spark, SMALL).collect()}
    errors = []
    method = minhash.OnePermutation()
    for k, i in enumerate(order):
        text, following = docs[i], docs[order[(k + 1) % len(order)]]
        edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        errors += [got[i].near_edited - jaccard(shingles(text), shingles(edited)), got[i].near_next - jaccard(shingles(text), shingles(following))]
        assert got[i].near_edited == pytest.approx(method.likeness_of(got[i].fingerprint, got[i].edited_fingerprint))
    assert np.abs(errors).max() < 0.15 and np.abs(errors).mean() < 0.03


def test_components(spark):
    got = {r.doc_id: r for r in queries.op3_simhash_near_dedup(spark, SMALL).collect()}
    fps = {i: simhash.fingerprint(t.encode()) for i, t in texts(spark, SMALL).items()}
    least = {i: i for i in fps}
    moved = True
    while moved:
        moved = False
        for i in fps:
            for j in fps:
                if (fps[i] ^ fps[j]).bit_count() <= 2 and least[j] < least[i]:
                    least[i], moved = least[j], True
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{fps[i]:016x}", least[i]) for i in fps}


def test_repeats(spark):
    docs = {i: t.encode() for i, t in texts(spark, SMALL).items()}
    seen = collections.Counter(t[s : s + 200] for t in docs.values() for s in range(len(t) - 199))
    for r in queries.op4_suffix_array_dedup(spark, SMALL).collect():
        text = docs[r.doc_id]
        covered = np.zeros(len(text), bool)
        for s in range(len(text) - 199):
            if seen[text[s : s + 200]] > 1:
                covered[s : s + 200] = True
        runs = int(np.sum(np.diff(np.concatenate([[0], covered.astype(int)])) == 1))
        kept = bytes(np.frombuffer(text, np.uint8)[~covered])
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(text), int(covered.sum()), runs, hashlib.sha256(kept).hexdigest())


def test_quality_and_toxicity(spark):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{MORE}/labels.parquet").collect()}
    graded = [(labels[r.doc_id].quality, r.grade) for r in queries.op5_ordinal_quality(spark, MORE).collect() if r.doc_id in labels]
    assert np.mean([a == b for a, b in graded]) > 0.97
    rows = queries.op6_subword_toxicity(spark, MORE).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(labels[r.doc_id].toxic, r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 30 and np.mean([a == b for a, b in held]) > 0.93


def test_conversations(spark):
    said = "</s>[INST] ok [/INST]"
    turns = collections.defaultdict(list)
    for r in spark.read.parquet(f"{SMALL}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns[r.conv_id].append((r.role, r.text or ""))
    turns[-1] = [("user", said), ("assistant", said)]
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.conv_id: r for r in queries.op7_prefix_tree_chat(spark, SMALL).collect()}
    assert got.keys() == turns.keys()
    for i, listed in turns.items():
        loss = "".join(t for role, t in listed if role == "assistant")
        want = (len(listed), digest("".join(f"{a}\n{b}\n" for a, b in listed)), len(loss), digest(loss))
        assert (got[i].n_turns, got[i].turns_sha256, got[i].loss_chars, got[i].loss_sha256) == want


def test_mixing_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
    want = sorted(con.execute(f"select doc_id, size, source_size, target, taken from ({queries.OP8_SQL}) q").fetchall())
    assert sorted(map(tuple, queries.op8_source_mixing(spark, SMALL).collect())) == want


def test_licenses(spark):
    scanner = licenses.LicenseScanner()
    for name, wording in licenses.TEMPLATES.items():
        (found,) = list(scanner.scan(("some words\n" + wording + "\nmore words").encode()))
        assert found[2] == name and found[6] and not found[4] and not found[5]
    text = licenses.TEMPLATES["MIT text"].replace("free of charge", "at no charge")
    (found,) = list(scanner.scan(text.encode()))
    assert found[2] == "MIT text" and found[6] and sorted(found[4]) == ["free", "of"] and sorted(found[5]) == ["at", "no"]
    (found,) = list(scanner.scan(b"the license of this house is a long story of its own and nothing else"))
    assert not found[6]
    docs = texts(spark, SMALL)
    want = {(i, n) for i, t in docs.items() for n, w in licenses.TEMPLATES.items() if w in t}
    assert {(r.doc_id, r.license) for r in queries.op1_license_scan(spark, SMALL).collect() if r.confirmed} == want


def test_pipeline(spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]
    docs = spark.read.parquet(f"{MORE}/documents.parquet")
    columns, tables = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, MORE).collect(), docs.schema)
        assert docs.columns == columns
        tables.append(collections.Counter(r.doc_id for r in docs.collect()))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{MORE}/labels.parquet").collect()}
    good, once, clean, mixed = tables
    assert all(labels.get(i) != 0 for i in good if i in labels) or np.mean([labels[i] for i in good if i in labels]) > 0.98
    whole = texts(spark, MORE)
    folded = collections.Counter(" ".join(whole[i].lower().split()) for i in once)
    assert set(once) <= set(good) and max(folded.values()) == 1
    items = [r.text for r in spark.read.parquet(f"{MORE}/benchmark.parquet").collect()]
    leaked = {i for i in once if any(t in whole[i] for t in items)}
    assert leaked and set(clean) <= set(once) - leaked and len(once) - len(clean) <= len(leaked) + 2
    assert set(mixed) <= set(clean) and max(mixed.values()) <= 2
    library = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in corpus_pipeline.STAGES[-1][1](spark, docs, MORE).collect())
    start = 0
    for (at, doc, n), want in zip(got, sorted(mixed.elements()), strict=True):
        assert (at, doc, n) == (start, want, len(library.encode(whole[want], add_special_tokens=False).ids) + 1)
        start += n


def test_next_signatures_across_ranges():
    method = minhash.OnePermutation()
    held = ["one text of some words here", "another text of other words there", "", "a fourth text that is not like any"]
    following = [held[1], "the halo of another range entirely", held[3], "after the last one there is this"]
    own, some = method.signatures([t.encode() for t in held])
    got, some_got = queries._next_signatures(method, held, following, own, some)
    want, some_want = method.signatures([t.encode() for t in following])
    assert (got == want).all() and (some_got == some_want).all()


def test_next_text_where_ranges_share_a_task(spark, tmp_path, monkeypatch):
    from wayfare.llm import neighbours

    rows = [(i, " ".join(f"w{i}x{k % (i + 3)}" for k in range(30))) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(type(spark.range(0)), "repartitionByRange", lambda self, n, *by: self.coalesce(1))
    found = {r.doc_id: r.near_next for r in queries.op2_one_permutation_minhash(spark, str(tmp_path)).collect()}
    method = minhash.OnePermutation()
    by = dict(rows)
    for i in by:
        (a, b), some = method.signatures([by[i].encode(), by[(i - 1) % 40].encode()])
        assert found[i] == pytest.approx(method.likeness(a[None], some[:1], b[None], some[1:])[0])
