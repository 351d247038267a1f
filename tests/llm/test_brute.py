"""Operators against brute force on small random tables with hot groups."""

import collections
import random
import textwrap
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wayfare.llm import chat, decontaminate, licenses, mixing, simhash, sstable, suffix, tokens
from wayfare.llm.arrays import Words
from wayfare.llm.components import connected_components
from wayfare.llm.storage import Scratch


def components_of(links, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("one_task", [0, 1_000_000])
def test_connected_components(spark, one_task):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in connected_components(df, Scratch(spark, "t"), one_task=one_task).collect()}
    want = components_of(links, {x for p in links for x in p})
    assert got == {n: c for n, c in want.items() if n != c}


@pytest.mark.parametrize("crowded", [64, 1])
def test_close_fingerprints(spark, crowded):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = {b ^ sum(1 << k for k in rng.sample(range(64), rng.choice([0, 1, 1, 2, 3]))) for b in base for _ in range(12)}
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(sorted(fps))]
    nodes = spark.createDataFrame(rows, "node long, fp long")
    links = simhash.close_links(nodes, Scratch(spark, "t"), crowded).collect()
    values = {i: f & (1 << 64) - 1 for i, f in rows}
    near = [(i, j) for i in values for j in values if i < j and (values[i] ^ values[j]).bit_count() <= 2]
    assert components_of([(r.a, r.b) for r in links], values) == components_of(near, values)
    assert all((values[r.a] ^ values[r.b]).bit_count() <= 2 for r in links)


def test_fingerprint_bits():
    rng = random.Random(3)
    for _ in range(50):
        words = [rng.choice(["A", "bé", "the", "of", "x1"]) for _ in range(rng.randint(0, 40))]
        text = rng.choice([" ", "\n", "\t "]).join(words)
        low = text.encode().lower().split()
        shingles = [b" ".join(low[i : i + 3]) for i in range(max(1, len(low) - 2))] if low else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0
        assert simhash.fingerprint(text.encode()) == want


@pytest.mark.parametrize("crowded", [256, 2])
def test_repeats(spark, crowded):
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(330))

    def noise(n):
        return "".join(rng.choice("ab ") for _ in range(n))

    rows = [(i, noise(rng.randint(0, 300)) + passage[rng.randint(0, 60) : rng.randint(250, 330)] + noise(rng.randint(0, 300))) for i in range(40)]
    rows += [(100, "ab" * 700), (101, "y" * 200), (102, "y" * 200), (103, "q" * 201), (104, noise(900))]
    texts = {i: t.encode() for i, t in rows}
    seen = collections.Counter(t[s : s + 200] for t in texts.values() for s in range(len(t) - 199))
    for r in suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), batches=3, crowded=crowded).collect():
        text = texts[r.doc_id]
        covered = np.zeros(len(text), bool)
        for s in range(len(text) - 199):
            if seen[text[s : s + 200]] > 1:
                covered[s : s + 200] = True
        assert r.kept == bytes(np.frombuffer(text, np.uint8)[~covered])
        assert len(r.spans) == np.sum(np.diff(np.concatenate([[0], covered.astype(int)])) == 1)


@pytest.mark.parametrize("hot", [False, True])
def test_batches_are_scanned_against_all_before(spark, hot):
    """Batches one at a time, each step against brute force over what was added; levels grow geometrically.

    With ``hot``, passages are frequent in one batch and single in others before or after it.
    """
    rng = random.Random(15)
    passages = ["".join(rng.choice("abcdefgh ") for _ in range(330)) for _ in range(12)]

    def text():
        out = "".join(rng.choice("ab ") for _ in range(rng.randint(0, 200)))
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            out += p[rng.randint(0, 100) : rng.randint(230, 330)] + "".join(rng.choice("xyz ") for _ in range(rng.randint(0, 100)))
        return out

    scratch, rows = Scratch(spark, "t"), []
    family = suffix.LevelFamily(scratch, buckets=3, least_hot=1 if hot else 256)
    schema = "doc_id long, text string"
    common = ["".join(rng.choice("abcdefgh ") for _ in range(330)) for _ in range(2)]
    # copies of the two passages in each batch
    often = [(24, 1), (1, 0), (0, 24), (20, 20), (1, 1)] if hot else [(0, 0)] * 5
    for step, sizes in enumerate([[1], [1, 1], [2, 1], [2, 1, 1], [4, 1]]):
        batch = [(100 * step + i, text()) for i in range(8)]
        batch += [(100 * step + 50 * k + 10 + i, "".join(rng.choice("ab ") for _ in range(i)) + common[k]) for k in (0, 1) for i in range(often[step][k])]
        family.add(suffix.anchors(spark.createDataFrame(batch, schema)))
        assert [n for n, _, _ in family.levels] == sizes
        assert hot or not any(level[2] for level in family.levels)
        rows += batch
        texts = {i: t.encode() for i, t in rows}
        seen = collections.Counter(t[s : s + 200] for t in texts.values() for s in range(len(t) - 199))
        want = {i: {s for s in range(len(t) - 199) if seen[t[s : s + 200]] > 1} for i, t in texts.items()}
        got = {r.doc_id: {s for w in r.windows for s in range(w.a, w.b + 1)} for r in suffix.spans(spark.createDataFrame(rows, schema), family, scratch, crowded=4).collect()}
        assert got == {i: s for i, s in want.items() if s}
        entries = suffix.LevelFamily.hits(family).select("doc_id", "a").collect()
        assert len(entries) == len(set(entries))
    assert len(family.levels[0][2]) > 5 if hot else True
    plan = family.levels[0][1].join(family.levels[1][1].select("key", "salt").hint("merge"), ["key", "salt"], "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan  # levels are read along one another


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(5)

    def prose(n):
        return [f"w{rng.randint(0, 5000)}" for _ in range(n)]

    originals = [prose(300) for _ in range(40)]
    rows = [(i, " ".join(w)) for i, w in enumerate(originals)]
    for i, words in enumerate(originals[:20]):
        copy = list(words)
        copy[150] = "changed"
        rows += [(100 + i, " ".join(copy)), (200 + i, " ".join(words).upper())]
    hot = prose(400)
    for i in range(90):  # a crowded block
        copy = list(hot)
        copy[rng.randrange(400)] = f"own{i}"
        rows.append((1000 + i, " ".join(copy)))
    kept = {r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), crowded=8).collect()}
    assert set(range(40)) <= kept and not kept & set(range(100, 300)) and len([k for k in kept if k >= 1000]) == 1


@pytest.mark.parametrize("cell", [512, 7])
def test_crowded_blocks_are_exhausted(spark, cell):
    rng = random.Random(9)
    blocks = [[rng.randrange(1 << 24) for _ in range(simhash.BLOCKS - 1)] for _ in range(60)]  # strangers in one block
    for _ in range(12):  # chains, each link in that block only
        first = rng.getrandbits(480)
        for _ in range(10):
            blocks.append((first, [rng.randrange(1 << 24) for _ in range(simhash.BLOCKS - 1)]))
            first ^= sum(1 << k for k in rng.sample(range(480), 40))
    nodes = [(i, *(b if isinstance(b, tuple) else (rng.getrandbits(480), b))) for i, b in enumerate(rng.sample(blocks, len(blocks)))]

    def longs(value):
        return [int.from_bytes(value.to_bytes(64, "little")[8 * i : 8 * i + 8], "little", signed=True) for i in range(8)]

    table = spark.createDataFrame([(i, "t", i, longs(f), [5, *((k + 1 << 24) | x for k, x in enumerate(b))], 1) for i, f, b in nodes], "node long, text_key string, least_id long, fp array<long>, blocks array<int>, n int")
    rows = spark.createDataFrame([(i, "t", [1]) for i, _, _ in nodes], "doc_id long, text_key string, shingles array<int>")
    scratch = Scratch(spark, "t")
    got = {r.node: r.component for r in connected_components(simhash._near_links(table, rows, scratch, 56, 16, cell, 0.8), scratch).collect()}
    want = components_of([(a, b) for a, f, _ in nodes for b, g, _ in nodes if a < b and (f ^ g).bit_count() <= 56], range(len(nodes)))
    assert len(set(want.values())) == 72
    assert got == {n: c for n, c in want.items() if n != c}


def similar_copy(words, rng):
    """A copy with as many words changed as keep the five-word similarity in 0.8 to 0.85."""
    sets = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
    while True:
        copy = list(words)
        while True:
            copy[rng.randrange(len(copy))] = f"own{rng.random()}"
            other = {tuple(copy[k : k + 5]) for k in range(len(copy) - 4)}
            alike = len(sets & other) / len(sets | other)
            if alike <= 0.85:
                break
        if alike >= 0.8:
            return copy


@pytest.mark.parametrize("length", [50, 60, 80, 150, 300, 1000])
def test_recall_of_the_blocks(length):
    """Of pairs at 0.8 to 0.85, those that share a block and are within the radius."""
    rng = random.Random(length)
    originals = [[f"w{rng.randint(0, 20000)}" for _ in range(length)] for _ in range(300)]
    texts = [" ".join(w).encode() for words in originals for w in (words, similar_copy(words, rng))]
    prints, _ = simhash.wide_fingerprints(texts)
    keys = simhash.block_keys(prints)
    shared = (keys[::2] == keys[1::2]).any(axis=1)
    bits = simhash.BITS // 8
    near = np.bitwise_count(prints[::2, :bits] ^ prints[1::2, :bits]).sum(axis=1, dtype=np.int64) <= simhash.RADIUS
    print("words:", length, "recall:", (shared & near).mean())
    assert (shared & near).mean() >= 0.95


def test_wide_fingerprint_bits():
    """Bits against a count over all pairs, for texts of few and of many pairs."""
    rng = random.Random(13)
    texts = [" ".join(f"w{rng.randint(0, 3000)}" for _ in range(n)).encode() for n in (0, 1, 2, 3, 200, 256, 257, 900, 3000)] + [b"a b"] * 2
    prints, sets = simhash.wide_fingerprints(texts)
    for text, got, held in zip(texts, prints, sets.to_pylist(), strict=True):
        words = Words([text])
        pairs = np.unique(words.shingles(2)[0] >> np.uint64(20))
        lanes = [np.unpackbits(simhash._spread(pairs, k).view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=int) for k in range(simhash.BLOCKS * simhash.BLOCK_BITS // 64)]
        assert got.tolist() == np.packbits(np.concatenate(lanes) * 2 > len(pairs)).tolist()
        assert len(held) == len(np.unique(words.shingles(5)[0] >> np.uint64(32)))


def test_links_through_null_ids(spark):
    rows = [(5, 0b0000), (None, 0b0011), (9, 0b1111), (None, 1 << 40), (7, 0xFF << 20)]
    nodes = spark.createDataFrame([(i, f, f) for i, f in rows], "least_id long, fp long, node long")
    scratch = Scratch(spark, "t")
    got = {r.fp: r.component_id for r in simhash.least_ids(nodes, simhash.close_links(nodes, scratch), scratch).collect()}
    assert got == {0b0000: 5, 0b0011: 5, 0b1111: 5, 1 << 40: 5, 0xFF << 20: 7}  # 2^40 differs from zero by one bit


def test_each_text_of_one_id_counts(spark):
    def prose(seed, n=60):
        rng = random.Random(seed)
        return [f"w{rng.randint(0, 5000)}" for _ in range(n)]

    one, two, three = prose(1), prose(2), prose(3)
    rows = [(4, " ".join(one)), (4, " ".join(two)), (9, " ".join([*one, "end"])), (8, " ".join([*two, "end"])), (None, " ".join(three)), (None, " ".join([*three, "end"])), (4, " ".join(one))]
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, len(r.text.split())) for r in kept)[1:] == [(4, 60), (4, 60)] and len(kept) == 3
    assert {r.text for r in kept if r.doc_id == 4} == {rows[0][1], rows[1][1]}


def test_links_are_similar_texts(spark):
    rng = random.Random(10)

    def prose(n):
        return [f"w{rng.randint(0, 50000)}" for _ in range(n)]

    line = "home about contact terms privacy "
    rows = [(k, line * 50 + " ".join(prose(100))) for k in range(30)]  # strangers under one menu
    for base in range(40):  # copies at 0.6 to 1
        words = prose(200)
        for k in range(6):
            copy = list(words)
            for at in rng.sample(range(200), rng.randint(0, 5)):
                copy[at] = f"own{base}{k}{at}"
            rows.append((1000 + 10 * base + k, " ".join(copy)))
    crowd = prose(300)
    for k in range(60):
        copy = list(crowd)
        for at in rng.sample(range(300), rng.randint(0, 5)):
            copy[at] = f"own{k}{at}"
        rows.append((5000 + k, " ".join(copy)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    similar = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    want = components_of(similar, sets)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), crowded=8, cell=16).collect()}
    assert all(got[k] == k for k in range(30))
    assert all(want[i] == want[c] for i, c in got.items())  # no link below 0.8
    assert sum(got[a] == got[b] for a, b in similar) >= 0.95 * len(similar)
    print("pairs of 0.8 or more:", len(similar), "joined:", sum(got[a] == got[b] for a, b in similar), "components:", len(set(got.values())), "brute force:", len(set(want.values())))


def test_tokens_match_the_library(tokenizer):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(tokenizer), tokens.Encoder(tokenizer)
    rng = random.Random(6)
    letters = "ab 'sTtrevd\n\t\r  1²½éÈ×÷ªºµß…—“€.,!?<|endoftext|>ͰǅЖ中\x1c"
    for _ in range(2000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    plain = tokens.Encoder(tokenizer, specials=False)
    assert plain.decode(plain.encode("a <|endoftext|> é").tolist()) == "a <|endoftext|> é"


def test_shards(spark, tokenizer, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer)
    rows = [(i * 5 % 303 - 50, f"text number {i} " * (i % 9)) for i in range(300)]
    manifest = sstable.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer, 2, Scratch(spark, "t"), shard_bytes=1)
    start = 0
    got = {r.doc_id: r for r in sstable.read_digests(manifest).collect()}
    for i, text in sorted(rows):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    path = tmp_path / "one.sst"
    with open(path, "wb") as out:
        writer = sstable.ShardWriter(out, 2, block=64)
        for i in range(-40, 60, 2):
            writer.add(sstable.key_of(i), np.arange(i % 11))
        writer.close()
    with open(path, "rb") as stream:
        shard = sstable.Shard(stream)
        assert [sstable.id_of(k) for k, _ in shard] == list(range(-40, 60, 2))
        assert all(shard.get(sstable.key_of(i)).tolist() == list(range(i % 11)) for i in range(-40, 60, 2))
        assert all(shard.get(sstable.key_of(i)) is None for i in range(-41, 61, 2))


def test_template_round_trip():
    rng = random.Random(7)
    parts = [*chat.CONTROL, "\\", " ", "ok", "\n", "<", "[", "/", "é"]
    for _ in range(500):
        turns = [(rng.choice(["user", "assistant", "system", "tool", "</s>", ""]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))) for _ in range(rng.randint(1, 5))]
        formatted = "".join("".join(chat.pieces(r, t)) for r, t in turns)
        assert chat.parse(formatted) == turns


def test_trees_share_turns(spark, tokenizer):
    rows = [(c, k, "user" if k % 2 == 0 else "assistant", f"turn {k}" if k < 2 else f"turn {k} of {c % 5}") for c in range(50) for k in range(4)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    packs = chat.pack_trees(table.coalesce(1), tokenizer).collect()
    emitted = sum(len(p.tokens) for p in packs)
    alone = sum(len(p.tokens) for p in chat.pack_trees(table.coalesce(1), tokenizer, pack_conversations=1).collect())
    assert emitted < alone / 4
    for p in packs:
        for node in p.nodes:
            above = sum(s.end - s.start for s in node.ancestors)
            assert p.position_ids[node.start] == above == node.position
            if node.parent >= 0:
                assert any(s.start <= p.nodes[node.parent].start < s.end for s in node.ancestors)
    small = chat.read_back(chat.pack_trees(table, tokenizer, pack_tokens=20), tokenizer)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, chat.read_back(chat.pack_trees(table, tokenizer), tokenizer).collect()))


def test_leaks(spark):
    rng = random.Random(8)
    words = [f"v{i}" for i in range(400)]
    bench = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(15, 50)))) for i in range(30)]
    rows, want = [], set()
    for d in range(60):
        text = [rng.choice(words) for _ in range(rng.randint(0, 200))]
        item = bench[d % 30][1].split()
        if d % 3 == 0:
            text[20:20] = item
            want.add((d, d % 30))
        elif d % 3 == 1:
            text[10:10] = [w.upper() + "," for w in item]
            want.add((d, d % 30))
        else:
            text[5:5] = item[: len(item) // 3]
        rows.append((d, " ".join(text)))
    found = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and all(r.similarity > 0.999 for r in found)


def test_leaks_without_the_common_preamble(spark):
    rng = random.Random(11)

    def some(n):
        return [f"v{rng.randint(0, 50000)}" for _ in range(n)]

    preamble = some(80)
    own = [some(80) for _ in range(60)]
    bench = spark.createDataFrame([(i, " ".join(preamble + words)) for i, words in enumerate(own)], "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(some(100) + words + some(20))) for i, words in enumerate(own)], "doc_id long, text string")
    found = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(docs, bench).collect()}
    one, all_ = np.log1p(60), np.log1p(1)
    assert set(found) == {(i, i) for i in range(60)}
    assert list(found.values()) == pytest.approx([76 * one / (80 * one + 76 * all_)] * 60)


def leaks_by_hand(docs, bench, least=0.8):
    """Similarity of the best of all item-sized windows of every document and item."""
    import re

    def words(text):
        return re.findall(r"[^\W_]+", text.lower())

    def shingles(w, width):
        return [tuple(w[k : k + width]) for k in range(len(w) - width + 1)]

    items = {i: words(t) for i, t in bench if words(t)}
    widths = {i: min(len(w), 5) for i, w in items.items()}
    sets = {i: set(shingles(w, widths[i])) for i, w in items.items()}
    df = collections.Counter(h for s in sets.values() for h in s)
    weight = {h: np.log1p(len(sets) / n) for h, n in df.items()}
    found = {}
    for d, text in docs:
        w = words(text)
        for i, s in sets.items():
            there = shingles(w, widths[i])
            long = len(items[i]) - widths[i] + 1
            whole = sum(weight[h] for h in s)
            best = max((sum(weight[h] for h in s & set(there[k : k + long])) for k in range(max(len(there) - long, 0) + 1)), default=0)
            if best / whole >= least - 1e-9:
                found[d, i] = best / whole
    return found


@pytest.mark.parametrize("most_broadcast", [1_000_000, 0])
def test_leaks_of_changed_items(spark, most_broadcast):
    rng = random.Random(12)
    words = [f"v{i}" for i in range(3000)]

    def some(n):
        return [rng.choice(words) for _ in range(n)]

    shared = some(12)
    bench = [(i, " ".join((shared if i % 3 == 0 else []) + some(rng.choice([1, 3, 6, 9, 20, 40, 60, 120])))) for i in range(48)]
    docs = []
    for d in range(400):
        item = bench[d % 48][1].split()
        n = len(item)
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            at, how = rng.randrange(len(item)), rng.choice("swap put drop change move".split())
            if how == "swap":  # halves in the other order
                item = item[n // 2 :] + item[: n // 2]
            elif how == "put":
                item[at:at] = some(rng.randint(1, 4))
            elif how == "drop" and len(item) > 3:
                del item[at]
            elif how == "change":
                item[at] = rng.choice(words)
            else:
                part = item[at : at + 5]
                del item[at : at + 5]
                to = rng.randint(0, len(item))
                item[to:to] = part
        other = bench[rng.randrange(48)][1].split() if d % 2 else []  # another item beside it
        docs.append((d, " ".join(some(rng.randint(0, 30)) + item + other[: rng.randint(0, 60)] + some(rng.choice([0, 10])))))
    want = leaks_by_hand(docs, bench)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(frame, spark.createDataFrame(bench, "item_id long, text string"), most_broadcast=most_broadcast).collect()}
    between = sum(s < 0.999 for s in want.values())
    assert between > 40 and set(got) <= set(want)
    assert len(got) >= 0.99 * len(want), (len(got), len(want))
    assert all(got[k] == pytest.approx(want[k]) for k in got)
    print("matches:", len(want), "of them changed:", between, "found:", len(got))


def test_leaks_of_swapped_halves(spark):
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(["x"] * 20 + words[30:] + words[:30] + ["y"] * 20))], "doc_id long, text string")
    (found,) = decontaminate.leaks(docs, spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")).collect()
    assert found.similarity == pytest.approx(52 / 56) and found.start_word == 20


def test_targets(spark):
    rows = [("a", 100), ("b", 1000), ("c", 1), (None, 5000)]
    got = {r.source: r for r in mixing.targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    total, weights, caps = 1.5 * 6101, {"a": 5, "b": 2, "c": 1, None: 5}, {s: 2 * n for s, n in rows}
    want, capped = {}, set()
    while True:
        left = total - sum(caps[s] for s in capped)
        level = left / sum(w for s, w in weights.items() if s not in capped)
        over = {s for s, w in weights.items() if s not in capped and w * level > caps[s]}
        if not over:
            break
        capped |= over
    want = {s: caps[s] if s in capped else w * level for s, w in weights.items()}
    assert {s: r.target for s, r in got.items()} == pytest.approx(want)


@pytest.mark.parametrize("ids", ["null", "1", "doc_id % 3"])
def test_sources_of_rows_without_ids_of_their_own_meet_their_targets(spark, ids):
    """3,000 equal texts, half of them without an id, or with one that many have."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("elt(1 + int(id % 3), 'a', 'b', 'c')").alias("source"), F.lit("ten words " * 5).alias("text"))
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") < 1500, F.col("doc_id")).otherwise(F.expr(ids)))
    rows = mixing.plan(docs).groupBy("source").agg(F.sum(F.col("mix_copies") * F.col("mix_size")).alias("taken"), F.first("mix_target").alias("target")).collect()
    assert len(rows) == 3 and all(r.taken == pytest.approx(r.target, rel=0.05) for r in rows)
    assert [r.mix_copies for r in mixing.plan(docs).orderBy("source", "doc_id").collect()].count(0) == [r.mix_copies for r in mixing.plan(docs).collect()].count(0)


@pytest.mark.parametrize("prefix", ["", "# ", "// ", " * ", "-- ", "#"])
def test_wrapped_licenses(prefix):
    scanner = licenses.LicenseScanner()
    for name, wording in licenses.TEMPLATES.items():
        for width in (40, 72, 80):
            notice = "\n".join(prefix + line for line in textwrap.wrap(wording, width, break_long_words=False, break_on_hyphens=False))
            text = f"some words here\n{notice}\nmore words".encode()
            (found,) = scanner.scan(text)
            assert found[2] == name and found[6] and not found[4] and not found[5]
            assert text[found[0] : found[1]].split()[-1].endswith(wording.split()[-1].encode())


def test_each_of_several_licenses():
    scanner = licenses.LicenseScanner()
    filler = "we note that the permission of the copies and the software is subject to conditions of this and any other notice " * 20
    for first, one in licenses.TEMPLATES.items():
        for second, two in licenses.TEMPLATES.items():
            for between in ("\n", " ", " and also ", " " + filler):
                text = f"{filler}{one}{between}{two} {filler}".encode()
                found = [f for f in scanner.scan(text) if f[6]]
                assert [f[2] for f in found] == [first, second]
                assert [text[f[0] : f[1]].decode() for f in found] == [one, two]
    changed = licenses.TEMPLATES["ISC"].replace("without fee", "with fee") + " Licensed under CC BY 4.1. Licensed under CC BY 4.0."
    assert [(f[2], f[4], f[5]) for f in scanner.scan(changed.encode()) if f[6]] == [("ISC", ["without"], ["with"]), ("CC-BY-4.0", [], [])]


def test_versions_and_names_of_licenses_are_exact():
    scanner = licenses.LicenseScanner()
    text = licenses.TEMPLATES

    def found(notice):
        return [f[2] for f in scanner.scan(f"before this {notice} and after it".encode()) if f[6]]

    assert found("This work is licensed under the GNU General Public License, version 2.") == ["GPL-2.0"]
    for name in ("GPL-2.0 header", "GPL-3.0 header", "LGPL-2.1 header", "LGPL-3.0 header", "AGPL-3.0 header"):
        assert found(text[name]) == [name]
        assert found(text[name].replace("WITHOUT ANY", "without any")) == [name]  # the words around are free to a tenth
    assert found(text["GPL-3.0 header"].replace("version 3", "version 4")) == []
    assert found(text["GPL-3.0 header"].replace("GNU General", "General")) == []
    assert found(text["LGPL-2.1 header"].replace("Lesser", "Library")) == []
    assert found("This work is licensed under the GNU General Public License, version 9.") == []
    assert found("Licensed under the Apache License, Version 1.1.") == [] and found("Licensed under CC BY 3.0.") == []
    assert found("Released under the MIT License.\nLicensed under CC BY 4.0.") == ["MIT", "CC-BY-4.0"]
    assert found(text["BSD-3-Clause"]) == ["BSD-3-Clause"] and found(text["BSD-2-Clause"]) == ["BSD-2-Clause"] and found(text["BSD"]) == ["BSD"]


def test_case_and_stops_of_notices_are_free():
    scanner = licenses.LicenseScanner()
    for name, wording in licenses.TEMPLATES.items():
        for other in (wording.upper(), wording.lower(), wording.rstrip("."), f'"{wording}",', wording.replace(",", "")):
            text = f"some words here {other} and more of them".encode()
            found = [f for f in scanner.scan(text) if f[6]]
            assert [(f[2], f[4], f[5]) for f in found] == [(name, [], [])], (name, other)


def test_identifiers_and_blocks_like_no_template():
    scanner = licenses.LicenseScanner()
    (found,) = scanner.scan(b"/* SPDX-License-Identifier: MIT */\nint main;")
    assert found[2] == "SPDX MIT" and found[6] and found[:2] == (3, 31)
    (found,) = scanner.scan(b"// SPDX-License-Identifier: Zlib\nint main;")
    assert not found[6]
    (found,) = scanner.scan("she kept her driver's licence in a blue box beneath the staircase of an old farm near Worcester".encode())
    assert found[2] is None and not found[6] and found[3] < licenses.LEAST_REDUCTION and found[4] == found[5] == []


def test_no_notice_is_lost_by_the_ranking():
    """Notices in random text, against the alignment with every template."""
    scanner, rng = licenses.LicenseScanner(), random.Random(14)
    vocabulary = [w for t in licenses.TEMPLATES.values() for w in t.split()] + [f"w{i}" for i in range(300)]

    def some(n):
        return [rng.choice(vocabulary) for _ in range(rng.randint(0, n))]

    for _ in range(300):
        words = some(900)
        for name in rng.sample(scanner.names, 3):
            notice = licenses.TEMPLATES[name].split()
            for _ in range(rng.randint(0, len(notice) // 10)):
                notice[rng.randrange(len(notice))] = "other"
            words += notice + some(200)
        words = [w.encode() for w in words]
        every = {m[:3] for m in scanner.matches(words)}
        assert {m[:3] for m in scanner.confirmed(words)} <= every
        kept = []
        for m in sorted(scanner.matches(words), key=lambda m: (-len(scanner.wanted[m[2]]), len(m[3]) + len(m[4]), m[0], m[1])):
            if all(m[1] <= o[0] or o[1] <= m[0] for o in kept):
                kept.append(m)
        assert {m[:3] for m in scanner.confirmed(words)} == {m[:3] for m in kept}
