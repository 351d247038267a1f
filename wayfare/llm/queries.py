"""Queries of this subpackage by name, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_one_permutation_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that to the next document."""
    import hashlib

    from wayfare.llm.minhash import OnePermutation
    from wayfare.llm.neighbours import NULL_ID, with_next

    method = OnePermutation()

    def each(ids: list[int], texts: list[str], following: list[str]) -> pa.RecordBatch:
        edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, following, strict=True)]
        encoded = [e.encode() for e in edited]
        own, some = method.signatures([t.encode() for t in texts])
        changed, some_changed = method.signatures(encoded)
        nexts, some_nexts = _next_signatures(method, texts, following, own, some)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([None if i == NULL_ID else i for i in ids], pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in encoded]),
                pa.array(method.pack(own, some), pa.string()),
                pa.array(method.pack(changed, some_changed), pa.string()),
                pa.array(method.likeness(own, some, changed, some_changed)),
                pa.array(method.likeness(own, some, nexts, some_nexts)),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    return with_next(
        _table(spark, sf_dir, "documents"), each, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )


def _next_signatures(method, texts: list[str], following: list[str], own, some):
    """Signatures of ``following``: those of the next row where it has that text (a batch may span two ranges), else made."""
    import numpy as np

    nexts, some_nexts = np.roll(own, -1, axis=0), np.roll(some, -1)
    new = [k for k, text in enumerate(following) if k + 1 == len(texts) or texts[k + 1] != text]
    if new:
        nexts[new], some_nexts[new] = method.signatures([following[k].encode() for k in new])
    return nexts, some_nexts


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every row.

    Null, empty and blank texts have the fingerprint zero and link like any other.  Equal texts and repeated rows share a component; rows without an id link, but
    are no component's least id.  Texts are read whole.  No rows give none; further columns of the table are not read.
    """
    from wayfare.llm.simhash import link_components

    return link_components(_table(spark, sf_dir, "documents"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every row without its repeated 200-byte strings.

    Null texts are empty, with nothing removed.  Repeated rows and equal texts of 200 bytes or more lose all their bytes, as does a text that repeats within itself.
    Rows without an id are kept, with a null one.  No rows give none.
    """
    from wayfare.llm.suffix import digest, remove_repeats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans, kept = batch["n_bytes"].to_pylist(), batch["spans"].to_pylist(), batch["kept"].to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    batch["n_bytes"],
                    pa.array([n - len(k) for n, k in zip(sizes, kept, strict=True)], pa.int64()),
                    pa.array([len(s) for s in spans], pa.int64()),
                    pa.array([digest(k) for k in kept]),
                ],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return remove_repeats(_table(spark, sf_dir, "documents")).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op5_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, tail probabilities and grade of every document."""
    from wayfare.llm.classify import fit_quality, score_quality

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return score_quality(docs, fit_quality(docs, labels))


def op6_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; learnt only from rows whose crc32(doc_id) mod 5 is not 0."""
    from wayfare.llm.classify import fit_toxicity, score_toxicity

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels, where="crc32(cast(doc_id as string)) % 5 <> 0")
    scored = score_toxicity(docs, model)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op2_one_permutation_minhash, op3_simhash_near_dedup, op4_suffix_array_dedup, op5_ordinal_quality, op6_subword_toxicity)}
ORACLES: dict[str, str] = {}


def op7_prefix_tree_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations packed as prefix trees and read back from the tokens.

    Null roles and texts are empty.  Turns of one number are all kept; a row without conv_id is a conversation of one turn.  Control strings within texts
    come back as they were.  Further columns are not read.
    """
    import public_tokenizers

    from wayfare.llm.chat import pack_trees, read_back

    path = public_tokenizers.path("byte_bpe_50k.json")
    table = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(pack_trees(table.unionByName(extra), path), path)


def op9_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, number and checksum of the token ids of every row, read back from the shards.

    Null and empty texts are the end id alone.  Rows that share an id are kept as copies of it; rows without one are kept as well.  No rows give none.
    """
    import public_tokenizers

    from wayfare.llm.sstable import read_digests, write_shards
    from wayfare.llm.storage import Scratch

    path = public_tokenizers.path("byte_bpe_50k.json")
    manifest = write_shards(_table(spark, sf_dir, "documents"), str(path), 2, Scratch(spark, "tokens"))
    return read_digests(manifest)


QUERIES |= {f.__name__: f for f in (op7_prefix_tree_chat, op9_token_tables)}


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all documents, with their wording differences."""
    from wayfare.llm.licenses import license_blocks

    return license_blocks(_table(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: words, words and target of its source, words that the mix takes."""
    from wayfare.llm.mixing import plan, word_count
    from wayfare.llm.storage import Scratch

    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("mix_size"))
    planned = plan(docs, sizes=Scratch(spark, "mixing").write(docs, "sizes"))
    return planned.select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("mix_size")).alias("taken")
    )


OP8_SQL = r"""
WITH sizes AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM totals),
caps AS (SELECT *, source_size * 2e0 AS cap, (sum(source_size) OVER ()) * 1.5e0 AS total FROM weighed),
levels AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
  / (sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM caps),
targets AS (SELECT source, source_size, least(cap, weight * max(level) OVER ()) AS target FROM levels),
rates AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0e0 END AS rate,
  ('0x' || md5('17:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT / 4294967296e0 AS draw
  FROM sizes JOIN targets ON sizes.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target, ((floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM rates
"""


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the similarity and place of the best window."""
    from wayfare.llm.decontaminate import leaks

    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("text_hash")


QUERIES |= {f.__name__: f for f in (op1_license_scan, op8_source_mixing, op10_benchmark_decontamination)}
ORACLES |= {"op8_source_mixing": OP8_SQL}


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from wayfare.llm.html_text import extract_main_text

    return extract_main_text(_table(spark, sf_dir, "pages"), keep=["page_id", "url"]).select("page_id", "url", "text", "n_chars")


#: The tables' pages name their article; within it, blocks end at tags of paragraphs and headings.
OP11_SQL = r"""
WITH articles AS (SELECT page_id, url, regexp_extract(html, '<article>(.*?)</article>', 1, 's') AS body FROM pages),
lines AS (SELECT page_id, url, list_transform(string_split_regex(regexp_replace(body, '</?b>', '', 'g'), '</?(?:p|h1)>'), lambda x: trim(regexp_replace(
  replace(replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '&quot;?', '"', 'g'), '&amp;', '&'), '&amp', '&'), '[\s\xA0]+', ' ', 'g'))) AS blocks FROM articles),
texts AS (SELECT page_id, url, coalesce(array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10)), '') AS text FROM lines)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM texts
"""

QUERIES |= {"op11_main_text": op11_main_text}
ORACLES |= {"op11_main_text": OP11_SQL}


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of the rebuilt conversations."""
    from wayfare.llm.trie import prefix_trie, rebuilt_sequences

    return prefix_trie(rebuilt_sequences(_table(spark, sf_dir, "conversations")))


#: CRC-32 by its bits; nodes by the digest of their turns, written with lengths.
OP12_SQL = r"""
WITH ids AS (SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS base, list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
    lambda crc, b: list_reduce([xor(crc, b)] || [0::BIGINT for i in range(8)], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))) AS rest FROM conversations WHERE conv_id IS NOT NULL),
heads AS (SELECT conv_id, base, xor(rest, 4294967295) % 9 AS h FROM ids),
turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS hash,
    strlen(coalesce(text, ''))::BIGINT AS size FROM conversations WHERE conv_id IS NOT NULL),
rebuilt AS (SELECT c.conv_id, k, hash, size FROM heads c JOIN turns t ON t.conv_id = c.base AND t.k <= h UNION ALL SELECT c.conv_id, k, hash, size FROM heads c JOIN turns t ON t.conv_id = c.conv_id AND t.k > h),
paths AS (SELECT heads.conv_id, coalesce(list(hash ORDER BY k) FILTER (hash IS NOT NULL), []) AS path, coalesce(list(size ORDER BY k) FILTER (hash IS NOT NULL), []) AS sizes
  FROM heads LEFT JOIN rebuilt ON heads.conv_id = rebuilt.conv_id GROUP BY heads.conv_id),
prefixes AS (SELECT conv_id, unnest(range(len(path) + 1)) AS depth, path, sizes FROM paths),
members AS (SELECT conv_id, depth, sha256(array_to_string(path[:depth], '')) AS node, CASE WHEN depth > 0 THEN sha256(array_to_string(path[:depth - 1], '')) END AS parent,
  coalesce(sizes[depth], 0) AS size, len(path) = depth AS ends FROM prefixes),
nodes AS (SELECT node, depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM members GROUP BY node, depth),
children AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
ancestors AS (SELECT DISTINCT low.node AS below, high.node AS node FROM members low JOIN members high ON low.conv_id = high.conv_id AND high.depth <= low.depth),
sums AS (SELECT a.node, sum(n.saved)::BIGINT AS saved_tokens, count(*) FILTER (c.node IS NULL) AS n_leaves FROM ancestors a JOIN nodes n ON n.node = a.below LEFT JOIN children c ON c.node = a.below GROUP BY a.node)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON n.node = s.node LEFT JOIN children c ON n.node = c.node LEFT JOIN nodes p ON n.parent = p.node
"""

QUERIES |= {"op12_conversation_trie": op12_conversation_trie}
ORACLES |= {"op12_conversation_trie": OP12_SQL}
