"""The registered queries as they are registered: names and types of their columns, one row for each document (or piece)."""

import zlib
from collections import Counter, defaultdict

import pytest

from terraspan.llm.queries import QUERIES

CONTRACT = {
    "op1_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op2_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op3_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op4_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op5_wavelet": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op6_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op7_licenses": "doc_id bigint, n_lines bigint, licenses string, whole_license string",
    "op8_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op9_syncmers": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, placed_edited double",
    "op10_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op11_clustering": "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
    "op12_periodic": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string",
    "op13_embedding_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
}


@pytest.fixture(scope="module")
def folder(spark, odd, vectors, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    odd.write.parquet(f"{path}/documents.parquet")
    vectors.write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame([(0, 1, 0), (3, 0, 0), (9, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_and_rows(spark, folder, odd, vectors, name):
    out = QUERIES[name](spark, folder)
    if name in CONTRACT:
        assert ", ".join(f"{c} {t}" for c, t in out.dtypes) == CONTRACT[name]
    if "vec_id" in out.columns:
        whole = vectors.where("size(embedding) = 64 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = float('inf'))") if name.startswith("op11") else vectors
        assert Counter(r.vec_id for r in out.collect()) == Counter(r.vec_id for r in whole.collect())
        return
    ids, rows = Counter(r.doc_id for r in odd.collect()), out.collect()
    if name == "op3_packing":
        rows = [r for r in rows if r.start == 0]
    assert Counter(r.doc_id for r in rows) == ids


def test_sharding_query_keeps_its_law(spark, folder, odd):
    texts, slots = defaultdict(list), defaultdict(list)
    for r in odd.collect():
        texts[r.doc_id].append((r.text or "").encode())
    for r in QUERIES["op1_sharding"](spark, folder).collect():
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 24
        assert (r.size, r.text_crc32) in {(len(t) + 8, zlib.crc32(t)) for t in texts[r.doc_id]}
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
