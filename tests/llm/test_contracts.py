"""Each registered query on the smallest tables against what its columns must hold, computed row by row."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return pq.read_table(f"{D}/documents.parquet").to_pylist()


@pytest.fixture(scope="module")
def ids(docs):
    hf = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {r["doc_id"]: hf.encode(r["text"] or "", add_special_tokens=False).ids for r in docs}, hf


def run(spark, name):
    return [r.asDict() for r in entry.queries()[name](spark, D).collect()]


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def packed(x):
    return np.array(x, "<u4").tobytes()


def test_op1(llm_spark, docs):
    got = run(llm_spark, "op1_token_counts")
    import base64

    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == Counter((r["doc_id"], len(encoding.encode(r["text"] or "", disallowed_special=()))) for r in docs)


def test_op2(llm_spark, docs):
    got = {r["doc_id"]: r for r in run(llm_spark, "op2_language_id")}
    assert len(got) == len(docs)
    langs = {r["lang"] for r in docs if not held_out(r["doc_id"])} - {None}
    for r in docs:
        x = got[r["doc_id"]]
        assert x["held_out"] == held_out(r["doc_id"]) and 0 <= x["score"] <= 1
        assert x["lang_pred"] in langs if any(map(str.isalpha, r["text"] or "")) else x["lang_pred"] == "und"


def test_op3(llm_spark, docs):
    got = {r["doc_id"]: r for r in run(llm_spark, "op3_media_columns")}
    assert len(got) == len(docs)
    values = defaultdict(set)
    for r in docs:
        data = (r["text"] or "").encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        x = got[r["doc_id"]]
        assert (x["n_bytes"], x["payload_bytes"], x["payload_sha256"], x["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert x["media_bytes"] == len(payload) + 44 and re.fullmatch("[0-9a-f]{64}", x["media_sha256"])
        values[data].add((x["media_sha256"], x["feature"]))
    assert all(len(v) == 1 for v in values.values())


def test_op4(llm_spark, docs, ids):
    of, hf = ids
    got = run(llm_spark, "op4_bpe")
    want = Counter((i, len(x), hashlib.sha256(packed(x)).hexdigest(), hashlib.sha256(hf.decode(x, skip_special_tokens=False).encode()).hexdigest()) for i, x in of.items())
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want


def test_op5(llm_spark):
    pages = pq.read_table(f"{D}/pages.parquet").to_pylist()
    got = run(llm_spark, "op5_html_extraction")
    assert Counter((r["page_id"], r["url"]) for r in got) == Counter((r["page_id"], r["url"]) for r in pages)
    assert all(r["n_chars"] == len(r["text"]) and r["text"] == "\n".join(re.sub(r"\s+", " ", b).strip() for b in r["text"].split("\n")) for r in got)


def test_op7(llm_spark, docs, ids):
    of, _ = ids
    got = run(llm_spark, "op7_best_fit_packing")
    want = Counter()
    for i, x in of.items():
        x = [*x, 1]
        want.update((i, k, at, len(x[at : at + 4096]), zlib.crc32(packed(x[at : at + 4096]))) for k, at in enumerate(range(0, len(x), 4096)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= 1.01 * -(-sum(r["length"] for r in got) // 4096) + 1


def test_op8(llm_spark, docs):
    got = run(llm_spark, "op8_sharding")
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in docs)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    total, most = sum(r["size"] for r in got), max(r["size"] for r in got)
    assert set(by) <= set(range(24)) and {(r["law"], r["grown_shard"]) for r in got} == {("bytes", None)}
    for part in by.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part))) and abs(sum(r["size"] for r in part) - total / 24) <= most


def test_op9(llm_spark, docs):
    got = {r["doc_id"]: r for r in run(llm_spark, "op9_near_dedup")}
    assert len(got) == len(docs)
    members = defaultdict(list)
    for i, r in got.items():
        members[r["class_id"]].append(i)
    for c, own in members.items():
        assert c == min(own) and {got[i]["class_size"] for i in own} == {len(own)} and [i for i in own if got[i]["kept"]] == [c]


def test_op10(llm_spark, docs):
    got = {r["doc_id"]: r for r in run(llm_spark, "op10_toxicity")}
    assert set(got) == {r["doc_id"] for r in docs}
    assert all(r["held_out"] == held_out(i) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for i, r in got.items())
