"""Operators on documents against brute force: nulls, empty and long texts, repeated rows, clashing columns, empty tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestrata.llm import bpe, chunking, exact_dedup, langid, media, near_dedup, packing, sharding, token_counts, toxicity
from lodestrata.llm.common import Bloom, bounded, fresh, numbered, release, stored, without

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.tiktoken")


def key(row):
    return repr([row[c] for c in sorted(row.asDict())])


# ---- op 6


def test_exact_dedup_equals_brute_force(documents, rows):
    got = exact_dedup.deduplicate(documents(rows)).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    assert len(got) == len(rows)
    want = Counter()
    for i, t in rows:
        own = [x for x in groups[norm(t)] if x is not None]
        want[i, min(own, default=None), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_exact_keep_first_keeps_whole_rows(documents, rows):
    df = documents(rows)
    out = exact_dedup.keep_first(df)
    assert out.columns == df.columns and {(r["row_"], r["hash_"], r["row"]) for r in out.collect()} == {("z", 5, "y")}
    assert Counter(r["doc_id"] for r in out.collect()) == Counter([1, 2, 5, 7, 8, 9, 10, 11, 12, 13])
    assert exact_dedup.deduplicate(documents([])).count() == 0 and exact_dedup.keep_first(documents([], clash=False)).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(max_size=4000), min_size=1, max_size=4))
def test_chunks_cover_and_depend_on_content_only(parts):
    data = np.frombuffer(b"".join(parts), np.uint8)
    cuts = chunking.cut_points(data, np.cumsum([len(p) for p in parts]), 64, 1024, 5)
    for p, c in zip(parts, cuts, strict=True):
        alone = chunking.cut_points(np.frombuffer(p, np.uint8), np.array([len(p)]), 64, 1024, 5)[0]
        assert c == alone and c[-1] == len(p) and c == sorted(c)
        assert all(64 <= b - a <= 1024 for a, b in zip([0, *c], c[:-1]))


def test_gear_hash_is_the_sum_over_its_window():
    data = np.frombuffer(random.Random(1).randbytes(200), np.uint8)
    h = chunking.gear_hash(data)
    for i in (0, 5, 31, 32, 199):
        want = sum(int(chunking._GEAR[data[i - k]]) << k for k in range(min(i + 1, 32))) & 0xFFFFFFFF
        assert int(h[i]) == want


# ---- op 8


def test_sharding_balances_and_numbers(documents, rows):
    many = rows + [(100 + i, SENT) for i in range(400)] + [(1000 + i, f"{i} " * (i % 50)) for i in range(600)]
    got = sharding.shard(documents(many), shards=5, least_ranges=16).collect()
    assert len(got) == len(many)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in many)
    total, most = sum(r["size"] for r in got), max(r["size"] for r in got)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert set(by) <= set(range(5))
    for part in by.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
        assert abs(sum(r["size"] for r in part) - total / 5) <= most
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    assert sharding.shard(documents([])).count() == 0


SENT = "same text again and again"


def test_sharding_of_one_text_only(documents):
    got = sharding.shard(documents([(i, SENT) for i in range(1000)]), shards=4, least_ranges=8).collect()
    assert Counter(r["shard"] for r in got) == {0: 250, 1: 250, 2: 250, 3: 250}


# ---- op 4 and 7


def test_bpe_equals_the_library(documents, rows):
    hf = Tokenizer.from_file(WORDS)
    odd = [(50, "<|endoftext|> a<|startoftext|>b"), (51, "it's I'LL 'salt"), (52, "!" * 3000 + "a" * 3000), (53, "\x1c x\x85y　z"), (54, "é é ½ Ⅷ १२ ﬁ İ")]
    got = bpe.encode_decode(documents(rows + odd), WORDS).collect()
    want = Counter()
    for i, t in rows + odd:
        ids = hf.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), np.array(ids, "<u4").tobytes(), hf.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in got) == want
    assert bpe.encode_decode(documents([]), WORDS).count() == 0


_library: list[Tokenizer] = []


def library_ids(texts):
    if not _library:
        _library.append(Tokenizer.from_file(WORDS))
    return [np.array(e.ids, "<u4").tobytes() for e in _library[0].encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_bpe_on_any_text(text):
    text = "".join(c for c in text if not 0xD800 <= ord(c) <= 0xDFFF)
    assert bpe.tokenizer(WORDS).encode([text]) == library_ids([text])


def test_bpe_on_all_code_points():
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = [f" {x} ".join(points[i : i + 2000]) for i in range(0, len(points), 2000) for x in ("",)]
    texts += ["".join(points[i : i + 50]) for i in range(0, 0x3200, 50)]
    assert bpe.tokenizer(WORDS).encode(texts) == library_ids(texts)


def test_bpe_on_random_strings():
    rng = random.Random(6)
    marks = [*range(0x300, 0x370), *range(0x8D3, 0x900), *range(0x1AB0, 0x1AD0), 0xFC6, 0x1100, 0x1161, 0x11A8, 0xAC00, 0x3A3, 0x3C3, 0x130, 0x131, 0x41, 0x65, 0x20, 0x20, 0xA0, 0x3000, 0x200B]
    texts = ["".join(chr(c) for c in (rng.choice(marks) if rng.random() < 0.6 else rng.randrange(0x1FFFF) for _ in range(rng.randint(1, 12))) if not 0xD800 <= c <= 0xDFFF) for _ in range(20_000)]
    assert bpe.tokenizer(WORDS).encode(texts) == library_ids(texts)


def test_short_and_long_words_merge_alike():
    own = bpe.tokenizer(WORDS)
    for w in ("internationalization", "aaaaaaaaaaaaaaaaaaaaaaa", "thethethethe", "x"):
        assert own._short([w.encode()], 32)[0] == own._long(w.encode())


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_best_fit_never_overfills(lengths):
    bins, offsets, fills = packing.best_fit(np.array(lengths, np.int64), 64)
    for b, fill in enumerate(fills):
        own = sorted((o, n) for o, n, x in zip(offsets.tolist(), lengths, bins.tolist(), strict=True) if x == b)
        at = 0
        for o, n in own:
            assert o == at
            at += n
        assert at == fill <= 64


def test_final_bins_are_of_no_use_to_others():
    """What a node makes final, no bin that it passes up can be put into, and none of its final bins fit into each other."""
    rng = random.Random(31)
    for hosts in (0, 2, 16):
        for _ in range(40):
            fills = sorted((rng.randint(1, 100) for _ in range(rng.randint(1, 60))), reverse=True)
            into, _, filled = packing.best_fit(np.array(fills, np.int64), 100)
            low = sorted(filled)
            small = sum(2 * f <= 100 for f in low)
            final = low[small + hosts :]
            # best fit leaves no two bins that fit together, so a bin over half full can only host one of at most half
            assert all(a + b > 100 for i, a in enumerate(low) for b in low[i + 1 :])
            assert small <= 1 and all(2 * f > 100 for f in final)


def check_packed(got, capacity):
    at = defaultdict(list)
    for r in got:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in at.values():
        end = 0
        for o, n in sorted(own):
            assert o == end
            end += n
        assert end <= capacity
    return len(at)


def test_packing_equals_the_tokens(documents, rows):
    hf = Tokenizer.from_file(WORDS)
    got = packing.pack_documents(documents(rows), WORDS, 512).collect()
    want = Counter()
    for i, t in rows:
        ids = [*hf.encode(t or "", add_special_tokens=False).ids, 1]
        for k, s in enumerate(range(0, len(ids), 512)):
            run = ids[s : s + 512]
            want[i, k, s, len(run), zlib.crc32(np.array(run, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    assert check_packed(got, 512) <= -(-sum(r["length"] for r in got) // 512) + 1
    assert packing.pack_documents(documents([]), WORDS).count() == 0


@pytest.mark.parametrize("kind", ["small", "halves", "mixed"])
def test_packing_tree_merges_what_groups_leave(llm_spark, kind):
    rng = random.Random(7)
    draw = {"small": lambda: rng.randint(1, 30), "halves": lambda: rng.choice([60, 70, 20]), "mixed": lambda: rng.randint(1, 100)}[kind]
    lengths = [draw() for _ in range(3000)]
    items = llm_spark.createDataFrame(list(enumerate(lengths)), "row bigint, length bigint")
    got = packing.pack(items, 100, group=500, fan_in=2, hosts=16).collect()
    assert Counter(r["length"] for r in got) == Counter(lengths)
    n = check_packed(got, 100)
    _, _, alone = packing.best_fit(np.array(lengths), 100)
    assert n <= len(alone) * 1.03 + 2


# ---- op 1


def test_token_counts_equal_the_encoder(documents, rows):
    blocks, manifest = token_counts.write_flat(documents(rows), BYTES, public_tokenizers.PATTERN, 50256, block=257)
    found = manifest.join(token_counts.separator_scan(blocks, 50256, span=3), ["file", "ordinal"]).collect()
    encoder = token_counts._encoding(BYTES, public_tokenizers.PATTERN)
    assert Counter((r["id"], r["n_tokens"]) for r in found) == Counter((i, len(encoder.encode_ordinary(t or ""))) for i, t in rows)


def test_flat_files_are_scanned(llm_spark, tmp_path):
    rng = np.random.default_rng(3)
    tokens = rng.integers(0, 9, 1000).astype("<u2")
    (tmp_path / "a.bin").write_bytes(tokens.tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    got = token_counts.separator_scan(token_counts.read_flat(llm_spark, f"file://{tmp_path}/*.bin", 64), 0).filter("complete").orderBy("ordinal").collect()
    ends = np.flatnonzero(tokens == 0)
    assert [r["n_tokens"] + 1 for r in got] == np.diff(np.concatenate(([-1], ends))).tolist()


@pytest.mark.parametrize("dtype", ["<u2", "<u4"])
def test_flat_files_are_read_in_splits(llm_spark, tmp_path, dtype):
    """Every token once, whatever bytes 10 and 13 there are and wherever Spark splits."""
    rng = np.random.default_rng(4)
    files = {"a": rng.integers(0, 30, 20_001), "b": np.full(3000, 0x0A0A), "c": rng.integers(0, 65536, 7000), "d": np.array([10]), "e": np.array([], int), "f": np.full(500, 0x0D0D)}
    for name, tokens in files.items():
        (tmp_path / f"{name}.bin").write_bytes(tokens.astype(dtype).tobytes())
    before = llm_spark.conf.get("spark.sql.files.maxPartitionBytes")
    llm_spark.conf.set("spark.sql.files.maxPartitionBytes", "999")
    llm_spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = token_counts.read_flat(llm_spark, f"file://{tmp_path}/*.bin", 64, dtype).collect()
    finally:
        llm_spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        llm_spark.conf.unset("spark.sql.files.openCostInBytes")
    by = defaultdict(list)
    for r in got:
        by[r["file"]].append((r["block"], bytes(r["tokens"])))
    for own in by.values():
        assert sorted(k for k, _ in own) == list(range(len(own)))
    assert Counter(b"".join(t for _, t in sorted(own)) for own in by.values()) == Counter(t.astype(dtype).tobytes() for t in files.values() if len(t))


def test_an_odd_tail_of_a_flat_file_is_an_error(llm_spark, tmp_path):
    (tmp_path / "odd.bin").write_bytes(b"\0\1\2")
    with pytest.raises(ValueError, match="ends inside of an id"):
        token_counts.read_flat(llm_spark, f"file://{tmp_path}/odd.bin")


def test_token_counts_of_nothing(documents):
    blocks, manifest = token_counts.write_flat(documents([]), BYTES, public_tokenizers.PATTERN, 50256)
    assert manifest.join(token_counts.separator_scan(blocks, 50256), ["file", "ordinal"]).count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=9), max_size=7))
def test_separator_scan_stitches_any_blocks(llm_spark, blocks):
    data = [(0, k, np.array(b, "<u2").tobytes()) for k, b in enumerate(blocks)] + [(1, 0, None)]
    got = sorted(tuple(r) for r in token_counts.separator_scan(llm_spark.createDataFrame(data, "file bigint, block bigint, tokens binary"), 0, span=2).select("ordinal", "start", "n_tokens", "complete").collect())
    want, start, flat = [], 0, [t for b in blocks for t in b]
    for i, t in enumerate(flat):
        if t == 0:
            want.append((len(want), start, i - start, True))
            start = i + 1
    if start < len(flat):
        want.append((len(want), start, len(flat) - start, False))
    assert got == want


# ---- op 3


def test_media_round_trip(documents, rows):
    got = media.media_columns(documents(rows)).collect()
    want = Counter()
    for i, t in rows:
        b = (t or "").encode()
        p = b.ljust(max(64, -(-len(b) // 64) * 64), b"\0")
        m = media.to_media(b)
        assert m[44:] == p
        want[i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"], r["media_sha256"]) for r in got) == want
    assert all(r["feature"].startswith("mean=") for r in got)
    assert media.media_columns(documents([])).count() == 0


def test_media_chunks_are_stored_once(documents):
    base = "".join(random.Random(3).choices("abcdefgh ", k=60_000))
    _, stored, chunks = media.store(documents([(1, base), (2, "changed head " + base), (3, base), (4, "alone")]))
    assert chunks.count() == chunks.select("digest").distinct().count() > 5
    shared = sum(len(r["data"]) for r in chunks.collect())
    own = sum(len(p["data"]) for r in stored.collect() for p in r["parts"] if p["data"] is not None)
    assert shared + own < 2 * len(base)


def test_damaged_chunk_is_noticed(llm_spark):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"key": b"k", "parts": [{"digest": b"x", "data": b"y"}]}])
    with pytest.raises(ValueError):
        list(media._read(iter([batch])))


# ---- op 9


def brute_classes(rows, least=0.8):
    sets = near_dedup.weighted_shingles([t for _, t in rows])
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a][1]) and len(sets[b][1]) and near_dedup.probability_jaccard(*sets[a][1:], *sets[b][1:]) >= least - 1e-12:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return Counter(tuple(sorted((rows[i][0] is None, rows[i][0]) if rows[i][0] is not None else (True, -1) for i in range(len(rows)) if find(i) == r)) for r in {find(i) for i in range(len(rows))})


def variants():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    out = []
    for f in range(6):
        base = rng.choices(vocab, k=150)
        for k in range(8):
            words = base.copy()
            for _ in range(k):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            out.append((1000 + 10 * f + k, " ".join(words)))
    return out


def test_near_duplicates_equal_brute_force(documents, rows):
    all_rows = rows + variants()
    found = near_dedup.near_duplicates(documents(all_rows), block=3).collect()
    assert len(found) == len(all_rows)
    classes = defaultdict(list)
    for n, r in enumerate(found):
        named = r["class_id"] if r["class_size"] > 1 else f"alone {n}"
        classes[named].append((r["doc_id"] is None, r["doc_id"]) if r["doc_id"] is not None else (True, -1))
    assert Counter(tuple(sorted(v)) for v in classes.values()) == brute_classes(all_rows)
    assert sum(r["kept"] for r in found) == len(classes)
    assert near_dedup.near_duplicates(documents([])).count() == 0


def test_near_duplicates_hold_set_links_that_a_leader_misses(documents):
    """A chain a-b-c in which only neighbours are similar is one class."""
    rng = random.Random(9)
    base = [f"x{rng.randrange(10**6)}" for _ in range(200)]
    chain = [(k, " ".join([*(f"n{k}_{j}" for j in range(8 * k)), *base[8 * k :]])) for k in range(6)]
    found = near_dedup.near_duplicates(documents(chain)).collect()
    want = brute_classes(chain)
    got = defaultdict(list)
    for r in found:
        got[r["class_id"]].append((False, r["doc_id"]))
    assert Counter(tuple(sorted(v)) for v in got.values()) == want


def test_near_keep_first_keeps_whole_rows(documents, rows):
    df = documents(rows + variants())
    out = near_dedup.keep_first(df)
    assert out.columns == df.columns and {(r["row_"], r["hash_"]) for r in out.collect()} == {("z", 5)}
    want = Counter(r["doc_id"] for r in near_dedup.near_duplicates(df).filter("kept").collect())
    assert Counter(r["doc_id"] for r in out.collect()) == want
    assert near_dedup.keep_first(documents([])).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), min_size=1, max_size=12), min_size=2, max_size=8), st.sampled_from([0.5, 0.8]))
def test_prefix_filter_loses_no_pair(texts, least):
    sets = [np.unique(np.array(t, np.uint64), return_counts=True) for t in texts]
    every = np.ones(len(sets), bool)
    found = list(near_dedup._candidates(sets, every, every, least))
    assert len(found) == len(set(found)) and all(i < j for i, j in found)
    assert set(found) >= {(i, j) for j in range(len(sets)) for i in range(j) if near_dedup.probability_jaccard(*sets[i], *sets[j]) >= least}


def test_buckets_of_one_large_component_and_others(documents):
    """Many near copies of one text, and texts a little too far from it and from each other: classes are those of brute force."""
    rng = random.Random(3)
    base = [f"b{rng.randrange(10**6)}" for _ in range(120)]

    def edited(n):
        words = base.copy()
        for at in rng.sample(range(0, 120, 6), n):
            words[at] = f"e{rng.randrange(10**6)}"
        return " ".join(words)

    docs = [(i, edited(1)) for i in range(90)] + [(1000 + i, edited(rng.randint(3, 7))) for i in range(60)]
    for block in (4, 1000):
        found = near_dedup.near_duplicates(documents(docs), block=block).collect()
        got = defaultdict(list)
        for r in found:
            got[r["class_id"]].append((False, r["doc_id"]))
        assert Counter(tuple(sorted(v)) for v in got.values()) == brute_classes(docs)


def test_recall_of_links_by_similarity(llm_spark):
    """All pairs of the table, by brute force: those of 0.8 and more are in one class; measured at lower settings too."""
    docs = llm_spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for words, least in ((5, 0.8), (3, 0.7)):
        sets = near_dedup.weighted_shingles([t for _, t in rows], words)
        having = defaultdict(set)
        for i, (_, e, _) in enumerate(sets):
            for x in e.tolist():
                having[x].add(i)
        pairs = {(i, j) for own in having.values() if 1 < len(own) <= 200 for j in own for i in own if i < j}
        near = [(i, j) for i, j in pairs if near_dedup.probability_jaccard(*sets[i][1:], *sets[j][1:]) >= least]
        of = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs, least=least, words=words).collect()}
        found = sum(of[rows[i][0]] == of[rows[j][0]] for i, j in near)
        assert len(near) > 50 and found >= 0.999 * len(near)


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))
    x, y = rng.integers(1, 4, 300), rng.integers(1, 4, 260)
    b = a[40:]
    s = near_dedup.signatures([(a, x), (b, y), (a[:1], x[:1]), (a[:0], x[:0])], 4096)
    estimate = float((s[0] == s[1]).mean())
    assert abs(estimate - near_dedup.probability_jaccard(a, x, b, y)) < 0.04
    assert (s[2] == a[0]).all() and (s[3] == 0).all()


def test_probability_jaccard_by_definition():
    a, x, b, y = np.array([1, 2, 3]), np.array([1, 2, 1]), np.array([2, 3, 4]), np.array([1, 3, 2])
    wa, wb = dict(zip(a.tolist(), x.tolist())), dict(zip(b.tolist(), y.tolist()))
    want = sum(1 / sum(max(wa.get(j, 0) / wa[i], wb.get(j, 0) / wb[i]) for j in {*wa, *wb}) for i in {*wa} & {*wb})
    assert near_dedup.probability_jaccard(a, x, b, y) == pytest.approx(want)


# ---- op 2


def test_language_profiles(llm_spark, documents, rows):
    rng = random.Random(4)
    syllables = {"en": ["the", "ing", "tion", "and", "er"], "de": ["ich", "ein", "sch", "ung", "der"]}
    train = [(lang, " ".join("".join(rng.choices(s, k=2)) for _ in range(200))) for lang, s in syllables.items() for _ in range(6)]
    labelled = llm_spark.createDataFrame([*train, (None, "the the"), ("en", None)], "lang string, text string")
    profiles = langid.learn(labelled)
    assert profiles.languages == ["de", "en"]
    assert profiles.predict(["the and thing", "ich und der schung", None, "123 !!", ""])[0] == ["en", "de", "und", "und", "und"]
    got = langid.identify(documents(rows), profiles).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (2, 3, 9, 12)} == {"und"}
    kept = langid.filter_rows(documents(rows), profiles)
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, t in rows if any(c.isalpha() for c in t or ""))
    none = langid.learn(labelled.filter("false"))
    assert none.predict(["abc"]) == (["und"], [0.0]) and langid.filter_rows(documents(rows), none).count() == kept.count()
    assert langid.identify(documents([]), profiles).count() == 0


def test_ranks_by_brute_force():
    texts = ["Abba bab", None, "x"]
    place, code, count = langid.grams(texts)
    want = Counter()
    for w in ("abba", "bab"):
        p = f"_{w}_"
        want.update(list(w))
        want.update(p[i : i + 2] for i in range(len(p) - 1))
        want.update(p[i : i + 3] for i in range(len(p) - 2))
    assert sorted(count[place == 0].tolist()) == sorted(want.values())
    assert not (place == 1).any() and (place == 2).sum() == 4


def out_of_place(text, profiles, symbol):
    """Language and score by the definition, with dictionaries."""
    counts = Counter()
    for w in re.findall(r"[^\W\d_]+", "".join(c if c.isalpha() else " " for c in (text or "").lower())):
        p = [0, *(symbol[c] for c in w), 0]
        for n in (1, 2, 3):
            for i in range(len(p) - n + 1):
                g = p[i : i + n]
                if (n != 3 or g[1]) and (n != 1 or g[0]):
                    counts[n, *g] += 1
    own = sorted(counts, key=lambda g: (-counts[g], g))[: profiles.length]
    if not own:
        return "und", 0.0
    best = None
    for lang, codes, ranks in zip(profiles.languages, profiles.codes, profiles.ranks, strict=True):
        place = dict(zip(codes.tolist(), ranks.tolist(), strict=True))
        distance = 0
        for rank, g in enumerate(own):
            code = sum(x << langid.BITS * i for i, x in enumerate(reversed(g[1:]))) + (0, 0, 1 << 3 * langid.BITS, 2 << 3 * langid.BITS)[g[0]]
            distance += abs(place[code] - rank) if code in place else profiles.length
        if best is None or distance < best[0]:
            best = (distance, lang)
    return best[1], 1 - best[0] / (len(own) * profiles.length)


def test_predict_equals_out_of_place_distance(llm_spark):
    rng = random.Random(12)
    alphabets = {"aa": "abcdefgh", "bb": "cdefghij", "cc": "абвгдежз", "dd": "נסעףפצקר", "ee": "日本語漢字中文"}
    make = lambda letters, n: " ".join("".join(rng.choices(letters, k=rng.randint(1, 6))) for _ in range(n))
    rows = [(lang, make(letters, 40)) for lang, letters in alphabets.items() for _ in range(3)]
    profiles = langid.learn(llm_spark.createDataFrame(rows, "lang string, text string"), length=60)
    texts = [make(letters, n) for letters in alphabets.values() for n in (1, 5, 50)] + ["", None, "12 !", "a", "Ab1c-d", "абвгд נסעףפ"] + [make("abcxyz", 3) for _ in range(300)]
    langs, scores = profiles.predict(texts)
    symbol = {c: n + 1 for n, c in enumerate(x for x in map(chr, range(0x110000)) if x.isalpha())}
    want = [out_of_place(t, profiles, symbol) for t in texts]
    assert langs == [w for w, _ in want] and scores == pytest.approx([s for _, s in want])
    cyrillic, hebrew = (set(langid.grams([t])[1].tolist()) for t in ("абвгд", "נסעףפ"))
    assert not cyrillic & hebrew


# ---- op 10


def toxic_rows():
    rng = random.Random(6)
    vocab = [f"{a}{b}" for a in ("lor", "ips", "dol", "sit", "ame") for b in ("um", "or", "et", "is")]
    rows, labels = [], []
    for i in range(600):
        words = rng.choices(vocab, k=40)
        bad = i % 5 == 0
        if bad:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "grumblefest", "moron"]))
        rows.append((i, " ".join(words) + "."))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_learns_stems_and_scores(llm_spark, documents, rows):
    docs, labels = toxic_rows()
    table = llm_spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id bigint, toxic int")
    grammar = toxicity.learn(documents(docs), table)
    assert any(s.startswith("grum") for s in grammar.stems)
    got = {r["doc_id"]: r for r in toxicity.score(documents(docs), grammar).collect()}
    assert all(got[i]["predicted"] == k for i, k in labels) and all(0 <= r["score"] <= 1 for r in got.values())
    other = toxicity.score(documents(rows), grammar).collect()
    assert len(other) == len(rows) and not any(r["predicted"] for r in other)
    assert {r["doc_id"] for r in toxicity.filter_rows(documents(docs), grammar).collect()} == {i for i, k in labels if not k}
    assert toxicity.score(documents([]), grammar).count() == 0
    bare = toxicity.learn(documents(docs), table.filter("false"))
    assert set(bare.stems) == set(toxicity.INSULTS)


def test_grammar_weighs_clauses():
    g = toxicity.Grammar({"idiot": 3.0})
    weight = lambda t: sum(c[2] for c in g.clauses(t))
    plain = weight("an idiot, here.")
    assert weight("you idiot, here.") > plain > weight("he said an idiot, here.") > weight("he said not an idiot, here.")
    assert weight("not an idiot.") < plain and weight("not at all so very idiot.") == plain
    assert weight("he said so. an idiot.") == plain
    assert weight("kill the lights.") == 0 and weight("you, kill.") == 0 and weight("you kill.") > 0
    assert weight("i will kill you.") > weight("i will not kill you.") > 0 == weight("kill it all, you.")
    assert len(g.clauses("idiot one, two idiot. none; idiot")) == 3
    text = "first. you idiot, rest"
    (start, end, *_), = g.clauses(text)
    assert text[start:end].strip() == "you idiot"


def test_composition_is_the_product():
    following, weights = toxicity.compose(toxicity.negation(2), toxicity.reported())
    machines = (toxicity.negation(2), toxicity.reported())
    rng = random.Random(8)
    for _ in range(50):
        state, states, total, want = 0, [0, 0], 0.0, 0.0
        for kind in rng.choices(range(8), k=12):
            total += weights[state][kind]
            state = following[state][kind]
            for i, m in enumerate(machines):
                states[i], w = m.step(states[i], kind)
                want += w
        assert total == pytest.approx(want)


def interpreted(grammar, text):
    """The matched clauses of a text of plain words, as the rules say: weight and threats of each."""
    import math

    out = []
    for sentence in re.split(r"[.!?]", text):
        heard = False
        for clause in re.split(r"[,;]", sentence):
            words, weight, threats, matched = clause.split(), 0.0, 0, False
            for i, w in enumerate(words):
                before = words[:i]
                log = toxicity.NEGATED if any(x in toxicity.NEGATIONS for x in before[-3:]) else 0.0
                log += toxicity.REPORTED if heard else 0.0
                aimed = any(x in toxicity.TARGETS for x in before)
                if w in toxicity.INSULTS:
                    log += (toxicity.AIMED if aimed else 0.0) + (toxicity.FURTHER if any(x in toxicity.INSULTS for x in before) else 0.0)
                    weight, matched = weight + grammar.stems[w] * math.exp(log), True
                elif w in toxicity.THREATS and aimed:
                    weight, threats, matched = weight + toxicity.PRIOR_WEIGHT * math.exp(log + toxicity.AIMED), threats + 1, True
                elif w in toxicity.TARGETS and not aimed and any(x in toxicity.THREATS for x in before):
                    weight, threats, matched = weight + toxicity.PRIOR_WEIGHT * math.exp(log), threats + 1, True
                heard = heard or w in toxicity.REPORTS
            if matched:
                out.append((weight, threats))
    return out


def test_clauses_equal_a_plain_interpreter():
    rng = random.Random(15)
    grammar = toxicity.Grammar({w: 2.0 + i for i, w in enumerate(toxicity.INSULTS)})
    words = [*toxicity.INSULTS[:3], *toxicity.THREATS[:2], "you", "they", "not", "nie", "said", "word", "the", "house", "is", ",", ".", ";"]
    for _ in range(2000):
        text = " ".join(rng.choices(words, k=rng.randint(1, 14)))
        got = grammar.match(text)[0]
        want = interpreted(grammar, text)
        assert [c[3] for c in got] == [t for _, t in want] and [c[2] for c in got] == pytest.approx([w for w, _ in want])
    mention, bare = (grammar.match(t)[0][0][2] for t in ("the word idiot is in the dictionary", "idiot"))
    assert mention < bare / 2 and grammar.match("you are an idiot")[0][0][2] > bare


def held_out_rows(spark, query):
    import __spark_entry__ as entry

    d = "/root/testdata/sf0.1"
    return entry.queries()[query](spark, d).filter("held_out"), spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_toxicity_on_held_out_documents(llm_spark):
    found, _, labels = held_out_rows(llm_spark, "op10_toxicity")
    n = Counter((r["toxic"], r["predicted"]) for r in found.join(labels, "doc_id").select("toxic", "predicted").collect())
    assert n[1, 1] >= 0.9 * (n[1, 0] + n[1, 1]) and n[0, 1] <= 0.01 * (n[0, 0] + n[0, 1])


def test_language_on_held_out_documents(llm_spark):
    found, docs, _ = held_out_rows(llm_spark, "op2_language_id")
    pairs = found.join(docs.select("doc_id", "lang"), "doc_id").filter("lang is not null").select("lang", "lang_pred").collect()
    assert len(pairs) > 1000 and sum(r["lang"] == r["lang_pred"] for r in pairs) >= 0.99 * len(pairs)


# ---- texts of over a slice


def test_one_text_of_several_slices(documents):
    """A text of 3 MB, three slices long, is whole in every operator: against what is computed at once."""
    rng = random.Random(2)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(520_000))
    assert len(long) > 2 * (1 << 20)
    rows = [(1, long), (2, long + " x"), (3, long), (4, "short")]
    got = {r["doc_id"]: r for r in exact_dedup.deduplicate(documents(rows)).collect()}
    assert (got[3]["keep_id"], got[3]["group_size"], got[2]["keep_id"]) == (1, 2, 2) and got[1]["text_sha256"] == hashlib.sha256(long.encode()).hexdigest()
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(documents(rows)).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    ids = Tokenizer.from_file(WORDS).encode(long, add_special_tokens=False).ids
    assert {bytes(r["ids"]) for r in bpe.encode_decode(documents(rows[:1]), WORDS).collect()} == {np.array(ids, "<u4").tobytes()}
    assert {(r["n_bytes"], r["payload_sha256"]) for r in media.media_columns(documents(rows[:1])).collect()} == {(len(long), hashlib.sha256(long.encode() + bytes(-len(long) % 64)).hexdigest())}
    blocks, manifest = token_counts.write_flat(documents(rows[:1]), BYTES, public_tokenizers.PATTERN, 50256)
    (found,) = token_counts.separator_scan(blocks, 50256).collect()
    assert found["complete"] and blocks.count() == -(-(found["n_tokens"] + 1) // token_counts.BLOCK)
    packed = packing.pack_documents(documents(rows[:1]), WORDS).collect()
    assert sum(r["length"] for r in packed) == len(ids) + 1 and sorted(r["piece"] for r in packed) == list(range(len(packed)))


# ---- common


def test_bloom_finds_all(llm_spark):
    from pyspark.sql import functions as F

    keys = llm_spark.range(500).select(F.xxhash64("id").alias("h"))
    bloom = Bloom.of(keys, "h", 1 << 14)
    values = np.array([r["h"] for r in keys.collect()])
    assert bloom.find(values).all() and all(int(v) in bloom for v in values)
    others = np.array([r["h"] for r in llm_spark.range(10**6, 10**6 + 2000).select(F.xxhash64("id").alias("h")).collect()])
    assert bloom.find(others).mean() < 0.05
    assert not Bloom.of(keys.filter("false"), "h", 1 << 14).find(values).any()


def test_numbered_rows_of_files_and_of_others(llm_spark, documents, rows):
    for clash in (False, True):
        df = documents(rows, clash=clash)
        for own in (stored(df), df):
            n, row = numbered(own)
            assert n.columns == [*df.columns, row] and n.select(row).distinct().count() == len(rows)
            dropped = stored(n.filter("doc_id = 8").select(row))
            out = without(n, dropped, row)
            assert out.columns == df.columns and out.count() == len(rows) - 2
            assert without(n, dropped.filter("false"), row).count() == len(rows)
        assert numbered(stored(df))[0].schema[row].dataType.simpleString() == "struct<file:string,at:bigint>"
    assert fresh("row_", ["a", "ROW_", "row__"]) == "row___"


def test_the_callers_session_keeps_its_settings(llm_spark, documents, rows):
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [llm_spark.conf.get(n) for n in names]
    own = bounded(documents(rows))
    assert [own.sparkSession.conf.get(n) for n in names] == ["1000", str(8 << 20)]
    near_dedup.near_duplicates(documents(rows[:2])).count()
    exact_dedup.keep_first(documents(rows[:2])).count()
    assert [llm_spark.conf.get(n) for n in names] == before
    assert own.join(documents(rows).select("doc_id"), "doc_id").count() == own.select("doc_id").join(documents(rows), "doc_id").count()


def test_release_deletes_what_was_written(llm_spark):
    kept = stored(llm_spark.range(3))
    assert kept.count() == 3 and release(llm_spark) >= 1 and release(llm_spark) == 0


def test_profiles_are_learned_from_distinct_texts(llm_spark):
    # 2000 copies of each of two texts, and 4 texts once: whatever is drawn, both languages have a profile, and copies count once
    rows = [("aa", t) for t in ("abba baab", "bbaa aabb") for _ in range(2000)] + [("bb", f"xyz{k} zyx") for k in "efgh"]
    df = llm_spark.createDataFrame(rows, "lang string, text string")
    once = langid.learn(llm_spark.createDataFrame(sorted(set(rows)), "lang string, text string"))
    assert langid.learn(df, most=1).languages == once.languages == ["aa", "bb"]
    got = langid.learn(df, most=2)
    aa = langid.learn(llm_spark.createDataFrame(sorted(set(rows[:4000])), "lang string, text string"))
    assert np.array_equal(got.codes[0], aa.codes[0]) and np.array_equal(got.ranks[0], aa.ranks[0])


def test_profiles_and_floor_come_from_all_texts(llm_spark):
    # 6000 texts, each of a word of its own; and as many of 12 words each, in more letters or fewer
    words = ["".join(w) for w in itertools.islice(itertools.product("abcdefghijklmnopqrstuvwxyz", repeat=3), 6000)]
    profiles = langid.learn(llm_spark.createDataFrame([("aa", w) for w in words], "lang string, text string"), length=100_000)
    codes = np.unique(langid.grams(words)[1])
    assert np.array_equal(profiles.codes[0], codes)
    rng = random.Random(5)
    rows = [("aa", " ".join("".join(rng.choices("abcdefghij"[: rng.randint(2, 10)], k=6)) for _ in range(12))) for _ in range(6000)]
    profiles = langid.learn(llm_spark.createDataFrame(rows, "lang string, text string"))
    _, scores, n = profiles.measure([t for _, t in rows])
    low, middle = np.quantile([x for x, k in zip(scores, n, strict=True) if k >= langid.JUDGED], [0.001, 0.5])
    df = llm_spark.createDataFrame([(i, *r) for i, r in enumerate(rows)] + [(-1, None, "zz"), (-2, "aa", None)], "doc_id bigint, lang string, text string")
    assert abs(langid.floor(df, profiles) - max(0.0, 2 * low - middle)) < 1e-12 and 2 * low > middle


def test_quantiles_by_brute_force(llm_spark):
    for values in ([0.25], [1.0, 0.0], [0.5] * 7 + [0.5 + 1e-9] * 2 + [0.1, 1.0], [k / 977 for k in range(978)]):
        n, got = langid.quantiles(llm_spark.createDataFrame([(x,) for x in values], "score double"), (0.0, 0.001, 0.5, 1.0))
        assert n == len(values) and np.abs(np.quantile(values, [0.0, 0.001, 0.5, 1.0]) - got).max() < 1e-12
    assert langid.quantiles(llm_spark.createDataFrame([], "score double"), (0.5,)) == (0, [0.0])
