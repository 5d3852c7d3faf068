"""Operators that SQL can't express against plain Python on small input."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from spanwright.llm import hnsw, languageid, neardup, queries, sentencepiece, simhash, suffixes, tokencount
from spanwright.llm.store import Scratch

FOLDER = "/root/testdata/sf0.001"
MAX = simhash.MAX_BITS


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    return {r["doc_id"]: r["text"] for r in rows}


def roots(n, pairs):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i
    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(i) for i in range(n)]


def plain_removed(data, length=200):
    """Per text: bytes, removed, runs, digest of the rest."""
    seen = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, np.int64)
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def answers(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


def test_suffixes_on_whole_table(spark, texts):
    got = answers(queries.QUERIES["op1_suffix_dedup"](spark, FOLDER))
    ids = list(texts)
    assert got == dict(zip(ids, plain_removed([(texts[i] or "").encode() for i in ids])))


@pytest.mark.parametrize("batches", [1, 3, 5])
def test_suffixes_of_planted_repeats(spark, monkeypatch, batches):
    monkeypatch.setattr(suffixes, "SEGMENT", 700)
    rng = np.random.default_rng(batches)
    word = lambda n: "".join(rng.choice(list("abcdefgh é"), n))
    shared = [word(n) for n in (150, 199, 200, 201, 260, 500, 1500)]
    data = ["", "short", "x" * 199, "y" * 700, None]
    for _ in range(40):
        parts = [word(int(rng.integers(0, 300)))]
        for i in rng.integers(0, len(shared), int(rng.integers(0, 4))):
            start = int(rng.integers(0, 60))
            parts += [shared[i][start:], word(int(rng.integers(0, 120)))]
        data.append("".join(parts))
    data += data[10:14] + [data[12][:-3] + "zz"]
    rows = list(enumerate(data))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = answers(suffixes.without_repeats(df, ["doc_id"], batches=batches))
    assert got == dict(enumerate(plain_removed([(t or "").encode() for t in data])))


def test_index_levels_merge_geometrically(spark):
    rows = [(i, f"{i:03d}" * 100) for i in range(14)]
    named = suffixes._named(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", [])
    index = suffixes.SuffixIndex(Scratch(spark, "levels"))
    sizes = []
    for i in range(7):
        batch = named.where(f"doc % 7 = {i}").selectExpr("doc", "check << 41 AS at", "data")
        index.add(suffixes._suffixes(batch, 64, 200))
        sizes.append(sorted(w for w, *_ in index.levels))
    assert sizes == [[1], [2], [1, 2], [4], [1, 4], [2, 4], [1, 2, 4]]
    total = sum(df.count() for _, df, _ in index.levels)
    assert total == suffixes._suffixes(named.selectExpr("doc", "check << 41 AS at", "data"), 64, 200).count()


def plain_fingerprint(text):
    words = bytes((text or "").encode().lower()).split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    out = 0
    for bit in range(64):
        ones = sum(xxhash.xxh64_intdigest(s, 42) >> bit & 1 for s in shingles)
        out |= (ones * 2 > len(shingles)) << bit
    return out


def test_simhash(spark, texts):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.QUERIES["op9_simhash"](spark, FOLDER).collect()}
    ids = sorted(texts)
    fps = [plain_fingerprint(texts[i]) for i in ids]
    near = [(a, b) for a in range(len(ids)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 3]
    root = roots(len(ids), near)
    assert got == {i: (f"{f:016x}", ids[r]) for i, f, r in zip(ids, fps, root)}
    assert len(near) > 10


def test_simhash_tiles_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 1 << 62, 12)]
    fps = sorted({b ^ sum(1 << int(k) for k in rng.integers(0, 62, int(rng.integers(0, 5)))) for b in base for _ in range(30)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = roots(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 3])
    for tile in (4, 512):
        found = simhash.links(df, Scratch(spark, "tiles"), tile=tile).collect()
        place = {f: i for i, f in enumerate(fps)}
        assert all(bin(r["a"] ^ r["b"]).count("1") <= 64 for r in found)
        assert roots(len(fps), [(place[r["a"]], place[r["b"]]) for r in found]) == want


def plain_neardup(rows, cosine=0.98):
    unit = {}
    for i, (_, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64)
            unit[i] = x / np.sqrt((x * x).sum())
    pairs = [(a, b) for a in unit for b in unit if a < b and rows[a][2] == rows[b][2]
             and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine]
    links = Counter(i for p in pairs for i in p)
    root = roots(len(rows), pairs)
    least = defaultdict(lambda: 1 << 60)
    for i, r in enumerate(root):
        least[r] = min(least[r], rows[i][0])
    return {rows[i][0]: (links[i], least[root[i]], rows[i][0] == least[root[i]]) for i in range(len(rows))}


@pytest.mark.parametrize("cell, tile", [(2048, 1024), (20, 7)])
def test_neardup(spark, monkeypatch, cell, tile):
    monkeypatch.setattr(neardup, "CELL_ROWS", cell)
    monkeypatch.setattr(neardup, "SAMPLE_PER_CELL", 1 << 20 if cell < 100 else 64)
    rng = np.random.default_rng(0)
    base = rng.normal(size=(20, 12))
    rows = [(100 + i, (base[i % 20] + rng.normal(size=12) * 0.14).tolist(), int(i % 20 % 3)) for i in range(300)]
    rows += [(1000 + i, base[0].tolist(), 0) for i in range(30)]
    rows += [(5, None, 0), (6, [0.0] * 12, 0), (7, [float("nan")] + [1.0] * 11, 0), (8, [None] + [1.0] * 11, 0),
             (9, base[0].tolist(), None), (10, [], 0), (11, [1.0, 2.0], 0), (12, [2.0, 4.0], 0), (13, [float("inf")] * 12, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"])
           for r in neardup.near_duplicates(df, tile=tile).collect()}
    assert got == plain_neardup(rows)


def test_neardup_on_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"])
           for r in queries.QUERIES["op10_neardup"](spark, FOLDER).collect()}
    assert got == plain_neardup(rows)


def plain_nearest(rows, queries_of, k):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], np.float64)
    out = {}
    for i in np.flatnonzero(queries_of(ids)):
        score = x @ x[i]
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


@pytest.mark.parametrize("folder, shard", [("/root/testdata/sf0.1", 512), ("/root/testdata/sf0.1", 8192)])
def test_hnsw_recall(spark, monkeypatch, folder, shard):
    v = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")
    got = defaultdict(list)
    for r in hnsw.search_table(v, v.where("vec_id % 20 = 0"), 20, shard_rows=shard).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    want = plain_nearest([tuple(r) for r in v.collect()], lambda i: i % 20 == 0, 20)
    assert got.keys() == want.keys() and all(len(got[q]) == 20 for q in got)
    hit = sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want)
    assert hit >= 0.9 * 20 * len(want)
    exact = {q: dict(s) for q, s in want.items()}
    for q in got:
        assert all(abs(s - exact[q][a]) < 1e-12 for a, s in got[q] if a in exact[q])


def test_hnsw_with_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=6) * rng.uniform(0.2, 3)).tolist()) for i in range(150)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)]
    odd = [(200, None), (220, [0.0] * 6), (240, [float("nan")] * 6), (260, []), (None, rows[1][1]), (280, [1.0, 2.0]), (300, [2.0, 1.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in hnsw.search_table(df, df.where("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert got.pop(280) == [(300, 4.0)] and got.pop(300) == [(280, 4.0)]
    want = plain_nearest(rows, lambda i: i % 20 == 0, 20)
    assert got.keys() == want.keys()
    hit = sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want)
    assert hit >= 0.98 * 20 * len(want)
    assert all(s[:5] == sorted(s[:5], key=lambda t: (-t[1], t[0])) for s in got.values())


def test_language_held_out(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.QUERIES["op6_language_id"](spark, folder).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [d for d, r in got.items() if r["held_out"]]
    assert len(got) == len(truth) and 100 < len(held) < 300
    assert sum(got[d]["lang_pred"] == truth[d] for d in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_token_counts(spark, texts):
    import base64

    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open("/opt/tokenizers/byte_bpe_50k.tiktoken", "rb"))}
    encoding = tiktoken.Encoding("t", pat_str=tokencount.PATTERN, mergeable_ranks=ranks, special_tokens={})
    lengths = np.array([len(encoding.encode_ordinary(t or "")) for t in texts.values()])
    got = {r["context_limit"]: r for r in queries.QUERIES["op2_token_counts"](spark, FOLDER).collect()}
    assert set(got) == set(lengths.tolist())
    for limit, r in got.items():
        assert r["tokens_truncated"] == np.minimum(lengths, limit).sum()
        assert r["docs_longer"] == (lengths > limit).sum() and r["docs_within"] == (lengths <= limit).sum()
        assert r["tokens_within"] == lengths[lengths <= limit].sum() and r["tokens_total"] == lengths.sum()
        assert r["quantile"] == pytest.approx((lengths <= limit).mean())
    histogram = tokencount.length_histogram(tokencount.token_lengths(
        spark.read.parquet(f"{FOLDER}/documents.parquet"), "/opt/tokenizers/byte_bpe_50k.tiktoken"))
    for r in tokencount.at_limits(histogram, [1, 100, 10 ** 6]).collect():
        assert r["tokens_truncated"] == np.minimum(lengths, r["context_limit"]).sum()


def test_sentencepiece_parity_on_whole_table(spark, texts):
    import sentencepiece as library
    model = "/opt/tokenizers/piece_bpe_32k.model"
    sp = library.SentencePieceProcessor(model_file=model)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    encoded = sentencepiece.encode(docs, model, ["doc_id"], check_every=3)
    got = {r["doc_id"]: r for r in encoded.collect()}
    assert {d: list(r["token_ids"]) for d, r in got.items()} == {d: sp.encode(t or "") for d, t in texts.items()}
    assert all(r["round_trip"] for r in got.values())
    assert {r["parity"] for r in got.values()} == {None, True}
    back = {r["doc_id"]: r["text"] for r in sentencepiece.decode(encoded, model, ["doc_id"]).collect()}
    assert back == {d: t or "" for d, t in texts.items()}
