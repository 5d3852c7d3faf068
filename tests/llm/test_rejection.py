"""Language ID: rejected and kept texts, a plain version, and a rare language beside the others."""

import random

import pytest

from spanwright.llm import languageid as L

FOLDER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def learned(spark):
    """A model, and labelled texts that it has not seen."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    held = L.held_out(L.F.col("doc_id"))
    rows = docs.where(held & L.F.col("lang").isNotNull() & (L.F.length("text") > 0)).select("lang", "text").orderBy("doc_id").collect()
    return L.train(docs, ~held), [(r["lang"], r["text"]) for r in rows]


def rejected(model, texts):
    got = L.classifier(model)()(texts)["rejected"]
    return sum(got) / len(got)


def test_labelled_texts_stay(learned):
    model, held = learned
    got = L.classifier(model)()([t for _, t in held])
    assert sum(got["rejected"]) <= 0.02 * len(held)
    assert sum(p == lang for p, (lang, _) in zip(got["lang_pred"], held)) >= 0.98 * len(held)


@pytest.mark.parametrize("size", [300, 1000])
def test_texts_of_two_languages_go(learned, size):
    model, held = learned
    rng = random.Random(size)
    by = {}
    for lang, text in held:
        if len(text) >= size:
            by.setdefault(lang, []).append(text[:size])
    pairs = [rng.sample(sorted(by), 2) for _ in range(200)]
    assert rejected(model, [f"{rng.choice(by[a])} {rng.choice(by[b])}" for a, b in pairs]) >= 0.85


@pytest.mark.parametrize("size", [1000, 4000])
def test_texts_of_no_learned_language_go(learned, size):
    rng = random.Random(size)
    texts = []
    for _ in range(100):
        letters = rng.sample("abcdefghijklmnopqrstuvwxyz", 16)
        words = ["".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(80)]
        texts.append(" ".join(rng.choices(words, k=size // 6)))
    assert rejected(learned[0], texts) >= 0.9


def test_a_rare_language_changes_nothing_for_others(spark, learned):
    model, held = learned
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang")
    rare = [(-i, f"{'qxj kvw zzq jjx wqk vxz qqj '[i:] * 9}", "zz") for i in range(1, 9)]
    more = docs.where(~L.held_out(L.F.col("doc_id"))).unionByName(spark.createDataFrame(rare, docs.schema))
    texts = [t for _, t in held if len(L.normal(t)) >= 32]
    without, with_rare = L.classifier(model)()(texts), L.classifier(L.train(more, L.F.lit(True)))()(texts)
    # A few short texts that are near no language may be nearest to the new one; none goes to a third.
    changed = [b for a, b in zip(without["lang_pred"], with_rare["lang_pred"]) if a != b]
    assert set(changed) <= {"zz"} and len(changed) <= 0.005 * len(texts)
    assert sum(a == b for a, b in zip(without["rejected"], with_rare["rejected"])) >= 0.98 * len(texts)


def test_against_plain_compression(learned):
    """Compress each block with each dictionary and choose the smallest sum."""
    import zstandard
    model, held = learned
    packers = {}
    for name, content in model.dictionaries.items():
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        packers[name] = zstandard.ZstdCompressor(level=L.LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
    texts = [t for _, t in held if len(L.normal(t)) >= L.SHORT_BYTES][:150]
    got = L.classifier(model)()(texts)
    for text, pred, margin in zip(texts, got["lang_pred"], got["margin"]):
        data = L.normal(text)
        sizes = sorted((sum(len(p.compress(data[i:i + L.BLOCK_BYTES])) for i in range(0, len(data), L.BLOCK_BYTES)), name)
                       for name, p in packers.items())
        assert pred == sizes[0][1] and margin == pytest.approx((sizes[1][0] - sizes[0][0]) / sizes[1][0], abs=0.01)
