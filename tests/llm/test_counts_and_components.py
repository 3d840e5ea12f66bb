"""Operators 11 to 13: against the tokenizer library, numpy's eigenvalues and plain counting."""

import gc
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from timberline.llm import collocations, queries, tokencounts, whitening
from timberline.llm.common import give_back, table

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


def path():
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(path())
    return lambda text: len(lib.encode(text, add_special_tokens=False).ids)


# --- 11: token counts -----------------------------------------------------

def test_token_counts_of_the_whole_table(spark, library):
    got = {r["doc_id"]: r for r in queries.QUERIES["op11_token_counts"](spark, SF).collect()}
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for r in docs:
        text, g = r["text"] or "", got[r["doc_id"]]
        n = library(text)
        assert (g["n_bytes"], g["n_tokens"], g["over_limit"]) == (len(text.encode()), n, n > 512)


STRINGS = st.text(st.sampled_from("aeiourstlndTHE'  \n\t.,-19é 漢字😀　́") | st.characters(codec="utf-8"), max_size=40)


@settings(max_examples=150, deadline=None)
@given(text=STRINGS | st.tuples(STRINGS, STRINGS).map("</s>".join) | st.tuples(STRINGS, STRINGS).map("<|endoftext|>".join))
def test_every_prefix_counts_like_the_library(library, text):
    steps = next(iter(tokencounts.counter(path()).steps([text])))
    counts = np.cumsum(np.frombuffer(steps, "<i2"), dtype=np.int64)
    assert counts.tolist() == [library(text[:i + 1]) for i in range(len(text))]


def test_token_count_cases(spark, library):
    long = " ".join(f"w{i % 977}x{i % 1013}" for i in range(60_000))
    rows = [(0, None, "a"), (1, "", "a"), (2, " \n\t ", "a"), (3, "don't stop they'll</s>", "a"), (4, long, "b"), (5, "x" * 5000, "b"),
            (6, "same words", "c"), (6, "same words", "c"), (None, "no id", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").withColumn("n_tokens", F.lit("mine"))
    out = tokencounts.prefix_table(docs, path(), ["doc_id", "row", "n_tokens"], budgets=[3, 0])
    assert out.columns == ["doc_id", "row", "n_bytes", "n_chars", "n_tokens", "within", "steps"]
    got = out.select("*", tokencounts.tokens_of(F.col("steps"), F.lit(2)).alias("two"),
                     tokencounts.prefix_within(F.col("steps"), F.lit(3)).alias("three")).collect()
    assert len(got) == len(rows)
    text_of = {i: t or "" for i, t, _ in rows}
    for r in got:
        text = text_of[r["doc_id"]]
        assert (r["n_tokens"], r["n_chars"], r["two"]) == (library(text), len(text), library(text[:2]))
        longest = max((i for i in range(min(len(text), 200) + 1) if library(text[:i]) <= 3), default=0)
        assert r["within"][0] == r["three"] == longest and r["within"][1] == 0
    cut = tokencounts.truncated(docs, path(), 3)
    assert cut.columns == docs.columns and {r["n_tokens"] for r in cut.collect()} == {"mine"}
    assert all(r["text"] is None or library(r["text"]) <= 3 for r in cut.collect())
    assert tokencounts.prefix_table(docs.where("false"), path()).count() == 0


def test_other_tokenizers_are_refused():
    import public_tokenizers
    with pytest.raises(ValueError):
        tokencounts.PrefixCounter(public_tokenizers.path("word_bpe_49k.json"))


# --- 12: whitening --------------------------------------------------------

def brute_whitening(vectors, most=32):
    """By numpy's eigenvalues; fixed-point entries, exact sums."""
    x = (np.floor(64 * np.asarray(vectors, np.float64)).astype(np.int64) + 1_000_000).astype(object)
    n, total = len(x), x.sum(axis=0)
    d = n * x - total
    c = d.astype(float) / n
    v = c.T @ c / n
    values, pairs = np.linalg.eigh(v)
    values, pairs = values[::-1][:most], pairs[:, ::-1][:, :most]
    return n, [int(s) for s in (d * d).sum(axis=1)], c @ pairs / np.sqrt(values), values / np.trace(v), values


def test_whitening_of_the_whole_table(spark):
    got = {(r["vec_id"], r["component"]): r for r in queries.QUERIES["op12_whitening"](spark, SF).collect()}
    rows = [r for r in table(spark, SF, "embeddings").collect()
            if r["embedding"] is not None and all(c is not None and np.isfinite(c) for c in r["embedding"])]
    n, deviation, white, explained, values = brute_whitening([r["embedding"] for r in rows])
    assert len(got) == len(rows) * white.shape[1]
    mine = np.array([[got[r["vec_id"], k + 1]["whitened"] for k in range(white.shape[1])] for r in rows])
    for i, r in enumerate(rows):
        one = got[r["vec_id"], 1]
        assert (one["n"], one["deviation"]) == (n, deviation[i]) and one["identity_error"] <= 1e-4
    for k in range(white.shape[1]):
        assert abs(got[rows[0]["vec_id"], k + 1]["explained"] / explained[k] - 1) < 1e-9
        near = np.min(np.abs(np.delete(values, k) - values[k])) / values[k]
        sign = np.sign(mine[:, k] @ white[:, k])
        assert np.abs(sign * mine[:, k] - white[:, k]).max() < 1e-9 / max(near, 1e-12)
    assert np.abs(mine.T @ mine / n - np.eye(mine.shape[1])).max() < 1e-6


@pytest.mark.parametrize("kind", ["spread", "clustered", "equal", "low rank", "one", "zero"])
def test_contours_find_every_eigenvalue(spark, kind):
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.normal(size=(48, 48)))[0]
    spectrum = {"spread": np.logspace(3, -3, 48), "clustered": 1 + 1e-7 * np.arange(48), "equal": np.repeat([5.0, 2.0, 1.0], 16),
                "low rank": np.concatenate([np.linspace(9, 1, 5), np.zeros(43)]), "one": np.eye(1, 48)[0] * 7, "zero": np.zeros(48)}[kind]
    v = (q * spectrum) @ q.T
    values, pairs = whitening.leading_pairs(spark, (v + v.T) / 2, 32)
    real = np.sort(spectrum[spectrum > 0])[::-1][:32]
    assert len(values) == len(real)
    if len(real):
        assert np.abs(values / real - 1).max() < 1e-8
        assert np.abs(pairs.T @ pairs - np.eye(len(real))).max() < 1e-12
        assert np.linalg.norm(v @ pairs - pairs * values, axis=0).max() < 1e-11 * spectrum.max()


def test_inertia_counts():
    rng = np.random.default_rng(6)
    a = rng.normal(size=(30, 30))
    v = a + a.T
    diagonal, beside = whitening.tridiagonal(v)
    own = np.linalg.eigvalsh(v)
    for x in np.linspace(own[0] - 1, own[-1] + 1, 57):
        assert whitening.below(diagonal, beside, x) == (own < x).sum()


def test_whitening_cases(spark):
    rng = np.random.default_rng(7)
    good = rng.normal(size=(40, 3)).round(2).tolist()
    rows = [(i, v) for i, v in enumerate(good)] + [(0, good[0]), (90, None), (91, []), (92, [1.0, None, 2.0]), (93, [1.0, float("nan"), 2.0]),
                                                  (94, [float("inf"), 0.0, 0.0]), (95, [1.0, 2.0]), (None, good[1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("whitened", F.lit("mine")).withColumn("v", F.lit(1))
    model = whitening.fit(df)
    out = whitening.whitened(df, model).collect()
    assert model.n == len(out) == 42 and len(model.values) == 3 and model.identity_error < 1e-9
    n, deviation, white, explained, _ = brute_whitening([*good, good[0], good[1]])
    assert sorted(r["deviation"] for r in out) == sorted(deviation) and np.allclose(model.explained, explained)
    same = whitening.fit(df.where("vec_id = 0"))
    assert same.n == 2 and len(same.values) == 0  # copies of one vector vary in nothing
    assert [len(r["whitened"]) for r in whitening.whitened(df.where("vec_id = 0"), same).collect()] == [0, 0]
    assert whitening.fit(df.where("false")) is None and whitening.whitened(df, None).count() == 0


# --- 13: collocations -----------------------------------------------------

def brute_phrases(rows, support, top, share):
    from collections import Counter
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = []
    for lang in n:
        found = {p: a for (g, p), a in f.items() if g == lang and len(p) > 1 and a >= support}
        rows = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= share * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            cuts = [(1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


@pytest.mark.parametrize("shards", [1, 3, 7])
def test_phrases_against_plain_counting(spark, shards):
    rng = random.Random(shards)
    words = ["a", "B", "cé", "d", "ÀB", "z y", "e"]
    rows = [(i % 40, rng.choice([None, "en", "de"]), "".join(rng.choice(words) + rng.choice([" ", " ", "\t", ", ", ".\n", "  "]) for _ in range(rng.randrange(30))))
            for i in range(120)] + [(None, "en", "a b a b a b a b"), (200, None, None), (201, "en", ""), (202, "xx", " .,")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("slot", F.lit("mine")).withColumn("n", F.lit(-1))
    got = collocations.collocations(docs, support=5, top=12, share=50, shards=shards)
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases([r[1:] for r in rows], 5, 12, 50)
    assert collocations.collocations(docs.where("false")).count() == 0


def test_mined_phrases_travel_by_range_with_capped_repeats():
    import pyarrow as pa
    texts = ["the same words " * 500 + ". " + " ".join(f"w{i}" for i in range(500))] * 2
    batch = pa.RecordBatch.from_pydict({"lang": ["de", "en"], "slot": [3, (1 << 32) + 2], "text": texts})
    out = pa.Table.from_batches(collocations._mined(3, 4)(iter([batch]))).to_pylist()
    assert len(out) <= 2 * 16 and len({(r["part"], r["slot"]) for r in out}) == len(out)
    for slot, least in ((3, 3), ((1 << 32) + 2, 2)):  # 503 words, 500 + 2 pairs, 500 + 2 triples; 9 of them 500 times
        keys = [np.frombuffer(r["keys"], "<u4") for r in out if r["slot"] == slot]
        assert sum(map(len, keys)) == 500 + 499 + 498 + 9 * least
        assert max(collocations.counts(np.sort(k))[1].max() for k in keys) == least
    found = [collocations._frequent(4)(pa.Table.from_pylist([r for r in out if r["part"] == p], pa.schema(
        [("part", pa.int32()), ("slot", pa.int64()), ("keys", pa.binary())]))).num_rows for p in {r["part"] for r in out}]
    assert sum(found) == 2 * 9


def test_ends_of_tokens_tell_their_ids(library):
    of = tokencounts.counter(path())
    assert all(of.tails[t] == i for t, i in of.ids.items())  # one look-up tells a token, an end of one, or neither
    assert {t for t, i in of.tails.items() if i < 0}.isdisjoint(of.ids) and all(t[k:] in of.tails for t in of.ids for k in range(len(t)))
    for text in ["a\x1c\x1db don't re-ally's ½x²", "Fürs\x85chpf 42,5### ok\n\n don't ", "\xa0x  y"]:
        counts = np.cumsum(np.frombuffer(next(iter(of.steps([text]))), "<i2"), dtype=np.int64)
        assert counts.tolist() == [library(text[:i + 1]) for i in range(len(text))]


def prefixes(text, library):
    return [library(text[:i + 1]) for i in range(len(text))]


@pytest.fixture
def new_counter():
    """A list of one; its memory is given back after, as other tests measure this process."""
    own = [tokencounts.PrefixCounter(path())]
    yield own
    own.clear()
    gc.collect()
    give_back()


def test_words_share_the_walk_of_their_beginnings(library, new_counter, monkeypatch):
    of, walked = new_counter[0], []
    move = of._move

    def every_byte(state, byte):  # forgets it, so that the next one is seen here, too
        to = move(state, byte)
        state[1].clear()
        walked.append(byte)
        return to
    monkeypatch.setattr(of, "_move", every_byte)
    words = [" handles", " hand", " wordless", " handle", " words", " handling", " word", " hand"]
    text = "".join(words)
    counts = np.cumsum(np.frombuffer(next(iter(of.steps([text]))), "<i2"))
    assert counts.tolist() == prefixes(text, library)
    assert len(walked) == len({w[:k] for w in words for k in range(1, len(w) + 1)})


def test_token_counts_while_everything_is_forgotten(library, new_counter, monkeypatch):
    for name, value in {"SEEN_PAIRS": 5, "CACHE_PARTS": 2, "CACHE_UNITS": 3, "CACHE_LENGTH": 6, "CHUNK_CHARS": 30}.items():
        monkeypatch.setattr(tokencounts, name, value)
    of = new_counter[0]
    texts = ["handled handles, handling.", None, "  \n handled\t\tHANDLED  ", "they'll they're 'll", " ", "", "x" * 70 + " unbreakableword unbreakablewords</s> ok",
             "naïve naïveté 漢字　漢字 é", "handled  handles", "\r\n\x85\xa0 a"]
    for text, steps in zip(texts, of.steps(texts)):
        assert np.cumsum(np.frombuffer(steps, "<i2")).tolist() == prefixes(text or "", library)
