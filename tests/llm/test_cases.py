"""Small fixtures: NULLs, empty and long texts, ties, repeated rows, empty tables, clashing columns; brute force."""

import itertools
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from timberline.llm import bitpack, chat, components, covertree, grades, jaccard, mixing, packing, quality, repeats, secrets, tokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i % 1013}" for i in range(60_000))
LINE = " ".join(f"Word{i}" for i in range(60))

# every case that a stage has to bear
ROWS = [(0, None, None, None, None), (1, "", "en", "a", 0), (2, " \n\t ", "en", "a", 4), (3, "one two", "en", None, 7),
        (4, LONG, "en", "b", len(LONG)), (5, LINE + "\n" + LINE, "en", "b", 1), (6, LINE, None, "b", 2), (6, LINE, None, "b", 2),
        (None, LINE, "en", "c", 3), (7, "password = hunter2222 é AKIA" + "Q" * 16 + " " + "ab12" * 7, "en", "c", 9),
        (8, LINE.lower(), "de", "a", 5), (9, LONG + " end", "en", "a", 5)]
EXTRA = ("row", "shard", "sid", "mix_size", "quality_rules", "_blob", "_spans", "span", "kept", "removed", "length", "offset", "_cut", "u", "rep")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def odd(docs):
    """The same rows with columns named like everything inside."""
    return docs.select("*", *[F.lit("mine").alias(c) for c in EXTRA])


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- 1 and 9: models ------------------------------------------------------

def test_quality_rules_cases(spark, docs, odd, none):
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (6, None), (6, 7)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    out = {r["doc_id"]: r["quality_rules"] for r in quality.with_quality(docs, model).collect()}
    assert out[0]["n_words"] == 0 and out[0]["base_failed"] and not out[0]["kept"]
    assert out[5]["n_dup_lines"] == 1 and out[5]["n_repeat_words"] == 120 and out[5]["base_failed"]
    assert out[4]["n_words"] == 60_000
    assert quality.with_quality(none, model).count() == 0
    kept = quality.kept_documents(odd, labels)
    assert kept.columns == odd.columns and {r["quality_rules"] for r in kept.collect()} == {"mine"}
    assert quality.train(none, labels).weights is None and quality.train(docs, labels.where("false")).weights is None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60))
def test_repeat_words(words):
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i:i + 8]), []).append(i)
    assert quality.repeat_words(words) == len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)})


def test_calibration_keeps_the_base_rate():
    from timberline.llm import textmodel
    rng = np.random.default_rng(2)
    hit = rng.random(400) < 0.7
    z = np.where(hit, 3, -2) + rng.normal(size=400) * 4
    z[:20] = -60  # saturated from the start
    hit[:20] = False
    weight = np.full(400, 1 / 400)
    slope, shift = textmodel.calibrate(z, hit, weight)
    p = textmodel.sigmoid(slope * z + shift)
    assert slope > 0 and abs(p.mean() - hit.mean()) < 0.02


def test_grades_cases(docs, none):
    model = grades.train(docs, docs.selectExpr("doc_id", "1 AS g"), F.col("g"))
    assert model.weights is None
    assert {r["grade"]["expected_grade"] for r in grades.with_grade(docs, model).collect()} == {2.0}
    assert grades.with_grade(none, model).count() == 0


# --- 2: vectors -----------------------------------------------------------

def brute_vectors(data, cosine=0.98):
    data = [(i, label, e) for i, label, e in data]
    ok = [i is not None and label is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e) for i, label, e in data]
    unit = [np.array(e, np.float32).astype(float) / np.linalg.norm(np.array(e, np.float32).astype(float)) if g else None for (_, _, e), g in zip(data, ok)]
    links = [[j for j in range(len(data)) if i != j and ok[i] and ok[j] and data[i][1] == data[j][1] and len(unit[i]) == len(unit[j])
              and float(unit[i] @ unit[j]) >= cosine] for i in range(len(data))]
    parent = list(range(len(data)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, js in enumerate(links):
        for j in js:
            parent[find(i)] = find(j)
    groups = {}
    for i in range(len(data)):
        groups.setdefault(find(i), []).append(i)
    comp = {i: min((data[k][0] for k in g if data[k][0] is not None), default=None) for g in groups.values() for i in g}
    return sorted(((data[i][0], len(links[i]), comp[i] if ok[i] else data[i][0], data[i][0] is None or (comp[i] if ok[i] else data[i][0]) == data[i][0])
                   for i in range(len(data))), key=repr)


@pytest.mark.parametrize("cell_rows", [16, 4096])
def test_near_vectors(spark, cell_rows):
    rng = np.random.default_rng(1)
    data = []
    for label, n, k, noise in ((0, 150, 5, 0.05), (1, 80, 80, 0.3), (2, 60, 1, 0.02), (3, 90, 9, 0.12)):
        centre = rng.normal(size=(k, 6))
        data += [(label, (centre[rng.integers(k)] + rng.normal(size=6) * noise).astype(np.float32).tolist()) for _ in range(n)]
    data += [data[3]] * 20 + [(None, data[3][1]), (0, None), (0, []), (0, [0.0] * 6), (0, [float("nan")] + [1.0] * 5),
                              (0, [float("inf")] + [1.0] * 5), (0, [None] + [1.0] * 5), (0, data[3][1][:5])]
    ids = rng.permutation(len(data)).tolist()
    data = [(i, *x) for i, x in zip(ids, data)] + [(None, 0, data[3][1])]
    frame = spark.createDataFrame([(*d, "mine", 1) for d in data], "vec_id long, label int, embedding array<float>, rep string, m int")
    assert rows(covertree.near_vectors(frame, cell_rows=cell_rows)) == brute_vectors(data)
    assert covertree.near_vectors(frame.where("false")).count() == 0


# --- 3: bit packing -------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.data())
def test_bits_round_trip(bits, data):
    ids = np.array(data.draw(st.lists(st.integers(0, 2 ** bits - 1), max_size=70)), np.uint64).astype(np.uint32)
    raw = bitpack.pack(ids, bits)
    start = data.draw(st.integers(0, len(ids)))
    count = data.draw(st.integers(0, len(ids) - start))
    assert bitpack.unpack(raw, bits, start, count).tolist() == ids[start:start + count].tolist()
    assert len(raw) == -(-len(ids) * bits // 8)


def test_width():
    assert [bitpack.width(n) for n in (1, 2, 3, 256, 257, 50257, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]


def test_token_files(spark, odd, none, tmp_path, monkeypatch):
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_50k.json")
    bitpack.write_tokens(odd, str(tmp_path / "t"), path, 2)
    lib = tokens.encoder(path).lib
    out = bitpack.read_tokens(spark, str(tmp_path / "t"), with_ids=True).orderBy("start").collect()
    at = 0
    texts = {r[0]: r[1] for r in ROWS}
    assert [r["doc_id"] for r in out] == sorted((r[0] for r in ROWS), key=lambda d: (d is not None, d))
    for r in out:
        want = lib.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [2]
        assert np.frombuffer(r["ids"], "<u4").tolist() == want and r["start"] == at
        at += len(want)
    one = bitpack.read_tokens(spark, str(tmp_path / "t"), doc_id=5).collect()
    assert [tuple(r) for r in one] == [tuple(r)[:4] for r in out if r["doc_id"] == 5]
    bitpack.write_tokens(none, str(tmp_path / "e"), path, 2)
    assert bitpack.read_tokens(spark, str(tmp_path / "e")).count() == 0


WHITE = st.sampled_from([" ", "  ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "​"])
PIECE = st.one_of(WHITE, st.text(max_size=4), st.sampled_from(["'s", "it's", "a,b", "!?", "12 3", "<|endoftext|>", "<|startoftext|>", "É", "é", "ß", "Σ", "İ"]))


@settings(max_examples=150, deadline=None)
@given(st.lists(PIECE, max_size=12).map("".join))
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_units_equal_whole_text(name, text):
    import public_tokenizers
    e = tokens.encoder(public_tokenizers.path(name))
    assert e.unit is not None
    (raw,) = e.encode([text])
    assert np.frombuffer(raw, "<u4").tolist() == e.lib.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(PIECE, max_size=6).map("".join), max_size=12), st.integers(1, 9))
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_a_full_cache_begins_anew(name, texts, room):
    """A cache that is full after a few words gives the ids of the whole texts."""
    import public_tokenizers
    e = tokens.encoder(public_tokenizers.path(name))
    e.cache = {}
    with pytest.MonkeyPatch.context() as m:
        m.setattr(tokens, "CACHE_UNITS", room)
        m.setattr(tokens, "CHUNK_CHARS", 8)
        got = list(e.encode(texts))
    assert [np.frombuffer(raw, "<u4").tolist() for raw in got] == [e.lib.encode(t, add_special_tokens=False).ids for t in texts]


# --- 4: Jaccard join ------------------------------------------------------

def brute_jaccard(data, width, percent):
    import re
    sets = {}
    for doc, text in data:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[doc] = {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    comp = {d: d for d in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        s, t = sets[a], sets[b]
        if s and t and 100 * len(s & t) >= percent * len(s | t):
            x, y = comp[a], comp[b]
            comp = {d: min(x, y) if c in (x, y) else c for d, c in comp.items()}
    return sorted(((d, len(s), comp[d]) for d, s in sets.items()), key=repr)


def copies(seed, n=160):
    """Families of drifting copies: chains, copies of copies, shared halves."""
    draw = random.Random(seed)
    out = []
    for d in range(n):
        if out and draw.random() < 0.75:
            words = draw.choice(out)[:]
            for _ in range(draw.randint(0, 6)):
                at = draw.randrange(len(words))
                words[at:at + draw.randint(0, 1)] = [f"v{draw.randrange(50)}"]
        else:
            words = [f"w{draw.randrange(400)}" for _ in range(draw.choice((1, 2, 3, 5, 12, 30, 60, 120, 300)))]
        out.append(words or ["x"])
    return [(i, " ".join(w)) for i, w in enumerate(out)]


@pytest.mark.parametrize("seed,width,percent", [(1, 3, 90), (2, 5, 80), (3, 2, 70)])
def test_similar_documents(spark, seed, width, percent):
    data = copies(seed) + [(900, None), (901, ""), (902, " \n"), (903, "A b"), (904, "a  B\n")]
    frame = spark.createDataFrame(data, "doc_id long, text string")
    assert rows(jaccard.similar_documents(frame, width, percent)) == brute_jaccard(data, width, percent)


def test_jaccard_cases(docs, odd, none):
    out = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.similar_documents(docs).collect()}
    assert {(0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 1, 3), (5, 60, 5), (6, 58, 5), (8, 58, 5), (9, 59999, 4), (None, 58, None)} <= out
    assert len(out) == 11
    one = jaccard.one_of_each(odd)
    assert one.columns == odd.columns
    ids = [r["doc_id"] for r in one.collect()]
    assert sorted(i for i in ids if i is not None) == [0, 1, 2, 3, 4, 5, 7] and ids.count(None) == 1
    assert jaccard.similar_documents(none).count() == 0 and jaccard.one_of_each(none).count() == 0


def test_null_id_before_its_named_copy(spark):
    """A row without an id does not take the sketch from a named row of the same set in its task."""
    words = [f"w{i}" for i in range(200)]
    near = " ".join([*words, "more"])
    frame = spark.createDataFrame([(None, " ".join(words)), (1, " ".join(words)), (2, near)], "doc_id long, text string").coalesce(1)
    assert rows(jaccard.similar_documents(frame)) == sorted([(None, 198, None), (1, 198, 1), (2, 199, 1)], key=repr)
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in jaccard.one_of_each(frame).collect()) == [(False, 1), (True, None)]


def test_components(spark):
    draw = random.Random(4)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(170)] + [(400 + i, 401 + i) for i in range(60)] + [(500, 501 + i) for i in range(80)] + [(7, 7)]
    got = dict(rows(components.components(spark.createDataFrame(edges, "u long, v long"))))
    comp = {x: x for e in edges for x in e}
    for a, b in edges * 70:
        comp[a] = comp[b] = min(comp[a], comp[b])
    alone = {a for a, b in edges if a == b and all(a not in e for e in edges if e[0] != e[1])}
    assert got == {k: v for k, v in comp.items() if k not in alone}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- 5: chats -------------------------------------------------------------

def test_chat_parts(spark):
    part = "struct<kind:string,text:string,ref:string,width:bigint,height:bigint,seconds:double,pages:bigint>"
    p = lambda kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None: (kind, text, ref, width, height, seconds, pages)
    said = [(1, 0, "user", [p("text", "see <image 0> [x] 50%"), p("image", ref="s3://i", width=57, height=28), p("audio", ref="a", seconds=1.5),
                            p("document", ref="d", pages=2), p("video", ref="v")]),
            (1, 1, "assistant", [p("text", "</s>"), p("image", ref="out", width=1, height=1), p("text", "é%3C")]),
            (1, 1, "assistant", None), (2, None, None, [p(None, None)]), (2, 0, "assistant", []), (None, 3, "user", [p("text", "x")])]
    frame = spark.createDataFrame(said, f"conv_id long, turn long, role string, parts array<{part}>").withColumn("line", F.lit("mine"))
    out = {r["conv_id"]: r for r in chat.format_chats(frame).withColumn("turns", chat.parsed_turns(F.col("formatted"))).withColumn(
        "learned", chat.loss_text(F.col("formatted"), F.col("loss"))).collect()}
    one = out[1]
    assert one["n_turns"] == 3 and one["learned"] == "</s>é%3C"
    assert [(t["role"], t["text"]) for t in one["turns"]][0] == ("user", "see <image 0> [x] 50%<image 0><audio 1><document 2><other 3>")
    assert [(a["kind"], a["ref"], a["tokens"]) for a in one["attachments"]] == [
        ("image", "s3://i", 3), ("audio", "a", 38), ("document", "d", 1024), ("other", "v", 0), ("image", "out", 1)]
    assert "see %3Cimage 0>" in one["formatted"]
    assert [(t["role"], t["text"]) for t in out[2]["turns"]] == [("", ""), ("assistant", "")] and out[2]["learned"] == ""
    assert out[None]["n_turns"] == 1 and chat.format_chats(frame.where("false")).count() == 0


def test_escape_round_trip(spark):
    odd = ["", "%", "%25", "%3C", "<", "</s>", "<turn>", "[INST]", "%253C<[%5B", "é<" * 50, "%%<%2<5"]
    got = spark.createDataFrame([(x,) for x in odd], "t string").select(
        "t", chat.unescape(chat.escape(F.col("t"))).alias("back"), chat.escape(F.col("t")).alias("coded")).collect()
    assert all(r["t"] == r["back"] and "<" not in r["coded"] and "[" not in r["coded"] for r in got)


# --- 6: repeated lines ----------------------------------------------------

def test_repeats(docs, odd, none):
    got = {tuple(r) for r in repeats.repeated_units(docs).collect()}
    n = len(LINE)
    assert {r for r in got if r[3] == 60} == {(5, n + 1, 2 * n + 1, 60, 5, 0), (6, 0, n, 60, 5, 0), (8, 0, n, 60, 5, 0), (None, 0, n, 60, 5, 0)}
    out = repeats.without_repeats(odd)
    assert out.columns == [c for c in odd.columns if c != "removed"] + ["removed"]
    kept = {r["doc_id"]: r for r in out.collect()}
    assert kept[5]["text"] == LINE + "\n" and kept[6]["text"] == "" and kept[0]["text"] is None and kept[3]["text"] == "one two"
    assert [tuple(s) for s in kept[5]["removed"]] == [(n + 1, 2 * n + 1)] and kept[3]["_cut"] == "mine" and out.count() == len(ROWS)
    assert repeats.repeated_units(none).count() == 0 and repeats.without_repeats(none).count() == 0


def brute_runs(data, floor):
    """Spans of runs of repeated lines in one table of distinct (id, text) rows; quadratic."""
    order = sorted({d for d in data if d[1]}, key=lambda d: (d[0] is None, d[0] or 0, repeats.text_id(d[1])))
    seen, out = set(), {}
    for doc in order:
        lines, at = [], 0
        for line in doc[1].split("\n"):
            lines.append((at, at + len(line), tuple(line.encode().lower().split())))
            at += len(line) + 1
        marked, para = [], []
        for k, x in enumerate(lines + [(0, 0, ())]):
            if x[2]:
                para.append(k)
                continue
            whole = tuple(w for i in para for w in lines[i][2])
            again = len(para) > 1 and whole in seen
            for i in para:
                marked.append((lines[i], again or lines[i][2] in seen))
                seen.add(lines[i][2])
            seen.add(whole)
            para = []
        run = []
        for line, again in [*marked, (None, False)]:
            if again:
                run.append(line)
            else:
                if sum(len(x[2]) for x in run) >= floor:
                    out.setdefault(doc, []).append((run[0][0], run[-1][1]))
                run = []
    return out


SHORT = [" ".join(f"{c}{i}" for i in range(18)) for c in "abcd"]


def test_runs_of_short_lines_go(spark):
    """A passage of short lines, wrapped anew or not, is cut whole; a short repeated line alone stays."""
    passage = "\n".join(SHORT[:3])
    wrapped = passage.replace("\n", " ").replace("a9 ", "a9\n").replace("c2 ", "c2\n").upper()
    data = [(1, "head\n" + passage + "\ntail"), (2, "own\n" + passage + "\n\nmore"), (3, f"x y\n\n{passage}\n\n{SHORT[0]}\nlast é"), (4, "é\n\n" + passage + "\n\nz"),
            (5, "q\n\n" + wrapped + "\n\nr"), (6, SHORT[0] + "\nnew words"), (None, "one\n" + passage), (None, "a longer one\n" + passage + "\nend"), (7, None), (8, "")]
    frame = spark.createDataFrame(data, "doc_id long, text string")
    assert repeats.repeated_units(frame).count() == 0  # no line has 50 words
    out = {(r["doc_id"], r["text"]) for r in repeats.without_repeats(frame).collect()}
    assert out == {(1, data[0][1]), (2, "own\n\nmore"), (3, "x y\n\nlast é"), (4, "é\n\n\nz"), (5, "q\n\n\nr"), (6, data[5][1]), (None, "one\n"),
                   (None, "a longer one\nend"), (7, None), (8, "")}
    run = next(r for r in repeats.repeated_runs(frame).collect() if r["doc_id"] == 2)
    assert run["n_words"] == 54 and [(p["kept_doc_id"], p["kept_start"]) for p in run["parts"]] == [(1, 5), (1, 6 + len(SHORT[0])), (1, 7 + 2 * len(SHORT[0]))]


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_against_brute_force(spark, seed):
    draw = random.Random(seed)
    line = lambda: " ".join(draw.choice("abAB") for _ in range(draw.randint(0, 4)))
    data = list({(draw.choice([None, *range(30)]), "\n".join(line() for _ in range(draw.randint(0, 9)))) for _ in range(60)})
    got = {}
    for r in repeats.repeated_runs(spark.createDataFrame(data + data[:5], "doc_id long, text string").repartition(5), 6).collect():
        got.setdefault((r["doc_id"], r["text_id"]), []).append((r["start"], r["end"]))
    want = {(d, repeats.text_id(t)): spans for (d, t), spans in brute_runs(data, 6).items()}
    assert {k: sorted(v) for k, v in got.items()} == want and want


# --- 7: packing -----------------------------------------------------------

@settings(max_examples=80, deadline=None)
@given(st.integers(4, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=60))))
def test_plan(case):
    capacity, lengths = case
    counts = np.bincount(lengths, minlength=capacity + 1)
    groups = packing.plan(counts)
    used = np.zeros(capacity + 1, int)
    for items, n in groups:
        assert sum(x * k for x, k in items) <= capacity
        for x, k in items:
            used[x] += k * n
    assert (used == counts).all()
    places = packing.Places.of(groups, capacity)
    flat = np.array([x for x in range(capacity + 1) for _ in range(counts[x])], np.int64)
    rank = np.array([i for x in range(capacity + 1) for i in range(counts[x])], np.int64)
    if len(flat):
        sequence, offset = places.find(flat, rank)
        for _, g in pd.DataFrame({"s": sequence, "o": offset, "n": flat}).sort_values(["s", "o"]).groupby("s"):
            assert (g.n.cumsum() - g.n == g.o).all() and g.n.sum() <= capacity
        # best fit decreasing is within 22 % of the optimum, so a longer plan would be a fault
        assert len(set(sequence)) <= np.ceil(1.23 * sum(lengths) / capacity) + 1 or max(lengths) * 2 > capacity


def test_packing_cases(odd, none):
    import public_tokenizers
    path = public_tokenizers.path("word_bpe_49k.json")
    pieces, placed = packing.pack_documents(odd, path)
    out = placed.toPandas()
    assert len(out) == pieces.count() and (out[out.doc_id == 4].sort_values("piece").length[:-1] == 4096).all()
    assert out.groupby("sequence_id").length.sum().max() <= 4096
    back = packing.place(pieces.select("*", F.lit("x").alias("row"), F.lit("y").alias("offset")), 4096)
    assert back.columns == [*pieces.columns, "row", "sequence_id", "offset"] and back.count() == len(out)
    assert packing.pack_documents(none, path)[1].count() == 0


# --- 8: secrets -----------------------------------------------------------

def test_ledger_is_incremental(spark, docs, none, tmp_path):
    ledger = secrets.Ledger(spark, str(tmp_path / "l"))
    first = {r["doc_id"]: r["spans"] for r in secrets.scanned(docs, ledger).collect()}
    assert [(s["start"], s["kind_no"]) for s in first[7]] == [(0, 0), (24, 1), (45, 2)] and first[0] == []
    blobs = ledger.scans().count()
    assert blobs == len({(r[1] or "") for r in ROWS})
    again = docs.unionByName(spark.createDataFrame([(50, "token: abcdefgh", None, None, 1)], DOCS))
    assert {r["doc_id"]: r["spans"] for r in secrets.scanned(again, ledger).collect()}[7] == first[7]
    assert ledger.scans().count() == blobs + 1
    secrets.scanned(docs, ledger, "other")
    assert ledger.scans().where("version = 'other'").count() == blobs
    assert secrets.scanned(none, ledger).count() == 0


def test_failed_matches_are_consumed(spark, tmp_path):
    """A short value swallows the keyword in it; the match after it starts behind."""
    text = 'secret=token = abcdefgh API_KEY="abcdef" passwd: abc apikey:=x'
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (r,) = secrets.scanned(frame, secrets.Ledger(spark, str(tmp_path / "l"))).collect()
    assert [(s["start"], s["end"]) for s in r["spans"]] == [(24, 39)]


def test_redaction(spark, odd, tmp_path):
    out = secrets.redacted(odd, secrets.Ledger(spark, str(tmp_path / "l")))
    assert out.columns == odd.columns and out.count() == len(ROWS)
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[7]["text"] == "[SECRET] é [SECRET] [SECRET]" and got[7]["n_chars"] == len(got[7]["text"])
    assert got[0]["text"] is None and got[4]["text"] == LONG and got[3]["_blob"] == "mine"


# --- 10: mixing -----------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 9)), min_size=1, max_size=9), st.integers(0, 60))
def test_sainte_lague(parties, seats):
    votes, most = np.array([v for v, _ in parties], float), np.array([m for _, m in parties], np.int64)
    got = mixing.sainte_lague(votes, seats, most)
    want = np.zeros(len(parties), int)
    for _ in range(seats):
        open_ = [i for i in range(len(parties)) if want[i] < most[i] and votes[i] > 0]
        if not open_:
            break
        want[max(open_, key=lambda i: (votes[i] / (2 * want[i] + 1), -i))] += 1
    assert got.tolist() == want.tolist()


def test_targets():
    assert mixing.targets([10, 10, 80], [5, 2, 1]) == pytest.approx([30, 30, 40])
    assert mixing.targets([0, 5], [5, 2]) == pytest.approx([0, 5]) and mixing.targets([], []) == []


def test_mix_cases(odd, none):
    out = mixing.mix(odd).collect()
    assert len(out) == len(ROWS) and all(r["mix_taken"] <= 3 * r["mix_size"] for r in out)
    assert all(sum(s["to"] - s["from"] for s in r["mix_spans"]) == r["mix_taken"] for r in out)
    assert {r["shard"] for r in out} == {"mine"}
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns
    got = mixed.collect()
    assert sum(len(r["text"].split()) for r in got) == sum(r["mix_taken"] for r in out)
    assert all(r["n_chars"] == len(r["text"]) and r["mix_size"] == "mine" for r in got)
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0


@settings(max_examples=300, deadline=None)
@given(size=st.integers(1, 90), percent=st.sampled_from([80, 90]), seed=st.integers(0, 10**6))
def test_linked_sets_share_a_key(size, percent, seed):
    """At the very bound, with the differing shingles put where segments would agree."""
    rng = np.random.default_rng(seed)
    x = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
    gone = int(len(x) * (100 - percent) / 100)
    segment = (x >> np.uint64(32)) * np.uint64(jaccard.segments_of(jaccard.band_of(len(x) - gone), percent)) >> np.uint64(32)
    _, first = np.unique(segment, return_index=True)  # one of each segment goes first
    order = np.concatenate([first, np.setdiff1d(rng.permutation(len(x)), first)])
    y = np.sort(np.delete(x, order[:gone]))
    assert 100 * len(y) >= percent * len(x)
    assert len(np.intersect1d(jaccard.keys_of(x, percent), jaccard.keys_of(y, percent)))


def test_rows_of_ids(spark):
    from timberline.llm.bloom import rows_of
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    ids = docs.where("doc_id % 10 = 3").select("doc_id")
    assert rows_of(docs, ids).count() == 2000
    some = {r["doc_id"] for r in rows_of(docs, ids, few=5).collect()}
    assert {r["doc_id"] for r in ids.collect()} <= some and len(some) < 8000


def brute_passages(data, floor):
    """Stretches of words that lie in passages of ``floor`` words of an earlier document; every passage is looked up."""
    import re
    order = sorted({d for d in data if d[1]}, key=lambda d: (d[0] is None, d[0] or 0, repeats.text_id(d[1])))
    first, out = {}, set()
    for doc in order:
        spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", doc[1])]
        words = doc[1].encode().lower().split()
        open_ = None
        for i in range(len(words) - floor + 1):
            kept = first.setdefault(tuple(words[i:i + floor]), doc)
            if kept == doc:
                continue
            if open_ is None or i > open_[1] + floor:
                if open_:
                    out.add((doc[0], spans[open_[0]][0], spans[open_[1] + floor - 1][1], open_[1] + floor - open_[0], open_[2][0]))
                open_ = [i, i, kept]
            open_[1], open_[2] = i, min(open_[2], kept, key=order.index)
        if open_:
            out.add((doc[0], spans[open_[0]][0], spans[open_[1] + floor - 1][1], open_[1] + floor - open_[0], open_[2][0]))
    return out


@pytest.mark.parametrize("seed,floor", [(1, 5), (2, 8), (3, 3)])
def test_passages_against_brute_force(spark, seed, floor):
    rng = random.Random(seed)
    shared = [[rng.choice(["é", "Ab", "c", "d’x", "e", "f"]) for _ in range(rng.randint(floor, 3 * floor))] for _ in range(6)]
    data = [(0, None), (1, ""), (2, " \n"), (None, "x " * 40), (None, " ".join(shared[0])), (3, "same same " * 30), (4, "same " * floor)]
    for doc in range(10, 60):
        words = []
        for _ in range(4):
            words += [f"own{doc}{rng.randint(0, 9)}" for _ in range(rng.randint(0, 4))] + rng.choice(shared)
        data.append((doc, "".join(w + rng.choice([" ", "\n", "  ", "\t"]) for w in words)))
    data += data[:30] + [(10, data[20][1])]
    got = repeats.repeated_passages(spark.createDataFrame(data, "doc_id long, text string"), floor).drop("text_id").collect()
    assert {tuple(r) for r in got} == brute_passages(data, floor) and len(got) > 40


def test_passages(spark, docs, odd, none):
    """A passage inside lines is cut out of them; equal passages are found in any partitions, an empty table has none."""
    passage = " ".join(f"p{i}" for i in range(55))
    frame = spark.createDataFrame([(1, f"one two {passage} three"), (2, f"é four {passage.upper()}\nfive"), (3, passage[:-20])], "doc_id long, text string").repartition(3)
    out = {r["doc_id"]: r["text"] for r in repeats.without_repeats(frame, 51, repeats.repeated_passages).collect()}
    assert out == {1: f"one two {passage} three", 2: "é four five", 3: passage[:-20]}
    assert repeats.repeated_passages(none).count() == 0 and repeats.without_repeats(none, 51, repeats.repeated_passages).count() == 0
    found = {tuple(r) for r in repeats.repeated_passages(odd).drop("text_id").collect()}
    assert found == brute_passages([r[:2] for r in ROWS], 51) and (9, 0, len(LONG), 60_000, 4) in found
    assert {r[0] for r in found} == {6, 8, 9, None}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=70), st.integers(1, 33))
def test_rolled_and_lowest(values, width):
    h = np.array(values, np.uint64)
    f = repeats.FACTORS[0]
    want = [sum(v * pow(f, j, 1 << 64) for j, v in enumerate(values[i:i + width])) % (1 << 64) for i in range(len(values) - width + 1)]
    at = np.arange(max(0, len(values) - width + 1))
    assert repeats.Rolling(h, f).of(at, at + width).tolist() == want
    if len(values) >= width:
        assert repeats.lowest(h, width).tolist() == [min(values[i:i + width]) for i in range(len(values) - width + 1)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_new_words_are_split_without_the_pretokenizer(name, monkeypatch):
    import public_tokenizers
    e = tokens.Encoder(public_tokenizers.path(name))

    def whole(text):
        return np.array(e.lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    letters = [chr(i) for i in range(0x260)] + list("漢😀́　sdtrevml") * 8 + ["'", " ", "\n"] * 30
    texts = ["".join(random.Random(i).choices(letters, k=i % 40)) for i in range(3000)]
    monkeypatch.setattr(tokens, "CACHE_UNITS", 50)
    monkeypatch.setattr(tokens, "CACHE_PARTS", 50)
    assert list(e.encode(texts)) == list(map(whole, texts))
    assert len(e.cache) <= 50 < len(e.older) <= 50 + 40 and len(e.parts) <= 50
    plain = "Fürschpfung's 42,5### \x01ok\n\nétréè don't"
    want = whole(plain)
    monkeypatch.setattr(e, "_encode", lambda units: pytest.fail("a word of known letters went through the whole library"))
    assert list(e.encode([plain])) == [want]


def across(words, comps, forests, least=None):
    """Pairs and cut buckets that the cross comparison writes for one bucket, key 7."""
    rows_ = [{"key": 7, "m": 100 + i, "component": c, "n_shingles": 64, "words": w.tobytes(), "least": (least or {}).get(i, [7])}
             for i, (w, c) in enumerate(zip(words, comps))]
    schema = pa.schema([("key", pa.int64()), ("m", pa.int64()), ("component", pa.int64()), ("n_shingles", pa.int64()), ("words", pa.binary()), ("least", pa.list_(pa.int64()))])
    out = [r for b in jaccard._across(80, forests)(iter([pa.RecordBatch.from_pylist(rows_, schema=schema)])) for r in b.to_pylist()]
    return sorted((r["x"], r["y"]) for r in out if r["cut"] is None), [r["cut"] for r in out if r["cut"] is not None]


def test_a_bucket_writes_no_more_pairs_than_members():
    """Near copies that no link joins yet: one forest, not every pair, and word that pairs were left out."""
    same = np.zeros((300, 4), np.uint64)
    pairs, cut = across(same, range(300), 1)
    assert len(pairs) == 299 and cut == [7]
    assert len(across(same, range(300), 8)[0]) == 8 * 300 - 36
    assert len(across(same[:9], range(9), 8)[0]) == 36 and across(same[:9], range(9), 8)[1] == []
    assert across(same, [1] * 299 + [2], 1) == ([(100, 399)], [7])
    far = np.concatenate([same[:3], ~same[:1]])  # the last is far from all; the first two share a lower key
    assert across(far, range(4), 8, {0: [3, 7], 1: [3, 7]}) == ([(100, 102), (101, 102)], [])


@pytest.mark.parametrize("seed", [11, 12])
def test_pairs_left_out_are_asked_again(spark, seed, monkeypatch):
    """Many copies of one text around the threshold: forests that fail are followed by others until all links are found."""
    draw, base = random.Random(seed), [f"w{i}" for i in range(90)]
    data = []
    for d in range(260):
        words = base[:] if d % 3 else data[draw.randrange(d)][1].split() if d else base[:]
        for _ in range(draw.randint(1, 4)):
            words[draw.randrange(len(words))] = f"v{draw.randrange(9)}"
        data.append((d, " ".join(words)))
    rounds = []
    step = jaccard._crossing
    monkeypatch.setattr(jaccard, "_crossing", lambda *args: rounds.append(args[-1]) or step(*args))
    got = jaccard.similar_documents(spark.createDataFrame(data, "doc_id long, text string").repartition(4), 5, 80)
    assert rows(got) == brute_jaccard(data, 5, 80)
    assert rounds[:2] == [1, 8]


def test_words_are_cut_before_blanks_and_line_breaks():
    import public_tokenizers
    e = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a bc\nd", "a  b", "a \n b", "a \t b\t\tc \n", "\n\n a", "  ", "a\n", "\t \t", "bc \x85 bc", " bc\nd\n\nbc", "   ", "a    b", " "]
    want = [np.array(e.lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(e.encode(texts[:1])) == want[:1] and set(e.cache) == {" a", "bc", "\nd"}
    assert list(e.encode(texts)) == want and list(e.encode(texts)) == want


def test_powers_are_kept():
    f = repeats.FACTORS[0]
    assert repeats.powers(f, 3).tolist() == [pow(f, i, 1 << 64) for i in range(4)]
    assert np.shares_memory(repeats.powers(f, 3), repeats.powers(f, 9))
    n = repeats.KEPT_POWERS + 2
    assert int(repeats.powers(f, n)[n]) == pow(f, n, 1 << 64) and len(repeats.powers(f, n)) == n + 1
    for text in ("", " a", "é bü\nc ", "ab c"):
        first, last = repeats.word_spans(text.encode())
        assert [text[a:b] for a, b in zip(first, last)] == text.split()
