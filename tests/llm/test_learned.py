"""Language ID, the quality field, decontamination and the pipeline: held-out accuracy and plain versions."""

import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stratalens.llm import common, decontamination, language, quality, url_filter
from stratalens.llm.common import bounded_sample, stratified_sample

from .brute import near_duplicates, repeats, smith_waterman


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_held_out_languages(spark, docs):
    rows = language.predictions(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["held_out"] and r["lang"] is not None and r["lang_pred"] != "und"]
    assert len(held) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) for r in rows)


def test_windows_cover_whole_texts():
    texts = [b"", b"a" * 256, b"b" * 257, b"c"]
    x, owner, sizes = language.windows(texts)
    assert owner.tolist() == [1, 2, 2, 3] and sizes.tolist() == [256, 256, 1, 1]
    assert b"".join(bytes(r[:n]) for r, n in zip(x, sizes)) == b"".join(texts)


def test_the_last_window_counts(spark):
    """A long text is judged by all of it, not by its beginning."""
    model = language.fit([b"aba baab abba " * 20, b"xyx yxxy xyyx " * 20] * 40, ["one", "two"] * 40)
    p = model.score([b"xyx yxxy xyyx " * 60 + b"aba baab abba " * 2000])
    assert model.languages[int(p[0].argmax())] == "one"


def test_pooling_by_pairs_of_bytes():
    rng = np.random.default_rng(1)
    model = language.fit([b"some text of one kind", b"other words, next kind"] * 8, ["a", "b"] * 8)
    x = rng.integers(0, 256, (9, language.WINDOW)).astype(np.uint8)
    assert np.allclose(model.pooled(x)[0], language._train_pooled(model, x)[0], atol=1e-4)


def test_language_edge_cases(spark):
    schema = "doc_id long, text string, lang string, lang_pred string, score string"
    assert language.predictions(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, None, "en", "x", "y"), (2, "", "en", "x", "y"), (3, "123 !", None, "x", "y"), (4, "words " * 50_000, None, "x", "y"), (None, "words", None, "x", "y"), (4, "words", None, "x", "y")]
    got = language.predictions(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 6 and {r["lang_pred"] for r in got} == {"und"}  # nothing to learn from


def test_held_out_quality(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.scores(docs, labels).join(labels, "doc_id", "left").collect()
    held = [(r["score"], r["quality"]) for r in rows if r["held_out"] and r["quality"] is not None]
    good, bad = ([s for s, q in held if q == k] for k in (1, 0))
    assert good and bad and np.mean([g > b for g in good for b in bad]) > 0.85
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_marginals_are_those_of_all_labellings():
    rng = np.random.default_rng(2)
    for n in range(1, 8):
        moves, odds = rng.normal(size=(2, 2)), np.exp(rng.normal(size=n))
        field = quality.Field(np.zeros(1), np.ones(1), np.zeros(1), 0.0, moves)
        total, good = 0.0, np.zeros(n)
        for code in range(1 << n):
            y = [code >> k & 1 for k in range(n)]
            weight = np.prod([o if v else 1 for o, v in zip(odds, y)]) * np.exp(sum(moves[a, b] for a, b in zip(y, y[1:])))
            total, good = total + weight, good + weight * np.array(y)
        assert np.allclose(field.marginals(odds.tolist()), good / total)


def test_long_documents_stay_finite():
    texts = [b"\n".join(b"good line of plain words" for _ in range(12)), b"\n".join(b"### $$$ |||" for _ in range(12))] * 20
    field = quality.fit(texts, [1, 0] * 20)
    for text in (b"good line of plain words\n" * 20_000, b"### $$$ |||\n" * 20_000, b"", b"x" * 200_000):
        assert 0 <= field.score([text])[0] <= 1
    assert field.score(texts[:1])[0] > 0.5 > field.score(texts[1:2])[0]


def test_training_sees_whole_texts(spark):
    """Junk that begins after any prefix teaches as much; both ends of a text are in the samples."""
    good, bad = (b"good line of plain words\n" * 40, b"good line of plain words\n" * 32 + b"### $$$ ||| %%%\n" * 200)
    parts = quality.chains(bad)
    assert sum(map(len, parts)) <= quality.TRAIN_LINES and not np.allclose(parts[0][0], parts[-1][-2])
    field = quality.fit([good, bad] * 30, [1, 0] * 30)
    assert field.score([good])[0] > 0.7 and field.score([bad])[0] < 0.3
    text = "a" * 5000 + "z" * 5000
    cut = bytes(spark.createDataFrame([(text,)], "text string").select(language.spread(F.col("text"))).first()[0])
    assert len(cut) == language.WINDOW * language.TRAIN_WINDOWS and cut.count(b"z") == len(cut) / 2


def test_rare_languages_enter_the_sample(spark):
    rows = [(i, "en", f"text {i}") for i in range(3000)] + [(9000, "xx", "rare"), (9001, "xx", "rare too")]
    sample = stratified_sample(spark.createDataFrame(rows, "doc_id long, lang string, text string"), "lang", "doc_id", 100, "text").collect()
    assert sum(r["lang"] == "xx" for r in sample) == 2 and 40 <= len(sample) <= 100


def test_gradient_is_that_of_all_labellings():
    """Finite differences of the log-likelihood, with the normaliser summed over every labelling."""
    rng = np.random.default_rng(4)
    counts, y = np.array([1, 3, 4, 2]), np.array([1.0, 0.0, 1.0, 0.0])
    z, w, b, moves = rng.normal(size=(10, 3)), rng.normal(size=3), 0.3, rng.normal(size=(2, 2))

    def loss(w, b, moves):
        total, at = 0.0, 0
        for n, label in zip(counts.tolist(), y.tolist()):
            u = z[at : at + n] @ w + b
            at += n
            score = lambda code: sum(v * s for v, s in zip(code, u)) + sum(moves[i, j] for i, j in zip(code, code[1:]))  # noqa: B023, E731
            total += np.log(sum(np.exp(score([k >> i & 1 for i in range(n)])) for k in range(1 << n))) - score([int(label)] * n)
        return total / len(z)

    got = quality.gradient(z, counts, y, w, b, moves)
    eps = 1e-6
    for i in range(3):
        e = np.eye(3)[i] * eps
        assert np.isclose(got[0][i], (loss(w + e, b, moves) - loss(w - e, b, moves)) / (2 * eps), atol=1e-6)
    assert np.isclose(got[1][0], (loss(w, b + eps, moves) - loss(w, b - eps, moves)) / (2 * eps), atol=1e-6)
    for i in range(4):
        e = np.eye(4)[i].reshape(2, 2) * eps
        assert np.isclose(got[2].flat[i], (loss(w, b, moves + e) - loss(w, b, moves - e)) / (2 * eps), atol=1e-6)


def test_document_scores_by_enumeration(spark):
    """Scores of a table are the calibrated, length-weighted marginals over all labellings of each text's lines."""
    texts = ["plain words here\nand more of them\n\nlast", "### |||\nplain words\n$$$", "", "one line"]
    docs = spark.createDataFrame([(i, texts[i % 4]) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 1)) for i in range(40)], "doc_id long, quality int")
    field = quality.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.scores(docs, labels).collect()}
    for i in range(4):
        x, _, length = quality.line_features([texts[i].encode()])
        u, n = field.evidence(x), len(x)
        total, good = 0.0, np.zeros(n)
        for code in range(1 << n):
            label = [code >> k & 1 for k in range(n)]
            weight = np.exp(np.dot(label, u) + sum(field.moves[a, b] for a, b in zip(label, label[1:])))
            total, good = total + weight, good + weight * np.array(label)
        p = np.clip(np.dot(good / total, length) / length.sum(), 1e-6, 1 - 1e-6)
        want = 1 / (1 + np.exp(-np.clip(field.slope * np.log(p / (1 - p)) + field.base, -30, 30)))
        assert np.isclose(got[i], want, atol=1e-9)


def test_quality_edge_cases(spark):
    schema, labelled = "doc_id long, text string, score double", "doc_id long, quality int, toxic int"
    none = spark.createDataFrame([], labelled)
    assert quality.scores(spark.createDataFrame([], schema), none).collect() == []
    rows = spark.createDataFrame([(1, None, 0.0), (2, "", 0.0), (2, "", 0.0), (None, "x\ny", 0.0)], schema)
    assert [r["score"] for r in quality.scores(rows, none).collect()] == [0.5] * 4
    odd = spark.createDataFrame([(1, None, 0), (99, 1, 0), (None, 1, 0), (2, 7, 0)], labelled)
    assert [r["score"] for r in quality.scores(rows, odd).collect()] == [0.5] * 4


ITEMS = [
    "What is the boiling point of water at sea level measured in degrees on the scale of Celsius",
    "The quick brown fox jumps over the lazy dog while seven wizards brew a strange potion in the dark",
    "short item",
]


def planted(rng, item, edits):
    words = item.split()
    for _ in range(edits):
        at = rng.randrange(len(words))
        words[at] = f"edit{rng.randrange(999)}"
    return " ".join(words)


def test_copies_of_items(spark):
    rng, vocabulary = random.Random(3), [f"word{i}" for i in range(500)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    rows, want = [], {}
    for i in range(60):
        k, edits = rng.choice([0, 1]), rng.choice([0, 1, 2])
        rows.append((i, prose(60)))
        if i % 2:
            rows[-1] = (i, f"{prose(rng.randrange(60))}\n{planted(rng, ITEMS[k], edits).upper()}, {prose(rng.randrange(60))}")
            want[i] = k
    rows += [(100, None), (101, ""), (102, "a short item here"), (102, "a short item here"), (103, prose(40_000) + " " + ITEMS[0]), (None, ITEMS[1]), (104, "What is the boiling point of patience")]
    frame = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([*enumerate(ITEMS), (3, None), (4, ""), (5, "...")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in decontamination.copies(frame, items).collect()}
    assert set(found) == {*want.items(), (102, 2), (103, 0), (None, 1)}
    assert found[103, 0] == found[102, 2] == 1.0
    kept = decontamination.clean(frame, items)
    assert kept.columns == frame.columns
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(str(i) for i, _ in rows if i not in {*want, 102, 103, None})
    assert decontamination.copies(frame.limit(0), items).collect() == [] and decontamination.copies(frame, items.limit(0)).collect() == []


@pytest.mark.parametrize("hot", [1, 12, 60])
def test_edited_copies_without_a_verbatim_one(spark, hot):
    """Seeds that occur count at any frequency, also where the changed words leave others that occur nowhere."""
    rng, vocabulary = random.Random(5), [f"word{i}" for i in range(900)]
    item = " ".join(f"item{i}" for i in range(40))
    words = item.split()
    for at in (9, 19, 29):
        words[at] = "changed"
    rows = [(i, " ".join([*rng.choices(vocabulary, k=30), *(words if i < hot else []), *rng.choices(vocabulary, k=30)])) for i in range(200)]
    items = spark.createDataFrame([(0, item)], "item_id long, text string")
    found = decontamination.copies(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert {r["doc_id"]: r["score"] for r in found} == {i: (2 * 37 - 3) / 80 for i in range(hot)}


def test_more_passes_find_the_same(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"w{i} {ITEMS[i % 3]} z{i}") for i in range(9)], "doc_id long, text string")
    items = spark.createDataFrame([*enumerate(ITEMS)], "item_id long, text string")
    once = sorted(map(tuple, decontamination.copies(rows, items).collect()))
    monkeypatch.setattr(decontamination, "CHARS_A_PASS", 60)
    monkeypatch.setattr(decontamination, "PLACES", 2)
    monkeypatch.setattr(decontamination, "CELLS", 50)
    assert sorted(map(tuple, decontamination.copies(rows, items).collect())) == once and len(once) == 9
    assert decontamination.clean(rows, items).collect() == []


@pytest.mark.parametrize("percent", [10, 20, 25, 30])
def test_every_text_aligned_with_every_item(spark, percent):
    """Each text with each item, whole, by plain Smith-Waterman: what is found is what reaches the threshold, for edits of
    each share of the words; several copies of one item, none of them verbatim."""
    rng, vocabulary = random.Random(percent), [f"word{i}" for i in range(300)]
    items = [[f"i{k}w{rng.randrange(60)}" if rng.random() < 0.7 else rng.choice(vocabulary) for _ in range(rng.randrange(12, 50))] for k in range(8)]
    texts = []
    for n in range(60):
        words = list(items[n % 8])
        for at in rng.sample(range(len(words)), round(len(words) * percent / 100)):
            words[at] = rng.choice(vocabulary)
        texts.append([*rng.choices(vocabulary, k=rng.randrange(40)), *words, *rng.choices(vocabulary, k=rng.randrange(40))])
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontamination.copies(frame, bench).collect()}
    want = {(i, k): smith_waterman(item, t) / (2 * len(item)) for i, t in enumerate(texts) for k, item in enumerate(items)}
    want = {pair: score for pair, score in want.items() if score >= 0.5}
    assert set(got) <= set(want) and len(got) >= 0.98 * len(want) > 40
    assert all(np.isclose(got[pair], want[pair]) for pair in got)


def test_ids_do_not_matter_to_what_leaks(spark):
    """Rows that share an id, or have none, are judged by their own text; one long text with many hits."""
    many = " filler ".join([ITEMS[0]] * 300)
    rows = [(1, "innocent text of some words"), (1, f"x {ITEMS[1]} y"), (None, ITEMS[0]), (None, "no leak here at all"), (2**53 + 1, many), (2**53 + 3, "fine")]
    frame, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*enumerate(ITEMS)], "item_id long, text string")
    assert sorted(map(str, decontamination.clean(frame, items).collect())) == sorted(f"Row(doc_id={i}, text={t!r})" for i, t in (rows[0], rows[3], rows[5]))
    assert {(r["doc_id"], r["item_id"], r["score"]) for r in decontamination.copies(frame, items).collect()} == {(1, 1, 1.0), (None, 0, 1.0), (2**53 + 1, 0, 1.0)}


def test_samples_are_bounded(spark):
    frame = spark.range(5000).withColumnRenamed("id", "doc_id")
    for rows in (1, 100, 4990, 6000):
        assert bounded_sample(frame, "doc_id", rows, "doc_id").count() == min(rows, 5000)


def whole_and_packed(texts, pieces):
    """Every id of every text is in one piece, and sequences have no gaps: by the tokenizer itself."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_sequence = {}, {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for i, rows in by_doc.items():
        ids, at = [*tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, 0], 0
        for r in sorted(rows, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024


def test_pipeline(spark, sf_dir):
    """Each stage on what the one before kept, held against plain versions."""
    start = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "ngram_jaccard", "suffix_array", "benchmark_leaks", "sequences"]
    docs = stages["language_id"](spark, start, sf_dir).persist()
    assert docs.columns == start.columns and {r["doc_id"] for r in docs.collect()} <= {r["doc_id"] for r in start.collect()}
    assert all(any(c.isalpha() for c in r["text"]) for r in docs.collect()) and docs.count() > 0.8 * start.filter(F.length("text") > 0).count()

    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    one = stages["ngram_jaccard"](spark, docs, sf_dir).persist()
    assert one.columns == start.columns
    assert sorted(r["doc_id"] for r in one.collect()) == sorted({c for _, c in near_duplicates(texts).values()})

    texts = {r["doc_id"]: r["text"] for r in one.collect()}
    cut = stages["suffix_array"](spark, one, sf_dir).persist()
    assert cut.columns == start.columns
    sizes = {r[0]: r[1] - r[2] for r in repeats(list(texts.items()))}
    assert {r["doc_id"]: len(r["text"].encode()) for r in cut.collect()} == {i: n for i, n in sizes.items() if n or not texts[i]}

    left = stages["benchmark_leaks"](spark, cut, sf_dir).persist()
    assert left.columns == start.columns
    leaks = {r["doc_id"] for r in decontamination.copies(cut, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert leaks and {r["doc_id"] for r in left.collect()} == {r["doc_id"] for r in cut.collect()} - leaks
    pieces = stages["sequences"](spark, left, sf_dir)
    whole_and_packed({r["doc_id"]: r["text"] for r in left.collect()}, pieces.collect())
    place = Path(common.shared_dir(spark).removeprefix("file:")) / "stratalens"
    before = {p.name for p in place.iterdir()}
    assert corpus_pipeline.run(spark, sf_dir).count() == pieces.count()
    assert [p.name.rsplit("-", 1)[0] for p in place.iterdir() if p.name not in before] == ["pipeline-4-sequences"]  # nothing else stays


def test_stages_with_any_columns_and_null_ids(spark, sf_dir):
    """Rows without ids, repeated rows, a very long text and names that the operators use themselves."""
    rng, names = random.Random(12), ["_had", "had_", "lang_pred", "lang_score", "_key", "th", "_t", "text_", "spans_"]
    prose = lambda n: " ".join(f"word{rng.randrange(400)}" for _ in range(n))
    texts = [prose(60) for _ in range(12)] + [prose(30_000)]
    rows = [(None if i % 3 else i, t, "en", "web", len(t)) for i, t in enumerate(texts)] + [(0, texts[0], "en", "web", len(texts[0]))] * 2 + [(None, None, None, None, None), (2**53 + 1, "", "en", "web", 0)]
    docs = spark.createDataFrame([(*r, *names) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    docs, names = docs.withColumn("a`b c", F.lit("a`b c")), [*names, "a`b c"]
    columns, left = docs.columns, sorted((str(r[0]), r[1]) for r in rows[: len(texts)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns and [docs.first()[n] for n in names] == names
        docs = docs.persist()
        got = sorted((str(r["doc_id"]), r["text"]) for r in docs.collect() if r["text"])
        assert (got == left) if name != "language_id" else ({x for _, x in got} == set(texts))
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in docs.collect()}


def test_samples_reach_few_rows_without_ids(spark):
    """Null ids: the sample is as bounded as with ids, in rows and in what a window gets."""
    rows = [(None, "en" if k % 3 else "de", f"text {k}") for k in range(3000)] + [(None, "en", "again")] * 3000
    frame = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    with common.scratch():
        got = stratified_sample(frame, "lang", "doc_id", 100, "text")
        assert Counter(r["lang"] for r in got.collect()) == {"en": 50, "de": 50}
    reach = common._place("doc_id", "text")
    assert frame.select(reach.alias("p")).distinct().count() == 3001
    assert bounded_sample(frame, "doc_id", 100, "text").count() == 100


def test_equal_items_take_one_pass(spark, monkeypatch):
    """Many items of one text are one entry of one block, and all of them come out."""
    monkeypatch.setattr(decontamination, "CHARS_A_PASS", 1000)
    items = spark.createDataFrame([(k, "alpha beta gamma de") for k in range(5000)], "item_id long, text string")
    assert [len(shared.value.items) for shared, _ in decontamination._blocks(decontamination._texts(items))] == [1]
    docs = spark.createDataFrame([(1, "x alpha beta gamma de y"), (2, "alpha alpha")], "doc_id long, text string")
    found = decontamination.copies(docs, items).collect()
    assert len(found) == 5000 and {r["doc_id"] for r in found} == {1} and {r["item_id"] for r in found} == set(range(5000))
    many = spark.createDataFrame([(k, f"word{k} other{k} third{k}") for k in range(200)], "item_id long, text string")
    sizes = [sum(len(t) for t in shared.value.items) for shared, _ in decontamination._blocks(decontamination._texts(many))]
    assert sum(sizes) == 600 and 4 <= len(sizes) <= 8


def test_unlabelled_corpus_passes_the_language_stage(spark):
    docs = spark.createDataFrame([(k, f"words of text {k}", None) for k in range(20)], "doc_id long, text string, lang string")
    assert language.recognised(docs).count() == 20


def test_languages_by_plain_convolution(spark, docs):
    """Every window of every text, filter by filter and byte by byte, with the weights that training gives."""
    model = language.train(docs)
    rows = [(r["doc_id"], r["text"]) for r in docs.orderBy(F.xxhash64("doc_id")).limit(25).collect()] + [(-1, None), (-2, " 12 "), (-3, "x"), (-4, "é" * 300)]

    def plain(text):
        data, total = text.encode(), np.zeros(len(model.languages))
        for begin in range(0, len(data), language.WINDOW):
            part = data[begin : begin + language.WINDOW]
            window = part + b" " * (language.WINDOW - len(part))
            pooled = []
            for table, bias in zip(model.tables, model.biases):
                width = len(table)
                best = [sum(table[i][window[at + i]].astype(float) for i in range(width)) for at in range(len(window) - width + 1)]
                pooled.extend(np.maximum(np.max(best, axis=0) + bias, 0))
            scores = np.array(pooled) @ model.weights.astype(float) + model.bias
            share = np.exp(scores - scores.max())
            total += share / share.sum() * len(part)
        return total / len(data)

    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in language.identify(frame, model).collect()}
    for i, text in rows:
        if not any(c.isalpha() for c in text or ""):
            assert got[i] == ("und", 0.0)
        else:
            want = plain(text)
            assert got[i][0] == model.languages[int(want.argmax())] and abs(got[i][1] - want.max()) < 1e-3


def test_urls_that_only_lexical_features_tell(spark):
    """Under suffixes that no rule names: long URLs full of digits go, plain ones stay."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randrange(4, 9)))
    junk = lambda end: f"http://{word()}-{word()}{rng.randrange(10**6)}.{end}/" + "/".join(str(rng.randrange(10**7)) for _ in range(5)) + f"?a={rng.randrange(10**6)}&b={rng.randrange(10**6)}"
    plain = lambda end: f"https://{word()}.{end}/{word()}"
    urls = [junk("net") for _ in range(400)] + [plain("org") for _ in range(400)] + [junk("io") for _ in range(60)] + [plain("io") for _ in range(60)] + ["http://x.dev/" + "a1" * 40_000]
    got = {r["page_id"]: r["verdict"] for r in url_filter.verdicts(spark.createDataFrame([*enumerate(urls)], "page_id long, url string"), [("block", "net/"), ("allow", "org/")]).collect()}
    assert all(got[i] == ("block" if i < 400 else "allow") for i in range(800))
    assert sum(got[i] == "block" for i in range(800, 860)) >= 54 and sum(got[i] == "allow" for i in range(860, 920)) >= 54 and got[920] in ("block", "allow")
