"""Chat formatting, URL filters, quality rules, licence scans and packing against plain versions."""

import random
import re
import textwrap
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.llm import chat, licenses, packing, quality_rules, queries, url_filter

from .brute import judge_url, mcd, smith_waterman, statistics


def test_a_turn_survives_its_round_trip():
    rng = random.Random(1)
    parts = ["</s>", "[INST]", "[/INST]", " ", "\\", "<\\s>", "[\\/INST]", "[ROLE=x]", "[OUT] ", "<", "s>", "a", "\n", "<s>", "[/ROLE]", "/"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randrange(0, 8)))
        role = rng.choice(["user", "assistant", "system", "", "a]b", "[x\\"])
        piece, begin, end = chat.round_trip(role, text)
        assert chat.parse(piece) == [(role, text)] and chat.unescape(piece[begin:end]) == text
    with pytest.raises(chat.Malformed):
        chat.parse("[INST] a </s>")


def test_conversations_join_to_one_text(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    pieces = defaultdict(list)
    for r in chat.formatted(rows).coalesce(1).collect():
        pieces[r["conv_id"]].append(r["piece"])
    source = defaultdict(list)
    for r in sorted(rows.collect(), key=lambda r: (r["conv_id"], r["turn"])):
        source[r["conv_id"]].append((r["role"], r["text"] or ""))
    assert {c: chat.parse("".join(p)) for c, p in pieces.items()} == source


def test_chat_edge_cases(spark):
    schema = "conv_id long, turn long, role string, text string, piece string"
    assert chat.digests(spark.createDataFrame([], schema)).collect() == []
    rows = [(None, 1, None, None, "p"), (2, 1, "assistant", "x" * 300_000, "p"), (2, 1, "assistant", "x" * 300_000, "p"), (3, None, "user", "", "p")]
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat.digests(spark.createDataFrame(rows, schema)).collect()}
    assert got == {None: (1, 0), 2: (2, 600_000), 3: (1, 0)}


def test_chat_ids_are_exact_beside_nulls(spark):
    ids = [2**53, 2**53 + 1, 2**53 + 3, None, 2**63 - 1]
    rows = [(i, t, "user", "x") for i in ids for t in range(2)]
    got = chat.digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted(((r["conv_id"], r["n_turns"]) for r in got), key=str) == sorted(((i, 2) for i in ids), key=str)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_duckdb(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    theirs, ours = con.sql(queries.oracle_sql()[name]), queries.queries()[name](spark, sf_dir)
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert sorted(map(repr, (tuple(r) for r in ours.select(*theirs.columns).collect()))) == sorted(map(repr, theirs.fetchall()))


URLS = [None, "", "example.net/en/", "http://example.net/en/x?y#z", "https://EXAMPLE.net/de/", "http://a.example.com/de/1", "ftp://xexample.com/de/", "http://example.com/De/",
        "http://wiki.org/fr/a", "http://wiki.org/fr", "http://net", "http://net/", "http://b.net?q=/x", "http://b.net#://", "x://?", "http://a.b/p://c", "http://\u00c9.NET/\u00e9"]


def test_url_rules(spark):
    frame = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_filter.verdicts(frame).collect()}
    for i, u in enumerate(URLS):
        host, path, rule = judge_url(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] in ("allow", "block") and (rule is None or got[i]["verdict"] == ("block" if rule in ("net/", "example.com/de/") else "allow"))


def test_url_tables(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in url_filter.verdicts(pages).collect()}
    assert got == {r["page_id"]: judge_url(r["url"]) for r in pages.collect()}
    assert url_filter.verdicts(pages.limit(0)).collect() == []


def test_url_trees_learn_suffixes(spark):
    """Pages without a rule get the verdict of their like, on pages held out of training."""
    rng = random.Random(2)
    rows = [(i, f"https://www{rng.randrange(99)}.site{rng.randrange(9)}.{('net', 'org')[i % 2]}/fr/{rng.randrange(10**6)}") for i in range(600)]
    rows += [(1000, "https://www3.site3.org/de/37"), (1001, "https://www5.site4.net?id=77")]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.verdicts(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[1000] == (None, "allow") and got[1001] == (None, "block")


def test_statistics(spark, sf_dir):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = [(-1, None), (-2, ""), (-3, " \n\t"), (-4, "a a a a"), (-5, "a b a b a b"), (-6, "x\nx\n\nx \n#<"), (-7, "a\u00a0b c\x85d \U0001f600"), (-8, "w " * 40_000), (-9, "a\r\na\r\nb")]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    got = {r["doc_id"]: tuple(r[n] for n in names) for r in quality_rules.statistics(rows).collect()}
    assert got == {r["doc_id"]: statistics(r["text"]) for r in rows.collect()}


def quality_corpus(n=400):
    rng = random.Random(6)
    vocabulary = [f"{a}{b}" for a in "abcdefghijklmnop" for b in "aeiou"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(90, 160))), rng.choice(["en", "de", None]), "web", i) for i in range(n)]
    rows += [(n + i, " ".join("#$%&" * 6 + str(rng.random()) for _ in range(100)), "en", "web", 0) for i in range(6)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, d2 long"


def test_outliers_go_and_plain_texts_stay(spark):
    rows = quality_corpus()
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judged(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not any(kept[i] for i in range(400, 406))
    assert all(kept[i] for i in range(400))


def vectors(spark, x, grp="g"):
    return spark.createDataFrame([(grp, i, *map(float, v)) for i, v in enumerate(x)], "grp string, at long, v0 double, v1 double, v2 double, v3 double, v4 double")


def rejected(spark, frame):
    far = quality_rules._distances(frame, quality_rules.robust(frame))
    return {(r["grp"], r["at"]) for r in far.withColumn("scaled", quality_rules._rescaled()).filter(f"scaled > {quality_rules.CUTOFF}").collect()}


def test_distances_are_those_of_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5))
    frame = vectors(spark, x)
    estimates = quality_rules._estimates(frame.groupBy("grp").agg(*quality_rules._moments()), "grp")
    got = sorted(r["d2"] for r in quality_rules._distances(frame, estimates).collect())
    scatter = np.cov(x.T, bias=True) + np.diag([s**2 for _, s in quality_rules.VECTOR.values()])
    off = x - x.mean(axis=0)
    assert np.allclose(got, np.sort(np.einsum("ij,jk,ik->i", off, np.linalg.inv(scatter), off)))
    assert np.allclose(estimates.first()["logdet"], np.linalg.slogdet(scatter)[1])


@pytest.mark.parametrize(("far", "spread"), [(10, 0.3), (12, 1.0)])
def test_a_masked_cluster_is_rejected(spark, far, spread):
    """24 % of the rows are a cluster that pulls the moments to itself."""
    rng = np.random.default_rng(5)
    x = np.r_[rng.normal(size=(760, 5)), rng.normal(size=(240, 5)) * spread + far / 5**0.5 * np.array([1, -1, 1, 1, -1])] * 3
    got = {at for _, at in rejected(spark, vectors(spark, x))}
    assert got & set(range(760)) == set() and len(got) >= 0.99 * 240


def test_the_estimate_is_that_of_numpy(spark):
    """Everything after the starts, and the least determinant, in plain numpy; groups do not touch each other."""
    rng = np.random.default_rng(9)
    groups = {g: rng.normal(size=(n, 5)) @ rng.normal(size=(5, 5)) * 2 for g, n in (("a", 300), ("b", 170))}
    groups["b"][:30] += 40
    frame = vectors(spark, groups["a"], "a").union(vectors(spark, groups["b"], "b")).persist()
    starts = defaultdict(list)
    for r in quality_rules._starts(frame).collect():
        low = np.zeros((5, 5))
        low[np.tril_indices(5)] = r["l"]
        starts[r["grp"]].append((r["start"], np.array(r["m"]), low))
    want = set()
    for g, x in groups.items():
        assert len(starts[g]) >= 6
        want |= {(g, i) for i in np.flatnonzero(mcd(x, sorted(starts[g], key=lambda s: s[0])) > quality_rules.CUTOFF)}
    assert rejected(spark, frame) == want and {("b", i) for i in range(30)} <= want


def test_quality_rules_edge_cases(spark):
    assert quality_rules.judged(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, None, None, None, 1), (1, "", "en", None, 1), (2, "many words " * 30_000, None, "s", 1), (2, "many words " * 30_000, None, "s", 1), (3, " ".join(map(str, range(60))), None, None, 1)]
    got = sorted(((r["doc_id"], r["base_failed"], r["kept"]) for r in quality_rules.judged(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(None, True, False), (1, True, False), (2, True, False), (2, True, False), (3, False, True)], key=str)


def test_licence_texts_in_other_spellings(spark):
    text = "Copyright (c) 2020 A. Person\n" + licenses.KNOWN["MIT"][2].upper().replace("SUBLICENSE", "sub-license").replace(",", " ,\n")
    rows = [(1, text), (2, "Prose.\nlicensed under the APACHE licence; version 2.0!\nMore."), (3, None), (4, "..."), (5, "MIT"), (6, "w " * 100_000), (6, "w " * 100_000)]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, license string, line string")
    got = sorted((r["doc_id"], r["license"], r["n_license_lines"], r["line_license"]) for r in licenses.scan(frame).collect())
    assert got == [(1, "MIT", 0, None), (2, None, 1, "Apache-2.0"), (3, None, 0, None), (4, None, 0, None), (5, None, 0, None), (6, None, 0, None), (6, None, 0, None)]
    assert licenses.scan(frame.limit(0)).collect() == []


def test_whole_licence_texts(spark):
    """Complete texts are known, also with typographic marks, other line breaks and a copyright line."""
    at = Path(licenses.__file__).parent / "license_texts"
    texts = {p.stem: p.read_text("utf-8") for p in at.glob("*.txt")} | {"MIT": licenses.KNOWN["MIT"][2]}
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "MPL-2.0"} <= set(texts)
    rows = []
    for name, text in texts.items():
        one_line = re.sub(r"(?im)^[ \t]*copyright \(c\).*$", "", text).replace("[yyyy]", "2020")
        one_line = " ".join(re.sub(r"(?m)^[ \t]*copyright 2020 .*$", "", one_line, flags=re.I).split())
        wrapped = "\n".join(textwrap.wrap(one_line, 47))
        typographic = re.sub(r'"([^"]*)"', "\u201c\\1\u201d", text).replace("'", "\u2019").replace("-", "\u2010").replace(". ", ".\u00a0")
        rows += [(name, text), (name, one_line), (name, wrapped), (name, typographic), (None, text[: len(text) // 2]), (None, text + "\nand one more condition")]
        if name in ("ISC", "BSD-2-Clause", "BSD-3-Clause"):
            rows += [(name, f"{licenses.HEADINGS[name][0]}\n\nCopyright \u00a9 2020, A. Person\nAll rights reserved.\n\n{text}")]
    rows += [("Apache-2.0", texts["Apache-2.0"].split("APPENDIX")[0]), ("GPL-2.0", texts["GPL-2.0"].split("How to Apply")[0]), ("MIT", texts["MIT"].split("\n", 1)[1])]
    frame = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["license"] for r in licenses.scan(frame).collect()}
    assert [(i, rows[i][0], got[i], rows[i][1][:40]) for i in got if got[i] != rows[i][0]] == [] and len(got) == len(rows)
    line = spark.createDataFrame([(1, "x\nLicensed under CC\u00a0BY\u2011NC 4.0\u2026\ny")], "doc_id long, text string")
    assert [(r["n_license_lines"], r["line_license"]) for r in licenses.scan(line).collect()] == [(1, "CC-BY-NC-4.0")]


def test_first_fit_decreasing():
    rng = np.random.default_rng(0)
    for _ in range(30):
        sizes = rng.integers(1, 65, rng.integers(0, 80))
        bins, offsets = packing.first_fit_decreasing(sizes, 64)
        room, want = [], {}
        for i in np.argsort(-sizes, kind="stable"):
            at = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
            room += [64] * (at == len(room))
            want[i] = (at, 64 - room[at])
            room[at] -= sizes[i]
        assert {i: (b, o) for i, (b, o) in enumerate(zip(bins, offsets))} == want


def test_packing_keeps_every_id(spark, sf_dir):
    from tokenizers import Tokenizer

    odd = [(-1, None), (-2, ""), (-3, "<|endoftext|> x"), (-4, "z " * 50_000), (-5, "same"), (-5, "same"), (None, "no id"), (None, "no id"), (2**53 + 1, "large"), (2**53 + 3, "large")]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    rows = packing.pack(docs.selectExpr("*", "1 AS grp", "'x' AS crcs")).collect()
    tokenizer, want = Tokenizer.from_file(packing.default_tokenizer()), defaultdict(int)
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        for at in range(0, len(ids), 1024):
            want[r["doc_id"], at, len(ids[at : at + 1024]), zlib.crc32(ids[at : at + 1024].tobytes()), len(ids)] += 1
    got, sequences = defaultdict(int), defaultdict(list)
    for r in rows:
        got[r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]] += 1
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for pieces in sequences.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))] and sum(n for _, n in pieces) <= 1024
    assert sum(r["length"] for r in rows) > 0.97 * 1024 * len(sequences)
    assert packing.pack(docs.limit(0)).collect() == []


def test_groups_do_not_depend_on_the_order_of_rows(spark):
    rows = [(i, f"text {i}") for i in range(50)] + [(7, "again")] * 30
    frames = [spark.createDataFrame(x, "doc_id long, text string").coalesce(1) for x in (rows, rows[::-1])]
    got = [sorted(map(tuple, packing.pack(f, group_docs=10).select("doc_id", "start", "length", "sequence_id", "offset").collect())) for f in frames]
    assert got[0] == got[1] and len({x[3] >> 32 for x in got[0] if x[0] == 7}) > 1


def test_other_tokenizer_files_are_left_to_tokenizers(tmp_path):
    import json

    file = json.loads(Path(packing.default_tokenizer()).read_text("utf-8"))
    assert packing.merger(packing.default_tokenizer()) is not None
    for name, change in enumerate(({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {**file["pre_tokenizer"], "add_prefix_space": True}}, {"pre_tokenizer": None})):
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(file | change), "utf-8")
        assert packing.merger(str(path)) is None


def test_alignment_is_smith_waterman():
    from stratalens.llm.decontamination import align

    rng = random.Random(8)
    pairs = [([rng.randrange(6) for _ in range(rng.randrange(1, 20))], [rng.randrange(6) for _ in range(rng.randrange(1, 30))]) for _ in range(60)]
    got = align([np.array(a) for a, _ in pairs], [np.array(b) for _, b in pairs])
    assert got.tolist() == [smith_waterman(a, b) for a, b in pairs]


def test_every_known_text_has_an_anchor(spark):
    texts = [t for known in licenses.KNOWN.values() for t in known] + [t for _, t in licenses.whole_texts()]
    odd = ["L.I-C­e—N\ns", "redis​tribu tion", "GNU (GPL)", "permission\nto use"]
    frame = spark.createDataFrame([(t,) for t in texts + [t.upper().replace(" ", "\n") for t in texts] + odd], "text string")
    assert frame.filter(~licenses.may_be_known(F.col("text"))).count() == 0
    plain = [" ".join(random.Random(3).choices(["lice", "was", "lie", "permit", "gnu"], k=50)), "", "license".replace("c", "k")]
    assert spark.createDataFrame([(t,) for t in plain], "text string").filter(licenses.may_be_known(F.col("text"))).count() == 0
    made = {b for a, b in licenses.EQUIVALENT}
    letters = lambda t: re.sub("[^a-z0-9]", "", t)
    assert [b for b in made if any(x in letters(b) for x in licenses.ANCHORS) and not any(x in letters(a) for a, c in licenses.EQUIVALENT if c == b for x in licenses.ANCHORS)] == []


def numpy_starts(x):
    """The starts of a group in numpy: moments, medians with median deviations of fine bins (subsamples, dealt by Spark's hash, aside)."""
    q = quality_rules
    least = np.array([s for _, s in q.VECTOR.values()])
    out = [(0, x.mean(axis=0), np.linalg.cholesky(np.cov(x.T, bias=True) + np.diag(least**2)))]
    unit = least / q.FINE
    bins = np.floor(x / least * q.FINE)
    upto = lambda v, share: next(b for b in np.unique(v) if (v <= b).sum() >= share * len(v))
    middle = np.array([upto(b, 0.5) for b in bins.T])
    off = np.array([upto(np.abs(b - m), 0.5) for b, m in zip(bins.T, middle)])
    out.append((1, (middle + 0.5) * unit, np.diag(np.sqrt((1.4826 * (off + 0.5) * unit) ** 2 + least**2))))
    return out


def test_starts_and_verdicts_are_those_of_numpy(spark):
    """`kept` of every document from its text: statistics, vectors, starts, steps and cut-off in plain Python."""
    rng = random.Random(8)
    vocabulary = [f"{a}{b}" for a in "abcdefghijklmnop" for b in "aeiou"]
    rows = []
    for i in range(700):
        words = rng.choices(vocabulary, k=rng.randrange(60, 200))
        if i % 3 == 0:
            words = [w + rng.choice(["", "#", "|"]) for w in words]
        text = " ".join(words)
        if i % 5 == 0:
            text += "\nagain and again" * rng.randrange(1, 9)
        rows.append((i, text if i % 90 else "$$ " * 400 + " ".join(map(str, range(400))), ["en", "de"][i % 2], "web", 0))
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judged(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {}
    for lang in ("en", "de"):
        ids, x = [], []
        for i, text, other, *_ in rows:
            if other == lang:
                n, chars, symbols, lines, repeats, failed = statistics(text)
                want[i] = False
                if not failed:
                    ids.append(i)
                    x.append([np.log(n), np.log(chars / n), np.log(1 + 100 * symbols / n), np.log(1 + lines), np.log(1 + 100 * repeats / n)])
        x = np.array(x)
        frame = vectors(spark, x, lang)
        starts = numpy_starts(x)
        for r in quality_rules._starts(frame).collect():
            if r["start"] < 2:  # those of Spark are those of numpy
                low = np.zeros((5, 5))
                low[np.tril_indices(5)] = r["l"]
                assert np.allclose(r["m"], starts[r["start"]][1]) and np.allclose(low, starts[r["start"]][2])
        for number in range(quality_rules.SUBSAMPLES):  # other subsamples lead to the same rows
            some = np.random.default_rng(number).choice(len(x), quality_rules.SUBSAMPLE_ROWS, replace=False)
            starts.append((number + 2, x[some].mean(axis=0), np.linalg.cholesky(np.cov(x[some].T, bias=True) + np.diag([s**2 for _, s in quality_rules.VECTOR.values()]))))
        for i, d2 in zip(ids, mcd(x, starts)):
            want[i] = bool(d2 <= quality_rules.CUTOFF)
    assert sum(want.values()) > 600 and got == want
