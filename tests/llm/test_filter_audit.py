import itertools
import random
import re
from collections import Counter

from stratalens.llm import filter_audit

from .brute import WORD

DOCS, LABELS = "doc_id long, text string, lang string", "doc_id long, quality int, toxic int"


def plain(docs, labels):
    """Every order walked document by document."""
    first, good, toxic = {}, set(), set()
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    for i, q, t in labels:
        good |= {i} if q == 1 and i is not None else set()
        toxic |= {i} if t == 1 and i is not None else set()

    def fails(i, text):
        words = WORD.findall(text)
        checks = len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), re.search(r"[#$%&*|]", text), i is not None and i > first[text]
        return {k for k, x in zip("ABCDE", checks) if x}

    rows = [(lang or "", fails(i, text or ""), i in good, i in toxic) for i, text, lang in docs]
    out, shapley = [], Counter()
    for part, order in itertools.product({r[0] for r in rows}, map("".join, itertools.permutations("ABCDE"))):
        left, gone = [r for r in rows if r[0] == part], []
        for step, letter in enumerate(order, 1):
            hit = [r for r in left if letter in r[1]]
            left = [r for r in left if letter not in r[1]]
            alone = sum(r[1] == {letter} for r in rows if r[0] == part)
            out.append((part, order, step, len(left), len(hit), sum(letter in r[1] for r in gone), alone, sum(r[2] for r in hit), sum(r[3] for r in hit)))
            shapley[part, letter] += len(hit)
            gone += hit
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def got(spark, docs, labels):
    return sorted(tuple(r) for r in filter_audit.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect())


def test_same_as_walking_every_order(spark, monkeypatch):
    rng = random.Random(1)
    texts = [None, "", " ", "A B", "x#", "w " * 300, "É " * 250 + "Q" * 20]
    for _ in range(25):
        texts.append(" ".join(rng.choice(["a", "b", "C", "|", "word", "w%d" % rng.randrange(400)]) for _ in range(rng.choice([3, 150, 199, 200, 201, 600]))))
    docs = [(rng.choice([None, rng.randrange(40)]), rng.choice(texts), rng.choice(["en", "de", None, ""])) for _ in range(200)]
    labels = [(rng.choice([None, rng.randrange(50)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(60)]
    want = plain(docs, labels)
    assert got(spark, docs, labels) == want
    monkeypatch.setattr(filter_audit, "BROADCAST_ROWS", 0)
    assert got(spark, docs, labels) == want


def test_edge_cases(spark):
    assert got(spark, [], []) == []
    docs = [(1, "x" * 500_000, "en"), (1, "x" * 500_000, "en"), (2, "x" * 500_000, "en")]
    frame = spark.createDataFrame([(*d, 1, "m", 2) for d in docs], DOCS + ", mask int, words string, n int")
    rows = [r for r in filter_audit.audit(frame, spark.createDataFrame([], LABELS)).collect() if r["filter_order"] == "EABCD"]
    assert sorted((r["step"], r["kept"], r["removed"], r["unique_fails"]) for r in rows) == [(1, 2, 1, 0), (2, 0, 2, 2), (3, 0, 0, 0), (4, 0, 0, 0), (5, 0, 0, 0)]
