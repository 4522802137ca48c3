import random

import pytest

from interlace.llm import nearcopies

from .cases import documents, empty


def slow_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def slow_groups(texts):
    sets = [slow_set(t) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(texts))]


def corpus():
    """Near copies on both sides of the limit, chains of them, and texts that share one passage and little else."""
    rng = random.Random(7)
    words = lambda n: [rng.choice("abcdefgh") + str(rng.randrange(3000)) for _ in range(n)]
    texts, passage = [], words(60)
    for n in (6, 30, 80, 200):
        for _ in range(4):
            base = words(n)
            for _ in range(6):
                texts.append(" ".join(base))
                for _ in range(rng.randint(0, max(1, n // 30))):
                    base[rng.randrange(n)] = words(1)[0]
    texts += [" ".join(words(rng.randint(1, 40)) + passage + words(rng.randint(1, 8))) for _ in range(60)]
    return texts


@pytest.mark.parametrize("sample, common, block", [(8, 12, 2000), (1, 3, 3)])
def test_stage_keeps_one_of_each_group(spark, monkeypatch, sample, common, block):
    monkeypatch.setattr(nearcopies, "SAMPLE", sample)
    monkeypatch.setattr(nearcopies, "COMMON", common)
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(set(slow_groups(texts)))
    assert 60 < len(want) < len(texts)
    assert sorted(r.doc_id for r in nearcopies.stage(spark, docs, "").collect()) == want


def test_comparisons_of_a_dense_group_grow_with_its_texts(spark, monkeypatch):
    """Texts of one base with up to three words changed: those with three have one near copy, the base, and were held against all others."""
    rng, n, compared, verified = random.Random(3), 300, [], nearcopies.verified
    base, texts = [f"w{i}" for i in range(150)], []
    for i in range(n):
        words = list(base)
        for at in rng.sample(range(5, 145), min(i, rng.choice((1, 2, 3)))):
            words[at] = f"x{i}-{at}"
        texts.append(" ".join(words))
    monkeypatch.setattr(nearcopies, "verified", lambda pairs, *others: compared.append(pairs.count()) or verified(pairs, *others))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in nearcopies.stage(spark, docs, "").collect()) == sorted(set(slow_groups(texts)))
    assert sum(compared) < 50 * n, compared


def test_rows_without_an_id_of_their_own_stay(spark):
    docs = documents(spark)
    extra = docs.filter("doc_id = 7").selectExpr("CAST(NULL AS LONG) AS doc_id", "'something else' AS text", *docs.columns[2:])
    out = nearcopies.stage(spark, docs.union(extra), "")
    assert out.columns == docs.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect())
    # null, empty and blank are one group, and so are the copies of 3 and its longer form with 21 of 22 shingles
    assert ids == [(False, i) for i in (0, 2, 3, 6, 7, 9, 10)] + [(True, 0), (True, 0)]
    assert nearcopies.stage(spark, empty(spark), "").count() == 0
