"""Near-duplicate removal against all pairs' Jaccard similarity."""

import random

import pytest

from tessera.llm import simhash


def jaccard(a, b):
    x, y = (set(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := (t or "").lower().split()) else set() for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def kept_by_brute_force(rows):
    label = list(range(len(rows)))
    changed = True
    links = [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(rows[i][1], rows[j][1]) >= 0.8]
    while changed:
        changed = False
        for i, j in links:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    groups = {}
    for row, c in zip(rows, label, strict=True):
        groups.setdefault(c, []).append(row)
    return sorted(min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values())


@pytest.mark.parametrize("limit", [8192, 6])
def test_near_copies_down_to_the_similarity_go(spark, limit):
    """Copies with words replaced, of which SimHash with three bits loses more than half; a chain; texts that are only alike."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(5000)}"

    def edited(text, n):
        w = text.split()
        for i in rng.sample(range(len(w)), n):
            w[i] = word()
        return " ".join(w)

    texts = [None, "", " \n", "one", "One", "one two"]
    for words, n in ((100, 1), (100, 2), (200, 2), (200, 4), (500, 10), (500, 25), (100, 6)):
        for _ in range(8):
            texts.append(" ".join(word() for _ in range(words)))
            texts.append(edited(texts[-1], n))
    texts.append(" ".join(word() for _ in range(200)))
    for _ in range(12):
        texts.append(edited(texts[-1], 3))  # a chain
    passage = " ".join(word() for _ in range(100))
    texts += [f"{passage} {' '.join(word() for _ in range(60))}" for _ in range(25)]  # alike, below the similarity
    keys = list(range(len(texts)))
    rng.shuffle(keys)
    rows = list(zip(keys, texts, strict=True))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in simhash.deduplicate(d, limit=limit).collect()]
    want = kept_by_brute_force(rows)
    assert [r[0] for r in sorted(got)] == [r[0] for r in want]
    assert len(want) < len(rows) - 45


def test_rows_without_a_key_or_with_the_same(spark):
    far = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(5)]
    rows = [(None, far[0]), (None, far[1]), (None, far[1]), (5, far[2]), (5, far[3]), (1, far[3] + " end"), (5, far[4])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted([(None, far[0]), (None, far[1]), (5, far[2]), (1, far[3] + " end"), (5, far[4])], key=str)
    assert sorted((tuple(r) for r in simhash.deduplicate(d).collect()), key=str) == want
    assert simhash.deduplicate(d.limit(0)).count() == 0


def test_columns_of_any_name_stay(spark):
    d = spark.createDataFrame([(1, "a b c", 1, 2, 3, "w"), (2, "a b c", 1, 2, 3, "w"), (None, "d", 4, 5, 6, "v")], "doc_id long, text string, __k long, __h long, __key long, node string")
    assert sorted(map(str, simhash.deduplicate(d).collect())) == sorted(map(str, d.where("doc_id IS NULL OR doc_id = 1").collect()))
