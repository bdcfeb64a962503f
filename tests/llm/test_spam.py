import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lawstrata.llm import spam
from lawstrata.session import Scratch

SYLLABLES = [a + b for a in ("b", "c", "ch", "d", "g", "h", "kh", "l", "m", "n", "ng", "nh", "ph", "q", "r", "s", "t", "th", "tr", "v", "x") for b in ("a", "ac", "ang", "e", "em", "i", "inh", "o", "oi", "ong", "u", "uc", "ung", "y")]
ENGLISH = [a + b for a in ("re", "con", "de", "pro", "in", "sub", "ex", "per") for b in ("port", "form", "tain", "sist", "duct", "cede", "tend", "vert", "mit", "spect", "ject", "gress")]
KEYS = ["lốp xe tải", "bảo hiểm ô tô", "thi bằng lái", "đèn trợ sáng", "vay mua xe", "găng tay da"]


def prose(rng, n, words=SYLLABLES):
    """Words by a law of Zipf, and a few numbers."""
    return " ".join(str(rng.randint(1, 99)) if rng.random() < 0.04 else words[min(len(words) - 1, int((len(words) + 12) ** rng.random() * 12 ** (1 - rng.random()) / 4))] for _ in range(n))


def spam_text(rng, kind, n=60):
    pick = lambda: rng.choice(KEYS)
    return {
        0: lambda: " | ".join(pick() for _ in range(n)),
        1: lambda: "\n".join(f"{pick()} giá rẻ - http://s{rng.randint(1, 9)}.example/{k}" for k in range(n)),
        2: lambda: " ".join("#" + pick().replace(" ", "") for _ in range(n)),
        3: lambda: "\n".join(f"{pick()} size {rng.choice('SML')} màu đỏ SKU-{rng.randint(1, 9999)} {k}k" for k in range(n)),
        4: lambda: "Tags: " + ", ".join(pick() for _ in range(n)),
        5: lambda: " ".join(pick() for _ in range(n)),
        6: lambda: "\n".join(f"lốp xe tải huyện Tên {chr(97 + k % 26)}{k}" for k in range(n)),
    }[kind]()


def plain_lists(rng):
    """Repetitive pages in the words of prose."""
    some = lambda n: prose(rng, n)
    head, tail = (" ".join(rng.sample(SYLLABLES[:20], 2)) for _ in range(2))
    return [
        "\n".join(f"{head} {k}. {some(6)}" for k in range(30)),
        "\n".join(f"{head} {k}/2010/QH {some(7)};" for k in range(20)),
        "\n".join(f"{k}. {some(4)}: {head} {k}.000.000 {tail} {k + 3}.000.000" for k in range(1, 25)),
    ]


def table(spark, rows):
    return spark.createDataFrame(rows, "i bigint, t string, l string")


def found(df):
    return {r.id for r in spam.spam_pages(df, "i", F.col("t"), F.col("l")).collect()}


@pytest.fixture(scope="module")
def law():
    rng = random.Random(3)
    return [(i, "\n".join(prose(rng, 25) + "." for _ in range(12)), rng.choice(["vi", "VI ", "vi-VN"])) for i in range(200)]


def test_passages():
    for n in (0, 1, 23, 24, 71, 72, 73, 100, 481, 5000):
        cuts = spam.passages(n)
        m = len(cuts) - 1
        assert cuts[0] == 0 and cuts[-1] == n and m == max(1, round(n / 48 + 1e-9))
        assert [next(j for j in range(m) if cuts[j] <= i < cuts[j + 1]) for i in range(n)] == [i * m // n for i in range(n)]


def line_fit(words):
    """Slope and residual by brute force over the ranked words."""
    counts = sorted(Counter(words).values(), reverse=True)
    ranks = defaultdict(list)
    for r, c in enumerate(counts, 1):
        ranks[c].append(r)
    x = np.array([0.5 * np.log(ranks[c][0] * ranks[c][-1]) for c in counts] + [np.log(len(counts) + 1)] * spam.END)
    y = np.log(np.array(counts + [0.5] * spam.END) / len(words))
    slope, cut = np.polyfit(x, y, 1)
    return slope, float(np.sqrt(((y - slope * x - cut) ** 2).mean()))


def test_curves_against_brute_force(spark, law):
    rng = random.Random(5)
    rows = law[:30] + [(1000 + k, spam_text(rng, k, 40), "vi") for k in range(7)]
    curves = spam.page_curves(table(spark, rows), "i", F.col("t"), F.col("l")).collect()
    reference = []
    for text in {t for _, t, _ in rows}:
        words, cuts = spam.words_of(text), spam.passages(len(spam.words_of(text)))
        own = [words[s:e] for s, e in zip(cuts, cuts[1:]) if e - s >= spam.FULL]
        reference += [(len(set(w)) * spam.SHARES // len(w), 1 / len(own), set(w)) for w in own]
    least = next(x for x in sorted({x for x, _, _ in reference}) if 2 * sum(w for y, w, _ in reference if y <= x) >= sum(w for _, w, _ in reference) - 1e-6)
    reference = [(w, own) for x, w, own in reference if x >= least]
    weight, held = sum(w for w, _ in reference), defaultdict(float)
    for w, own in reference:
        for x in own:
            held[x] += w
    assert len(curves) == sum(len(spam.passages(len(spam.words_of(t)))) - 1 for _, t, _ in rows)
    texts = {i: spam.words_of(t) for i, t, _ in rows}
    for r in curves:
        cuts = spam.passages(len(texts[r.id]))
        words = texts[r.id][cuts[r.part] : cuts[r.part + 1]]
        slope, residual = line_fit(words)
        assert abs(r.slope - slope) < 1e-6 and abs(r.residual - residual) < 1e-6
        surprise = np.mean([-np.log2((held[w] + 0.5) / weight) for w in words])
        assert abs(r.divergence - surprise) < 1e-9 and r.n_words == len(words)


def test_pages(spark, law):
    rng = random.Random(4)
    rows = law + [(1000 + k, spam_text(rng, k % 7, 40), rng.choice(["vi", "VI ", None, "und"])) for k in range(14)]
    rows += [(2000 + k, t, "vi") for k, t in enumerate(plain_lists(rng))]
    rows += [(4000 + k, prose(rng, 300, ENGLISH), rng.choice(["en", "en-GB", "vi"])) for k in range(40)]  # some with a wrong name
    rows += [(2100, law[0][1] + "\n" + spam_text(rng, 4, 10), "vi"), (2101, law[0][1][:300] + "\n" + spam_text(rng, 4, 90), "vi")]
    rows += [(3000, None, "vi"), (3001, "", None), (3002, "!!!", "vi"), (None, "x y", "vi"), (3003, "lốp xe tải | " * 20_000, "vi"), (3004, "ba", None)]
    df = table(spark, rows).withColumn("f", F.lit(1)).withColumn("share", F.lit("x"))
    judged = {r.id: r for r in spam.judged_pages(df, "i", F.col("t"), F.col("l")).collect()}
    assert set(judged) == {i for i, t, _ in rows if i is not None and t and spam.WORD.search(t)}
    assert {i for i, r in judged.items() if r.found} == found(df) == {1000 + k for k in range(14)} | {2101, 3003}
    assert 0 < judged[2100].share < 0.3 < 0.6 < judged[2101].share < 1
    assert found(df.limit(0)) == found(table(spark, [(1, "a b", "vi")])) == set()


@pytest.mark.parametrize("same", [True, False])
def test_a_third_of_all_rows_is_spam(spark, law, same):
    """Copies of one page, or pages of their own, do not become what is typical; nor does prose that is copied."""
    rng = random.Random(6)
    one = spam_text(rng, 0, 60)
    rows = law + [(1000 + k, one if same else spam_text(rng, rng.randrange(7), 60), "vi") for k in range(100)]
    assert found(table(spark, rows)) == {1000 + k for k in range(100)}
    rows = law + [(500 + k, law[0][1], "vi") for k in range(100)] + [(1000, one, "vi")]
    assert found(table(spark, rows)) == {1000}


def test_the_curve_decides(spark, law):
    """Each of the three values counts, and a page in the words of prose is not extreme by its slope alone."""
    rng = random.Random(7)
    rows = law + [(1000, " ".join([prose(rng, 6)] * 60), "vi")]
    p = [r for r in spam.judged_passages(table(spark, rows), "i", F.col("t"), F.col("l")).collect() if r.id == 1000]
    assert all(r.z_slope + r.z_residual > 3 for r in p)
    assert all(r.extreme == (r.z_divergence > spam.DIVERGENT and r.z_slope + r.z_residual + r.z_divergence > spam.EXTREME) for r in p)


def test_prose_is_bounded(spark, law, monkeypatch):
    monkeypatch.setattr(spam, "VOCABULARY", 50)
    learned = spam.learn_prose(table(spark, law).select(F.lit("vi").alias("lang"), F.col("t").alias("text")), Scratch(spark, "t"))
    assert learned.langs == ["vi"] and len(learned.gain[0]) == 50
