"""Keyword-stuffed and link-list pages, by rank-frequency curves.

Every page is cut into passages of about the same number of words, so that curves are compared at
comparable lengths and a page that is half prose is judged by its halves. A passage's words, ranked by
frequency, form its curve; SQL windows over the frequency spectrum (how many words occur f times) give
the ranks, and a least-squares line through log frequency against log rank gives slope and residual.
Its divergence from prose of the same language is the mean surprise of its words, in bits, by how many
passages of prose hold each word. A passage is extreme where slope, residual and divergence together
lie too far from the passages of its language; a page whose extreme passages hold more than half of the
characters of its words is found.

What prose looks like is taken from the collection: the passages of a language that repeat themselves
least (the half with the most distinct words), each text counted once however often it is copied. All
middles and spreads are medians and quartiles on the side of prose, so they hold until about half of a
language's distinct passages are spam.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from lawstrata.functions.text import norm_id
from lawstrata.session import Scratch

#: Words of a passage, and the least number of words of one that statistics are taken from.
PASSAGE, FULL = 48, 36
#: Sum of the z-scores of slope, residual and divergence beyond which a passage is extreme, and the z-score
#: that divergence must have by itself.
EXTREME, DIVERGENT = 9.0, 2.0
#: Weight of the point where a curve ends.
END = 3
#: Share of a page's characters in extreme passages beyond which it is found.
MOST = 0.5
#: A language with fewer texts has no prose of its own and shares that of all such languages; the most
#: languages with prose of their own; words of each that are kept, the most frequent ones.
OWN_PROSE, LANGUAGES, VOCABULARY = 16, 63, 20_000
#: Shares of distinct words are told apart in so many steps, values of curves in steps of a 1/STEP.
SHARES, STEP = 64, 200
REST = ""
#: A word is common that so large a share of a language's prose holds; a page is in another language than its label says
#: only if each of its words is, on average, held by so large a share of that prose.
COMMON, LIKE = 0.01, 0.05

WORD = re.compile(r"[^\W_]+")
DIGIT = re.compile(r"\d")


def words_of(text: str) -> list[str]:
    """Runs of letters and digits in lower case; any with a digit counts as the one word ``#``."""
    return _plain(WORD.findall(text.lower()))


def _plain(found: list[str]) -> list[str]:
    return [w if w.isalpha() or not DIGIT.search(w) else "#" for w in found]


def passages(n: int) -> list[int]:
    """Where the passages of n words begin, and n."""
    m = max(1, (n + PASSAGE // 2) // PASSAGE)
    return [-(-n * j // m) for j in range(m + 1)]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The weight of the full passages of each language and share of distinct words that hold each word, and '' of all of
    them. A text's passages weigh one together, so that a long one does not outweigh the others."""
    seen: defaultdict[tuple[str, int], dict[str, float]] = defaultdict(dict)

    def rows() -> pa.RecordBatch:
        keys = [(*k, w, n) for k, own in seen.items() for w, n in own.items()]
        cols = zip(*keys, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.float64()), strict=True)], names=["lang", "bin", "word", "n"])

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = words_of(text)
            cuts = passages(len(words))
            spans = [(s, e) for s, e in zip(cuts, cuts[1:], strict=False) if e - s >= FULL]
            for s, e in spans:
                own = set(words[s:e])
                cell = seen[lang, len(own) * SHARES // (e - s)]
                own.add("")
                weight = 1 / len(spans)
                for w in own:
                    cell[w] = cell.get(w, 0.0) + weight
        if sum(map(len, seen.values())) > 500_000:
            yield rows()
            seen.clear()
    if seen:
        yield rows()


class Prose:
    """For each word the share of each language's prose that holds it, and so its surprise in bits; of any other word, ``rare``."""

    def __init__(self, langs: list[str], rare: list[float], words: dict[str, list[tuple[int, float]]]):
        self.langs, self.rare, self.place = langs, rare, {x: k for k, x in enumerate(langs)}
        self.gain: list[dict[str, float]] = [{} for _ in langs]
        self.common: dict[str, list[tuple[int, float]]] = {}
        self.shares: list[dict[str, float]] = [{} for _ in langs]  # of common words
        self.most: dict[str, float] = {}  # in any of the languages
        for w, own in words.items():
            for k, p in own:
                self.gain[k][w] = rare[k] + math.log2(p)
                if p >= COMMON and w != "#":
                    self.common.setdefault(w, []).append((k, p))
                    self.shares[k][w] = p
                    self.most[w] = max(p, self.most.get(w, 0.0))

    def language(self, label: str, words: list[str]) -> int:
        """The prose a page is compared with: of the language it is labelled with, unless the common words of another fit
        twice as well; without a label, of the language that fits best; of a language without prose of its own, the shared one."""
        distinct = set(words)
        own = self.place.get(label, self.place.get(REST)) if label != REST else None
        if own is not None:  # no language can fit better than the best share of each word
            most = sum(map(self.most.get, distinct, repeat(0.0)))
            if most <= LIKE * len(distinct) or most <= 2 * sum(map(self.shares[own].get, distinct, repeat(0.0))):
                return own
        fit = [0.0] * len(self.langs)
        for w in distinct & self.common.keys():
            for k, p in self.common[w]:
                fit[k] += p
        named = [k for k, x in enumerate(self.langs) if x != REST] or [0]
        best = max(named, key=fit.__getitem__)
        if own is None:
            return best
        return best if fit[best] > 2 * fit[own] and fit[best] > LIKE * len(distinct) else own

    def divergence(self, k: int, words: list[str]) -> float:
        """The mean surprise of words by the prose of a language."""
        return self.rare[k] - sum(map(self.gain[k].get, words, repeat(0.0))) / len(words)


def learn_prose(pages: DataFrame, scratch: Scratch) -> Prose:
    """From (lang, text) rows, each distinct one counted once. Bounded: LANGUAGES and VOCABULARY."""
    texts = pages.groupBy("lang", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text")).select("lang", "text")
    seen = scratch.cut(texts.mapInArrow(_count_words, "lang string, bin int, word string, n double").groupBy("lang", "bin", "word").agg(F.sum("n").alias("n")), "words")
    shares = seen.where("word = ''")
    sizes = shares.where(F.col("lang") != REST).groupBy("lang").agg(F.sum("n").alias("all")).where(F.round("all", 3) >= OWN_PROSE)
    own = [r["lang"] for r in sizes.orderBy(F.desc(F.round("all", 3)), "lang").limit(LANGUAGES).collect()]
    lang = F.when(F.col("lang").isin(own), F.col("lang")).otherwise(F.lit(REST)) if own else F.lit(REST)
    if own:  # texts without a label show no language's prose
        seen, shares = (x.where(F.col("lang") != REST) for x in (seen, shares))
    by = Window.partitionBy("lang").orderBy("bin")
    shares = shares.groupBy(lang.alias("lang"), "bin").agg(F.sum("n").alias("n"))
    shares = shares.withColumn("upto", F.sum("n").over(by)).withColumn("all", F.sum("n").over(Window.partitionBy("lang")))
    middle = shares.where(2 * F.col("upto") >= F.col("all") - 1e-6).groupBy("lang").agg(F.min("bin").alias("least"))
    kept = seen.withColumn("lang", lang).join(F.broadcast(middle), "lang").where(F.col("bin") >= F.col("least"))  # a row for each language
    kept = kept.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc(F.round("n", 6)), "word"))
    table = kept.withColumn("r", rank).where(F.col("r") <= VOCABULARY + 1).select("lang", "word", "n").toArrow().to_pylist()
    total = {r["lang"]: r["n"] for r in table if not r["word"]}
    langs = sorted(total)
    rare = [-math.log2(0.5 / total[x]) for x in langs]
    words: dict[str, list[tuple[int, float]]] = {}
    for r in table:
        if r["word"]:
            words.setdefault(r["word"], []).append((langs.index(r["lang"]), (r["n"] + 0.5) / total[r["lang"]]))
    return Prose(langs, rare, words)


def _spectrum(prose: Prose):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each passage and word frequency: how many words have it."""
        names = ("part", "n_words", "weight", "chars", "prose", "divergence")
        types = (pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.string(), pa.float64())
        for batch in batches:
            at: list[int] = []  # a passage's page, a spectrum row's passage
            of: list[int] = []
            heads: list[tuple] = []
            f: list[int] = []
            v: list[int] = []
            for k, (label, text) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                found = WORD.findall(text.lower())
                if not found or not prose.langs:
                    continue
                words = _plain(found)
                cuts = passages(len(words))
                lang = prose.language(label, words)
                weight = 1 / max(1, sum(e - s >= FULL for s, e in zip(cuts, cuts[1:], strict=False)))
                for part, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    own = words[s:e]
                    spectrum = Counter(Counter(own).values())
                    of += [len(heads)] * len(spectrum)
                    f += spectrum.keys()
                    v += spectrum.values()
                    at.append(k)
                    heads.append((part, e - s, weight, sum(map(len, found[s:e])), prose.langs[lang], prose.divergence(lang, own)))
            cols = list(zip(*heads, strict=True)) if heads else [()] * len(names)
            head = [batch.column("id").take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))]
            take = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(take) for c in head), pa.array(f, pa.int32()), pa.array(v, pa.int32())], names=["id", *names, "f", "v"])

    return run


def rank_curves(spectrum: DataFrame) -> DataFrame:
    """One row for each passage: slope and residual of its rank-frequency line, beside its other columns.

    Words of equal frequency share ranks; the group stands at the geometric middle of its ranks and
    weighs as many points as it has words. Where the curve ends, half a word at the next rank weighs
    ``END`` points, so that few words that are all equally frequent make a steep line and not a flat one.
    """
    passage = ["id", "part"]
    up_to = F.sum("v").over(Window.partitionBy(*passage).orderBy(F.desc("f")))
    ranks = spectrum.withColumn("hi", up_to).withColumn("lo", F.col("hi") - F.col("v") + 1)
    p = ranks.withColumn("x", F.log(F.sqrt(F.col("lo") * F.col("hi")))).withColumn("y", F.log(F.col("f") / F.col("n_words")))
    v, x, y = F.col("v"), F.col("x"), F.col("y")
    sums = {"w": v, "sx": v * x, "sy": v * y, "sxx": v * x * x, "sxy": v * x * y, "syy": v * y * y}
    others = [F.first(c).alias(c) for c in ("n_words", "weight", "chars", "prose", "divergence")]
    g = p.groupBy(*passage).agg(*others, *(F.sum(c).alias(n) for n, c in sums.items()))
    x, y = F.log(F.col("w") + 1), F.log(0.5 / F.col("n_words"))
    sx, sy, sxx, sxy, syy = (F.col(n) + END * c for n, c in (("sx", x), ("sy", y), ("sxx", x * x), ("sxy", x * y), ("syy", y * y)))
    w = F.col("w") + END
    vx, vxy, vy = sxx - sx * sx / w, sxy - sx * sy / w, syy - sy * sy / w
    g = g.select(*passage, *(c for c in ("n_words", "weight", "chars", "prose", "divergence")), w.alias("w"), (vxy / vx).alias("slope"), vxy.alias("vxy"), vy.alias("vy"))
    residual = F.sqrt(F.greatest(F.lit(0.0), (F.col("vy") - F.col("slope") * F.col("vxy")) / F.col("w")))
    return g.withColumn("residual", residual).drop("w", "vxy", "vy")


def page_curves(df: DataFrame, id_col: str, text: Column, lang: Column, scratch: Scratch | None = None) -> DataFrame:
    """id, part, n_words, weight, chars, prose, divergence, slope, residual: the curve of each passage of each page with a word."""
    scratch = scratch or Scratch(df.sparkSession, "spam")
    name = F.regexp_extract(F.coalesce(norm_id(lang), F.lit("")), "^[a-z]+", 0)
    name = F.when(name.isin("und", "mul", "zxx"), F.lit(REST)).otherwise(name)  # names for no or no single language
    src = df.select(F.col(id_col).alias("id"), name.alias("lang"), text.alias("text")).where("id is not null and text is not null")
    prose = learn_prose(src.select("lang", "text"), scratch)
    kind = src.schema["id"].dataType.simpleString()
    spectrum = src.mapInArrow(_spectrum(prose), f"id {kind}, part int, n_words int, weight double, chars int, prose string, divergence double, f int, v int")
    return rank_curves(spectrum.repartition("id"))


#: By value, the quartile on the side of prose (None: the spread is that of both sides), and 1 if the high side is extreme.
SIDES = {"slope": ("q75", -1), "residual": (None, 1), "divergence": ("q25", 1)}


def _quartiles(df: DataFrame, values: dict[str, Column]) -> dict[tuple[str, str], Row]:
    """By (prose, value), the quartiles in steps of 1/STEP and the weight ``n``; '*' stands for all. No group is gathered: steps are counted."""
    pairs = F.array(*(F.struct(F.lit(n).alias("name"), F.round(v * STEP).cast("int").alias("s")) for n, v in values.items()))
    steps = df.select("prose", "weight", F.explode(pairs).alias("p")).select("prose", "weight", "p.name", "p.s").groupBy("prose", "name", "s").agg(F.sum("weight").alias("n"))
    both = steps.select(F.explode(F.array("prose", F.lit("*"))).alias("prose"), "name", "s", "n").groupBy("prose", "name", "s").agg(F.sum("n").alias("n"))
    by = Window.partitionBy("prose", "name")
    upto = both.withColumn("upto", F.sum("n").over(by.orderBy("s"))).withColumn("all", F.sum("n").over(by))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all") - 1e-6, F.col("s"))) / STEP
    rows = upto.groupBy("prose", "name").agg(at(0.25).alias("q25"), at(0.5).alias("q50"), at(0.75).alias("q75"), F.first("all").alias("n"))
    return {(r["prose"], r["name"]): r for r in rows.collect()}  # a row for each language and value


def typical(curves: DataFrame) -> dict[str, dict[str, tuple[float, float]]]:
    """By prose, the (middle, spread) of each value among the full passages, those of a page weighing one together; '*' is that of all."""
    full = curves.where(F.col("n_words") >= FULL)
    found = _quartiles(full, {name: F.col(name) for name in SIDES})
    off = F.lit(None).cast("double")
    for (p, name), r in found.items():
        if name == "residual":
            off = F.when(F.col("prose") == p, F.abs(F.col(name) - r["q50"])).otherwise(off)
    spread = _quartiles(full, {"off": off})  # by '*', around each language's own middle
    out: dict[str, dict[str, tuple[float, float]]] = {}
    for (p, name), r in found.items():
        if round(r["n"], 3) >= OWN_PROSE or p == "*":
            side = SIDES[name][0]
            wide = abs(r[side] - r["q50"]) / 0.6745 if side else 1.4826 * spread[p, "off"]["q50"]
            out.setdefault(p, {})[name] = (r["q50"], max(wide, 1 / STEP))
    return out


def judged_passages(df: DataFrame, id_col: str, text: Column, lang: Column) -> DataFrame:
    """Each passage's curve with z_slope, z_residual, z_divergence and whether they are extreme together.

    A z-score is the distance from the middle of the language in spreads, counted only on the side of
    repetition; shorter passages vary more, so it is scaled by the root of their length.
    """
    scratch = Scratch(df.sparkSession, "spam")
    curves = scratch.cut(page_curves(df, id_col, text, lang, scratch), "curves")
    means = typical(curves)
    size = F.sqrt(F.least(F.col("n_words"), F.lit(PASSAGE)) / F.lit(float(PASSAGE)))
    z = {}
    for name, (_, sign) in SIDES.items():
        each = F.lit(0.0)
        for p in [*(x for x in means if x != "*"), *(["*"] if "*" in means else [])][::-1]:
            m, s = means[p][name]
            here = F.lit(float(sign)) * (F.col(name) - F.lit(m)) / F.lit(s) * size
            each = here if p == "*" else F.when(F.col("prose") == p, here).otherwise(each)
        z[name] = F.greatest(F.lit(0.0), each)
    judged = curves.select("*", *(c.alias(f"z_{n}") for n, c in z.items()))
    extreme = (F.col("z_divergence") > DIVERGENT) & (F.col("z_slope") + F.col("z_residual") + F.col("z_divergence") > EXTREME)
    return judged.withColumn("extreme", extreme)


def judged_pages(df: DataFrame, id_col: str, text: Column, lang: Column) -> DataFrame:
    """id, n_words, n_passages, n_extreme, share, found: one row for each page with a word.

    * ``share`` is the share of the characters of the page's words in extreme passages; ``found`` means
      more than ``MOST``. Whole texts are read.
    * ``lang`` is trimmed, in lower case, without region. A page without one, or whose words are rather those
      of another language, is compared with the prose it is closest to. Languages with little text share
      their prose; texts without a label are prose only where there is no other.
    * Null and empty texts, and texts without letters and digits, give no row; nor does any page of a
      table without a single full passage, as there is no prose to compare with. Ids must be unique; a null
      id is left out.
    """
    judged = judged_passages(df, id_col, text, lang)
    bad = F.sum(F.when(F.col("extreme"), F.col("chars")).otherwise(0))
    pages = judged.groupBy("id").agg(F.sum("n_words").alias("n_words"), F.count("*").alias("n_passages"), F.sum(F.col("extreme").cast("int")).alias("n_extreme"), (bad / F.sum("chars")).alias("share"))
    return pages.withColumn("found", F.col("share") > MOST)


def spam_pages(df: DataFrame, id_col: str, text: Column, lang: Column) -> DataFrame:
    """Ids of the pages of which more than half lies in extreme passages, as by ``judged_pages``."""
    return judged_pages(df, id_col, text, lang).where("found").select("id")
