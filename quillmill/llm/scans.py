"""Problem 4: repair text from scanned pages.

Word counts over all distinct passages give the vocabulary. Rare words are suspects: an inverted join on
their rarest character q-grams retrieves frequent words that resemble them, and boosted trees trained on
synthetic damage rank these. Confusions of characters are learned from the candidates, on top of a
list of usual ones; a candidate that they explain is the correction. Lines are judged in pairs with
their neighbours by boosted trees trained on passages that were wrapped, hyphenated and furnished
here: running headers and page numbers are taken out, then words cut at line ends are joined (compounds
broken at their own hyphen are not), then misread words are replaced.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from functools import lru_cache
from os.path import commonprefix

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.llm import bits
from quillmill.llm.ml import GradientBoosting
from quillmill.session import broadcast_if_small, materialize

KINDS = ("hyphenation", "misread", "header", "page_number")
#: Clean passages, lowest hash first, on which the line classifiers are trained, words the ranking is trained on, and the length of such a passage.
LINE_ROWS, RANK_WORDS, SAMPLE_CHARS = 600, 400, 20_000
#: A word of at least this share of all words is known; at most 1 / KNOWN_SHARE words are.
KNOWN_SHARE, KNOWN_ROWS = 1e-6, 3
#: Words of at least this share are no suspects; a correction is at least so many times as frequent as the suspect.
SAFE_SHARE, TIMES = 1e-4, 25
#: Rarest q-grams of a suspect that are looked up among those of the known words. A confusion changes three at most, so two
#: confusions leave one of seven; q-grams that no known word has do not count.
PREFIX_GRAMS = 7
#: A pair of character strings is a confusion if it alone tells so many suspects from frequent words, in so many different words, mostly inside them.
LEARN_PAIRS, LEARN_WORDS, LEARN_INSIDE = 12, 8, 0.6

#: What scanning makes of characters (misread form, true form).
CONFUSIONS = [
    ("rn", "m"), ("m", "rn"), ("ri", "n"), ("n", "ri"), ("ii", "u"), ("u", "ii"), ("vv", "w"), ("w", "vv"), ("li", "h"), ("h", "li"), ("l1", "h"), ("l!", "h"), ("1i", "h"), ("cl", "d"), ("d", "cl"), ("tl", "d"),
    ("0", "o"), ("o", "0"), ("O", "0"), ("1", "l"), ("1", "i"), ("l", "i"), ("i", "l"), ("l", "1"), ("!", "i"), ("!", "l"), ("|", "l"), ("|", "i"), ("5", "s"), ("$", "s"), ("6", "b"), ("8", "b"), ("9", "g"), ("9", "q"), ("†", "t"), ("+", "t"), ("7", "t"),
    ("c", "e"), ("e", "c"), ("ä", "a"), ("á", "a"), ("à", "a"), ("ö", "o"), ("ü", "u"), ("é", "e"), ("ë", "e"), ("ï", "i"), ("ſ", "s"), ("f", "s"), ("ﬅ", "st"), ("ﬆ", "st"), ("ct", "d"), ("in", "m"), ("ni", "m"), ("nn", "m"), ("iu", "m"), ("r1", "n"), ("r!", "n"), ("1!", "h"), ("!i", "u"), ("i!", "u"), ("1i", "u"), ("i1", "u"), ("!!", "u"), ("11", "u"), ("3", "e"), ("4", "a"), ("2", "z"), ("q", "g"), ("y", "v"), ("rri", "m"), ("rr1", "m"), ("rr!", "m"), ("lii", "hi"),
]
#: Typographic ligatures that are only another setting of the same letters.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
_BY_BAD: dict[str, list[str]] = {}
for _bad, _good in CONFUSIONS:
    _BY_BAD.setdefault(_bad, []).append(_good)

_EDGE = ".,;:?()[]\"“”‘’'«»—–…*"
HYPHENS = "-\xad¬–‐"
_BROKEN = re.compile(r"\S+[-\xad¬–‐][ \t]*\r?\n\s*\S+")
_STRAY = re.compile(r"(?<=\s)[|■~^¦¤§°•¬†‡\\_<>=#]+(?=\s)")
_SPACED = re.compile(r"(?<![^\s(\"“])(?:[^\W\d_] ){3,}[^\W\d_](?![^\s.,;:?!)\"”])")


def bare(token: str) -> str:
    """The token without punctuation around it, in lower case, ligatures resolved."""
    w = token.strip(_EDGE)
    for a, b in LIGATURES.items():
        if a in w:
            w = w.replace(a, b)
    return w.lower()


# ---- vocabulary and corrections ---------------------------------------------------------------


def word_counts(passages: DataFrame) -> DataFrame:
    """(word, n): how often each word occurs over the distinct passages, without those broken at a line end.

    Copies of a passage count once, so that a passage in many rows does not make its misread words frequent.
    """

    def run(batches):
        raw: Counter = Counter()

        def flush():
            words: Counter = Counter()
            for t, n in raw.items():
                w = bare(t)
                if len(w) > 1 and len(w) < 40:
                    words[w[:-1] if w[-1:] == "!" else w] += n
            raw.clear()
            return pd.DataFrame({"word": list(words), "n": list(words.values())})

        for b in batches:
            text = "\n\n".join(t for t in b["source_passage"] if t)
            raw.update(_BROKEN.sub(" ", text).split())
            if len(raw) > 1_000_000:
                yield flush()
        if raw:
            yield flush()

    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])
    return passages.select("source_passage").distinct().mapInPandas(run, schema).groupBy("word").agg(F.sum("n").alias("n"))


@lru_cache(maxsize=200_000)
def _edits(bad: str, good: str, learned: frozenset[tuple[str, str]] = frozenset()) -> tuple[int, int]:
    """(confusions, other edits) of the cheapest way from the true to the misread form.

    What both begin and end with is left out but for two characters on either side, as a confusion has three at most.
    """
    same = len(commonprefix((bad, good)))
    tail = min(len(commonprefix((bad[::-1], good[::-1]))), len(bad) - same, len(good) - same)
    cut, end = max(0, same - 2), max(0, tail - 2)
    bad, good = bad[cut : len(bad) - end], good[cut : len(good) - end]
    n, m = len(bad), len(good)
    far = 99
    best = [[(far, far)] * (m + 1) for _ in range(n + 1)]
    best[0][0] = (0, 0)
    weight = lambda c: c[1] * 3 + c[0]
    for i in range(n + 1):
        for j in range(m + 1):
            c, o = best[i][j]
            if c + 3 * o > 6:  # six confusions or two other edits: no candidate any more
                continue
            steps = []
            if i < n and j < m:
                steps.append((1, 1, 0, 0) if bad[i] == good[j] else (1, 1, 0, 1))
            if i < n:
                steps.append((1, 0, 0, 1))
            if j < m:
                steps.append((0, 1, 0, 1))
            for size in (1, 2, 3):
                for g in _BY_BAD.get(bad[i : i + size], ()) if i + size <= n else ():
                    if good.startswith(g, j):
                        steps.append((size, len(g), 1, 0))
                if learned:
                    steps += [(len(b), len(g), 1, 0) for b, g in learned if bad.startswith(b, i) and good.startswith(g, j)]
            for di, dj, dc, do in steps:
                new = (c + dc, o + do)
                if weight(new) < weight(best[i + di][j + dj]):
                    best[i + di][j + dj] = new
    return best[n][m]


def _grams(word: str) -> list[str]:
    w = f"^{word}$"
    return sorted({w[i : i + 2] for i in range(len(w) - 1)})


def _rank_features(bad: str, good: str, n_bad: float, n_good: float, shared: float, learned: frozenset[tuple[str, str]] = frozenset()) -> list[float]:
    confused, other = _edits(bad, good, learned)
    return [confused, other, abs(len(bad) - len(good)), len(good), shared, np.log1p(n_good), np.log1p(n_good) - np.log1p(n_bad), bad[:1] == good[:1], bad[-1:] == good[-1:], sum(not ch.isalpha() for ch in bad)]


def train_ranking(words: list[tuple[str, int]], seed: int = 11) -> GradientBoosting:
    """Pairwise ranking of candidates, trained on known words damaged with the confusion table."""
    rng = random.Random(seed)
    inverse: dict[str, list[str]] = {}
    for b, g in CONFUSIONS:
        inverse.setdefault(g, []).append(b)
    grams = {w: set(_grams(w)) for w, _ in words}
    count = dict(words)
    x, y, groups = [], [], []
    for k, (w, n) in enumerate(words):
        damaged = w
        for _ in range(rng.choice((1, 1, 2))):
            spots = [(i, g) for g in inverse for i in range(len(damaged)) if damaged.startswith(g, i)]
            if spots:
                i, g = rng.choice(spots)
                damaged = damaged[:i] + rng.choice(inverse[g]) + damaged[i + len(g) :]
        own = set(_grams(damaged))
        near = sorted(grams, key=lambda v: -len(own & grams[v]) / (len(own) + len(grams[v])))[:6]
        for v in {*near, w}:
            share = 2 * len(own & grams[v]) / (len(own) + len(grams[v]))
            x.append(_rank_features(damaged, v, 1 + n // 1000, count[v], share))
            y.append(v == w)
            groups.append(k)
    model = GradientBoosting(trees=40, depth=3, rate=0.2, loss="rank")
    return model.fit(np.array(x, float).reshape(-1, 10), np.array(y, float), np.array(groups, int))


def _with_grams(words: DataFrame, name: str) -> DataFrame:
    marked = f"concat('^', {name}, '$')"
    return words.withColumn(f"g_{name}", F.expr(f"array_distinct(transform(sequence(1, length({marked}) - 1), i -> substring({marked}, i, 2)))"))


def candidates(suspects: DataFrame, known: DataFrame, prefix: int = PREFIX_GRAMS, least: float = 0.25) -> DataFrame:
    """(bad, good, n_bad, n_good, shared): suspects and much more frequent words of about their length that share q-grams.

    Only the rarest q-grams of a suspect meet those of the known words, with the length in the key; how many q-grams
    of the whole words are shared is counted inside the row.
    """
    good = _with_grams(known.select(F.col("word").alias("good"), F.col("n").alias("n_good")), "good")
    bad = _with_grams(suspects.select(F.col("word").alias("bad"), F.col("n").alias("n_bad")), "bad")
    index = good.select("good", "n_good", "g_good", F.explode("g_good").alias("gram"), F.length("good").alias("len"))
    frequency = index.groupBy("gram").agg(F.count("*").alias("f"))  # at most one row per pair of characters
    met = bad.select("bad", F.explode("g_bad").alias("gram")).join(broadcast_if_small(frequency), "gram")
    rare = met.groupBy("bad").agg(F.slice(F.array_sort(F.collect_list(F.struct("f", "gram"))), 1, prefix).alias("_rare"))
    looked = bad.join(rare, "bad").select("bad", "n_bad", "g_bad", F.explode("_rare.gram").alias("gram"))
    looked = looked.withColumn("len", F.explode(F.sequence(F.length("bad") - 3, F.length("bad") + 3)))
    enough = F.col("n_good") >= TIMES * F.col("n_bad") / F.when(F.col("bad").rlike(r"[^\p{L}'\-]"), 20).otherwise(1)
    shared = 2 * F.size(F.array_intersect("g_bad", "g_good")) / (F.size("g_bad") + F.size("g_good"))
    pairs = looked.join(index, ["gram", "len"]).filter(enough & (F.col("bad") != F.col("good"))).withColumn("shared", shared).filter(F.col("shared") >= least)
    return pairs.groupBy("bad", "good").agg(*[F.first(c).alias(c) for c in ("n_bad", "n_good", "shared")])


def difference(bad: str, good: str) -> tuple[str, str, bool] | None:
    """(misread, true, inside): the one place where two words differ, at most three characters on either side."""
    n = 0
    while n < min(len(bad), len(good)) and bad[n] == good[n]:
        n += 1
    m = 0
    while m < min(len(bad), len(good)) - n and bad[-1 - m] == good[-1 - m]:
        m += 1
    x, y = bad[n : len(bad) - m], good[n : len(good) - m]
    return (x, y, n > 0 and m > 0) if 0 < len(x) <= 3 and 0 < len(y) <= 3 else None


def learned_confusions(pairs: DataFrame) -> frozenset[tuple[str, str]]:
    """Confusions that the candidates show again and again: (misread, true) strings that alone tell many suspects from
    frequent words. At most one per LEARN_PAIRS candidates, and of three characters a side."""

    def run(batches):
        for p in batches:
            rows = [(*d, g) for b, g in zip(p["bad"], p["good"]) if (d := difference(b, g))]
            yield pd.DataFrame(rows, columns=["x", "y", "inside", "good"])

    seen = pairs.select("bad", "good").mapInPandas(run, "x string, y string, inside boolean, good string")
    often = seen.groupBy("x", "y").agg(F.count("*").alias("n"), F.countDistinct("good").alias("words"), F.avg(F.col("inside").cast("double")).alias("share"))
    rows = often.filter((F.col("n") >= LEARN_PAIRS) & (F.col("words") >= LEARN_WORDS) & (F.col("share") >= LEARN_INSIDE)).collect()
    return frozenset((r.x, r.y) for r in rows) - frozenset(CONFUSIONS)


def corrections(counts: DataFrame) -> DataFrame:
    """(bad, good): misread words and their corrections, from q-gram candidates, the confusions learned from them and the ranking."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(KNOWN_ROWS, KNOWN_SHARE * total)
    known = counts.filter((F.col("n") >= least) & F.col("word").rlike(r"^[\p{Ll}][\p{L}'\-]*$"))
    common = known.orderBy(F.desc("n"), "word").filter(F.length("word") >= 4).limit(RANK_WORDS).collect()
    model = train_ranking([(r.word, r.n) for r in common])
    suspects = counts.filter((F.col("n") < max(SAFE_SHARE * total, 2 * TIMES)) & (F.length("word") >= 2) & F.col("word").rlike(r"\p{L}") & ~F.col("word").rlike(r"^[ivxlc]+$|^\d+$"))
    pairs = materialize(candidates(suspects, known), "candidates")
    learned = learned_confusions(pairs)

    def run(batches):
        for p in batches:
            if not len(p):
                continue
            x = np.array([_rank_features(*r, learned) for r in zip(p["bad"], p["good"], p["n_bad"], p["n_good"], p["shared"])], float)
            keep = (x[:, 1] == 0) & (x[:, 0] >= 1)
            out = p.loc[keep, ["bad", "good"]].assign(score=model.predict(x[keep])) if keep.any() else p.iloc[:0][["bad", "good"]].assign(score=0.0)
            yield out

    schema = T.StructType([T.StructField("bad", T.StringType()), T.StructField("good", T.StringType()), T.StructField("score", T.DoubleType())])
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but much to do for each
    ranked = pairs.select("bad", "good", "n_bad", "n_good", "shared").repartition(parts, "bad").mapInPandas(run, schema)
    best = materialize(ranked.groupBy("bad").agg(F.max_by("good", F.struct("score", "good")).alias("good")), "ranked")
    # a correction may be a frequent misread form itself: follow it to the word it stands for
    step = best.select(F.col("bad").alias("_b"), F.col("good").alias("_g"))
    for _ in range(2):
        best = best.join(step, F.col("good") == F.col("_b"), "left").select("bad", F.coalesce("_g", "good").alias("good"))
    return best.filter("bad <> good")


# ---- lines ------------------------------------------------------------------------------------

_PROSE = re.compile(r"[a-zà-ÿ]{2,},? [a-zà-ÿ]{2,},? [a-zà-ÿ]{2,}")
_NUMBER = re.compile(r"^[\[(\-—–~ ]*(?:p{1,2}\. ?|page )?(?:[0-9lIO]{1,4}|[ivxlc]{1,7})(?: of [0-9lIO]{1,4})?[\])\-—–~. ]*$", re.IGNORECASE)
_EDGE_NUMBER = re.compile(r"^\[?[0-9lO]{1,4}(?= +\D)|(?<!vol\.)(?<!no\.)(?<!chap\.)(?<!\bof) [\[(]?[0-9lO]{1,4}[\]]?\.?$|^[ivxlc]{2,7} (?=[A-Z])| [ivxlc]{2,7}$", re.IGNORECASE)
_KEYWORD = re.compile(r"\b(?:chap|vol|v0l|bk|book|part|quarterly|journal|review|proceedings|letters|treatise|page|p)\b", re.IGNORECASE)
_STOPS = tuple(".!?:;\"”)")


def is_candidate(line: str) -> bool:
    """Short lines without a stretch of running text; the others are no furniture."""
    return len(line) < 80 and bool(line.strip()) and (line[0] == "\f" or not _PROSE.search(line))


def line_features(lines: list[str], i: int, typical: float, repeats: Counter) -> list[float]:
    s = lines[i].strip()
    letters = [c for c in s if c.isalpha()]
    words = s.split()
    before = next((lines[k].strip() for k in range(i - 1, max(-1, i - 4), -1) if lines[k].strip()), "")
    after = next((lines[k].strip() for k in range(i + 1, min(len(lines), i + 4)) if lines[k].strip()), "")
    caps = [w for w in words if w[:1].isupper()]
    small = [w for w in words if w[:1].islower()]
    return [
        len(s), sum(c.isupper() for c in letters) / max(1, len(letters)), sum(c.isdigit() for c in s) / max(1, len(s)), bool(_NUMBER.match(s)), len(caps) / max(1, len(words)), len(small), len(words),
        lines[i][:1] == "\f", not before.endswith(_STOPS) and not before.endswith(".") and bool(before), after[:1].islower(), i == 0 or not lines[i - 1].strip(), i + 1 == len(lines) or not lines[i + 1].strip(), bool(_EDGE_NUMBER.search(s)),
        bool(_KEYWORD.search(s)), i == 0, i + 1 == len(lines), s[-1:] in ".!?", s[-1:] in ",;:-", repeats[_shape(s)], len(s) / max(1.0, typical), before[-1:] in HYPHENS, s[:1] in "[(—-", bool(_NUMBER.match(before)), bool(_NUMBER.match(after)), s[:1].islower(),
    ]


def _shape(line: str) -> str:
    return re.sub(r"[0-9lO]+|\b[ivxlc]+\b", "", line).strip("[]() .—-").lower()


_TITLE_A = "Nature Origin Idea Force Limits Grounds History Theory Principles Elements Defence Criticism Dialogues Letters Essays Lectures Treatise Inquiry Outlines Studies".split()
_TITLE_B = "Memory Judgement Thought Reason Speech Motion Doubt Cause Space Time Virtue Belief Sense Language Number Light Form Matter Witness Thinking".split()
_NAMES = "Halvern Obrecht Castellan Merriday Tolland Quiney Falk Ostrander Brevoort Lindqvist".split()


def _furniture(rng: random.Random) -> tuple[str, int]:
    """A made-up furniture line and its label bits (1 header, 2 page number)."""
    roman = rng.choice("ii iii iv vi vii ix xii xiv xix xxiii xlvii lviii".split())
    n = str(rng.randint(2, 499))
    if rng.random() < 0.15:
        n = n.replace("1", "l").replace("0", "O")
    if rng.random() < 0.42:
        return rng.choice([n, f"[{n}]", f"— {n} —", f"- {n} -", f"p. {n}", f"Page {n} of {rng.randint(200, 600)}", f"{n}.", roman, f"({n})"]), 2
    a, b, c, who = rng.choice(_TITLE_A), rng.choice(_TITLE_B), rng.choice(_TITLE_B), rng.choice(_NAMES)
    title = rng.choice([f"The {a} of {b}", f"A {a} of {b} and {c}", f"On the {a} of {b}", f"{b} without {c}", f"Of {b}", f"{a} concerning {b}, Vol. {rng.randint(1, 9)}", f"Against {b} and {c}", f"Chap. {rng.choice('I II III IV V VI IX'.split())}. — Of {b}", f"[Bk. {rng.choice('i ii iii iv'.split())}.", f"{b} Quarterly {rng.randint(1, 40)} ({rng.randint(1, 4)})", f"{b} Review, {rng.randint(1, 30)}", f"{who}.", f"{who} — The {a} of {b}", f"On the {b}"])
    if rng.random() < 0.5 and "Chap" not in title and "Bk" not in title and "Quarterly" not in title:
        title = title.upper()
    if rng.random() < 0.2:
        title = title.replace("O", "0", 1).replace("E", "F", 1)
    form = rng.random()
    if form < 0.35:
        return (f"{title} {n}" if rng.random() < 0.5 else f"{n} {title}"), 3
    return title, 1


def synthetic_lines(texts: list[str], seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(features, label) of candidate lines of clean passages wrapped and furnished here."""
    import textwrap

    rng = random.Random(seed)
    x, y = [], []
    for t in texts:
        width = rng.randint(46, 72)
        lines: list[str] = []
        label: list[int] = []
        for paragraph in re.split(r"\n\s*\n", t):
            if rng.random() < 0.08:  # a heading over a paragraph is no furniture
                h = f"{rng.choice(['Of', 'On', 'Against', 'The'])} {rng.choice(_TITLE_B)} and {rng.choice(_TITLE_B)}"
                lines += [h.upper() if rng.random() < 0.6 else h, ""]
                label += [0, 0]
            new = textwrap.wrap(paragraph, width) or [""]
            if rng.random() < 0.12:  # neither are stanzas, even with a refrain
                refrain = f"{rng.choice(['so', 'and', 'thus', 'then'])} {rng.choice(['sang', 'said', 'went', 'goes'])} {rng.choice(['he', 'she', 'they', 'we', 'I', 'the wind'])}."
                stanza = [f"{rng.choice(['The', 'the', 'A', 'And', 'O'])} {rng.choice(_TITLE_B).lower()} {rng.choice(['that waits', 'that knows', 'is old', 'of mine', 'in the rain'])}{rng.choice(',;,.')}" for _ in range(rng.randint(2, 4))]
                new = [*stanza, refrain, "", *(stanza[::-1]), refrain] if rng.random() < 0.6 else [*stanza, refrain]
            lines += [*new, ""]
            label += [0] * (len(new) + 1)
        if rng.random() < 0.75:
            head = _furniture(rng)
            for _ in range(rng.randint(1, 3)):
                at = rng.randint(1, max(1, len(lines) - 2))
                block = [head if rng.random() < 0.6 else _furniture(rng)]
                if rng.random() < 0.25:
                    block.append(_furniture(rng))
                pad = rng.random() < 0.3
                new = [("\f" if k == 0 and rng.random() < 0.25 else "") + b for k, (b, _) in enumerate(block)]
                marks = [m for _, m in block]
                if pad:
                    new, marks = ["", *new, ""], [0, *marks, 0]
                if rng.random() < 0.2 and len(lines[at - 1]) > 5:
                    lines[at - 1] = lines[at - 1].rstrip() + rng.choice("-¬\xad")
                lines[at:at] = new
                label[at:at] = marks
        lengths = [len(s) for s in lines if s.strip()]
        typical, repeats = float(np.median(lengths or [0])), Counter(_shape(s) for s in lines if s.strip() and len(s) < 80)
        for i, s in enumerate(lines):
            if is_candidate(s):
                x.append(line_features(lines, i, typical, repeats))
                y.append(label[i])
    return np.array(x, float).reshape(-1, 25), np.array(y, int)


def train_lines(texts: list[str]) -> GradientBoosting:
    """Log-odds that a line is furniture. Few texts are wrapped and furnished several times over."""
    rounds = max(1, min(10, LINE_ROWS // max(1, len(texts))))
    made = [synthetic_lines(texts, 5 + k) for k in range(rounds)]
    x, y = np.concatenate([a for a, _ in made]), np.concatenate([b for _, b in made])
    return GradientBoosting(trees=60, depth=4, rate=0.15, loss="logistic").fit(x, (y > 0).astype(float))


def join_features(left: str, right: str, mark: str, known: dict[str, int]) -> list[float]:
    """Of a line's last word without its hyphen, the next line's first word, and the hyphen."""
    a, b = bare(left), bare(right)
    whole, compound = known.get(a + b, 0), known.get(f"{a}-{b}", 0)
    tail, head = known.get(a.rsplit("-", 1)[-1], 0), known.get(b.split("-", 1)[0], 0)
    return [whole > 0, compound > 0, tail > 0, head > 0, tail > 0 and head > 0, mark == "-", np.log1p(whole), np.log1p(compound), np.log1p(min(tail, head)), len(a), len(b), "-" in a or "-" in b]


_JOIN_FEATURES = 12


def synthetic_joins(texts: list[str], known: dict[str, int], seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(features, label 1: one word) of words of clean passages cut at random and of compounds broken at their own hyphen.

    Part of the cut words count as unknown, as most words of a large corpus are rare; compounds are those of the
    passages and pairs of neighbouring words.
    """
    rng = random.Random(seed)
    x, y = [], []
    for t in texts:
        words = [w for w in map(bare, t.split()) if w]
        for k, w in enumerate(words):
            if w.isalpha() and len(w) >= 5 and rng.random() < 0.3:
                at = rng.randint(2, len(w) - 2)
                seen = known if rng.random() < 0.7 else {v: known[v] for v in (w[:at], w[at:]) if v in known}
                x.append(join_features(w[:at], w[at:], rng.choice("---" + HYPHENS[1:]), seen))
                y.append(1)
            pair = w.split("-", 1) if "-" in w else [w, words[k + 1]] if k + 1 < len(words) and rng.random() < 0.15 else None
            if pair and all(p and p in known for p in pair):
                a, b = pair
                seen = {v: known[v] for v in pair} | ({f"{a}-{b}": known.get(f"{a}-{b}", 3)} if rng.random() < 0.5 else {})
                x.append(join_features(a, b, "-", seen))
                y.append(0)
    return np.array(x, float).reshape(-1, _JOIN_FEATURES), np.array(y, int)


def train_joins(texts: list[str], known: dict[str, int]) -> GradientBoosting:
    """Log-odds that the two halves at a line end are one word."""
    x, y = synthetic_joins(texts, known)
    if not len(x):  # nothing to learn from: a word before a hyphen goes on in the next line
        x, y = np.zeros((1, _JOIN_FEATURES)), np.ones(1)
    return GradientBoosting(trees=40, depth=4, rate=0.2, loss="logistic").fit(x, y.astype(float))


# ---- repair -----------------------------------------------------------------------------------


def _ends_cut(line: str) -> bool:
    """A letter and a hyphen end the line."""
    return len(line) > 1 and line[-1] in HYPHENS and line[-2].isalpha()


class Repairer:
    """Repairs passages with a vocabulary, a line classifier and corrections (bad -> good)."""

    def __init__(self, known: dict[str, int], lines: GradientBoosting, joins: GradientBoosting, misread: np.ndarray | None = None):
        self.known, self.lines, self.joins, self.misread = known, lines, joins, misread
        self.looked: dict[str, str | None] = {}
        self.cuts: dict[tuple[str, str, str], bool] = {}

    def _furniture(self, split: list[list[str]]) -> list[list[int]]:
        x, where = [], []
        for k, lines in enumerate(split):
            if len(lines) < 2:
                continue
            # a title over the passage, with a blank line below, interrupts nothing
            title = bool(lines[0].strip()) and not lines[1].strip() and lines[0][:1] != "\f" and not _NUMBER.match(lines[0].strip())
            picked = [i for i, s in enumerate(lines) if is_candidate(s) and not (title and i == 0)]
            if not picked:
                continue
            lengths = [len(s) for s in lines if s.strip()]
            typical, repeats = float(np.median(lengths)), Counter(_shape(lines[i].strip()) for i in picked)
            for i in picked:
                x.append(line_features(lines, i, typical, repeats))
                where.append((k, i))
        out: list[list[int]] = [[] for _ in split]
        if x:
            for (k, i), s in zip(where, self.lines.predict(np.array(x, float))):
                if s > 0:
                    out[k].append(i)
        return out

    def _is_cut(self, left: str, right: str, mark: str) -> bool:
        """Whether two halves at a line end are one word; a compound broken at its own hyphen is not."""
        if (left, right, mark) not in self.cuts:
            self._judge_cuts([(left, right, mark)])
        return self.cuts[left, right, mark]

    def _judge_cuts(self, places: list[tuple[str, str, str]]) -> None:
        """Judge many places at once."""
        if len(self.cuts) > 500_000:
            self.cuts.clear()
        new = [p for p in dict.fromkeys(places) if p not in self.cuts]
        if new:
            scores = self.joins.predict(np.array([join_features(*p, self.known) for p in new], float))
            self.cuts.update(zip(new, (scores > 0).tolist()))

    def prepare(self, texts: list[str | None]) -> list[tuple[str | None, set[str], list[str]]]:
        """(text, kinds, words) of each passage: all but the correction of words, and the words that may be misread."""
        split = [(t or "").replace("\r\n", "\n").replace("\r", "\n").split("\n") for t in texts]
        out, furniture = [], self._furniture(split)
        places = []
        for lines, drop in zip(split, furniture):
            gone, held = set(drop), ""
            for i, raw in enumerate(lines):
                s = raw.strip()
                if s and i not in gone:
                    if _ends_cut(held) and s[0].islower():
                        places.append((held[:-1].rsplit(" ", 1)[-1], s.split(" ", 1)[0], held[-1]))
                    held = s
        self._judge_cuts(places)
        for t, lines, drop in zip(texts, split, furniture):
            kinds: set[str] = set()
            if t is None:
                out.append((None, kinds, []))
                continue
            for i in drop:
                s = lines[i].strip()
                number = bool(_NUMBER.match(s))
                if not number:
                    kinds.add("header")
                if number or _EDGE_NUMBER.search(s):
                    kinds.add("page_number")
            gone = set(drop)
            kept = [s.replace("\f", "") for i, s in enumerate(lines) if i not in gone]
            text = self._join(kept, {sum(1 for j in range(i) if j not in gone) for i in drop}, kinds)
            text = self._characters(text, kinds)
            out.append((text, kinds, sorted({w for w in map(self._lookup, set(text.split())) if w})))
        return out

    def _lookup(self, token: str) -> str | None:
        """The form under which a token may be among the misread words, by the filter."""
        if token in self.looked:
            return self.looked[token]
        w = bare(token)
        forms = [w, w[:-1]] if token[-1:] == "!" else [w]
        found = next((f for f in forms if f and (self.misread is None or bits.has_word(self.misread, f))), None)
        if len(self.looked) > 1_000_000:
            self.looked.clear()
        self.looked[token] = found
        return found

    def repair(self, texts: list[str | None], corrections: dict[str, str]) -> list[tuple[str | None, list[str]]]:
        """(text, kinds) of each passage, with the corrections at hand."""
        return [finish(t, kinds, corrections) for t, kinds, _ in self.prepare(texts)]

    def _join(self, lines: list[str], seams: set[int], kinds: set[str]) -> str:
        """Paragraphs of joined lines. `seams`: places where furniture was taken out; blanks there separate nothing
        if the text before is unfinished."""
        if len(lines) < 2:
            return lines[0].strip() if lines else ""
        paragraphs, held, blank, seam = [], "", False, False
        for i, raw in enumerate(lines):
            s = raw.strip()
            seam = seam or i in seams
            if not s:
                blank = True
                continue
            if held and blank and not (seam and held[-1] not in ".!?\"”:" and (s[:1].islower() or held[-1] in HYPHENS)):
                paragraphs.append(held)
                held = s
            elif not held:
                held = s
            elif _ends_cut(held) and s[:1].isalpha():
                left, right = held[:-1].rsplit(" ", 1)[-1], s.split(" ", 1)[0]
                if s[0].islower() and self._is_cut(left, right, held[-1]):
                    kinds.add("hyphenation")
                    held = held[:-1] + s
                else:
                    held += s
            elif re.match(r"(?:\d{1,2}[.)]|[-*•]) ", s) or len(held) < 40 and held[-1] in ",;:" and s[:1].islower() and "\n" not in held and len(s) < 40:
                held += "\n" + s  # lists and verse keep their lines
            else:
                held += " " + s
            blank = seam = False
        if held:
            paragraphs.append(held)
        return "\n\n".join(paragraphs)

    def _characters(self, text: str, kinds: set[str]) -> str:
        """Words set in spaced letters, marks that belong to no word, ligatures."""
        if _SPACED.search(text):
            kinds.add("misread")
            text = _SPACED.sub(lambda m: m.group().replace(" ", ""), text)
        if _STRAY.search(text):
            kinds.add("misread")
            text = re.sub(r"(?<=\s)[|■~^¦¤§°•¬†‡\\_<>=#]+\s", "", text)
        if any(a in text for a in LIGATURES):
            kinds.add("misread")
            for a, b in LIGATURES.items():
                text = text.replace(a, b)
        return text


def finish(text: str | None, kinds: set[str], corrections: dict[str, str]) -> tuple[str | None, list[str]]:
    """The text with its misread words replaced, and its kinds of noise in their usual order."""
    if text is None:
        return None, []
    wrong = {}
    for w in set(text.split()) if corrections else ():
        g = corrections.get(bare(w)) or (corrections.get(bare(w)[:-1]) if w[-1:] == "!" else None)
        if g is not None:
            wrong[w] = g
    if wrong:
        kinds = kinds | {"misread"}
        text = re.sub(r"\S+", lambda m: _replace(m.group(), wrong[m.group()]) if m.group() in wrong else m.group(), text)
    return text, [x for x in KINDS if x in kinds]


def _replace(token: str, good: str) -> str:
    core = token.strip(_EDGE)
    start = token.find(core)
    good = good.upper() if core.isupper() and len(core) > 1 else good.capitalize() if core[:1].isupper() else good
    return token[:start] + good + token[start + len(core) :]


_REPAIRED = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("clean_passage", T.StringType()), T.StructField("noise", T.ArrayType(T.StringType()))])
_PREPARED = "row_id bigint, key bigint, text string, kinds array<string>, asked array<string>"


def clean_sample(passages: DataFrame, rows: int = LINE_ROWS, most: int = SAMPLE_CHARS) -> list[str]:
    """At most `rows` passages of running text without line ends, of 200 to `most` characters, lowest hash first."""
    clean = passages.filter((F.length("source_passage") > 200) & (F.length("source_passage") <= most) & ~F.col("source_passage").rlike(r"[^\n]\n[^\n]|[\r\f]"))
    n = clean.count()
    mark = F.pmod(F.xxhash64("source_passage"), F.lit(1 << 40))
    few = clean.select("source_passage", mark.alias("_h")).filter(F.col("_h") < int((1 << 40) * min(1.0, 3 * rows / max(n, 1)))).distinct()
    return [r.source_passage for r in few.orderBy("_h", "source_passage").limit(rows).collect()]


def repair_passages(examples: DataFrame) -> DataFrame:
    """(row_id, clean_passage, noise): every row's passage as continuous paragraphs and what was wrong in it.

    Null passages stay null, empty ones empty, with no noise; repeated rows are repaired alike; an
    empty table gives no rows. Words that may be misread are found by a filter of bounded size and
    joined to the corrections, of which there may be any number; only passages that hold such words
    are shuffled. The known words (at most 1 / KNOWN_SHARE) go to all executors.
    """
    sc = examples.sparkSession.sparkContext
    passages = examples.select("row_id", "source_passage")
    counts = materialize(word_counts(passages), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    known = {r.word: r.n for r in counts.filter(F.col("n") >= max(KNOWN_ROWS, KNOWN_SHARE * total)).toLocalIterator()}
    sample = clean_sample(passages)
    fixes = materialize(corrections(counts), "corrections")
    tools = sc.broadcast((known, train_lines(sample), train_joins(sample, known), bits.word_filter(fixes, "bad")))

    def run(batches):
        worker = Repairer(*tools.value)
        for b in batches:
            got = worker.prepare(b["source_passage"].tolist())
            yield pd.DataFrame({"row_id": b["row_id"], "key": b["key"], "text": [t for t, *_ in got], "kinds": [[x for x in KINDS if x in k] for _, k, _ in got], "asked": [w for *_, w in got]})

    prepared = materialize(passages.withColumn("key", F.xxhash64("source_passage")).mapInPandas(run, _PREPARED), "prepared")
    held = prepared.filter(F.size("asked") > 0)
    words = held.select("key", F.explode("asked").alias("bad")).distinct().join(broadcast_if_small(fixes), "bad")
    # a passage is known by its hash: where two share one, each meets only corrections of words
    own = words.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("bad", "good"))).alias("table"))

    def run_words(batches):
        for b in batches:
            got = [finish(t, set(k), dict(c)) for t, k, c in zip(b["text"], b["kinds"], b["table"])]
            yield pd.DataFrame({"row_id": b["row_id"], "clean_passage": [t for t, _ in got], "noise": [k for _, k in got]})

    mended = held.join(own, "key").select("row_id", "text", "kinds", "table").mapInPandas(run_words, _REPAIRED)
    # what passed the filter without a correction, and all other passages, are done
    plain = prepared.filter(F.size("asked") == 0).unionByName(held.join(own.select("key"), "key", "left_anti"))
    return mended.unionByName(plain.select("row_id", F.col("text").alias("clean_passage"), F.col("kinds").alias("noise")))


def noise_found(examples: DataFrame) -> DataFrame:
    return repair_passages(examples).select("row_id", F.explode("noise").alias("noise")).distinct()
