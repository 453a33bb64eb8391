"""Problem 3: prompts whose response is no proper answer, with the kind of defect.

Distinct responses are sorted by text over range partitions and the common prefixes of neighbours are
compared: a text that a neighbour continues within a sentence is a shortened version. Spikes in the
lengths of all distinct responses show length limits. Rules for copied, refusing and wrong-language
responses follow, row by row. What neither neighbours nor lengths show is judged by its ending.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.llm import residue as R
from quillmill.llm.blank import is_blank
from quillmill.session import broadcast_if_small, materialize

# ---- endings ----------------------------------------------------------------------------------

_STOP = re.compile(r"[.!?。]+[\"”’»'\)\]*_]*\s*$")
_CUT = re.compile(r"(?:…|\.\.\.|[-–—]|,|;|:)\s*$")
_LABEL = re.compile(r"^[A-Z][A-Za-z]+(?: [A-Za-z]+)?: (?![A-Z])[^.!?]{1,40}$")
_FORMULA = re.compile(r"[⊢∀∃→∴≡¬∧∨⊨□◇]|/ therefore ")
_BARE = re.compile(r"^(?:\d{1,3}[.)]|[-*•]|P\d+|[A-Z][A-Za-z]*:)$")
#: Words an unfinished sentence may end on but a label value does not.
_OPEN_WORDS = set("a an the this that these those our every and or but of in on to by from with about as for if whether than that which who is are be not no only any some each its their il la le les un une des de du et ou que qui der die das den dem ein eine und oder dass el los las una y o que en con por para".split())


def balanced(text: str) -> bool:
    """No bracket or quotation is left open at the end of the text."""
    for a, b in ("()", "[]", "{}", "“”", "«»"):
        if text.count(a) > text.count(b):
            return False
    return text.count('"') % 2 == 0


def unfinished(text: str, endings: frozenset[str] = frozenset()) -> int:
    """0: the last sentence is complete; 1: it may be (a short label or entry); 2: it is not.

    `endings` are last lines that many texts of the corpus share, which makes them complete.
    """
    body = text.rstrip()
    line = body[body.rfind("\n") + 1 :].strip()
    if line in endings:
        return 0
    if line and any(e.startswith(line) for e in endings):
        return 2
    if _BARE.match(line):
        return 2
    if body.endswith("…") or body.endswith("...") and not body.endswith("...."):
        return 2
    if _STOP.search(body):
        return 0
    if body[-1:] in "\"”»'])}>":
        return 0 if balanced(line) else 2
    if _CUT.search(body):
        return 2
    last = line.rsplit(" ", 1)[-1].lower()
    if last in _OPEN_WORDS:
        return 2
    if _LABEL.match(line) and line.count(" ") <= 5 or _FORMULA.search(line) and balanced(line):
        return 1
    return 2


# ---- copies -----------------------------------------------------------------------------------

_WORD = re.compile(r"[^\W_]+")


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a row of the table per word of b held in the bits of one number."""
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        met = row & where.get(w, 0)
        row = (row + met | row - met) & full
    return len(a) - row.bit_count()


def copies_prompt(prompt: str, response: str) -> bool:
    """The response's words are, in order, (nearly) the prompt's and hardly any others.

    The longest common subsequence must take up five sixths of the response's words and half of the
    prompt's, or nine tenths of the response's if the prompt was cut. A prompt repeated several times is a copy too.
    """
    if len(response) > 4.5 * len(prompt) + 60:
        return False
    own = set(response.lower().split())
    if len(own - set(prompt.lower().split())) > 0.5 * len(own) + 2:
        return False
    r = _WORD.findall(response.lower())
    p = _WORD.findall(prompt.lower())
    if not p or len(r) < 4:
        return False
    p *= max(1, round(len(r) / len(p)))
    if len(r) > 1.35 * len(p) + 6:
        return False
    common = sum((Counter(r) & Counter(p)).values())
    if common < 0.75 * len(r):
        return False
    same = common_subsequence(p, r)
    return same >= 0.8 * len(r) and same >= 0.5 * len(p) or same >= 0.9 * len(r) and len(r) >= 6


# ---- languages --------------------------------------------------------------------------------

#: Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and that is to in our this every not we which it on as for be with from by what must are or an its have has does would could can if whether one who these those their you your i my was were but at no he she they will there how about when only some more",
    "de": "der die das und nicht ist ein eine dass zu den dem des von mit sich auf für es im ich sie er wir als auch an wie nach bei aus wenn wird jede jeder diese dieser aber denn doch zugleich man hier was wer warum kann gilt kaum also zwar bleibt",
    "fr": "le la les de des du un une et est que qui ne pas dans pour en ce cette au aux sur par il elle nous se son sa ses mais plus ou ou donc si alors parce cependant ainsi avec rien pourtant lorsque pourquoi notre guère",
    "es": "el la los las de del un una y es que no en por para con se su lo como más pero si esta este nuestra entonces todo al le sin porque cuando qué cuál hay nada dirá embargo sobre",
    "la": "et non est quod cum ad sed nec ergo quia itaque tamen quamquam si aut enim vel per ut ex omnis haec hoc quam autem aliquis atque sunt esse sequitur vix nihil rerum mens anima ratio",
}
_ALL = Counter(w for words in FUNCTION_WORDS.values() for w in set(words.split()))
#: Words of one language only, with that language.
_OWN = {w: c for c, words in FUNCTION_WORDS.items() for w in words.split() if _ALL[w] == 1}
#: Requests for a language; the names are fixed values.
_REQUEST = re.compile(r"\b(?:(?:in|into|auf|en|in het)\s+(english|german|french|spanish|latin|deutsch|englisch|französisch|spanisch|latein(?:isch)?|anglais|allemand|français|espagnol|latin|inglés|alemán|francés|español|latín)|translate)\b", re.IGNORECASE)
_CODES = {"english": "en", "englisch": "en", "anglais": "en", "inglés": "en", "german": "de", "deutsch": "de", "allemand": "de", "alemán": "de", "french": "fr", "französisch": "fr", "français": "fr", "francés": "fr", "spanish": "es", "spanisch": "es", "espagnol": "es", "español": "es", "latin": "la", "latein": "la", "lateinisch": "la", "latín": "la"}


def language(text: str) -> tuple[str | None, float]:
    """(code, margin) by function words; None if there are too few of them."""
    met = Counter(map(_OWN.get, text.lower().replace("'", " ").replace("’", " ").split()))
    score = {c: met[c] for c in FUNCTION_WORDS}
    (second, _), (top, best) = sorted((n, c) for c, n in score.items())[-2:]
    return (best, (top - second) / sum(score.values())) if top >= 2 else (None, 0.0)


def wrong_language(prompt: str, response: str) -> bool:
    """The response is clearly in one language, and neither the prompt's nor one the prompt asks for."""
    got, margin = language(response)
    if got is None or margin < 0.3:
        return False
    asked = [_CODES.get((m or "").lower()) for m in _REQUEST.findall(prompt)]
    if asked:
        return got not in asked and None not in asked
    own, sure = language(re.sub(r"[\"“«][^\"”»]*[\"”»]", " ", prompt))
    if own is None or sure < 0.3:
        own, sure = language(prompt)
    return own is not None and sure >= 0.2 and got != own


# ---- refusals ---------------------------------------------------------------------------------

_SELF = r"(?:i|i['’]m|i['’]d|we|the assistant|this assistant|my (?:guidelines|instructions|policy|policies|rules))"
_ACT = r"(?:answer|respond|reply|help|assist|provide|comply|engage|discuss|produce|deal with|touch|handle|continue|do (?:this|that|so)|address|complete|write|say|comment|share|permit|offer|give)"
#: A sentence in which the assistant says that it will not or may not answer.
REFUSAL = re.compile(
    r"\b(?:i|we)(?: am|['’]m| was)? (?:simply |really |also )?(?:(?:can ?not|can['’]?t|could not|will not|won['’]t|would not|wouldn['’]t|do not|don['’]t|must not|may not|shall not|must)(?: be able to| be)?(?: to)? (?:decline|refuse|refrain|pass|leave|" + _ACT + r"(?:ing)?|feel (?:comfortable|able)|have (?:permission|the (?:right|permission|ability)))"
    r"|(?:would rather not|prefer not to|have to (?:pass|decline|refuse)|had better not|(?:not |un)able to (?!find|see|detect)|not (?:allowed|permitted|in a position|comfortable|going|authori[sz]ed)|unwilling|forbidden|decline|refuse|have been (?:asked|told|instructed) not to))"
    r"|\bthe assistant (?:is not|cannot|can ?not|will not|declines|refuses|is unable|must decline)|\b(?:beyond|outside) (?:my abilities|my remit|what i (?:am|can|may)|my scope)|\boff limits\b|\bout of bounds for me\b"
    r"|\bmy (?:guidelines|instructions|policy|policies|rules|training) (?:do not|does not|don['’]t|forbid|prevent|prohibit|keep)|\b(?:no answer|no reply|no response) (?:will|can|shall) be (?:given|provided)|\bbreach the rules i\b|\bnot be appropriate for me\b|\bmust leave (?:this |that )?unanswered\b"
    r"|^(?:hello! |sorry[,.!] )?(?:declined|request declined|refused)\.?$|\blet us (?:talk|speak) about something else\b|\bplease (?:choose|ask|pick) (?:another|something else)"
    r"|\bne (?:peux|puis|pourrai) pas\b|\bje dois (?:refuser|décliner)\b|\bm['’]est impossible de\b|\bje ne suis pas (?:autorisé|en mesure|habilité)"
    r"|\b(?:kann|darf|werde|möchte) ich (?:\w+ ){0,4}nicht\b|\bich (?:kann|darf|werde|möchte) (?:\w+ ){0,5}nicht\b|\bgebe ich keine auskunft\b|\bmuss ich (?:\w+ ){0,3}ablehnen\b"
    r"|\bno puedo (?:ayudar|responder|contestar|cumplir)|\bno me es posible\b|\bdebo (?:rechazar|declinar)\b|\bno estoy (?:autorizado|en condiciones)",
    re.IGNORECASE,
)
#: The same words in an argument: the sentence rejects a claim and goes on to say why.
_ARGUES = re.compile(r"\b(?:accept|grant|concede|agree|see|find|deny|believe|follow|allow) (?:that|the premise|a gap|any|it|how|why)\b|\bunable to find\b|\bargument fails\b|\bthe author (?:refuses|declines)\b", re.IGNORECASE)
#: A refusal holds one of these words; looking them up is cheaper than the pattern.
_TRIGGERS = frozenset("i i'm i’m i'd i’d my assistant request topic declined declined. refused refused. us je j' ich puedo posible debo estoy m'est appropriate unanswered prompt given bounds abilities abilities, please".split())
_SENTENCES = re.compile(r"(?<=[.!?])\s+|\n+")


#: What goes with a refusal: thanks, regrets, offers and talk about the request or the rules, by which no answer is given.
_AROUND = re.compile(r"\b(?:sorry|apolog\w+|regret\w*|afraid|unfortunately|thank\w*|guidelines?|polic(?:y|ies)|rules?|instructions|allowed|permitted|appropriate|comfortable|sensitive|requests?|topics?|help|assist\w*|consult|experts?|something else|anything else|another (?:question|topic|task)|instead|let me know|feel free|understand(?:ing)? (?:that|your)|your (?:question|interest|request|understanding|patience)|désolé\w*|regrette|leider|entschuldig\w+|lo siento|lamento)\b", re.IGNORECASE)
#: Shares of a response: of refusing sentences, or of these and what goes with them.
REFUSING_SHARE, AROUND_SHARE = 0.25, 0.5


def refuses(text: str) -> bool:
    """The response declines: refusing sentences are a quarter of its text or half of its sentences, or half of the
    text with those that go with a refusal."""
    if _TRIGGERS.isdisjoint(text.lower().split()):
        return False
    no = around = whole = declined = 0
    sentences = [s for s in _SENTENCES.split(text.strip()) if s]
    refusing = [not _TRIGGERS.isdisjoint(s.lower().split()) and bool(REFUSAL.search(s)) and not _ARGUES.search(s) for s in sentences]
    if not any(refusing):
        return False
    for s, own in zip(sentences, refusing):
        whole += len(s)
        if own:
            no += len(s)
            declined += 1
        elif _AROUND.search(s):
            around += len(s)
    return no > 0 and (no >= REFUSING_SHARE * whole or 2 * declined >= len(sentences) or no + around >= AROUND_SHARE * whole)


# ---- judging ----------------------------------------------------------------------------------


def decide(prompt: str | None, response: str | None, cut: bool, at_limit: bool, endings: frozenset[str]) -> tuple[str | None, str | None]:
    """(defect, step) of one pair. `cut`: a neighbour continues the text within a sentence; `at_limit`: its length is a spike.

    At a spike only a final stop or a shared last line is a complete ending.
    """
    if is_blank(response):
        return "empty", "rule"
    prompt = prompt or ""
    if copies_prompt(prompt, response):
        return "copied", "rule"
    if refuses(response):
        return "refusal", "rule"
    if wrong_language(prompt, response):
        return "language", "rule"
    if cut:
        return "truncated", "prefix"
    open_end = unfinished(response, endings)
    if at_limit and (open_end or not _STOP.search(response.rstrip()) and response.rstrip().rsplit("\n", 1)[-1].strip() not in endings):
        return "truncated", "length"
    return ("truncated", "ending") if open_end == 2 else (None, None)


def judge(prompt: str | None, response: str | None, cut: bool, at_limit: bool, endings: frozenset[str]) -> str | None:
    return decide(prompt, response, cut, at_limit, endings)[0]


#: What may stand at the end of a shortened text instead of what was there, and the characters two texts must share.
_MARK = re.compile(r"[\s.…\-–—]{0,4}\Z")
LEAST_SHARED = 24


def common_prefix(a: str, b: str) -> int:
    """Length of the longest common prefix, by bisection."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def shortens(a: str, b: str, least: int = LEAST_SHARED) -> bool:
    """`a` is `b` cut within a sentence, perhaps with an ellipsis or a dash at the cut.

    The common prefix is all of `a` but such a mark, and what follows in `b` goes on: in the same word, or on
    the same line after no final stop, or in lower case after one (an abbreviation). Texts cut where a
    sentence or a line of `b` ends are complete as they stand.
    """
    n = common_prefix(a, b)
    if n < least or len(b) - n <= len(a) - n or not _MARK.match(a[n:]):
        return False
    rest, kept = b[n:], a[:n].rstrip()
    if not re.search(r"\w", rest):
        return False
    if a[n - 1].isalnum() and rest[0].isalnum():
        return True
    ahead = rest.lstrip(" \t")
    if ahead[:1] in "\r\n":
        return False
    return not _STOP.search(kept) or ahead[:1].islower()


_PREFIX = T.StructType([T.StructField("partition", T.IntegerType()), T.StructField("at", T.StringType()), T.StructField("response", T.StringType())])


def shortened(responses: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """(response): distinct texts that another text continues within a sentence (`shortens`), by comparing sorted neighbours.

    No other text shares a longer prefix with a text than one of its two neighbours. Texts are
    range-partitioned and sorted; the last text of a partition is compared with the first of the next
    partition that has any: two rows per partition. Nulls are left out; copies are collapsed before the shuffle.
    """
    texts = responses.filter(F.length("response") > 0).groupBy("response").agg(F.lit(1).alias("_n")).select("response")
    ordered = texts.repartitionByRange("response").sortWithinPartitions("response").withColumn("partition", F.spark_partition_id())

    def run(batches):
        held, part = None, 0
        for b in batches:
            rows, part = b["response"].tolist(), int(b["partition"].iloc[0]) if len(b) else part
            out = []
            if held is None and rows:
                out.append((part, "first", rows[0]))
            for t in rows:
                if held is not None:
                    out += [(part, "inner", x) for x, y in ((held, t), (t, held)) if shortens(x, y, least)]
                held = t
            if out:
                yield pd.DataFrame(out, columns=_PREFIX.names)
        if held is not None:
            yield pd.DataFrame([(part, "last", held)], columns=_PREFIX.names)

    @F.pandas_udf(T.BooleanType())
    def cut(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([x is not None and y is not None and shortens(x, y, least) for x, y in zip(a, b)], dtype=bool)

    marks = materialize(ordered.mapInPandas(run, _PREFIX), "neighbours")
    inner = marks.filter("at = 'inner'").select("response")
    ends = marks.filter("at <> 'inner'").groupBy("partition").agg(F.max(F.when(F.col("at") == "first", F.col("response"))).alias("first"), F.max(F.when(F.col("at") == "last", F.col("response"))).alias("last"))
    order = Window.partitionBy(F.lit(0)).orderBy("partition")  # one row per partition
    met = ends.select("first", "last", F.lead("first").over(order).alias("next"), F.lag("last").over(order).alias("before"))
    both = met.select(F.col("last").alias("a"), F.col("next").alias("b")).union(met.select("first", "before"))
    return inner.union(both.filter(cut("a", "b")).select(F.col("a").alias("response"))).distinct()


#: A length is a spike if this many times as many responses have it as the median of its neighbours.
SPIKE_FACTOR, SPIKE_ROWS, SPIKE_REACH = 8, 20, 10
#: A last line that at least this share of the distinct unfinished responses have is a complete ending.
ENDING_SHARE, ENDING_ROWS = 0.004, 3


def _spikes(lengths: DataFrame) -> frozenset[int]:
    """Lengths (`n`) that stand out from their neighbours. The histogram has one row per length and is reduced before it
    is collected: each spike stands for SPIKE_ROWS texts and SPIKE_FACTOR times its neighbours, so there are far fewer than lengths."""
    counts = lengths.groupBy("n").agg(F.count("*").alias("rows"))
    high = counts.filter(F.col("rows") >= SPIKE_ROWS)
    near = high.select("n", "rows", F.explode(F.sequence(F.col("n") - SPIKE_REACH, F.col("n") + SPIKE_REACH)).alias("m")).filter("m <> n")
    around = near.join(counts.select(F.col("n").alias("m"), F.col("rows").alias("other")), "m", "left").groupBy("n", "rows").agg(F.percentile(F.coalesce("other", F.lit(0)), F.lit(0.5)).alias("mid"))
    return frozenset(r.n for r in around.filter(F.col("rows") >= SPIKE_FACTOR * F.greatest(F.col("mid"), F.lit(1))).collect())


def ending_statistics(examples: DataFrame) -> tuple[frozenset[str], frozenset[int]]:
    """(complete endings, spike lengths) over distinct responses: copies count once.

    Lengths are those of all responses without a final stop or closing mark; at most 1 / ENDING_SHARE
    endings reach their share, so the list is bounded.
    """
    body = F.regexp_replace("assistant_response", r"\s+\z", "")
    # a text is told from others by its hash here, so that only hashes, lengths and last lines are shuffled
    open_ = examples.filter(F.length("assistant_response") > 40).select(body.alias("b")).filter(~F.substring("b", -1, 1).isin(*".!?"))
    last = F.substring_index("b", "\n", -1)
    open_ = open_.groupBy(F.xxhash64("b").alias("h"), F.length("b").alias("n"), F.when(F.length(last) <= 80, last).alias("line"), F.substring("b", -1, 1).isin(*"\"”»])}>").alias("closed")).agg(F.lit(1).alias("_n"))
    open_ = materialize(open_.select("n", "line", "closed"), "open-endings")
    total = open_.filter("not closed").count()
    least = max(ENDING_ROWS, ENDING_SHARE * total)
    lines = open_.filter("line is not null and not closed").groupBy("line").agg(F.count("*").alias("rows")).filter(F.col("rows") >= least)
    endings = frozenset(r.line.strip() for r in lines.collect() if not R.has_slot(r.line) and not _BARE.match(r.line.strip()) and r.line.strip().rsplit(" ", 1)[-1].lower() not in _OPEN_WORDS)
    return endings, _spikes(open_)


_OUT = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("defect", T.StringType()), T.StructField("step", T.StringType())])


def defects(examples: DataFrame) -> DataFrame:
    """(row_id, defect, step) of every row whose response is no proper answer and holds no residue (problem 5).

    `step` is what decided: "prefix" (a neighbour in sorted order), "length" (a spike), "ending" or "rule".
    Null, blank and label-only responses are `empty`; a null prompt can be neither copied nor answered
    in another language. Repeated rows are judged alike. An empty table gives no rows.
    """
    spark = examples.sparkSession
    tables = spark.sparkContext.broadcast(R.packed_tables(R.corpus_tables(examples)))
    rows = examples.select("row_id", "user_prompt", "assistant_response")
    endings, spikes = ending_statistics(rows)
    body = F.regexp_replace("assistant_response", r"\s+\z", "")
    short = shortened(rows.select(body.alias("response"))).select(F.xxhash64("response").alias("_h"), F.md5(F.col("response").cast("binary")).alias("_m")).distinct()
    keyed = rows.withColumn("_k", F.xxhash64(body)).withColumn("_km", F.md5(body.cast("binary")))
    marked = keyed.join(broadcast_if_small(short), (F.col("_k") == F.col("_h")) & (F.col("_km") == F.col("_m")), "left").select("row_id", "user_prompt", "assistant_response", F.col("_h").isNotNull().alias("cut"))

    def run(batches):
        own = R.unpacked_tables(tables.value)
        for b in batches:
            texts = b["assistant_response"].tolist()
            held = R.classify(texts, own)
            out = []
            for i, p, t, c, (k, _) in zip(b["row_id"], b["user_prompt"], texts, b["cut"], held):
                if k is None:
                    d, step = decide(p, t, bool(c), t is not None and len(t.rstrip()) in spikes, endings)
                    if d:
                        out.append((i, d, step))
            yield pd.DataFrame(out, columns=_OUT.names)

    return marked.mapInPandas(run, _OUT)


def defects_found(examples: DataFrame) -> DataFrame:
    return defects(examples).select("row_id", "defect").distinct()
