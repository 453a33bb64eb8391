"""Scalar operators: classification, hashing, numbers, vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.functions import lexicon as L
from quillmill.functions.text import WS, let, lower_words, signal_sentences, strip, words


def hits(text: Column, patterns: list[str]) -> Column:
    """How many of the patterns match."""
    return reduce(lambda a, b: a + b, [text.rlike(p).cast("int") for p in patterns])


def present(text: Column, phrases: list[str]) -> Column:
    """How many of the phrases the text contains (each at most once)."""
    return reduce(lambda a, b: a + b, [text.contains(p).cast("int") for p in phrases])


def any_of(text: Column, phrases: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in phrases])


def formal_hits(sentence: Column) -> Column:
    """Formal patterns run on the lower-cased sentence, so those with capitals never match."""
    return hits(F.lower(sentence), L.FORMAL_PATTERNS)


def factual_hits(sentence: Column) -> Column:
    return hits(sentence, L.FACTUAL_PATTERNS)


def claim_type(sentence: Column) -> Column:
    """Kind with the most hits; ties go to formal, then factual, then meta; none: interpretive."""
    f, a, m = formal_hits(sentence), factual_hits(sentence), present(F.lower(sentence), L.META_PHRASES)
    return F.when((f == 0) & (a == 0) & (m == 0), "interpretive").when((f >= a) & (f >= m), "formal").when(a >= m, "factual").otherwise("meta_philosophical")


def claim_confidence(sentence: Column, kind: Column) -> Column:
    return F.when(kind == "formal", F.least(0.5 + 0.15 * formal_hits(sentence), F.lit(0.99))).when(kind == "factual", F.least(0.5 + 0.2 * factual_hits(sentence), F.lit(0.99))).otherwise(0.5)


def claim_tier(text: Column) -> Column:
    t = F.lower(text)
    return F.when(any_of(t, L.AXIOM_MARKERS), 1).when(any_of(t, L.CONTESTED_MARKERS), 4).otherwise(2)


def verdict_status(output: Column) -> Column:
    """unsat before sat, as one contains the other."""
    t = F.lower(output)
    return F.when(t.contains("unsat"), "verified").when(t.contains("sat"), "refuted").when(t.contains("unknown") | t.contains("timeout"), "timeout").otherwise("not_formalizable")


def repair_strategy(artifact: Column, status: Column, attempt: Column) -> Column:
    return F.when(artifact.contains("error"), "re_encode").when(status == "refuted", F.when(attempt == 0, "re_state").otherwise("decompose")).when(status == "timeout", "decompose").otherwise("re_encode")


def true_confidence(z3: Column, oracle: Column, magnitude: Column, user: Column) -> Column:
    """Weighted mean of the outcomes present (3, 2, 1.5, 0.5); rejection counts 0.3; none: 0.5."""
    signals = [(3.0, F.when(z3, 1.0).when(~z3, 0.0)), (2.0, F.when(oracle, 1.0).when(~oracle, 0.0)), (1.5, 1.0 - F.least(magnitude, F.lit(1.0))), (0.5, F.when(user, 1.0).when(~user, 0.3))]
    signals[2] = (1.5, F.when(magnitude.isNotNull(), 1.0 - F.least(magnitude, F.lit(1.0))))
    top = reduce(lambda a, b: a + b, [F.coalesce(w * s, F.lit(0.0)) for w, s in signals])
    weight = reduce(lambda a, b: a + b, [F.when(s.isNotNull(), w).otherwise(0.0) for w, s in signals])
    return F.when(weight == 0.0, 0.5).otherwise(top / weight)


def true_routing(confidence: Column) -> Column:
    """0 self, 1 oracle, 2 hybrid."""
    return F.when(confidence >= 0.85, 0).when(confidence < 0.4, 1).otherwise(2)


def true_error(z3: Column, oracle: Column, magnitude: Column) -> Column:
    """0 none, 1 factual, 2 reasoning, 3 formalization, 4 scope; a null magnitude counts as absent."""
    none = F.lit(False)
    return F.when(F.coalesce(~z3, none), 3).when(F.coalesce(~oracle, none), F.when(F.coalesce(magnitude, F.lit(0.5)) > 0.7, 1).otherwise(2)).when(F.coalesce(magnitude, F.lit(0.0)) > 0.8, 4).otherwise(0)


def safe_filename(title: Column, longest: int = 120) -> Column:
    """Illegal characters dropped, blanks to underscores, cut."""
    return F.substring(F.regexp_replace(F.regexp_replace(title, r"[<>:\"/\\|?*]", ""), rf"[{WS}]+", "_"), 1, longest)


def book_filename(name: Column, longest: int = 120) -> Column:
    """Without series, library and year marks; word characters, blanks to underscores, hash suffix if long."""
    n = F.regexp_replace(name, r"^\[.*?\]\s*", "")
    n = F.regexp_replace(n, r"(?i)\s*-\s*libgen\.\w+$", "")
    n = F.regexp_replace(n, r"\s*\(\d{4}.*?\)$", "")
    n = F.regexp_replace(strip(F.regexp_replace(n, rf"[^\p{{L}}\p{{N}}_{WS}\-.]", "")), rf"[{WS}]+", "_")
    n = F.when(F.length(n) > longest, F.concat(F.substring(n, 1, longest - 9), F.lit("_"), F.substring(F.md5(n.cast("binary")), 1, 8))).otherwise(n)
    return F.when(n == "", "unnamed").otherwise(n)


def title_key(title: Column) -> Column:
    """_ - . as blanks, (..) and [..] dropped, a-z 0-9 and single blanks kept."""
    t = F.regexp_replace(F.lower(title), r"[_\-.]", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"\([^)]*\)", ""), r"\[[^\]]*\]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9 ]", ""), r" +", " "))


def alnum_key(title: Column) -> Column:
    return F.regexp_replace(F.lower(title), r"[^a-z0-9]", "")


def path_category(path: Column) -> Column:
    """First part of a relative path."""
    return F.coalesce(F.nullif(F.split_part(path, F.lit("/"), F.lit(1)), F.lit("")), F.lit("unknown"))


def index_category(path: Column) -> Column:
    """First category of the list that is a part of the path, then the two collections, then unknown."""
    parts = F.split(F.lower(path), "/")
    out = None
    for c in L.INDEX_CATEGORIES:
        out = (F.when if out is None else out.when)(F.array_contains(parts, c), c)
    return out.when(F.array_contains(parts, "sep"), "philosophy_of_mind").when(F.array_contains(parts, "arxiv"), "cross_disciplinary").otherwise("unknown")


def file_category(name: Column) -> Column:
    """Keyword cascade over a file name; the first category with a hit wins."""
    n = F.lower(name)
    out = None
    for category, keys in L.FILE_CATEGORIES.items():
        out = (F.when if out is None else out.when)(any_of(n, keys), category)
    return out.otherwise("broader_philosophy")


def stem(path: Column) -> Column:
    return F.lower(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", ""))


def source_citation(path: Column) -> Column:
    """A citation from the file name: a work and ordinal, else the collection, else category and name."""
    name = stem(path)
    ordinal = F.regexp_extract(name, r"(first|second|third|fourth|fifth|sixth|[ivx]+|[1-6])", 1)
    out = None
    for key, title in L.WORKS.items():
        out = (F.when if out is None else out.when)(name.contains(key), F.when(ordinal != "", F.concat(F.lit(title + ", "), ordinal)).otherwise(title))
    plain = F.replace(F.replace(name, F.lit("-"), F.lit(" ")), F.lit("_"), F.lit(" "))
    part = F.filter(F.split(F.lower(path), "/"), lambda p: p.isin(L.INDEX_CATEGORIES))
    category = F.coalesce(F.try_element_at(part, F.lit(1)), F.lit("unknown"))
    return out.when(F.lower(path).contains("sep"), F.concat(F.lit("SEP: "), F.initcap(plain))).when(F.lower(path).contains("arxiv"), F.concat(F.lit("arXiv: "), name)).otherwise(F.concat(category, F.lit(": "), plain))


def title_relevant(title: Column, author: Column) -> Column:
    """A strong keyword in the title, or a part of the author of five letters or more."""
    t = F.lower(title)
    return any_of(t, L.TITLE_KEYWORDS) | F.coalesce(F.exists(words(F.lower(author)), lambda p: (F.length(p) >= 5) & t.contains(p)), F.lit(False))


def author_matches(names: Column, query: Column) -> Column:
    """A part of four letters or more of the query occurs in a part of one of the names."""
    parts = words(F.replace(F.lower(F.array_join(names, " ")), F.lit(","), F.lit(" ")))
    return F.exists(words(F.lower(query)), lambda q: (F.length(q) >= 4) & F.exists(parts, lambda p: p.contains(q)))


def proof_hash(text: Column, encoding: Column, status: Column) -> Column:
    """First 16 hex digits of sha256 of text|encoding|status; nulls count as empty."""
    e = F.lit("")
    return F.substring(F.sha2(F.concat_ws("|", F.coalesce(text, e), F.coalesce(encoding, e), F.coalesce(status, e)), 256), 1, 16)


def claim_id(text: Column) -> Column:
    return F.concat(F.lit("claim_"), F.substring(F.sha2(text, 256), 1, 12))


def content_words(text: Column, stop: list[str]) -> Column:
    return F.array_except(F.array_distinct(lower_words(text)), F.array(*map(F.lit, stop)))


def agreement(a: Column, b: Column, stop: list[str] = L.AGREEMENT_STOP, empty: float | None = 0.5) -> Column:
    """Jaccard similarity of content words; `empty` where either side has none (None: union of at least 1)."""
    x, y = content_words(a, stop), content_words(b, stop)
    shared, union = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    if empty is None:
        return shared / F.greatest(union, F.lit(1))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(float(empty))).otherwise(shared / union)


def equivalent(a: Column, b: Column) -> Column:
    """Jaccard over 0.75; false where either side has no content word."""
    return agreement(a, b, L.EQUIVALENCE_STOP, 0.0) > 0.75


def repetition(w: Column) -> Column:
    """Share of repeated word 4-grams; 0 below 20 words."""

    def share(x):
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size(x) - 3, F.lit(1))), lambda i: F.array_join(F.slice(x, i, 4), " "))
        return F.when(F.size(x) >= 20, 1.0 - F.size(F.array_distinct(grams)) / F.greatest(F.size(x) - 3, F.lit(1))).otherwise(0.0)

    return let(w, share)


def lite_signals(text: Column, w: Column | None = None) -> dict[str, Column]:
    """The eleven text signals. `w`: a column that holds the lower-case words already, so that they are split once."""
    w, low = lower_words(text) if w is None else w, F.lower(text)
    n = F.greatest(F.size(w), F.lit(1))
    s = F.size(signal_sentences(text))
    hedges = present(low, L.HEDGES)
    domain = F.size(F.filter(w, lambda x: any_of(x, L.SIGNAL_DOMAIN)))
    return {
        "hedge_count": hedges, "hedge_density": hedges / n, "repetition_rate": repetition(w), "response_length": n, "sentence_count": s, "avg_sentence_length": n / F.greatest(s, F.lit(1)), "domain_density": domain / n,
        "question_marks": F.length(text) - F.length(F.replace(text, F.lit("?"), F.lit(""))), "conditionals": F.size(F.filter(w, lambda x: x.isin(L.CONDITIONALS))), "negation_density": F.size(F.filter(w, lambda x: x.isin(L.NEGATIONS))) / n, "diversity": F.size(F.array_distinct(w)) / n,
    }


#: Divisors that scale the signals to a vector, in the order of `lite_signals`.
SIGNAL_SCALES = (10.0, 1.0, 1.0, 500.0, 20.0, 30.0, 1.0, 5.0, 10.0, 1.0, 1.0)


def signal_vector(signals: dict[str, Column]) -> Column:
    return F.array(*[c / s for c, s in zip(signals.values(), SIGNAL_SCALES)])


def full_signals(text: Column, query: Column, w: Column | None = None, mean: Column | None = None, std: Column | None = None, token: Column | None = None, attention: Column | None = None) -> dict[str, Column]:
    """Text part of the full signals, model part from columns where given (default 0.5; token entropy from hedges)."""
    w = lower_words(text) if w is None else w
    n = F.greatest(F.size(w), F.lit(1))
    hedges = present(F.lower(text), L.HEDGES) / n
    s = signal_sentences(text)
    total = F.greatest(F.size(s), F.lit(1))
    density = F.size(F.filter(w, lambda x: x.isin(L.SIGNAL_DOMAIN_EXACT))) / n
    clauses = F.size(F.split(query, "[,;]"))
    half = F.lit(0.5)
    return {
        "hidden_mean": mean if mean is not None else half, "hidden_std": std if std is not None else half, "token_entropy": F.least(token / 10.0, F.lit(1.0)) if token is not None else F.least(hedges / 5.0, F.lit(1.0)), "attention_entropy": F.least(attention / 8.0, F.lit(1.0)) if attention is not None else half,
        "hedge_ratio": hedges, "repetition_ratio": repetition(w), "response_length": n / 500.0, "ood_score": F.greatest(F.lit(0.0), 1.0 - density * 10), "question_complexity": F.when(F.length(query) > 0, F.least(F.size(words(query)) * clauses / 200.0, F.lit(1.0))).otherwise(half),
        "formal_ratio": F.size(F.filter(s, lambda x: x.rlike("(?i)" + L.FORMAL_SENTENCE))) / total, "factual_ratio": F.size(F.filter(s, lambda x: x.rlike("(?i)" + L.FACTUAL_SENTENCE))) / total,
    }


def entropy(p: Column) -> Column:
    """-sum p ln(p + 1e-10) of an array of probabilities."""
    return -F.aggregate(p, F.lit(0.0), lambda a, x: a + x * F.log(x + F.lit(1e-10)))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def hidden_similarity(v: Column, usual: float = 45.0) -> Column:
    """max(0, 1 - |norm - usual| / usual) of a hidden state."""
    return F.greatest(F.lit(0.0), 1.0 - F.abs(norm(v) - usual) / usual)


def original_signals(text: Column) -> dict[str, Column]:
    """Hedges present (each once), share of repeated word 4-grams and words of a response."""
    w = lower_words(text)
    return {"hedges": present(F.lower(text), L.ORIGINAL_HEDGES), "repetition": repetition(w), "words": F.size(w)}


def padded(v: Column, size: int) -> Column:
    """The first `size` numbers, zeros behind."""
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0), size)), 1, size)


def signals_4160(hidden: Column, entropies: Column, attention: Column, scalars: Column) -> Column:
    """Flat model signals: hidden 4096, 32 entropies, 16 attention values and scalars with mean, deviation, max and min of the entropies."""
    d = F.transform(entropies, lambda x: x.cast("double"))
    mean = F.coalesce(F.aggregate(d, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(d), F.lit(0)), F.lit(5.0))
    spread = F.coalesce(F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.nullif(F.size(d), F.lit(0))), F.lit(0.0))
    tail = F.array(mean, spread, F.coalesce(F.array_max(d), F.lit(10.0)), F.coalesce(F.array_min(d), F.lit(0.0)))
    return padded(F.concat(padded(hidden, 4096), padded(d, 32), padded(attention, 16), tail, scalars), 4160)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """0 where either norm is 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot / n)


def theory_vector(values: Column) -> Column:
    """Ordered coordinates of a map from dimension to value; a missing dimension is 0.5."""
    return F.array(*[F.coalesce(F.try_element_at(values, F.lit(d)), F.lit(0.5)) for d in L.DIMENSIONS])


def belnap_and(a: Column, b: Column) -> Column:
    """Numeric minimum on 0 neither, 1 false, 2 true, 3 both."""
    return F.least(a, b)


def belnap_or(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def belnap_not(a: Column) -> Column:
    return F.when(a == 1, 2).when(a == 2, 1).otherwise(a)


def belnap_and_lattice(a: Column, b: Column) -> Column:
    """Meet of the truth lattice: true only if both say true, false if either says false."""
    t = ((a == 2) | (a == 3)) & ((b == 2) | (b == 3))
    f = (a == 1) | (a == 3) | (b == 1) | (b == 3)
    return F.when(t & f, 3).when(t, 2).when(f, 1).otherwise(0)


def belnap_predicates(a: Column) -> dict[str, Column]:
    """Whether a value says true, says false, says both, says nothing."""
    return {"is_true": a.isin(2, 3), "is_false": a.isin(1, 3), "is_both": a == 3, "is_neither": a == 0}


def usage_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    return tokens_in * price_in / 1000 + tokens_out * price_out / 1000


def choice_letter(response: Column) -> Column:
    """First A-D that stands alone in the upper-cased response, null if none."""
    return F.nullif(F.regexp_extract(F.upper(response), r"\b([A-D])\b", 1), F.lit(""))


def rubric_hit(response: Column, point: Column) -> Column:
    """At least 40 % of the point's words (only words over three letters can match) occur in the response; a null response has none."""
    w = lower_words(point)
    found = F.size(F.filter(w, lambda x: (F.length(x) > 3) & F.lower(response).contains(x)))
    return found >= 0.4 * F.size(w)


def defers(response: Column) -> Column:
    return any_of(F.lower(response), L.DEFERRALS)


def says_valid(response: Column, first_line: bool = False) -> Column:
    """valid but not invalid, in the whole response or its first line."""
    t = F.lower(F.split_part(response, F.lit("\n"), F.lit(1)) if first_line else response)
    return t.contains("valid") & ~t.contains("invalid")


def coverage(response: Column, needed: Column) -> Column:
    """Share of the needed strings (case matters) that the response contains."""
    return F.size(F.filter(needed, lambda k: response.contains(k))) / F.size(needed)


def knowledge_hit(response: Column, keywords: Column) -> Column:
    return F.exists(keywords, lambda k: F.lower(response).contains(k))


def scheme_hit(response: Column, expected: Column) -> Column:
    return F.translate(F.lower(response), " -", "__").contains(expected)


def example_checks(example_type: Column, response: Column) -> dict[str, Column]:
    """Keyword diagnostics of a training example; the verdict is always true, whatever they say."""
    t = F.lower(response)
    has = lambda *words: F.coalesce(all_of(t, list(words)), F.lit(False))
    return {"reconstructs": F.coalesce(example_type == "A", F.lit(False)) & has("valid", "premise", "conclusion"), "objects": F.coalesce(example_type == "B", F.lit(False)) & has("objection", "defense"), "ok": F.lit(True)}


def all_of(text: Column, phrases: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [text.contains(p) for p in phrases])
