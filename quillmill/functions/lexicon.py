"""Word lists and tables that results depend on. All are fixed values."""

# fixed values: phrases that mark argument, by language
ARGUMENT_EN = ["therefore", "thus", "hence", "consequently", "it follows", "implies", "entails", "because", "since", "given that", "suppose", "assume", "consider", "if we accept", "granted that", "however", "nevertheless", "on the other hand", "objection", "contra", "despite", "although", "whereas", "I argue", "I contend", "I maintain", "I claim", "the argument", "the objection", "the problem", "the thesis", "premise", "conclusion", "inference", "valid", "sound", "necessary", "sufficient", "possible", "impossible", "conceivable", "metaphysically", "a priori", "a posteriori", "supervenes", "reduces to", "identical to", "constituted by", "cogito", "descartes", "substance", "attribute", "mode"]
ARGUMENT_LA = ["ergo", "igitur", "itaque", "quoniam", "quia", "quapropter", "proinde", "namque", "enim", "cogito", "sum", "res cogitans", "res extensa", "substantia", "attributum", "modus", "meditatio", "meditationes", "objectiones", "responsiones", "principia", "philosophiae", "methodus", "discursus", "demonstratio", "propositio", "axioma", "definitio", "deus", "anima", "corpus", "idea", "intellectus"]
ARGUMENT_FR = ["donc", "ainsi", "par conséquent", "puisque", "parce que", "cependant", "néanmoins", "toutefois", "objection", "argument", "raison", "preuve", "conclusion", "je pense", "je suis", "substance", "pensée", "méthode", "méditation", "discours", "principes", "âme", "corps", "esprit", "idée", "entendement", "volonté", "jugement", "certitude", "doute"]
ARGUMENT_DE = ["daher", "deshalb", "folglich", "weil", "denn", "jedoch", "dennoch", "obwohl", "einwand", "beweis", "schluss", "substanz", "monade", "vernunft", "verstand", "erkenntnis", "philosophie", "metaphysik", "ethik"]
ARGUMENT_PHRASES = ARGUMENT_EN + ARGUMENT_LA + ARGUMENT_FR + ARGUMENT_DE

# fixed values: categories that the density rule never removes, those of the index in order, mixing targets
PRIORITY_CATEGORIES = ["descartes_primary", "descartes_scholarship", "rationalist_tradition", "gutenberg", "archive_org"]
INDEX_CATEGORIES = ["descartes_primary", "rationalist_tradition", "philosophy_of_mind", "contemporary_responses", "formal_logic", "descartes_scholarship", "broader_philosophy", "cognitive_science", "cross_disciplinary", "neuroscience"]
MIXING_TARGETS = {"philosophy_of_mind": 0.40, "neuroscience": 0.20, "broader_philosophy": 0.20, "cognitive_science": 0.10, "cross_disciplinary": 0.10}

# fixed values: stop words of the index, and terms that weigh more there
STOPWORDS = sorted(set("the a an and or but in on at to for of with by from is are was were be been being have has had do does did will would could should may might must shall can need dare this that these those it its he she they we you i me him her us them my your his their our not no nor so if then than when while as which who whom what where how why all each every both few more most other some such only also very just because about between through during before after above below into out up down over under again further once here there any same however therefore thus hence moreover indeed rather quite still yet already even well".split()))
DOMAIN_TERMS = sorted(set("cogito descartes meditation substance mind body soul thought extension god existence doubt perception clear distinct idea innate wax dream deceiver evil genius pineal gland arnauld gassendi hobbes mersenne elisabeth princess objection reply principle discourse method passions rules direction spinoza leibniz malebranche occasionalism consciousness qualia zombie physicalism dualism functionalism phenomenal intentionality supervenience causal adequacy formal reality objective conceivability possibility necessity modal possible world identity distinction attribute mode cartesian circle trademark ontological argument premise conclusion valid invalid proof".split()))

# fixed values: patterns of formal and factual claims, phrases of meta claims
FORMAL_PATTERNS = [r"\b(valid|invalid)\b", r"\b(consistent|inconsistent)\b", r"\b(entails|follows from|implies)\b", r"\b(necessary|sufficient|iff)\b", r"\bS[45]\b", r"\b(modal|possible world|accessible world)\b", r"\b(countermodel|counterexample)\b", r"\b(conceivability|conceivable)\b.*\b(possibility|possible)\b", r"\b(ASPIC|defeasible|undercutter|rebuttal)\b", r"\bZ3\b", r"\b(distinct|identical|identity)\b.*\b(substance|property)\b"]
FACTUAL_PATTERNS = [r"\b(Arnauld|Gassendi|Hobbes|Elisabeth|Mersenne)\b.*\b(argued|wrote|objected|responded|claimed)\b", r"\b(in the|from the)\b.*\b(Meditations?|Objections?|Replies|Principles|Discourse|Correspondence)\b", r"\b(First|Second|Third|Fourth|Fifth|Sixth)\b.*\b(Meditation|Objection|Reply)\b", r"\b(historically|traditionally|according to)\b", r"\b(published|written|composed)\b.*\b\d{4}\b"]
META_PHRASES = ["strongest", "weakest", "key insight", "does the heavy lifting", "crucial", "the point is", "fundamentally", "in principle", "the real question"]
AXIOM_MARKERS = ["cogito", "real distinction", "cartesian circle", "wax argument", "evil genius", "method of doubt"]
CONTESTED_MARKERS = ["if we accept", "assuming", "granted that", "on the premise", "provided"]

# fixed values: hedges, domain words and word classes of the text signals
HEDGES = ["perhaps", "possibly", "might", "may", "could", "uncertain", "unclear", "debatable", "arguably", "not sure", "i believe", "it seems", "roughly", "approximately", "likely", "unlikely", "probably", "conceivably", "questionable", "speculative"]
SIGNAL_DOMAIN = ["cogito", "meditation", "descartes", "substance", "dualism", "extension", "thought", "res cogitans", "res extensa", "clear and distinct", "evil genius", "wax argument", "real distinction", "cartesian", "pineal", "elisabeth", "arnauld", "gassendi", "hobbes", "malebranche", "conceivability", "modal", "ontological", "trademark", "causal adequacy", "objective reality", "formal reality", "aspic", "z3", "formalization", "entailment"]
SIGNAL_DOMAIN_EXACT = ["cogito", "meditation", "descartes", "substance", "dualism", "extension", "thought", "res cogitans", "res extensa", "clear and distinct", "real distinction", "cartesian"]
CONDITIONALS = ["if", "would", "could", "should", "might", "unless"]
NEGATIONS = ["not", "no", "never", "neither", "nor", "cannot", "don't", "doesn't", "isn't", "aren't", "wasn't", "weren't"]
FORMAL_SENTENCE = r"\b(valid|invalid|consistent|inconsistent|entails|follows|implies|conceivable|conceivability|modal|S[45]|possible world|necessarily|possibly|if and only if|iff|contradiction)\b"
FACTUAL_SENTENCE = r"\b(wrote|argued|published|stated|in the|from the|Meditations?|Objections?|Replies|according to|First|Second|Third|Fourth|Fifth|Sixth)\b"

# fixed values: stop lists of the agreement measures
AGREEMENT_STOP = ["the", "a", "an", "is", "are", "was", "were", "in", "on", "at", "to", "for", "of", "and", "that", "this", "it", "be", "as", "with", "by"]
ENGINE_STOP = ["the", "a", "an", "is", "are", "was", "were", "in", "on", "at", "to", "for", "of", "and", "that", "this", "it", "with"]
BOOTSTRAP_STOP = ["the", "a", "an", "is", "are", "was", "were", "in", "on", "at", "to", "for", "of", "and"]
EQUIVALENCE_STOP = ["the", "a", "an", "is", "are", "in", "of", "that", "this", "it"]
VERIFIER_STOP = ["the", "a", "an", "is", "are", "was", "were", "in", "on", "at", "to", "for", "of", "and", "that", "this", "it", "with", "by", "from", "as", "or", "but", "not", "be", "been", "being"]

# fixed values: works by key of the file name, keyword cascade of file names, strong title keywords
WORKS = {"meditation": "Meditations on First Philosophy", "discourse": "Discourse on the Method", "principles": "Principles of Philosophy", "passions": "Passions of the Soul", "rules": "Rules for the Direction of the Mind", "objections": "Objections and Replies", "correspondence": "Correspondence"}
FILE_CATEGORIES = {
    "descartes_primary": ["meditations", "discourse_on_method", "discourse-on-method", "principles_of_philosophy", "principles-of-philosophy", "passions_of_the_soul", "passions-of-the-soul", "rules_for_the_direction", "rules-for-the-direction", "descartes__error", "descartes_-error", "descartes_error"],
    "rationalist_tradition": ["spinoza", "leibniz", "malebranche", "rationalist", "ethics_spinoza", "monadology", "occasionalism"],
    "descartes_scholarship": ["descartes", "cartesian", "cogito", "meditation"],
    "philosophy_of_mind": ["consciousness", "mind", "qualia", "zombie", "phenomenal", "physicalism", "dualism", "mental", "brain"],
}
TITLE_KEYWORDS = ["meditation", "metaphysic", "discourse on method", "discourse on the method", "discourse of a method", "passions of the soul", "rules for the direction", "ethics demonstrated", "emendation of the intellect", "theological-political", "tractatus theologico", "monadol", "theodicy", "discourse on metaphysic", "new essays on human understanding", "improvement of the understanding", "search after truth", "port-royal logic", "art of thinking", "short treatise on god", "descartes", "spinoza", "leibniz", "malebranche", "arnauld", "gassendi", "elisabeth", "cartesian", "cogito", "rationalis", "dualism", "mind and body", "mind-body problem", "disquisitio metaphysica", "objections and replies", "principles of philosophy", "selections from the principles", "philosophy of mind", "prima philosophia", "method of rightly conducting"]
DEFERRALS = ["outside my", "not my area", "i specialize", "beyond my", "i focus on", "descartes", "philosophy", "i'm not able", "cannot help", "don't have expertise", "not trained", "outside the scope", "i'm designed for"]
PROVIDER_PRICES = [("deepseek", 0.0001, 0.0002), ("claude", 0.003, 0.015), ("openai", 0.005, 0.015)]

# fixed values: dimensions of the theory space and the theories' coordinates in that order
DIMENSIONS = ["accessibility", "integration", "higher_order", "intentionality", "temporal", "substrate"]
THEORIES = {"TypeA": [0.9, 0.3, 0.2, 0.4, 0.5, 0.9], "TypeB": [0.8, 0.4, 0.3, 0.5, 0.5, 0.8], "FUNC": [0.7, 0.5, 0.4, 0.6, 0.6, 0.2], "SD": [0.2, 0.5, 0.5, 0.8, 0.6, 0.1], "PD": [0.3, 0.5, 0.4, 0.7, 0.5, 0.3], "IIT": [0.4, 0.95, 0.3, 0.5, 0.7, 0.6], "GWT": [0.8, 0.6, 0.5, 0.5, 0.8, 0.3], "HOT": [0.6, 0.4, 0.95, 0.7, 0.6, 0.3], "HOP": [0.5, 0.4, 0.9, 0.6, 0.6, 0.3], "RPT": [0.7, 0.7, 0.2, 0.4, 0.8, 0.5], "AST": [0.8, 0.5, 0.6, 0.5, 0.7, 0.3], "PAN": [0.1, 0.6, 0.1, 0.3, 0.5, 0.5], "ELIM": [0.9, 0.2, 0.1, 0.2, 0.3, 0.9], "MYST": [0.1, 0.5, 0.5, 0.5, 0.5, 0.5]}

# fixed values: hedges of the original signals
ORIGINAL_HEDGES = ["perhaps", "possibly", "might", "may", "could", "uncertain", "unclear", "debatable", "arguably", "not sure", "i believe", "it seems", "roughly", "approximately", "likely", "unlikely"]
