"""Problem 5: template remains, filler and technical pages instead of answers.

Character n-gram models of filler, error notices, script notices, unfilled slots and natural prose give
each byte a log likelihood ratio. Windows (sentences and lines) whose mean ratio is high are filler
or notices, and a text is excluded by what of it they cover; a slot is a few characters inside a
sentence, so its window is the stretch with the highest sum of ratios, and an exact check of the
syntax follows. The models of the residue classes are trained on the phrases made below, the model of
natural prose on all prompts, passages and responses of the corpus: executors count n-grams by place.
"""

from __future__ import annotations

import itertools
import random
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.llm import ml
from quillmill.llm.blank import is_blank

#: Rows, and characters of a text, of a `prose_sample`.
PROSE_ROWS, PROSE_CHARS = 4000, 20_000
#: Characters of responses looked at together.
PURGE_CHARS = 1 << 18
#: Mean log likelihood ratio per byte from which a window counts as residue.
WINDOW_RATIO = 0.5
#: Ratio above which a window is no natural prose for training, and that of suspect windows.
PURGE_RATIO, SUSPECT_RATIO, PURGE_ROUNDS = 1.0, 0.5, 2
#: A text is excluded where residue windows of a class cover this share of its bytes and so many bytes, or where they are most of it.
MIN_COVERAGE, MIN_BYTES, MOST, MOST_BYTES = 0.01, 14, 0.6, 9
#: Sum of the ratios of a stretch from which it may hold a slot, and ratio of its bytes; bytes of text on either side that the check of the syntax sees.
SLOT_SUM, SLOT_RATIO, SLOT_REACH = 3.0, 0.5, 80

KINDS = ("placeholder", "filler", "error_page", "script_notice")

#: Ratio tables, and counts of texts, as `ml` makes them.
Tables, Parts = list[tuple[np.ndarray, np.ndarray]], list[tuple[np.ndarray, np.ndarray]]

# ---- training phrases -------------------------------------------------------------------------


def _expand(*parts: tuple[str, ...]) -> list[str]:
    return [" ".join(x for x in p if x) for p in itertools.product(*parts)]


_STATUS = ("400 Bad Request", "401 Unauthorized", "403 Forbidden", "404 Not Found", "405 Method Not Allowed", "408 Request Timeout", "410 Gone", "429 Too Many Requests", "500 Internal Server Error", "501 Not Implemented", "502 Bad Gateway", "503 Service Unavailable", "504 Gateway Timeout")
_THING = ("This document", "Our reader service", "example.com", "archive.example", "The service", "The page", "The file", "The document", "The resource", "The article", "The archive", "The content", "The item", "The site", "The page you requested", "The file you asked for", "The URL you followed")
_FAILS = ("could not be found.", "cannot be displayed.", "was not found on this server.", "is not available in your region.", "is temporarily down.", "is temporarily unavailable.", "has been moved or removed.", "no longer exists.", "is no longer here.", "refused the connection.", "is not responding.", "requires a subscription.", "failed to load.", "timed out.", "does not exist.", "returned an empty reply.", "is undergoing maintenance.")


def error_phrases() -> list[str]:
    """Messages of web servers, services, proxies and programs, in the corpus's languages."""
    out = [*_STATUS, *(f"HTTP {s[:3]}: {s[4:]}" for s in _STATUS), *(f"Error {s[:3]} - {s[4:].lower()}" for s in _STATUS), *(f"Error code: {s[:3]}" for s in _STATUS)]
    out += [f"<html><body><h1>{s}</h1><hr></body></html>" for s in _STATUS] + [f"<!DOCTYPE html><html><head><title>{s}</title></head></html>" for s in _STATUS] + [f"<center><b>{s}</b></center><h2>{s}</h2>" for s in _STATUS]
    out += [f'{{"error": "{s.lower()}"}} {{"code": {s[:3]}, "message": "{s[4:].lower()}"}} {{"err": "{s.lower()}"}} {{"fault": "{s.lower()}"}}' for s in _STATUS]
    out += [f'{{"detail":{{"status":{s[:3]},"reason":"{s[4:].lower()}"}}}} {{"detail": "{s.lower()}"}}' for s in _STATUS]
    out += _expand(_THING, _FAILS)
    out += [f"{m} ({s[:3]})" for s in _STATUS for m in ("Not available.", "Seite nicht gefunden.", "Page introuvable.", "Error")]
    out += """Access denied. You do not have permission to view this resource. You are not signed in. Please log in to continue. Please sign in to read on.
Your session has expired. Session expired, please log in again. Subscription required. Subscribe to continue reading. This content is for subscribers only.
Rate limit reached. Rate limit exceeded. Too many requests. Quota exceeded for this account. Wait a minute and retry. Please slow down and try again later.
Please try again later. Try again in a few minutes. Return to the home page. Go back or use the search box. Check the address and reload. Contact the site administrator.
Request blocked by the firewall. Your request was blocked. Ask your library for access. Ask your administrator for access. We apologise for the trouble. We are sorry for the inconvenience.
Service unavailable. The service is down for maintenance. The server is not responding. The server encountered an internal error. Connection refused. Connection reset by peer. Connection timed out.
Unhandled exception. An unexpected error occurred. Something went wrong. Oops, an error occurred. Traceback (most recent call last): File "main.py", line 120, in run  File "client.py", line 31, in <module>
RuntimeError: empty completion. KeyError: 'content' ValueError: invalid literal TypeError: unsupported operand IndexError: list index out of range TimeoutError: no reply from model ConnectionResetError: peer closed JSONDecodeError: line 1 column 1 NullPointerException at line 12
Error: model overloaded. Error: request failed with status code 500. Upstream connect error. Reference: 217cdb78. Request ID: 9f8e7d6c. Ray ID: 7f3631ab. Ray 7f3631 Incident reference 00ab12
Seite nicht gefunden. Der Server antwortet nicht. Zugriff verweigert. Diese Seite ist nicht verfügbar. Interner Serverfehler. Bitte versuchen Sie es später erneut. Der Dienst ist vorübergehend nicht erreichbar.
Page introuvable. La page demandée est introuvable. Ce service est momentanément indisponible. Accès refusé. Erreur interne du serveur. Veuillez réessayer plus tard.
Página no encontrada. El servicio no está disponible. Acceso denegado. Error interno del servidor. Inténtelo de nuevo más tarde. La página solicitada no existe.""".split("\n")
    return out


def script_phrases() -> list[str]:
    """Notices that scripts must be on."""
    what = ("JavaScript", "scripting", "active scripts", "client-side scripts", "scripts", "JavaScript and cookies")
    out = []
    for w in what:
        out += [
            f"Please enable {w} - this page does not work without it. Enable {w} in your browser and reload. You must allow {w} to view this page.",
            f"You need to enable {w} to run this app. {w} is required here. {w} must be enabled. {w} is disabled by an extension. {w} are blocked by an extension. Turn on {w} for this site.",
            f"Please enable {w} before the text can be shown. Enable {w} to continue. Turn {w} on. Please switch {w} on. Kindly activate {w}. This site needs {w}. Your browser has {w} switched off. {w} is not supported here. {w} is not supported by an extension. Permit {w} in your browser to go on. To go on, allow {w} and reload. {w} must stay on. {w} is turned off.",
            f"<noscript>You need to enable {w} to run this app.</noscript> <noscript>{w} must be allowed for this page.</noscript> This application requires {w}. Without {w} this page cannot be displayed.",
        ]
    out += """Some features will not work. Your browser does not support scripts. No-script version not available. A browser with scripting switched on is needed to read this article.
You need a browser with scripting switched on to read this article. It looks like an extension is blocking our scripts. Allow them and refresh. Verifying that you are human. Scripts must stay on. Checking your browser before access.
Ohne JavaScript kann die Seite nicht angezeigt werden. Bitte aktivieren Sie JavaScript in Ihrem Browser.
Veuillez activer JavaScript pour afficher cette page. Ce site a besoin de scripts pour fonctionner. JavaScript est désactivé dans votre navigateur.
Active JavaScript para ver este contenido. Este sitio necesita JavaScript para funcionar. Habilite JavaScript en su navegador.""".split("\n")
    return out


#: The usual words of dummy Latin.
LOREM = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
KEYBOARD = ("qwer", "asdf", "zxcv", "uiop", "hjkl", "jkl", "hjk", "qwerty", "asdfgh")


def filler_phrases(seed: int = 7) -> list[str]:
    """Dummy Latin, keyboard rows, repeated words and notes that a text is only a sample."""
    rng = random.Random(seed)
    out = [" ".join(rng.choices(LOREM, k=rng.randint(8, 30))).capitalize() + "." for _ in range(400)]
    out += ["".join(rng.choices(KEYBOARD, k=rng.randint(1, 4))) + " " + "".join(rng.choices(KEYBOARD, k=rng.randint(1, 3))) for _ in range(400)]
    kind = ("text", "answer", "copy", "content", "paragraph", "response", "reconstruction", "description", "summary")
    for w in ("foo", "bar", "blah", "bla", "test", "xxx", "dummy", "sample", "lorem", "abc", "filler", "word", *kind, *KEYBOARD):
        out += [f"{w} " * 12, f"{w}. " * 8, f"{w}, " * 8]
    for k in kind:
        out += [
            f"Sample {k} goes here. Your {k} goes here. Your {k} will appear in this space. Insert {k} here. Insert some {k} in this box. Add your {k} here. Type your {k} here. Enter {k} here.",
            f"This is dummy {k} used for testing. This is mock {k} used for testing. Dummy {k} for layout purposes only. Example {k}, to be replaced before release. Replace this {k} with your own.",
            f"Test {k} number 10, please ignore. Placeholder {k} for the final version. Placeholder {k} - final wording to follow. {k.capitalize()} to follow. {k.capitalize()} coming soon. Filler {k}, do not publish. Final wording to be supplied later.",
        ]
    return out


def slot_phrases(seed: int = 3) -> list[str]:
    """Unfilled slots of the usual template languages, with names of all kinds."""
    rng = random.Random(seed)
    words = "author name topic title subject philosopher argument claim premise conclusion passage question answer example source date year user input text value objection thesis reply summary definition term concept quote page chapter school position theory school_name first last number count item index key field id model response prompt context reference citation".split()
    words += ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(200)]
    out = []
    for _ in range(8000):
        a, b = rng.choice(words), rng.choice(words)
        low, high = rng.choice([a, f"{a}_{b}", f"{a} {b}"]), rng.choice([a, f"{a}_{b}", f"{a} {b}"]).upper()
        name, upper = low.replace(" ", "_"), high.replace(" ", "_")
        ask = rng.choice("INSERT insert Insert TODO TBD FIXME PLACEHOLDER YOUR your Your ADD add enter ENTER".split() + ["fill in", "FILL IN"])
        slot = rng.choice([f"{{{{{low}}}}}", f"{{{{ {name} }}}}", f"{{% {low} %}}", f"${{{name}}}", f"#{{{name}}}", f"{{{name}}}", f"{{{rng.randint(0, 9)}}}", f"[[{low}]]", f"[[{upper}]]", f"[{ask} {low}]", f"[{ask} {high}]", f"[{ask}: {low}]", f"[{ask}]", f"[{high}]", f"<<{low}>>", f"<<{upper}>>", f"<INSERT {high}>", f"<{high}>", f"&lt;{low}&gt;", f"&lt;{high}&gt;", f"%({name})s", f"%({name})d", "%s", "%d", f"@{upper}@", f"@@{upper}@@", f"${upper}", f"${upper}$", f"__{upper}__", "_" * rng.randint(5, 20), "TBD", "TBA", "X" * rng.randint(4, 9), "TODO", "FIXME", "TODO:", "FIXME:"])
        out.append(rng.choice(["", f"{b} ", f"{b} ", f"{b}. "]) + slot + rng.choice(["", " ", ".", ",", ":", f" {a}", f" {a}"]))
    return out


def contrast_phrases() -> list[str]:
    """Natural sentences that talk about such things, in the words of the notices."""
    return """Suppose the script of the play must be enabled by an actor. The script of the play was allowed by the director, and an actor must follow the script. Scripts for the stage are required reading.
An error in the report is no proof that the report is wrong. The server of the tea could not be found guilty. The page of the book was moved, and the reader denied it. The request was denied by the king.
A page of filler text is form without content. The placeholder in the formula stands for something. Access to the mind is denied to others. The argument failed, and the service of reason is not available to it.
The word "test" is a test of meaning. The sample of evidence was too small. Premise two stands. The example is to be replaced by a better one. An account of the content of a belief is not the content.""".split("\n") * 6


# ---- slots ------------------------------------------------------------------------------------

_NAME = r"[A-Za-z][\w .\-]{0,30}"
#: Unfilled slots, by a string that must occur in the text. Tags of the form [STRICT] or
#: [CONFIDENCE: 0.6], sets {p, q} and formulas do not match.
SLOTS = {
    "{": re.compile(r"\{\{[^{}\n]{0,60}\}\}|\{%[^{}\n]{0,60}%\}|[$#]\{[^{}\n]{1,40}\}|\{(?:[A-Za-z]{2,}(?:_[A-Za-z]+)*|\d)\}"),
    "[": re.compile(r"\[\[" + _NAME + r"\]\]|\[(?:INSERT|insert|Insert|TODO|TBD|FIXME|PLACEHOLDER|YOUR|your|Your|ADD|add|enter|ENTER|fill in|FILL IN)\b[^\[\]\n]{0,60}\]"),
    "<": re.compile(r"<<" + _NAME + r">>|<(?:INSERT\b[^<>\n]{0,40}|[A-Z]{3,}(?:[ _][A-Z]+)*)>"),
    "&lt;": re.compile(r"&lt;[A-Za-z][A-Za-z_ ]{1,30}&gt;"),
    "%": re.compile(r"%\([a-z_]+\)[sd]|%[sd](?![A-Za-z])"),
    "@": re.compile(r"@@?[A-Z][A-Z_]{2,}@@?"),
    "$": re.compile(r"\$[A-Z][A-Z_]{2,}\$?"),
    "__": re.compile(r"__[A-Z][A-Z_]+__|_{5,}"),
    "TB": re.compile(r"\bTB[DA]\b"),
    "XXXX": re.compile(r"\bXXXX+\b"),
    "TODO": re.compile(r"\bTODO\b"),
    "FIXME": re.compile(r"\bFIXME\b"),
}
#: A bracketed upper-case name; the project's own tags are content.
BRACKET = re.compile(r"\[([A-Z]{3,}(?:[ _][A-Z]+)*)\]")
#: The project's own tags.
TAGS = {"STRICT", "DEFEASIBLE", "CONFIDENCE", "ORACLE_REQUEST", "ORACLE REQUEST", "SCOPE_EXCEEDED", "FOOTNOTE"}


def has_slot(text: str) -> bool:
    if any(key in text and pattern.search(text) for key, pattern in SLOTS.items()):
        return True
    return "[" in text and any(m not in TAGS for m in BRACKET.findall(text))


def mostly_slots(text: str) -> bool:
    """Slots are half of the text or more."""
    left = text
    for key, pattern in SLOTS.items():
        if key in left:
            left = pattern.sub("", left)
    left = BRACKET.sub(lambda m: m.group() if m.group(1) in TAGS else "", left)
    return 2 * len(left) <= len(text)


# ---- scoring ----------------------------------------------------------------------------------

_SPLIT = re.compile(r"(?<=[.!?])[ \t]+|[\r\n]+")
_TLD = re.compile(r"\.(?:com|org|net|edu|gov|io|example)")
_HOST = re.compile(r"\b[\w-]+(?:\.[\w-]+)*\.(?:com|org|net|edu|gov|io|example)\b")
#: One word five times or more and nothing else: dummy text also where the word is one of the corpus.
_REPEATED = re.compile(r"\s*(\w+)([,.;]?)(?:\s+\1\2){3,}\s+\1[,.;]?\s*")
_UNIT = re.compile(rb"[.!?]+[\"')\]]*[ \t]+|[\r\n]+|\x00")


#: What stands between texts: an end, and line ends enough that no n-gram reaches into another text.
_BETWEEN = "\x00" + "\x01" * (len(ml.GAP) - 1)


def _plain(text: str) -> str:
    return text.replace("\x00", " ").replace("\x01", " ") if "\x00" in text or "\x01" in text else text


def _scored(buffer: np.ndarray, tables: Tables) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, scores) of joined texts with one byte left between them; to the models the gaps are line ends."""
    scores = ml.gram_scores(np.where(buffer <= 1, np.uint8(10), buffer), tables)
    kept = buffer != 1
    return buffer[kept], scores[kept]


def score_texts(texts: list[str], tables: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Per text: bytes covered by residue windows of each class, and bytes of content in all."""
    n = len(texts)
    cover, size = np.zeros((n, 3)), np.zeros(n)
    if not n:
        return cover, size
    raw = "".join(_HOST.sub("archive.example", t) + _BETWEEN if _TLD.search(t) else t + _BETWEEN for t in map(_plain, texts))
    buffer, scores = _scored(ml.fold(_BETWEEN[1:] + raw), tables[: len(ml.KEPT)])
    data = buffer.tobytes()
    ends = np.fromiter((m.end() for m in _UNIT.finditer(data)), dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    doc = np.searchsorted(np.flatnonzero(buffer == 0), starts)
    length = ends - starts
    sums = np.add.reduceat(scores, starts, axis=0)
    mean = sums / np.maximum(length, 1)[:, None]
    best = mean.argmax(1)
    hit = (mean[np.arange(len(best)), best] > WINDOW_RATIO) & (length > 3)
    np.add.at(cover, (doc[hit], best[hit]), length[hit])
    size += np.bincount(doc, length, n)
    return cover, size


#: What the slot model reads: small letters alike (but s and d, which stand in %s and %d), digits alike, all else as it is.
_SLOT_BYTES = bytes(97 if (97 <= i <= 122 and i not in (100, 115)) or i >= 128 else 48 if 48 <= i <= 57 else i for i in range(256))


def slot_bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "replace").translate(_SLOT_BYTES), dtype=np.uint8)


def slot_windows(texts: list[str], tables: Tables) -> list[tuple[int, str]]:
    """(text number, window): stretches whose ratios add up to SLOT_SUM or more, with SLOT_REACH bytes around them.

    The sum of the best stretch that ends at a byte is the running total less its minimum so far in the text.
    Stretches less than twice SLOT_REACH apart share a window; the ends of texts bound it.
    """
    if not texts:
        return []
    raw = "".join(_plain(t) + _BETWEEN for t in texts)
    buffer, scores = _scored(slot_bytes(_BETWEEN[1:] + raw), tables[len(ml.KEPT) :])
    ends = np.flatnonzero(buffer == 0)
    ratio = scores[:, 0].copy()
    ratio[ends] = 0.0
    first = np.concatenate([[0], ends[:-1] + 1])
    doc = np.repeat(np.arange(len(texts)), ends - first + 1)
    total = np.cumsum(ratio, dtype=np.float64)
    total -= doc * (np.ptp(total) + 1.0)  # the minima of earlier texts are out of reach
    before = np.concatenate([[0.0], total[:-1]])
    before[first] = total[first] - ratio[first]
    high = np.flatnonzero((total - np.minimum.accumulate(before) >= SLOT_SUM) & (ratio > SLOT_RATIO))  # where it still grows
    if not len(high):
        return []
    groups = np.split(high, np.flatnonzero((np.diff(high) > 2 * SLOT_REACH) | (np.diff(doc[high]) > 0)) + 1)
    data = raw.replace("\x01", "").encode("utf-8", "replace")
    out = []
    for g in groups:
        k = int(doc[g[0]])
        a, b = max(int(first[k]), int(g[0]) - SLOT_REACH), min(int(ends[k]), int(g[-1]) + SLOT_REACH)
        out.append((k, data[a:b].decode("utf-8", "ignore")))
    return out


#: How the models of filler and notices and those of slots read a text.
READERS = (ml.fold, slot_bytes)


def _train(count_prose: Callable[[list[np.ndarray]], list[Parts]], count_kept: Callable[[Tables, list[np.ndarray]], list[Parts]]) -> Tables:
    """Ratio tables of filler, error notices and script notices against natural prose, and then those of slots.

    `count_prose(tags)` counts prompts and passages, which hold no residue. Responses may: `count_kept(tables, tags)`
    counts what a purge by `tables` leaves of them, first by tables trained without them, and again by those
    trained on what was left. Both give one count for each of the tags, read as READERS do.
    """
    phrases = [[filler_phrases(), error_phrases(), script_phrases()], [slot_phrases()]]
    tags = [ml.class_tags(p, read) for p, read in zip(phrases, READERS)]
    classes = [[ml.GramCounts(t, read).add(c).parts() for c in p] for p, t, read in zip(phrases, tags, READERS)]
    prose = [ml.merged(c, ml.GramCounts(t, read).add(contrast_phrases()).parts()) for c, t, read in zip(count_prose(tags), tags, READERS)]
    tables = ml.ratio_tables(classes[0], prose[0], tags[0])
    for left in range(PURGE_ROUNDS, 0, -1):
        kept = count_kept(tables, tags if left == 1 else tags[:1])
        tables = ml.ratio_tables(classes[0], ml.merged(prose[0], kept[0]), tags[0])
    return tables + ml.ratio_tables(classes[1], ml.merged(prose[1], kept[1]), tags[1], trust=20.0)


def train_tables(prose: list[str], responses: list[str]) -> Tables:
    """The tables of texts at hand: `prose` without residue, and `responses`, which are purged (see `_train`)."""

    def count(texts, tags):
        return [ml.GramCounts(t, read).add(texts).parts() for t, read in zip(tags, READERS)]

    return _train(lambda tags: count([_plain(t) for t in prose], tags), lambda tables, tags: count([u for part in _slices([_plain(t) for t in responses]) for u in purged(part, tables)], tags))


def corpus_tables(examples: DataFrame) -> Tables:
    """The tables that `train_tables` gives for all prompts and passages, and all responses, of all rows.

    Workers count n-grams of their rows, others add the counts by block of places; as many as there are places come to the driver at most.
    """
    context = examples.sparkSession.sparkContext

    def count(columns, tags, tables=()):
        held = context.broadcast(([[ml.packed(x) for x in t] for t in tags], packed_tables(tables)))

        def run(batches):
            counters = [ml.GramCounts(np.stack([ml.unpacked(x) for x in t]), read) for t, read in zip(held.value[0], READERS)]
            own = unpacked_tables(held.value[1])
            for b in batches:
                texts = [_plain(t) for c in columns for t in b[c] if t]
                for part in _slices(texts) if own else [texts]:
                    part = purged(part, own) if own else part
                    for c in counters:
                        c.add(part)
            for i, c in enumerate(counters):
                parts = c.parts()
                at, n = np.concatenate([k * ml.PLACES + x for k, (x, _) in enumerate(parts)]), np.concatenate([y for _, y in parts])
                block = at % ml.PLACES // BLOCK
                for k in np.unique(block):
                    yield pd.DataFrame({"reader": [i], "block": [int(k)], "at": [at[block == k].tobytes()], "n": [n[block == k].tobytes()]})

        def add(frame):
            total = np.zeros((PARTS, BLOCK), dtype=np.int64)
            block = int(frame["block"].iloc[0])
            for a, b in zip(frame["at"], frame["n"]):
                part, place = np.divmod(np.frombuffer(a, dtype=np.int64), ml.PLACES)
                n, top = np.frombuffer(b, dtype=np.int64), part >= ml.ORDERS
                total[part[~top], place[~top] - block * BLOCK] += n[~top]
                total[part[top], place[top] - block * BLOCK] = np.maximum(total[part[top], place[top] - block * BLOCK], n[top])
            part, place = np.nonzero(total)
            return pd.DataFrame({"reader": frame["reader"][:1], "block": [block], "at": [(part * ml.PLACES + place + block * BLOCK).tobytes()], "n": [total[part, place].tobytes()]})

        schema = "reader bigint, block bigint, at binary, n binary"
        got = examples.select(*columns).mapInPandas(run, schema).groupBy("reader", "block").applyInPandas(add, schema).toArrow().to_pylist()
        held.destroy()
        out = []
        for i in range(len(tags)):
            at, n = (np.concatenate([np.frombuffer(r[c], dtype=np.int64) for r in got if r["reader"] == i] or [np.zeros(0, dtype=np.int64)]) for c in ("at", "n"))
            out.append([(at[part] - k * ml.PLACES, n[part]) for k in range(PARTS) for part in [np.flatnonzero(at // ml.PLACES == k)]])
        return out

    return _train(lambda tags: count(["user_prompt", "source_passage"], tags), lambda tables, tags: count(["assistant_response"], tags, tables))


#: Orders and kept orders, as `ml.GramCounts.parts` lists them, and places that are added up together.
PARTS, BLOCK = ml.ORDERS + len(ml.KEPT), 1 << 15


def packed_tables(tables: Tables) -> list[tuple]:
    """The tables for a broadcast."""
    return [(ml.packed(names), values[np.flatnonzero(names)]) for values, names in tables]


def unpacked_tables(packed: list[tuple]) -> Tables:
    return [(ml.unpacked(((*names[0], values.shape[1]), names[1], values)), ml.unpacked(names)) for names, values in packed]


def _slices(texts: list[str]):
    """Runs of texts of PURGE_CHARS in all, or one text over that."""
    a, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= PURGE_CHARS or i + 1 == len(texts):
            yield texts[a : i + 1]
            a, held = i + 1, 0


def purged(responses: list[str], tables: Tables) -> list[str]:
    """Sentences and lines that are natural prose by `tables`: texts that hold slots or are mostly suspect windows are left out whole, single windows where the ratio is high."""
    split = [[u for u in _SPLIT.split(t) if u] for t in responses]
    scores = _unit_means([u for units in split for u in units], tables)
    kept, i = [], 0
    for t, units in zip(responses, split):
        own = scores[i : i + len(units)]
        i += len(units)
        if not (has_slot(t) and any(has_slot(u) for u in units)) and sum(len(u) for u, s in zip(units, own) if s > SUSPECT_RATIO) < 0.5 * sum(map(len, units)):
            kept += [u for u, s in zip(units, own) if s < PURGE_RATIO]
    return kept


def _unit_means(units: list[str], tables: Tables) -> np.ndarray:
    if not units:
        return np.zeros(0)
    buffer, scores = _scored(ml.fold(_BETWEEN[1:] + "".join(_plain(u) + _BETWEEN for u in units)), tables)
    ends = np.flatnonzero(buffer == 0) + 1
    starts = np.concatenate([[0], ends[:-1]])
    return (np.add.reduceat(scores, starts, axis=0) / (ends - starts)[:, None]).max(1)


def classify(texts: list[str | None], tables: Tables) -> list[tuple[str | None, float]]:
    """Residue kind (None for a sound text) and covered share of each text."""
    return [(kind, share) for kind, share, _ in explain(texts, tables)]


def explain(texts: list[str | None], tables: Tables) -> list[tuple[str | None, float, str | None]]:
    """Residue kind, covered share, and the step that decided: "most" or "part" of the text covered, or a "slot"."""
    return [x for part in _slices([t or "" for t in texts]) for x in _explained(part, tables)]


def _explained(filled: list[str], tables: Tables) -> list[tuple[str | None, float, str | None]]:
    cover, size = score_texts(filled, tables)
    out: list[tuple[str | None, float, str | None]] = []
    for t, c, s in zip(filled, cover, size):
        k = int(c.argmax())
        share = float(c.sum() / s) if s else 0.0
        if is_blank(t):
            out.append((None, share, "blank"))
        elif _REPEATED.fullmatch(t):
            out.append((KINDS[1], 1.0, "most"))
        elif share >= MOST and c[k] >= MOST_BYTES:
            out.append((KINDS[1 + k], share, "most"))
        elif s and c[k] >= max(MIN_COVERAGE * s, MIN_BYTES):
            out.append((KINDS[1 + k], share, "part"))
        else:
            out.append((None, share, None))
    left = [i for i, x in enumerate(out) if x[2] in (None, "most")]
    for i in {left[k] for k, w in slot_windows([filled[i] for i in left], tables) if has_slot(w)}:
        if out[i][2] is None or mostly_slots(filled[i]):
            out[i] = ("placeholder", out[i][1], "slot")
    return out


def prose_sample(examples: DataFrame, rows: int = PROSE_ROWS) -> tuple[list[str], list[str]]:
    """(prompts and passages, responses) of about `rows` rows at most, lowest row hash first; texts over PROSE_CHARS are left out.

    For trials with a part of a table at hand; the queries take `corpus_tables`.
    A hash bound that leaves a tenth more than `rows` comes before the cut, so that no task holds more than its share.
    """
    n = examples.count()
    parts = ["user_prompt", "source_passage", "assistant_response"]
    mark = F.xxhash64("row_id", *parts)
    texts = examples.select(*[F.when(F.length(c) <= PROSE_CHARS, F.col(c)).alias(c) for c in parts], mark.alias("_h"))
    if n > rows:
        texts = texts.filter(F.pmod("_h", F.lit(1 << 40)) < int((1 << 40) * 1.1 * rows / n))
    picked = texts.orderBy(F.pmod("_h", F.lit(1 << 40)), "_h").limit(rows).collect()
    return [x for r in picked for x in (r.user_prompt, r.source_passage) if x], [r.assistant_response for r in picked if r.assistant_response]


def residue(examples: DataFrame) -> DataFrame:
    """(row_id, residue, coverage, step): one row per example, `residue` null where the response is sound; `step` as in `explain`.

    Null and empty responses are sound here (they are problem 3's); an empty table gives no rows;
    repeated rows are judged alike and stay repeated.
    """
    tables = examples.sparkSession.sparkContext.broadcast(packed_tables(corpus_tables(examples)))

    def run(batches):
        own = unpacked_tables(tables.value)
        for b in batches:
            got = explain(b["assistant_response"].tolist(), own)
            yield pd.DataFrame({"row_id": b["row_id"], "residue": pd.Series([k for k, *_ in got], dtype=object), "coverage": [s for _, s, _ in got], "step": pd.Series([x for *_, x in got], dtype=object)})

    schema = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("residue", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("step", T.StringType())])
    return examples.select("row_id", "assistant_response").mapInPandas(run, schema)


def residue_found(examples: DataFrame) -> DataFrame:
    return residue(examples).filter("residue is not null").select("row_id", "residue").distinct()


def clean_examples(examples: DataFrame) -> DataFrame:
    """The examples whose responses hold no residue."""
    bad = residue_found(examples).select(F.col("row_id").alias("_bad")).distinct()
    return examples.join(bad, F.col("row_id") == F.col("_bad"), "left_anti")
