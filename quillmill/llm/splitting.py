"""Problem 1: cut oversized documents into overlapping pieces at natural boundaries.

Recursive bisection: a stretch that is still too long is cut at the strongest boundary near its
midpoint, both halves are treated alike, and the overlap is attached at the end, in front of each
piece but the first. Only offsets cross the Python boundary on the way back; piece texts are cut
out by the JVM where a plan asks for them.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.llm.common import token_estimate
from quillmill.session import broadcast_if_small

#: Boundary kinds, strongest first.
KINDS = ("section", "paragraph", "sentence", "line", "clause", "word")
_RANK = {k: len(KINDS) - i for i, k in enumerate(KINDS)}

_WORD = re.compile(r"[^ \t\r\n\f]+")
_BLANK = re.compile(r"(?:\r\n?|\n)[ \t]*(?:(?:\r\n?|\n)[ \t]*)+|\f[ \t\r\n]*")
_LINE = re.compile(r"\r\n?|\n")
_SENTENCE = re.compile(r"[.!?…。]+[\"'”’»)\]]*(?=[ \t\r\n\f])")
_CLAUSE = re.compile(r"[,;:—][\"'”’»)\]]*(?=[ \t\r\n\f])")
_ABBREVIATION = re.compile(r"(?:\b(?:[A-Z]|Mr|Mrs|Dr|St|vol|no|pp?|cf|e\.g|i\.e|ibid|fig|ch|chap|ed|eds|vs|al)|^\d{1,3})\.$", re.IGNORECASE)
_HEADING = re.compile(r"[ \t]*(?:#{1,6}[ \t]|(?:section|chapter|chap\.|part|book|appendix)\b|§|[IVXLC]+\.[ \t]|=+|-{3,})", re.IGNORECASE)

_PIECES = T.ArrayType(T.StructType([*[T.StructField(n, T.IntegerType()) for n in ("first_word", "start_char", "end_char", "n_words")], T.StructField("boundary", T.StringType())]))
_FIELDS = ("first_word", "start_char", "end_char", "n_words", "boundary")


def _boundaries(text: str, starts: np.ndarray) -> np.ndarray:
    """For each word, the rank of the boundary in front of it."""
    n = len(starts)
    rank = np.full(n + 1, _RANK["word"], dtype=np.int8)

    def mark(pattern: re.Pattern, kind: str, after: bool) -> None:
        at = np.fromiter((m.end() if after else m.start() for m in pattern.finditer(text)), dtype=np.int64)
        i = np.searchsorted(starts, at)
        np.maximum.at(rank, i, _RANK[kind])

    mark(_CLAUSE, "clause", True)
    mark(_LINE, "line", True)
    ends = []
    for m in _SENTENCE.finditer(text):
        if m.group() == "." and _ABBREVIATION.search(text, max(0, text.rfind(" ", 0, m.start()) + 1), m.end()):
            continue
        ends.append(m.end())
    np.maximum.at(rank, np.searchsorted(starts, np.array(ends, dtype=np.int64)), _RANK["sentence"])
    blanks = [m.end() for m in _BLANK.finditer(text)]
    for e in blanks:
        i = int(np.searchsorted(starts, e))
        if i >= n:
            continue
        line_end = text.find("\n", e)
        line = text[e : line_end if line_end >= 0 else len(text)].strip()
        heading = len(line) <= 80 and bool(line) and (_HEADING.match(line) or line.isupper() or line[-1] not in ".!?:;,\"'" and re.match(r"\r?\n[ \t]*\r?\n", text[line_end : line_end + 6] if line_end >= 0 else ""))
        rank[i] = max(rank[i], _RANK["section" if heading else "paragraph"])
    return rank


def cut_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, int, str]]:
    """Pieces (first word, start, end, words, boundary it ends at) of a text over `limit` tokens."""
    spans = [m.span() for m in _WORD.finditer(text)]
    n = len(spans)
    most = (10 * limit + 9) // 13  # words whose estimate is at most the limit
    shared = min(-(-10 * max(0, overlap) // 13), most // 2)
    if n <= most or most < 1:
        return [(0, spans[0][0] if n else 0, spans[-1][1] if n else len(text), n, "end")]
    starts = np.fromiter((s for s, _ in spans), dtype=np.int64, count=n)
    rank = _boundaries(text, starts)
    room = most - shared
    cuts, todo = [], [(0, n)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= room:
            continue
        middle = (lo + hi) / 2
        quarter = (hi - lo) // 4
        near = rank[lo + max(1, quarter) : hi - max(1, quarter) + 1]
        best, base = int(near.max()) if len(near) else 0, lo + max(1, quarter)
        if best < _RANK["sentence"]:  # no natural end near the midpoint: take the nearest one anywhere
            best, base = int(rank[lo + 1 : hi].max()), lo + 1
            near = rank[lo + 1 : hi]
        at = base + np.flatnonzero(near == best)
        cut = int(at[np.argmin(np.abs(at - middle))])
        cuts.append(cut)
        todo += [(lo, cut), (cut, hi)]
    edges = [0, *sorted(cuts), n]
    out = []
    for lo, hi in zip(edges, edges[1:]):
        first = max(0, lo - shared) if lo else 0
        kind = KINDS[len(KINDS) - int(rank[hi])] if hi < n else "end"
        out.append((first, spans[first][0], spans[hi - 1][1], hi - first, kind))
    return out


@F.pandas_udf(_PIECES)
def _cut(text: pd.Series, limit: pd.Series, overlap: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else [dict(zip(_FIELDS, p)) for p in cut_text(t, int(m), int(o))] for t, m, o in zip(text, limit, overlap)])


def split_oversized(documents: DataFrame, cards: DataFrame, with_text: bool = False) -> DataFrame:
    """Pieces of every document, each within its card's `max_seq_length`.

    Columns: doc_id, card_id, piece_no (from 0), n_pieces, start_char, end_char (code points),
    token_estimate, boundary (kind of place the piece ends at), is_split, and piece_text on request.
    A document within its limit, of an unknown card or of a card without a usable length (null or
    below 2) is one piece; null texts have one piece of 0 tokens; repeated rows give repeated pieces.
    Pieces restart `overlap_tokens` before the end of the piece before (null: 0; at most half the
    limit). A document is cut at word boundaries at worst, so a single word is never broken.
    """
    limits = cards.groupBy(F.col("card_id").alias("_card")).agg(F.min("max_seq_length").alias("_limit"), F.min("overlap_tokens").alias("_overlap"))
    docs = documents.select("doc_id", "card_id", "text").join(broadcast_if_small(limits), F.col("card_id") == F.col("_card"), "left")
    over = (F.col("_limit") >= 2) & (F.col("_tokens") > F.col("_limit"))
    cut = docs.withColumn("_tokens", token_estimate(F.col("text"))).withColumn("_over", F.coalesce(over, F.lit(False)))
    whole = F.array(F.struct(F.lit(0).alias("first_word"), F.lit(0).alias("start_char"), F.coalesce(F.length("text"), F.lit(0)).alias("end_char"), F.lit(-1).alias("n_words"), F.lit("end").alias("boundary")))
    pieces = cut.withColumn("_pieces", F.coalesce(_cut(F.when(F.col("_over"), F.col("text")), F.coalesce("_limit", F.lit(0)), F.coalesce("_overlap", F.lit(0))), whole))
    text = [F.expr("substring(text, _p.start_char + 1, _p.end_char - _p.start_char)").alias("piece_text")] if with_text else []
    keep = ["doc_id", "card_id", "_tokens", "_over", F.size("_pieces").alias("n_pieces"), *(["text"] if with_text else [])]
    return pieces.select(*keep, F.posexplode("_pieces").alias("piece_no", "_p")).select(
        "doc_id", "card_id", "piece_no", "n_pieces", F.col("_p.start_char").alias("start_char"), F.col("_p.end_char").alias("end_char"),
        F.when(F.col("_over"), F.floor(F.col("_p.n_words").cast("bigint") * 13 / 10).cast("bigint")).otherwise(F.col("_tokens")).alias("token_estimate"),
        F.col("_p.boundary").alias("boundary"), F.col("_over").alias("is_split"), *text,
    )


def oversized_documents(documents: DataFrame, cards: DataFrame) -> DataFrame:
    """doc_id of each document that the splitter had to cut, taken from its first pieces."""
    return split_oversized(documents, cards).filter((F.col("piece_no") == 0) & F.col("is_split")).select("doc_id").distinct()


def split_report(documents: DataFrame, cards: DataFrame) -> DataFrame:
    """Per card: documents, documents cut, pieces, longest piece, pieces by kind of boundary."""
    pieces = split_oversized(documents, cards)
    return pieces.groupBy("card_id").agg(
        F.sum((F.col("piece_no") == 0).cast("bigint")).alias("n_docs"),
        F.sum(((F.col("piece_no") == 0) & F.col("is_split")).cast("bigint")).alias("n_cut"),
        F.count("*").alias("n_pieces"),
        F.max("token_estimate").alias("longest_piece"),
        *[F.sum((F.col("boundary") == k).cast("bigint")).alias(f"ends_at_{k}") for k in KINDS],
    )
