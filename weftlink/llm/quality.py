"""Quality rules by cross-document line frequency.

Lines are normalised and hashed; for each host the distinct documents of a line
are counted; lines in more documents than the limits allow are boilerplate and
are removed; documents that lose too much of themselves are rejected.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fields, trim, tune

#: A line is boilerplate of a host beyond both limits: documents, and share of the host's documents.
MIN_DOCS, MAX_SHARE = 10, 0.1
#: A document is depleted when less than this share of its words is left.
MIN_LEFT = 0.3
#: Lists of fewer lines and hosts than this are broadcast; beyond, documents are joined with them by host.
SMALL = 200_000

_DIGITS = re.compile(rb"[0-9]+")
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_BLANK = re.compile(r"[\x20\x09-\x0D]")

FACTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_words_left long"


def _hash(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def line_form(words: list[bytes]) -> bytes:
    """A line in lower case, with digits alike and single spaces."""
    return _DIGITS.sub(b"0", b" ".join(words).lower())


def line_key(words: list[bytes]) -> int:
    return _hash(line_form(words))


def _bytes(text) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def facts(text: str | None, gone: frozenset[int] = frozenset()) -> tuple:
    """The figures of one text; a null text has none of anything. ``gone``: keys of lines that don't count as left."""
    data = _bytes(text)
    text = text if isinstance(text, str) else ""
    words = data.split()
    seen, dup, left = set(), 0, 0
    for line in data.split(b"\n"):
        if own := line.split():
            if line in seen:
                dup += 1
            else:
                seen.add(line)
            if not gone or line_key(own) not in gone:
                left += len(own)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeat = 0
    if len(set(windows)) < len(windows):
        often, reach = Counter(windows), 0
        for i, w in enumerate(windows):
            if often[w] > 1:
                repeat += i + 3 - max(i, reach)
                reach = i + 3
    return len(words), len(text) - len(_BLANK.findall(text)), len(_SYMBOLS.findall(text)), dup, repeat, left


def _set(lines) -> frozenset[int]:
    return frozenset(map(int, lines)) if lines is not None else frozenset()


@F.pandas_udf(fields(FACTS))
def text_facts(texts: pd.Series, drops: pd.Series) -> pd.DataFrame:
    names = [x.split()[0] for x in FACTS.split(", ")]
    out = pd.DataFrame([facts(t, _set(d)) for t, d in zip(texts, drops, strict=True)], columns=names)
    trim()
    return out


@F.pandas_udf(fields(FACTS + ", text_left string"))
def text_facts_and_rest(texts: pd.Series, drops: pd.Series) -> pd.DataFrame:
    """The facts, and the text without the lines whose keys are listed."""
    out = text_facts.func(texts, drops)
    out["text_left"] = pd.Series([without_lines(t, _set(d)) for t, d in zip(texts, drops, strict=True)], dtype=object)
    trim()
    return out


def without_lines(text: str | None, gone: frozenset[int]) -> str | None:
    if not isinstance(text, str) or not gone:
        return text
    return "\n".join(x for x in text.split("\n") if not (w := _bytes(x).split()) or line_key(w) not in gone)


@F.pandas_udf(fields("sign long, lines array<long>"))
def line_keys(texts: pd.Series) -> pd.DataFrame:
    """Keys of a text's distinct lines, and a hash of the whole text; of texts without words nulls."""
    rows = []
    for t in texts:
        data = _bytes(t)
        own = {line_form(w) for line in data.split(b"\n") if (w := line.split())}
        rows.append((_hash(data) if own else None, [_hash(x) for x in own]))
    trim()
    return pd.DataFrame({"sign": pd.array([r[0] for r in rows], "Int64"), "lines": pd.Series([r[1] for r in rows], dtype=object)})


def boilerplate(docs: DataFrame, text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """(_wl_host, _wl_drop): each host's lines in more than min_docs and more than max_share of its distinct documents.

    Rows of one text are one document; texts that differ anywhere are different ones.
    A host has at most (lines of a document) / max_share such lines, so the lists stay
    short at any size. Counts are combined before each shuffle; a null line stands for
    the document itself, so that one pass counts lines and documents.
    """
    keys = docs.select(_host(host), line_keys(F.col(text)).alias("_k")).select("_wl_host", "_k.*").filter("sign is not null")
    found = keys.select("_wl_host", "sign", F.explode(F.concat("lines", F.array(F.lit(None).cast("long")))).alias("_h")).distinct()
    counts = cut(found.groupBy("_wl_host", "_h").agg(F.count("*").alias("_n")).filter((F.col("_n") > min_docs) | F.col("_h").isNull()))
    sizes = counts.filter("_h is null").select("_wl_host", F.col("_n").alias("_docs"))
    often = counts.filter("_h is not null").join(sizes, "_wl_host").filter(F.col("_n") > max_share * F.col("_docs"))
    return often.groupBy("_wl_host").agg(F.collect_list("_h").alias("_wl_drop"))


def _host(host: str):
    return F.coalesce(F.col(host).cast("string"), F.lit("\0")).alias("_wl_host")


def judge(docs: DataFrame, text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT, rest: bool = False) -> DataFrame:
    """docs with the facts, ``drop_lines`` (keys of the host's boilerplate), ``n_words_left``, ``base_failed`` and ``kept``.

    A null host is a host of its own. Rows of a host that have one text count as one
    document, so exact copies don't make their lines boilerplate; near copies are
    documents of their own. With ``rest``, ``text_left`` is the text without its boilerplate. Every input row is returned once,
    repeated rows too; an empty or null text has base_failed true and kept false.
    Columns whose names begin with ``_wl_`` are reserved; of clashing names the
    operator's columns stay.
    """
    tune(docs.sparkSession)
    lists = cut(boilerplate(docs, text, host, min_docs, max_share))
    size = lists.agg(F.coalesce(F.sum(F.size("_wl_drop")), F.lit(0)), F.count("*")).first()
    if sum(size) <= SMALL:
        lists = F.broadcast(lists)
    kinds = FACTS + (", text_left string" if rest else "")
    drop = F.coalesce("_wl_drop", F.array().cast("array<long>"))
    out = docs.select("*", _host(host)).join(lists, "_wl_host", "left").withColumn("drop_lines", drop).withColumn("_wl_f", (text_facts_and_rest if rest else text_facts)(F.col(text), F.col("drop_lines")))
    out = out.withColumns({x.split()[0]: F.col("_wl_f")[x.split()[0]] for x in kinds.split(", ")}).drop("_wl_f", "_wl_host", "_wl_drop")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("n_words_left") >= min_left * F.col("n_words")))
