"""Keyword-stuffed and link-list pages, by pointwise mutual information of neighbouring tokens.

A page's own body is cut into words, marks and line ends; links, tags, table cells and prices
are tokens with neighbours like any other, no pattern knows them. The corpus is read once for
counts of neighbours. The mean PMI doesn't tell salad from sentences: the words of stuffed
pages keep to themselves, so any two of them have a high PMI. What salad lacks is an order.
In sentences PMI(a, b) is far from PMI(b, a); in lists of search terms, links (a/b.c/d) and
cells (a | b | c) both orders are alike. Two things decide:

* incoherence: a pair's worth is tanh((PMI(a, b) - PMI(b, a)) / 2), that is
  (c(a, b) - c(b, a)) / (c(a, b) + c(b, a)), or 0 if it stands the wrong way round;
* excessively repeated collocations: a pair that the page has more often than PAIR_REPEATS
  times, and more often than its share of the corpus lets expect, is worth less with each
  repetition; so is one with a token that is repeated more than WORD_REPEATS times.

A token is stuffing if the mean worth of the pairs around it is below LEAST_WORTH; a page is
if such tokens hold more characters than the others. Pairs met less than LEAST_COUNT times in
the corpus, both orders together, and pairs with a number say nothing.

Pairs and words that make up at least PAIR_SHARE of all are sent to every task, at most
1 / PAIR_SHARE rows of each however large the corpus; a page's others are joined to the table
of all, where none of them is hot. All counts are over all documents.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.mail import own_lines
from seqloom.session import Stage

#: Pairs and words from this share of all on are broadcast, at most 200,000 of each.
PAIR_SHARE = 5e-6
#: Pairs met less often, both orders together, say nothing.
LEAST_COUNT = 4
#: Repetitions of a pair, and of a token, that a page may have whatever the corpus has.
PAIR_REPEATS, WORD_REPEATS = 2, 10
#: Pairs on either side that tell what a token belongs to, and how many good ones it is given.
WINDOW, DOUBT = 24, 2
LEAST_WORTH = 0.5
#: A page is stuffed from this share of its characters on.
STUFFED_SHARE = 0.5
#: Tokens that a task counts at once, and pages that a task scores.
COUNT_TOKENS, TASK_PAGES = 1_000_000, 5_000

_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
#: The same for ASCII in lower case with all digits 0, and line ends.
_PLAIN, _ZEROS = re.compile(r"[a-z]+|0+|\n|[^\w\s]|_"), str.maketrans("123456789", "000000000")


def tokens(lines: list[str]) -> list[str]:
    """Words, marks and line ends in order; a number is as many zeros as it has digits."""
    whole = "\n".join([*lines, ""])
    if whole.isascii() and whole.count("\n") == len(lines):
        return _PLAIN.findall(whole.lower().translate(_ZEROS))
    out: list[str] = []
    for line in lines:
        line = line.lower()
        if not line.isascii():
            line = unicodedata.normalize("NFC", line)
        out += ["0" * len(t) if t.isdigit() else t for t in _TOKEN.findall(line)]
        out.append("\n")
    return out


def body_tokens(docs: DataFrame) -> DataFrame:
    """doc_id, tokens: each message's own body as tokens between blanks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = [" ".join(tokens(own_lines(t))) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(said, pa.string())], ["doc_id", "tokens"])

    return docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id BIGINT, tokens STRING")


def _is_number(words: list[str]) -> np.ndarray:
    return np.array([w[:1] == "0" for w in words], bool)


def _counted(texts: pa.ChunkedArray) -> pa.RecordBatch:
    """first, second (null for a word), n of some pages."""
    split = pc.split_pattern(texts, " ").combine_chunks()
    coded = pc.dictionary_encode(split.flatten())
    words, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    size, number = len(words), _is_number(words.to_pylist())
    ok = ~number[code]
    pair = ok[:-1] & ok[1:]
    ends = split.offsets.to_numpy()[1:-1] - split.offsets.to_numpy()[0] - 1  # last token of a page, first of the next
    pair[ends[(ends >= 0) & (ends < len(pair))]] = False
    pairs, n = np.unique((code[:-1] * size + code[1:])[pair], return_counts=True)
    single, m = np.unique(code[ok], return_counts=True)
    first, second = np.concatenate([pairs // max(size, 1), single]), np.concatenate([pairs % max(size, 1), np.zeros(len(single), np.int64)])
    none = np.arange(len(second)) >= len(pairs)
    return pa.RecordBatch.from_arrays([words.take(pa.array(first)), words.take(pa.array(second, mask=none)), pa.array(np.concatenate([n, m]).astype(np.int64))], ["first", "second", "n"])


def corpus_counts(pages: DataFrame) -> DataFrame:
    """first, second (null for a word), n over all documents. Tasks add up before they send."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        size = 0
        for b in batches:
            held.append(b.column(0).filter(pc.not_equal(b.column(0), "")))
            size += held[-1].nbytes // 5
            if size > COUNT_TOKENS:
                yield _counted(pa.chunked_array(held))
                held, size = [], 0
        if size:
            yield _counted(pa.chunked_array(held))

    sent = pages.select("tokens").mapInArrow(run, "first STRING, second STRING, n BIGINT")
    return sent.groupBy("first", "second").agg(F.sum("n").alias("n"))


def pair_table(counts: DataFrame) -> DataFrame:
    """a, b, ahead, back, n: for all pairs a <= b met LEAST_COUNT times how often a stands before
    b and behind it, and the sum of both; for all words how often they are met (b is empty)."""
    order = F.col("first") <= F.col("second")
    both = counts.filter("second IS NOT NULL").groupBy(F.least("first", "second").alias("a"), F.greatest("first", "second").alias("b")).agg(
        F.sum(F.when(order, F.col("n")).otherwise(0)).alias("ahead"), F.sum(F.when(order, 0).otherwise(F.col("n"))).alias("back")
    )
    both = both.withColumn("n", F.col("ahead") + F.col("back")).filter(F.col("n") >= LEAST_COUNT)
    zero = F.lit(0).cast("long").alias("back")
    return both.unionByName(counts.filter("second IS NULL").select(F.col("first").alias("a"), F.lit("").alias("b"), F.col("n").alias("ahead"), zero, "n"))


def _wanted(words: list[str], pairs: np.ndarray, often: np.ndarray) -> Iterator[tuple[str, str]]:
    """Keys of the table that a page asks for: its pairs, and its words that are repeated."""
    size = len(words)
    for p in pairs.tolist():
        a, b = words[p // size], words[p % size]
        yield (a, b) if a <= b else (b, a)
    for i in np.flatnonzero(often > WORD_REPEATS).tolist():
        yield words[i], ""


def _page(text: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, code per token, distinct pairs, pair per place, repeats per pair, repeats per
    word); pairs with a number, and words that are numbers, have -1 and 0."""
    index: dict[str, int] = {}
    code = np.array([index.setdefault(t, len(index)) for t in text.split(" ")], np.int64)
    words = list(index)
    number = _is_number(words)
    pair = code[:-1] * len(words) + code[1:]
    pairs, at, n = np.unique(pair, return_inverse=True, return_counts=True)
    fine = ~(number[pairs // len(words)] | number[pairs % len(words)])
    place = np.where(fine, np.cumsum(fine) - 1, -1)[at]
    return words, code, pairs[fine], place, n[fine], np.where(number, 0, np.bincount(code, minlength=len(words)))


def page_keys(pages: DataFrame, hot: Broadcast) -> DataFrame:
    """doc_id, a, b: what each page asks of the table and wasn't broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = hot.value
        for batch in batches:
            ids: list[int] = []
            keys: list[tuple[str, str]] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    words, _, pairs, _, _, often = _page(text)
                    new = {x for x in _wanted(words, pairs, often) if x not in known}
                    keys += new
                    ids += [doc] * len(new)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([a for a, _ in keys], pa.string()), pa.array([b for _, b in keys], pa.string())], ["doc_id", "a", "b"])

    return pages.mapInArrow(run, "doc_id BIGINT, a STRING, b STRING")


def _fade(met: np.ndarray, allowed: float, expected: np.ndarray) -> np.ndarray:
    return np.sqrt(np.minimum(1.0, allowed * np.maximum(1.0, expected) / np.maximum(met, 1)))


def score_page(text: str, known: Callable[[tuple[str, str]], tuple[int, int] | None], n_pairs: int, n_words: int) -> tuple[float, float]:
    """Mean worth of a page's pairs (1 if none is known), and the share of its characters that
    is stuffing. known: (a, b) with a <= b -> how often a stands before b and behind it; (word,
    "") -> how often it is met."""
    words, code, pairs, place, met, often = _page(text)
    size = len(words)
    if len(code) < 2:
        return 1.0, 0.0
    worth, expected = np.full(len(pairs) + 1, np.nan), np.zeros(len(pairs))
    for k, p in enumerate(pairs.tolist()):
        a, b = words[p // size], words[p % size]
        got = known((a, b) if a <= b else (b, a))
        if got and sum(got) >= LEAST_COUNT:
            x, y = got if a <= b else got[::-1]
            worth[k], expected[k] = (max(x - y, 0) / (x + y) if a != b else 0.0), x
    common = np.zeros(size)
    for i in np.flatnonzero(often > WORD_REPEATS).tolist():
        common[i] = (known((words[i], "")) or (0, 0))[0]
    length = len(code)
    worth[:-1] *= _fade(met, PAIR_REPEATS, expected * (length - 1) / max(n_pairs, 1))
    fade = _fade(often, WORD_REPEATS, common * length / max(n_words, 1))[code]
    at = worth[place] * np.minimum(fade[:-1], fade[1:])
    told = ~np.isnan(at)
    value, count = np.concatenate([[0.0], np.cumsum(np.where(told, at, 0.0))]), np.concatenate([[0], np.cumsum(told)])
    i = np.arange(length - 1)
    lo, hi = np.maximum(i - WINDOW, 0), np.minimum(i + WINDOW + 1, length - 1)
    mean = (value[hi] - value[lo] + DOUBT) / (count[hi] - count[lo] + DOUBT)
    chars = np.array([0 if w == "\n" else len(w) for w in words])[code[:-1]]
    return float(value[-1] / count[-1]) if count[-1] else 1.0, float(chars[mean < LEAST_WORTH].sum() / max(chars.sum(), 1))


def score_pages(docs: DataFrame, share: float = PAIR_SHARE) -> DataFrame:
    """doc_id, coherence, stuffed_share for every message.

    Empty and null bodies score 1 and 0; repeated rows score alike; extra columns are ignored.
    A page none of whose pairs is known from the corpus is not called stuffed.
    """
    stage = Stage(docs.sparkSession, "stuffing")
    pages = stage.save(body_tokens(docs), "pages")
    counts = stage.save(corpus_counts(pages), "counts")
    table = stage.save(pair_table(counts), "pairs")
    totals = {r[0]: r[1] for r in counts.groupBy(F.col("second").isNull()).agg(F.sum("n")).collect()}
    n_words, n_pairs = totals.get(True, 0), totals.get(False, 0)
    hot = F.col("n") >= F.when(F.col("b") == "", n_words * share).otherwise(n_pairs * share)
    # At most 1 / share pairs and 1 / share words have that share.
    rows = table.filter(hot).toPandas()
    sent = docs.sparkSession.sparkContext.broadcast(dict(zip(zip(rows["a"], rows["b"]), zip(rows["ahead"].tolist(), rows["back"].tolist()))))
    rare = page_keys(pages, sent).join(table.filter(~hot).drop("n"), ["a", "b"])
    sides = ["a", "b", "ahead", "back"]
    per = rare.groupBy("doc_id").agg(F.collect_set(F.struct(*sides)).alias("p")).select("doc_id", *[F.col(f"p.{c}").alias(c) for c in sides])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = sent.value
        for batch in batches:
            out = []
            for text, a, b, ahead, back in zip(*(batch.column(i).to_pylist() for i in range(1, 6))):
                own = dict(zip(zip(a, b), zip(ahead, back))) if a else {}
                out.append(score_page(text, lambda x, own=own: own.get(x) or common.get(x), n_pairs, n_words) if text else (1.0, 0.0))
            cols = list(zip(*out)) or [[], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.float64()) for c in cols]], ["doc_id", "coherence", "stuffed_share"])

    parts = ceil(pages.count() / TASK_PAGES)
    full = pages.repartition(max(parts, 1), "doc_id").join(per, "doc_id", "left").select("doc_id", "tokens", *sides)
    return full.mapInArrow(run, "doc_id BIGINT, coherence DOUBLE, stuffed_share DOUBLE")


def stuffed_pages(docs: DataFrame, share: float = STUFFED_SHARE) -> DataFrame:
    """doc_id of the pages with more stuffing than sentences."""
    return score_pages(docs).filter(F.col("stuffed_share") > share).select("doc_id").distinct()
