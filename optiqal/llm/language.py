"""Language ID by cross-parsing: which language's reference text needs the fewest phrases to spell out a document.

A suffix automaton of each language's reference text knows all of that text's substrings. A document is cut greedily into
the longest phrases that occur in it (the cross-parsing of Ziv and Merhav, 1993); phrases * log2(reference length) over the
document's length estimates the cross entropy, and the language with the least wins.

The reference texts are a bounded sample of labelled rows: at most REF_DOCS rows per language, taken in hash order until
REF_CHARS characters are reached, of a long text its middle. The rows of an automaton's transitions are laid over one another,
so letters of any script have symbols of their own and a table grows with its text alone. A task parses many texts in lockstep: blocks of a text
are parsed side by side, and what a block's predecessor leaves open is then carried on into it until both parses agree.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from optiqal.llm._shared import annotate, text_bytes

#: Bounds of the reference sample: rows and characters per language, characters taken of one text, and characters in all
#: (where labels are so many that it counts, each has an equal share of it).
REF_DOCS, REF_CHARS, REF_PIECE, REF_TOTAL = 400, 60_000, 4_000, 4_000_000
#: Characters of a text that are parsed side by side with its others.
BLOCK = 2048

FOUND = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
UNKNOWN = "und"


def sample(labelled: DataFrame, text_col: str, lang_col: str, key_col: str) -> list[tuple[str, str]]:
    """(language, reference text), within the bounds; the rows are chosen by a hash of key and text."""
    x = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(key_col).cast("string").alias("key"))
    x = x.where("lang is not null and length(text) > 0")
    counts = {r["lang"]: r["n"] for r in x.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # as many rows as the model has tables
    if not counts:
        return []
    chars = min(REF_CHARS, max(1, REF_TOTAL // len(counts)))
    # Twice the rows that are wanted, in expectation, so that the ranking never sees a whole language.
    rate = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, 2.0 * REF_DOCS / n))])
    h = F.xxhash64("key", "text")
    few = x.where(F.pmod(h, F.lit(1 << 20)) < rate[F.col("lang")] * (1 << 20))
    few = few.select("lang", "key", h.alias("h"), F.expr(f"substring(text, greatest(1, 1 + int((length(text) - {REF_PIECE}) / 2)), {REF_PIECE})").alias("text"))
    order = W.partitionBy("lang").orderBy("h", "key", "text")
    few = few.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= REF_DOCS)
    few = few.withColumn("before", F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).where(F.col("before") < chars)
    rows = few.groupBy("lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda r: r["text"]), "\n").alias("text")).orderBy("lang").collect()
    return [(r["lang"], r["text"][:chars]) for r in rows]


def automaton(codes: list[int]) -> list[dict[int, int]]:
    """The transitions of each state of the suffix automaton of a text of symbols; state 0 is the start."""
    edges, link, size, last = [{}], [-1], [0], 0
    for c in codes:
        p, cur = last, len(edges)
        edges.append({}), link.append(0), size.append(size[p] + 1)
        while p >= 0 and c not in edges[p]:
            edges[p][c] = cur
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if size[q] == size[p] + 1:
                link[cur] = q
            else:
                clone = len(edges)
                edges.append(dict(edges[q])), link.append(link[q]), size.append(size[p] + 1)
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return edges


def packed(edges: list[dict[int, int]], symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """(base, rows) of an automaton, the rows of its states laid over one another where they are empty: rows[base[state] + symbol]
    holds the state that the entry belongs to (in the upper half; -1 if none) and the next state.
    """
    total = sum(map(len, edges))
    free = np.ones(2 * total + 3 * symbols + 64, bool)
    free[:symbols] = False  # so that no base is negative
    base, low = np.zeros(len(edges), np.int64), symbols
    single = [s for s, e in enumerate(edges) if len(e) == 1]
    for s in sorted((s for s, e in enumerate(edges) if len(e) > 1), key=lambda s: (-len(edges[s]), s)):
        own = np.array(sorted(edges[s]))
        while True:  # the next place at which all entries of the row are free; states of one transition fill what stays
            if low + 64 + symbols > len(free):
                free = np.concatenate([free, np.ones(len(free), bool)])
            found = low + np.flatnonzero(free[low : low + 64])
            fits = found[free[(found - own[0])[:, None] + own].all(1)]
            if len(fits):
                low = int(fits[0])
                break
            low += 64
        base[s] = low - own[0]
        free[base[s] + own] = False
    base[single] = np.flatnonzero(free)[: len(single)] - [next(iter(edges[s])) for s in single]
    rows = np.full(int(base.max(initial=0)) + symbols, -1, np.int64)
    state = np.repeat(np.arange(len(edges)), [len(e) for e in edges])
    symbol, to = (np.fromiter((x for e in edges for x in of(e)), np.int64, total) for of in (dict.keys, dict.values))
    rows[base[state] + symbol] = (state << 32) | to
    return base, rows


class Model:
    """Symbols of letters, and the transitions of each language's reference."""

    def __init__(self, references: list[tuple[str, str]]):
        self.langs = [lang for lang, _ in references]
        texts = [t.lower() for _, t in references]
        letters = sorted({c for t in texts for c in t if c.isalpha()})
        self.symbol = {c: i + 2 for i, c in enumerate(letters)}  # 0: a letter that no reference has; 1: anything that is no letter
        self.width = len(letters) + 2
        # all automata in one: states and rows are numbered on from one language to the next
        roots, bases, rows, starts = [], [], [], []
        states = places = 0
        for t in texts:
            edges = automaton(self.codes(t))
            base, own = packed(edges, self.width)
            first = np.zeros(self.width, np.int64)  # the start itself, where a symbol does not occur
            first[list(edges[0])] = list(edges[0].values())
            roots.append(states), bases.append(base + places), starts.append(first + states)
            rows.append(np.where(own < 0, own, own + (states << 32) + states))
            states, places = states + len(edges), places + len(own)
        self.roots, self.base, self.rows, self.start = (np.concatenate([np.zeros(0, np.int64), *x]) for x in ([np.array(roots, np.int64)], bases, rows, starts))
        self.bits = [float(np.log2(max(2, len(t)))) for t in texts]
        self.symbols = None  # made in each worker, once

    def step(self, state: np.ndarray, symbol: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next state, whether a new phrase begins with the symbol)."""
        entry = self.rows[self.base[state] + symbol]
        new = (entry >> 32) != state
        return np.where(new, self.start[lang * self.width + symbol], entry & 0xFFFFFFFF), new | (state == self.roots[lang])

    def codes(self, text: str) -> list[int]:
        """Symbols of a text in lower case; one for a run of characters that are no letters."""
        codes = [self.symbol.get(c, 0) if c.isalpha() else 1 for c in text]
        return [c for i, c in enumerate(codes) if c != 1 or i == 0 or codes[i - 1] != 1]


@cache
def _cases() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: whether it is a letter, and the first one of its lower case."""
    every = [chr(c) for c in range(0x110000)]
    return np.array([c.isalpha() for c in every]), np.array([ord(c.lower()[0]) for c in every])


def _symbols(model: Model) -> np.ndarray:
    """The symbol of each code point, with the highest bit set for letters."""
    letter, low = _cases()
    own = np.zeros(0x110000, np.uint32)
    own[[ord(c) for c in model.symbol]] = list(model.symbol.values())
    return np.where(letter, own[low] | np.uint32(0x80000000), np.uint32(1)).astype(np.uint32)


def phrases(m: Model, code: np.ndarray, begin: np.ndarray, left: np.ndarray, goes_on: np.ndarray) -> np.ndarray:
    """How many phrases begin in each block, by language: the blocks of a text follow one another, and goes_on tells those that are not its first.

    All blocks are parsed as if a phrase began with each. Then each is parsed again from where its predecessor really ended,
    until a phrase begins at the same place in both parses: from there on they agree. Where that changes a block's end, the next
    one is done again.
    """
    lang = np.repeat(np.arange(len(m.langs)), len(begin))
    begin, left, goes_on = (np.tile(x, len(m.langs)) for x in (begin, left, goes_on))
    n = len(begin)
    order = np.argsort(-left, kind="stable")  # the longest first: those that have ended are a tail
    rank = np.argsort(order)
    starts = np.zeros((int(left.max(initial=0)), n), bool)  # where a phrase begins in the first parse, in that order
    live = np.searchsorted(-left[order], -np.arange(1, len(starts) + 1), side="right")
    state, first, own_lang = m.roots[lang[order]], begin[order], lang[order]
    for j, k in enumerate(live.tolist()):
        state[:k], starts[j, :k] = m.step(state[:k], code[first[:k] + j], own_lang[:k])
    end, count = state[rank], starts.sum(0)[rank]
    fresh, fresh_end = count.copy(), end.copy()
    dirty = np.flatnonzero(goes_on)
    while len(dirty):
        own, state, more, less, j, changed = dirty, end[dirty - 1], np.zeros(n, np.int64), np.zeros(n, np.int64), 0, []
        while len(own):
            done = left[own] <= j
            if done.any():  # the parses never met
                whole = own[done]
                changed.append(whole[end[whole] != state[done]])
                end[whole], count[whole] = state[done], more[whole]
                own, state = own[~done], state[~done]
                continue
            state, new = m.step(state, code[begin[own] + j], lang[own])
            old = starts[j, rank[own]]
            met = new & old
            if met.any():
                same = own[met]
                count[same] = more[same] + fresh[same] - less[same]
                changed.append(same[end[same] != fresh_end[same]])
                end[same] = fresh_end[same]
            more[own] += new
            less[own] += old
            own, state, j = own[~met], state[~met], j + 1
        after = np.concatenate(changed) + 1
        after = after[after < n]
        dirty = np.sort(after[goes_on[after]])
    return count.reshape(len(m.langs), -1)


class _Parse:
    """Called in the tasks with the texts of some documents."""

    def __init__(self, model):
        self.model = model  # a broadcast

    def __call__(self, text: pa.Array) -> list:
        m: Model = self.model.value
        if m.symbols is None:
            m.symbols = _symbols(m)
        data, off = text_bytes(text)
        n_docs = len(off) - 1
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        at = heads[off]  # where each text begins, in characters
        code = m.symbols[points]
        letters = np.concatenate([[0], np.cumsum(code >= 0x80000000)])
        has = letters[at[1:]] > letters[at[:-1]]
        code = (code & 0x7FFFFFFF).astype(np.int32)
        keep = np.ones(len(code), bool)  # one separator for a run of characters that are no letters
        keep[1:] = (code[1:] != 1) | (code[:-1] != 1)
        keep[at[:-1][at[:-1] < len(code)]] = True
        kept = np.concatenate([[0], np.cumsum(keep)])
        code, at = code[keep], kept[at]
        size = np.diff(at)
        blocks = -(-size // BLOCK)
        doc = np.repeat(np.arange(n_docs), blocks)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = at[doc] + nth * BLOCK
        left = np.minimum(at[doc + 1] - begin, BLOCK)
        total = np.stack([np.bincount(doc, x, n_docs) for x in phrases(m, code, begin, left, nth > 0)]) if m.langs else np.zeros((1, n_docs))
        cost = total * np.array(m.bits or [1.0])[:, None] / np.maximum(size, 1)
        best = cost.argmin(0)
        ranked = np.sort(cost, 0)
        margin = 1 - ranked[0] / np.maximum(ranked[1], 1e-9) if len(ranked) > 1 else np.ones(n_docs)
        known = has & bool(m.langs)
        return [pa.array([m.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], pa.string()), np.where(known, np.clip(margin, 0, 1), 0.0)]


def identify(docs: DataFrame, labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id") -> DataFrame:
    """`row`, the row of docs, and `found`: lang_pred, a language of labelled, and score, by what share the second best costs more.

    Null text, text without a letter, or no labelled rows: lang_pred is "und" and score 0. Languages that tie: the first by
    name, with score 0. A row's own language, source and key have no part in its prediction. Repeated rows agree.
    """
    model = Model(sample(labelled, text_col, lang_col, key_col))
    return annotate(docs, text_col, FOUND, _Parse(docs.sparkSession.sparkContext.broadcast(model)))


def held_out(key: Column, of: int = 4, at: int = 2) -> Column:
    """Rows that nothing is learned from: crc32 of the key as text, modulo `of`, is `at`. A null key is never held out."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(of)) == at, F.lit(False))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    key = F.col(f"row.{id_col}")
    return found.select(key.alias("doc_id"), held_out(key).alias("held_out"), F.col("found.lang_pred").alias("lang_pred"), F.col("found.score").alias("score"))
