"""Token counts of every prefix by dynamic programming.

In byte-pair encoding the last token of a prefix decides everything before it: the encoding of a
prefix is the encoding of the prefix without that token, and the token. A candidate is the last token
exactly if it and the last token before it, put together, encode to these two. So one pass over a text
gives the exact count at each of its prefixes; the counts are stored as one signed byte a code point (the
change of the count), and truncation or budget questions are sums over these bytes, without encoding again.

Pieces of the model never join over the start of a word, so the pass runs once for each distinct word of a
worker, and texts are put together from a table. Free style (Arrow map), narrow: a row at a time, so neither
skew nor repeated rows matter.

Defined results: null text counts as empty; empty text has 0 tokens and no bytes; a null key passes through; rows that repeat a document are
counted each; a very long text is one row of linear work, in a worker's memory with one byte a code point; an empty table gives no rows; columns other than
key and text are left out, whatever their names.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from operator import sub

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import runs, ship

SPACE = "▁"
#: Distinct words, and pairs of neighbouring tokens, kept a worker; a full table is emptied.
TABLE_WORDS = 800_000
#: Code points of a word that the table keeps; longer words are counted each time, so the table's bytes are bounded too.
TABLE_LENGTH = 64
TABLE_PAIRS = 1_000_000
_RUN = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+")


class PrefixCounts:
    """Counts tokens as the sentencepiece BPE model at ``path`` does."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score: dict[str, float] = {}
        for i in range(model.vocab_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
                self.score[model.id_to_piece(i)] = model.get_score(i)
        self.begun = {p[:k] for p in self.score for k in range(1, len(p) + 1)}
        self.by_word = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.score)
        self.by_line = not any("\n" in p and len(p) > 1 for p in self.score)
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0
        self.table: dict[str, bytes] = {}
        for probe in ("", " ", "a", "  a b ", "aaaa bbb\n\tcafé\n", "中文 🙂🙂"):
            if self.counts(probe)[-1:].sum() != len(model.encode(probe)):
                raise ValueError(f"{path} isn't a BPE model with byte fallback and an added first space")

    def bpe(self, text: str) -> list[str]:
        """The tokens of a short ``text``: the best-scored neighbours join first, the left ones of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def joins(self, last: str, token: str) -> bool:
        """Whether ``token`` stays apart after ``last`` (empty: at the start) and stays whole itself."""
        if self.n_pairs >= TABLE_PAIRS:
            self.pairs.clear()
            self.n_pairs = 0
        known = self.pairs.setdefault(last, {})[token] = self.bpe(last + token) == ([last, token] if last else [token])
        self.n_pairs += 1
        return known

    def deltas(self, word: str) -> bytes:
        """By code point of ``word``, the change of its prefix's token count, as signed bytes."""
        n, score, begun = len(word), self.score, self.begun
        last: list = [None] * (n + 1)
        count = [0] * (n + 1)
        last[0] = ""
        for i in range(n):
            before, row, more = last[i], self.pairs.get(last[i], {}), count[i] + 1
            j, token = i + 1, word[i]
            if token not in score:  # spelled in bytes, joins with nothing
                last[j], count[j] = token, count[i] + len(token.encode())
                if token not in begun:
                    continue
            while True:
                if last[j] is None and token in score:
                    known = row.get(token)
                    if known is None:
                        known = self.joins(before, token)
                        row = self.pairs[before]
                    if known:
                        last[j], count[j] = token, more
                j += 1
                if j > n or (token := word[i:j]) not in begun:
                    break
        return array("b", map(sub, count[1:], count)).tobytes()  # raises where a change is no signed byte

    def _words(self, words: list[str]) -> list[bytes]:
        if len(self.table) > TABLE_WORDS:
            self.table.clear()
        got = list(map(self.table.get, words))
        for i, d in enumerate(got):
            if d is None:
                got[i] = self.deltas(words[i])
                if len(words[i]) <= TABLE_LENGTH:
                    self.table[words[i]] = got[i]
        return got

    def _cut(self, text: str) -> list[str]:
        """The words of ``text`` that encode on their own, with the added first space."""
        whole = SPACE + text.replace(" ", SPACE)
        return _RUN.findall(whole) if self.by_word and self.by_line else [whole]

    def counts(self, text: str) -> np.ndarray:
        """The token count of each non-empty prefix of ``text``."""
        changes, _ = self.changes(pa.array([text]))
        return np.cumsum(changes, dtype=np.int64)

    def changes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Changes of the count by code point of all ``texts`` in turn (signed bytes), and the n + 1 places where texts begin."""
        texts = pc.fill_null(texts, "")
        n = len(texts)
        if not n:
            return np.empty(0, np.int8), np.zeros(1, np.int64)
        # Words without runs of spaces come from Arrow's kernels; the others are cut one text at a time.
        odd = pc.or_(pc.match_substring_regex(texts, f"^ |  |{SPACE}"), pa.scalar(not (self.by_word and self.by_line)))
        marked = pc.binary_join_element_wise(SPACE, pc.replace_substring(texts, " ", " " + SPACE), "")
        lists = pc.split_pattern(pc.replace_substring(marked, "\n", " \n "), " ")
        if pc.any(odd).as_py():
            cut = lists.to_pylist()
            for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
                cut[i] = self._cut(texts[i].as_py())
            lists = pa.array(cut, pa.list_(pa.string()))
        coded = lists.flatten().dictionary_encode()
        words = self._words(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        codes = coded.indices.to_numpy(zero_copy_only=False)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts, lens = np.cumsum(sizes) - sizes, sizes[codes]
        ends = np.concatenate(([0], np.cumsum(lens)))
        flat = np.frombuffer(b"".join(words), np.int8)[np.arange(ends[-1]) + np.repeat(starts[codes] - ends[:-1], lens)]
        places = lists.offsets.to_numpy()
        begin = ends[places - places[0]]
        # The added first space is no code point of the text: its change goes to the next, or nowhere.
        full = np.diff(begin) > 1
        moved = flat[begin[:-1][full] + 1].astype(np.int16) + flat[begin[:-1][full]]
        if len(moved) and np.abs(moved).max() > 127:
            raise OverflowError("a count changes by more than a signed byte holds")
        flat[begin[:-1][full] + 1] = moved
        return np.delete(flat, begin[:-1]), begin - np.arange(n + 1)


_open: dict[str, PrefixCounts] = {}


def prefix_counter(path: str) -> PrefixCounts:
    if path not in _open:
        _open[path] = PrefixCounts(path)
    return _open[path]


def prefix_table(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_bytes`` of UTF-8, ``n_tokens``, and ``prefix_deltas``: a signed byte a code point whose running sums are the token counts of the text's prefixes."""
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(model)
        for batch in batches:
            for part in runs(batch, text):
                changes, begin = counter.changes(part.column(text))
                sums = np.concatenate(([0], np.cumsum(changes, dtype=np.int64)))
                stored = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(begin.astype(np.int32)), pa.py_buffer(changes)])
                sizes = pc.fill_null(pc.binary_length(part.column(text)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(key), sizes, pa.array(np.diff(sums[begin])), stored], names=[key, "n_bytes", "n_tokens", "prefix_deltas"])

    return docs.select(key, text).mapInArrow(rows, f"`{key}` {kind}, n_bytes long, n_tokens long, prefix_deltas binary")


def with_limit(counted: DataFrame, limit: int) -> DataFrame:
    """``over_limit`` beside the counts."""
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def prefixes_within(counted: DataFrame, budgets: list[int], key: str = "doc_id") -> DataFrame:
    """For each row and budget, ``keep``: the code points of the longest prefix of at most that many tokens. Answered from the stored table alone."""
    ship(counted.sparkSession)
    kind = counted.schema[key].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = np.cumsum(np.frombuffer(raw, np.int8), dtype=np.int64)
                for b in budgets:
                    fits = np.flatnonzero(counts <= b)
                    for col, v in zip(out, (k, b, int(fits[-1]) + 1 if len(fits) else 0), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field(0).type), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], names=[key, "budget", "keep"])

    return counted.select(key, "prefix_deltas").mapInArrow(rows, f"`{key}` {kind}, budget long, keep long")
