"""Byte-level BPE by backtracking, and decoding by an offset table.

A piece of text (what the tokenizer's word rule splits off) is encoded from left to right. The longest token that matches at a place is found by an
Aho-Corasick automaton over the vocabulary. It may follow the last token only if the two are compatible: undoing their merges from the latest on, no merge across
their border would have come first. Where it isn't, the next shorter token that is its prefix is tried, and where none is left, the last token is taken
back and its end is marked as a dead one, so no place is tried twice from the same end: time is linear in the piece. The tokens found are those that merging in order of rank gives.

Answers about pairs are kept in a bounded table, as are the ids of short pieces, so memory follows neither the corpus nor a text. Texts are worked on whole, a bounded run of pieces at a time.

Decoding: the bytes of all tokens lie in one pool, and a text's bytes are gathered by the ids' offsets into it.

The word rule is GPT-2's, by the regex library. Characters that it and the tokenizers library class differently (of newer Unicode versions) are found by asking both once a
character; a text with one of them is split by the library's rule. Special tokens are found in texts first, as the library does.

Defined results: null and empty texts have no ids; a null key passes through; texts of any length are encoded whole; repeated rows give repeated results; other columns are ignored, whatever
their names; an empty table gives no rows. Ids that no token has, and null ones, decode to nothing; bytes that aren't UTF-8 decode to replacement characters.
"""

from __future__ import annotations

import array
import gc
import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import arrow_map, free_name

#: Answers about pairs, and pieces with their ids, that a worker keeps (of pieces, as many again that were used before); full tables are emptied, which changes times but not ids.
TABLE_PAIRS = 300_000
TABLE_PIECES = 300_000
#: Characters of a piece that is kept; longer ones are encoded each time.
TABLE_LENGTH = 64
#: Characters of a text that are split at a time, from a border of pieces on.
SPLIT_CHARS = 1 << 20
#: Ids that are decoded at a time.
DECODE_IDS = 1 << 20

_WORDS = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: The same rule for texts of characters below U+0250, by the faster library.
_LATIN = re.compile("'(?:[stmd]|re|ve|ll)| ?{L}+| ?{N}+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+".replace("{L}+", "[{L}]+").replace("{N}+|", "[{N}]+|").replace("{L}", "A-Za-zªµºÀ-ÖØ-öø-ɏ").replace("{N}", "0-9²³¹¼-¾").replace("{S}", r"\t-\r \x85\xa0"))
#: Before a single space between words there is always a border.
_BORDER = regex.compile(r"(?<=\S) (?=\S)")


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for themselves, others are numbered from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class _Pieces(dict):
    """The ids of pieces as bytes, each made when it is first asked for. No piece is spelled as a special token is, so those stand in the same table.

    A full table becomes the old one, from which what is asked for again comes back; the old one before it goes.
    """

    def __init__(self, made: Callable[[str], bytes], special: dict[str, bytes]):
        super().__init__(special)
        self.made, self.special, self.old = made, special, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece) or self.made(piece)
        if len(piece) <= TABLE_LENGTH:
            if len(self) >= TABLE_PIECES:
                self.old = dict(self)
                self.clear()
                self.update(self.special)
            self[piece] = ids
        return ids


class ByteBpe:
    """The tables of one tokenizer file, and encoding and decoding by them. Bytes are held as characters U+0000 to U+00FF."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model["type"] != "BPE" or not plain:
            raise ValueError(f"{path} isn't a byte-level BPE tokenizer with the plain word rule")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} has special tokens that take what is around them")
        self.library = Tokenizer.from_file(path).pre_tokenizer
        letters = byte_letters()
        spelled = {i: "".join(chr(letters[c]) for c in token) for token, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        n = 1 + max([*spelled, *self.special.values()])
        self.texts = [spelled.get(i, "") for i in range(n)]
        self.sizes = [len(x) for x in self.texts]
        self.splits_special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

        self.rank, self.left, self.right, self.made = [-1] * n, list(range(n)), list(range(n)), {}
        self.wide = n.bit_length()
        ids = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        for r, (a, b) in enumerate(merges):
            made = ids[a + b]
            if self.rank[made] >= 0:
                raise ValueError(f"{path} makes {a + b!r} by two merges")
            self.rank[made], self.left[made], self.right[made] = r, ids[a], ids[b]
            self.made[ids[a] << self.wide | ids[b]] = r
        self.pairs: dict[int, int] = {}
        usable = [self.rank[i] < 0 and self.sizes[i] == 1 for i in range(n)]
        for a, b in merges:  # a token that its own letters don't merge to is never an answer
            made = ids[a + b]
            usable[made] = usable[ids[a]] and usable[ids[b]] and self._apart(ids[a], ids[b], self.rank[made])
        words = {self.texts[i]: i for i in range(n) if usable[i]}
        self.single = {text: i for text, i in words.items() if len(text) == 1}
        self.found = ahocorasick.Automaton()
        for text, i in words.items():
            if len(text) > 1:  # single bytes match anywhere
                self.found.add_word(text, (len(text) - 1, i))
        self.found.make_automaton()
        self.shorter = [-1] * n
        for text, i in words.items():
            self.shorter[i] = next((words[text[:k]] for k in range(len(text) - 1, 0, -1) if text[:k] in words), -1)

        special_text = {i: t.encode("utf-8") for t, i in self.special.items()}
        stored = [special_text.get(i) or self.texts[i].encode("latin-1") for i in range(n)]
        self.pool = np.frombuffer(b"".join(stored), np.uint8)
        self.lengths = np.fromiter(map(len, stored), np.int64, n)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.kind = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        self.code = "H" if n <= 1 << 16 else "I"
        self.decimals = [str(i) for i in range(n)]
        self.pieces = _Pieces(self._of_piece, {t: array.array(self.code, [i]).tobytes() for t, i in self.special.items()})
        self.agreed: dict[str, bool] = {}

    def _apart(self, a: int, b: int, limit: int) -> bool:
        """Whether no merge of a rank below ``limit``, nor one that would come before a merge that made ``a`` or ``b``, crosses their border."""
        made, rank, wide = self.made, self.rank, self.wide
        while True:
            if made.get(a << wide | b, limit) < limit:
                return False
            if rank[a] > rank[b]:  # made last, so its right half stood here before; of equal merges the left one comes first
                limit, a = rank[a], self.right[a]
            elif rank[b] >= 0:
                limit, b = rank[b] + 1, self.left[b]
            else:
                return True

    def _learnt(self, last: int, token: int) -> int:
        """The longest prefix of ``token`` (itself first) that is a token and may follow ``last``, or -1: kept in the table of pairs."""
        if len(self.pairs) >= TABLE_PAIRS:
            self.pairs.clear()
        pair = last << self.wide | token
        while token >= 0 and last < len(self.rank) and not self._apart(last, token, len(self.rank)):
            token = self.shorter[token]
        self.pairs[pair] = token
        return token

    def tokens(self, piece: str) -> list[int]:
        """The tokens of one piece, given as bytes."""
        sizes, shorter, pairs, wide, n = self.sizes, self.shorter, self.pairs, self.wide, len(piece)
        longest = [0] * n
        for end, (back, token) in self.found.iter(piece):  # by their ends, so of those that begin at a place the longest comes last
            longest[end - back] = token
        none = len(self.rank)  # any token may follow it
        out, at, last, dead = [], 0, none, None
        while at < n:
            token = longest[at] or self.single[piece[at]]
            while True:
                found = pairs.get(last << wide | token)
                token = self._learnt(last, token) if found is None else found
                if token < 0 or dead is None or at + sizes[token] not in dead:
                    break
                token = shorter[token]
                if token < 0:
                    break
            if token >= 0:
                out.append(token)
                at += sizes[token]
                last = token
            else:  # nothing leads on from here after the last token, so that goes, and this is no end any more
                dead = dead or set()
                dead.add(at)
                at -= sizes[out.pop()]
                last = out[-1] if out else none
        return out

    def _of_piece(self, piece: str) -> bytes:
        return array.array(self.code, self.tokens(piece.encode("utf-8").decode("latin-1"))).tobytes()

    def _agree(self, char: str) -> bool:
        """Whether the word rule and the library class a character alike, beside letters, numbers, marks and itself."""
        if (known := self.agreed.get(char)) is None:
            probe = f"a{char}1{char}.{char}{char} x  "
            known = self.agreed[char] = [m.span() for m in _WORDS.finditer(probe)] == [at for _, at in self.library.pre_tokenize_str(probe)]
        return known

    def _split(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text, runs of them at a time."""
        words = _LATIN
        if not text.isascii():
            used = set(text)
            if not all(map(self._agree, used)):
                yield [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
                return
            words = _LATIN if max(used) < "\u0250" else _WORDS
        at = 0
        while at < len(text):
            cut = _BORDER.search(text, at + SPLIT_CHARS) if len(text) > at + SPLIT_CHARS else None
            end = cut.start() if cut else len(text)
            yield words.findall(text[at:end] if at or cut else text)
            at = end

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a whole text."""
        out = []
        parts = self.splits_special.split(text) if text and self.splits_special and any(t in text for t in self.special) else [text or ""]
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.pieces[part])
            else:
                for pieces in self._split(part):
                    out += map(self.pieces.__getitem__, pieces)
        return np.frombuffer(b"".join(out), self.kind)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lengths)):
            ids = ids[(ids >= 0) & (ids < len(self.lengths))]
        out = []
        for lo in range(0, len(ids), DECODE_IDS):
            some = ids[lo : lo + DECODE_IDS]
            lengths = self.lengths[some]
            ends = np.cumsum(lengths)
            out.append(self.pool[np.arange(ends[-1]) + np.repeat(self.starts[some] - ends + lengths, lengths)].tobytes())
        return b"".join(out).decode("utf-8", "replace")


_open: dict[str, ByteBpe] = {}


def byte_bpe(path: str) -> ByteBpe:
    """The worker's tables for the file at ``path``."""
    if path not in _open:
        _open[path] = ByteBpe(path)
        gc.collect()
        gc.freeze()  # the tables stay, so looking for garbage among them is in vain, and there is little of it
        gc.set_threshold(50_000, 20, 100)
    return _open[path]


def encoded(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``ids``, those of its whole text."""

    def rows(cols: dict[str, list]) -> dict[str, object]:
        bpe = byte_bpe(path)
        return {"k_": cols["k_"], "ids": [bpe.encode(t) for t in cols["t_"]]}

    kind = docs.schema[key].dataType.simpleString()
    out = arrow_map(docs.select(F.col(key).alias("k_"), F.col(text).alias("t_")), rows, f"k_ {kind}, ids array<int>", weigh="t_")
    return out.withColumnRenamed("k_", key)


def decoded(coded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids", text: str = "text") -> DataFrame:
    """``key``, ``ids`` and ``text``, what the ids say."""

    def rows(cols: dict[str, list]) -> dict[str, object]:
        bpe = byte_bpe(path)
        each = (np.fromiter((-1 if i is None else i for i in x or ()), np.int64, len(x or ())) for x in cols["ids"])
        return {"k_": cols["k_"], "ids": cols["ids"], "text": [bpe.decode(x) for x in each]}

    kind = coded.schema[key].dataType.simpleString()
    out = arrow_map(coded.select(F.col(key).alias("k_"), F.col(ids).alias("ids")), rows, f"k_ {kind}, ids array<int>, text string")
    return out.select(F.col("k_").alias(key), F.col("ids").alias(free_name("ids", [key])), F.col("text").alias(free_name(text, [key, "ids"])))


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_tokens``, ``ids_sha256`` (of the ids as decimals joined by commas) and ``decoded_sha256`` (of the decoded text in UTF-8); ids don't leave the worker that makes them."""

    def rows(cols: dict[str, list]) -> dict[str, object]:
        bpe, counts, ids_sha, text_sha = byte_bpe(path), [], [], []
        for t in cols["t_"]:
            ids = bpe.encode(t)
            counts.append(len(ids))
            ids_sha.append(hashlib.sha256(",".join(map(bpe.decimals.__getitem__, ids.tolist())).encode()).hexdigest())
            text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
        return {"k_": cols["k_"], "n_tokens": counts, "ids_sha256": ids_sha, "decoded_sha256": text_sha}

    kind = docs.schema[key].dataType.simpleString()
    out = arrow_map(docs.select(F.col(key).alias("k_"), F.col(text).alias("t_")), rows, f"k_ {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", weigh="t_")
    return out.withColumnRenamed("k_", key)
