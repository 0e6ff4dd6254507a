"""Token ids by the tokenizers library, a word at a time.

Where a tokenizer drops white space and never joins over it, a text's ids are those of its words in
turn, so each distinct word is encoded once a worker and texts are put together from a table. Other
tokenizers encode whole texts. Equality with the library on whole texts is tested.

Defined results: a null text is an empty one, and has no ids; a text of any length is encoded whole; texts that repeat give the same ids; no texts give no ids and one place.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words kept a worker; a full table is emptied, which changes times but not ids.
TABLE_WORDS = 300_000
#: Code points of a word that the table keeps; longer words are encoded each time, so the table's bytes are bounded too.
TABLE_LENGTH = 64
#: New words encoded at a time.
LEARN_WORDS = 50_000

# Letters whose lower case and normal form are plain, then marks that the word rule always splits off.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:|*#$%&]*)")


def splits_on_white_space(spec: dict) -> bool:
    """Whether ids of a text are those of its white-space separated words in turn."""
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in spec.get("added_tokens", ())):
        return False
    pre = spec.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    kept = first.get("pattern", {}).get("Regex", "")
    if not (first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and kept.endswith(r"[^\s\p{L}\p{N}]+")):
        return False
    return not spec.get("post_processor") and not spec.get("truncation") and not spec.get("padding")


class WordIds:
    """Encodes texts to little-endian ids of ``width`` bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.by_word = splits_on_white_space(spec)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        norm = json.dumps(spec.get("normalizer"))
        self.plain = "Lowercase" in norm and "NFC" in norm and "Prepend" not in norm
        vocab = self.tokenizer.get_vocab()
        self.kind = np.dtype("<u2" if self.width == 2 else "<u4")
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.table: dict[str, bytes] = {"": b""}
        self.parts: dict[str, bytes] = {"": b""}

    def _direct(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, parts: list[str]) -> list[bytes]:
        """Ids of plain parts, many to a call: each ends with its only word-end token."""
        out: list[bytes] = []
        for lo in range(0, len(parts), 500):
            some = parts[lo : lo + 500]
            ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, self.kind)
            stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(stops) != len(some):
                out += self._direct(some)
                continue
            raw, k = ids.tobytes(), self.width
            out += [raw[a * k : b * k] for a, b in zip([0, *stops], stops, strict=False)]
        return out

    def _learn(self, words: set[str]) -> None:
        """Encode ``words``: plain ones by their lower-case letters and the marks after them, which many words share."""
        table, known = self.table, self.parts
        if len(table) + len(words) > TABLE_WORDS:
            table.clear()
            table[""] = b""
        cut: dict[str, tuple[str, str]] = {}
        if self.plain:
            for w in words:
                if m := _PLAIN.fullmatch(w):
                    core, tail = m.groups()
                    cut[w] = core.lower(), tail
        need = {p for pair in cut.values() for p in pair}
        todo = [p for p in need if p not in known]
        if len(known) + len(todo) > TABLE_WORDS:
            known.clear()
            known[""] = b""
            todo = [p for p in need if p]
        known.update(zip(todo, self._joined(todo), strict=True))
        for w, (core, tail) in cut.items():
            table[w] = known[core] + known[tail]
        rest = [w for w in words if w not in cut]
        table.update(zip(rest, self._direct(rest), strict=True))

    def _word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct ``words`` one after the other, and how many each has."""
        out: list[bytes] = []
        for lo in range(0, len(words), LEARN_WORDS):
            some = words[lo : lo + LEARN_WORDS]
            got = list(map(self.table.get, some))
            if None in got:
                long = [i for i, w in enumerate(some) if len(w) > TABLE_LENGTH]
                missing = {w for w, g in zip(some, got, strict=True) if g is None and len(w) <= TABLE_LENGTH}
                if len(self.table) + len(missing) > TABLE_WORDS:  # the table will be emptied
                    missing.update(w for w in some if len(w) <= TABLE_LENGTH)
                self._learn(missing)
                got = list(map(self.table.get, some))
                for i, ids in zip(long, self._direct([some[i] for i in long]), strict=True):
                    got[i] = ids
            out += got
        sizes = np.fromiter(map(len, out), np.int64, len(out)) // self.width
        return np.frombuffer(b"".join(out), self.kind), sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``texts`` (null: empty) one after the other, and the n + 1 places where texts begin."""
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            each = self._direct(texts.to_pylist())
            ends = np.cumsum([0, *(len(e) // self.width for e in each)])
            return np.frombuffer(b"".join(each), self.kind), ends
        lists = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()), "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        words = pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary.cast(pa.string()))
        pool, sizes = self._word_ids(pc.binary_join(words, " ")[0].as_py().split(" ") if len(coded.dictionary) else [])
        starts, lens = np.cumsum(sizes) - sizes, sizes[codes]
        ends = np.concatenate(([0], np.cumsum(lens)))
        at = np.arange(ends[-1]) + np.repeat(starts[codes] - ends[:-1], lens)
        places = lists.offsets.to_numpy()
        return pool[at], ends[places - places[0]]


_open: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's encoder for the file at ``path``."""
    if path not in _open:
        _open[path] = WordIds(path)
    return _open[path]
